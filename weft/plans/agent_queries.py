"""Queries over events read as agent transcripts.

Each event becomes one recorded model reply (or agent event) by a fixed CASE
on ``event_type`` and ``k`` from ``props``; the same SQL text derives it in
Spark and in the DuckDB oracle.  The operators under test -- extraction,
policy, approvals, summaries -- are the package's own on the Spark side and
plain SQL on the oracle side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators.agent_log import (
    HARD_BLOCKED,
    classify_commands,
    command_decision,
    default_block_rules,
    event_line,
    with_tool_call,
    flag_allowed,
    match_approvals_in,
    session_summary,
    tool_payload,
)
from weft.operators.ops_tables import tail_per_key
from weft.operators.ordering import keyed_running_sum
from weft.plans.registry import query
from weft.plans.tables import table
from weft.session import scratch_dir
from weft.sources.files import read_rules

# A shared SQL expression (valid in Spark SQL and DuckDB) over event_type, k.
_Q = "chr(34)"   # double quote
_S = "chr(39)"   # single quote
_NL = "chr(10)"


def _call(cmd_sql: str) -> str:
    return (f"('<tool_call>{{' || {_Q} || 'name' || {_Q} || ':' || {_Q} || 'shell' || {_Q} || ',' || {_Q} "
            f"|| 'args' || {_Q} || ':{{' || {_Q} || 'cmd' || {_Q} || ':' || {_Q} || {cmd_sql} || {_Q} "
            f"|| '}}}}</tool_call>')")


REPLY_SQL = f"""CASE event_type
  WHEN 'view' THEN 'Looking at item ' || CAST(k AS STRING) || ', nothing to run.'
  WHEN 'click' THEN 'Listing it. ' || {_call("'ls -la /tmp/d' || CAST(k AS STRING)")}
  WHEN 'purchase' THEN CASE k % 4
      WHEN 0 THEN {_call("'rm -rf /'")}
      WHEN 1 THEN {_call("'cat /var/log/syslog | tail -n ' || CAST(k AS STRING)")}
      WHEN 2 THEN {_call("'dd if=/dev/zero of=/dev/sda bs=1M'")}
      ELSE {_call("'sudo reboot'")} END
  WHEN 'error' THEN CASE k % 3
      WHEN 0 THEN '<tool_call>{{' || {_S} || 'name' || {_S} || ':' || {_S} || 'shell' || {_S} || ',' || {_S} || 'args'
                  || {_S} || ':{{' || {_S} || 'cmd' || {_S} || ':' || {_S} || 'id' || {_S} || '}}}}</tool_call>'
      WHEN 1 THEN '<tool_call>{{' || {_Q} || 'name' || {_Q} || ':' || {_Q} || 'shell' || {_Q} || '}}</tool_call>'
      ELSE 'Sure.' || {_NL} || '<tool_call>' || {_NL} || '{{' || {_Q} || 'name' || {_Q} || ': ' || {_Q} || 'shell'
           || {_Q} || ',' || {_NL} || ' ' || {_Q} || 'args' || {_Q} || ': {{' || {_Q} || 'cmd' || {_Q} || ': '
           || {_Q} || 'echo {{' || CAST(k AS STRING) || '}}' || {_Q} || '}}}}' || {_NL} || '</tool_call> and more text'
      END
  ELSE CASE k % 5
      WHEN 0 THEN {_call("'mkfs.ext4 /dev/sdb1'")}
      WHEN 1 THEN {_call("'chmod -R 777 /'")}
      WHEN 2 THEN {_call("'echo hi > /dev/sda'")}
      WHEN 3 THEN {_call("'whoami'")} || ' then ' || {_call("'rm -rf /'")}
      ELSE {_call("':(){{ :|:& }};:'")} END
END"""

KIND_SQL = """CASE event_type WHEN 'view' THEN 'model' WHEN 'click' THEN 'tool_call'
  WHEN 'purchase' THEN 'tool_result' WHEN 'error' THEN 'error' ELSE 'blocked' END"""

# Fixed parameters of the registered policy query.
ALLOW_PATTERNS = [r"^ls\b", r"^cat\s", r"^echo\b"]
MODE = "allow"
APPROVAL_TIMEOUT_S = 86400
TAIL_N = 50


def agent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return (ev.withColumn("k", F.get_json_object("props", "$.k").cast("int"))
            .withColumn("reply", F.expr(REPLY_SQL))
            .withColumn("kind", F.expr(KIND_SQL)))


_EV_SQL = f"""
WITH e AS (SELECT event_id, ts, user_id, event_type, value,
                  CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
r AS (SELECT *, {REPLY_SQL} AS reply, {KIND_SQL} AS kind FROM e),
c AS (SELECT *, regexp_extract(reply, '(?s)<tool_call>\\s*(\\{{.*?\\}})\\s*</tool_call>', 1) AS payload FROM r),
p AS (SELECT *, CASE WHEN payload = '' THEN 'none'
                     WHEN json_valid(payload) AND json_extract_string(payload, '$.args.cmd') IS NOT NULL THEN 'ok'
                     ELSE 'malformed' END AS call_status FROM c),
x AS (SELECT *, CASE WHEN call_status = 'ok' THEN json_extract_string(payload, '$.args.cmd') END AS cmd FROM p)
"""


@query("tool_calls", "P8", sql=_EV_SQL + "SELECT event_id, call_status, cmd FROM x")
def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = with_tool_call(agent_events(spark, sf_dir), "reply")
    return ev.select("event_id", "call_status", "cmd")


def _block_case_sql(col: str) -> str:
    whens = " ".join(f"WHEN regexp_matches({col}, '{p}') THEN {i + 1}" for i, p in enumerate(HARD_BLOCKED))
    return f"CASE {whens} END"


def _allow_sql(col: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({col}, '{p}')" for p in ALLOW_PATTERNS) + ")"


@query("command_policy", "F3 F4 J1 J2 P10 SRC7", sql=_EV_SQL + f""",
pol AS (SELECT event_id, cmd, CAST({_block_case_sql('cmd')} AS INTEGER) AS block_rule,
               CASE WHEN cmd IS NOT NULL THEN {_allow_sql('cmd')} END AS allowed FROM x)
SELECT event_id, cmd, block_rule, allowed,
       CASE WHEN cmd IS NULL THEN NULL WHEN block_rule IS NOT NULL THEN 'blocked' WHEN allowed THEN 'auto_run'
            ELSE 'needs_approval' END AS decision,
       CASE WHEN cmd IS NULL THEN NULL WHEN block_rule IS NOT NULL THEN 'blocked' ELSE 'skipped' END AS decision_dry_run
FROM pol
""")
def command_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Every event keeps its row; replies without a usable call get nulls.
    calls = with_tool_call(agent_events(spark, sf_dir), "reply").select("event_id", "cmd")
    rules = spark.createDataFrame(default_block_rules(), "rule_id INT, pattern STRING")
    # The allow list goes through a rule file (comments, blank lines) and SRC7.
    path = scratch_dir(spark, "allow")
    text = ["# allow list", ""] + [f"  {p}  " for p in ALLOW_PATTERNS]
    spark.createDataFrame([(t,) for t in text], "value STRING").coalesce(1).write.text(path)
    allow = read_rules(spark, path)
    out = flag_allowed(classify_commands(calls, "cmd", rules), "cmd", allow)
    has = F.col("cmd").isNotNull()
    return out.select("event_id", "cmd", F.col("block_rule").cast("int").alias("block_rule"),
                      F.when(has, F.col("allowed")).alias("allowed"),
                      F.when(has, command_decision("block_rule", "allowed", MODE)).alias("decision"),
                      F.when(has, command_decision("block_rule", "allowed", "dry-run"))
                      .alias("decision_dry_run"))


@query("tool_payloads", "P9", sql="""
WITH t AS (SELECT doc_id,
                  CASE WHEN doc_id % 7 = 0 THEN '' ELSE text END AS so,
                  CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 3 = 0 THEN text ELSE '' END AS se,
                  CAST(doc_id % 5 AS INTEGER) AS rc FROM documents),
b AS (SELECT doc_id, rc, substring(substring(so, 1, 16384) ||
         CASE WHEN substring(se, 1, 16384) <> '' THEN chr(10) || '[stderr]' || chr(10) || substring(se, 1, 16384) ELSE '' END,
         1, 8000) AS body FROM t)
SELECT doc_id, CASE WHEN body <> '' THEN body ELSE '[exit ' || CAST(rc AS VARCHAR) || ']' END AS payload FROM b
""")
def tool_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    seven = F.pmod("doc_id", F.lit(7)) == 0
    so = F.when(seven, F.lit("")).otherwise(F.col("text"))
    se = F.when(seven, F.lit("")).when(F.pmod("doc_id", F.lit(3)) == 0, F.col("text")).otherwise(F.lit(""))
    rc = F.pmod("doc_id", F.lit(5)).cast("int")
    return d.select("doc_id", tool_payload(so, se, rc).alias("payload"))


@query("approvals", "J3", sql=f"""
WITH e AS (SELECT event_id, ts, user_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
p AS (SELECT * FROM e WHERE event_type = 'purchase'),
c AS (SELECT * FROM e WHERE event_type = 'click'),
j AS (SELECT p.event_id, p.user_id, p.ts, c.event_id AS decision_id, c.ts AS decided_at, (c.k % 2 = 0) AS d,
             row_number() OVER (PARTITION BY p.event_id ORDER BY c.ts, c.event_id) AS rn
      FROM p LEFT JOIN c ON c.user_id = p.user_id AND c.ts >= p.ts
                        AND c.ts <= p.ts + INTERVAL {APPROVAL_TIMEOUT_S} SECOND)
SELECT event_id, user_id, ts, decision_id, decided_at, coalesce(d, false) AS approved,
       CASE WHEN decision_id IS NULL THEN 'timed_out' WHEN d THEN 'approved' ELSE 'rejected' END AS outcome
FROM j WHERE rn = 1
""")
def approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Calls (purchase) and decisions (click) are rows of one table: one scan.
    ev = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return match_approvals_in(ev, F.col("event_type") == "purchase", F.col("event_type") == "click",
                              F.pmod(k, F.lit(2)) == 0, key="user_id",
                              call_cols=["event_id", "user_id", "ts"], timeout_s=APPROVAL_TIMEOUT_S)


def _agent_event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = with_tool_call(agent_events(spark, sf_dir), "reply")
    return ev.select(
        "event_id", "ts", F.col("user_id").alias("session_id"), "kind", "k",
        F.when(F.col("kind").isin("model", "error", "blocked"), F.col("reply")).alias("text"),
        "cmd",
        F.when(F.col("kind") == "tool_result", F.concat(F.lit("out "), F.col("k").cast("string"))).alias("stdout"),
        F.when((F.col("kind") == "tool_result") & (F.pmod("k", F.lit(2)) == 1), F.lit("warn")).alias("stderr"),
        F.when(F.col("kind") == "tool_result", F.pmod("k", F.lit(3))).cast("int").alias("return_code"))


_AGENT_ROWS_SQL = _EV_SQL + """,
a AS (SELECT event_id, ts, user_id AS session_id, kind, k,
             CASE WHEN kind IN ('model', 'error', 'blocked') THEN reply END AS text, cmd,
             CASE WHEN kind = 'tool_result' THEN 'out ' || CAST(k AS VARCHAR) END AS stdout,
             CASE WHEN kind = 'tool_result' AND k % 2 = 1 THEN 'warn' END AS stderr,
             CAST(CASE WHEN kind = 'tool_result' THEN k % 3 END AS INTEGER) AS return_code FROM x)
"""


@query("event_lines", "P13 A4", sql=_AGENT_ROWS_SQL + """,
i AS (SELECT *, count(*) FILTER (WHERE kind = 'model') OVER (PARTITION BY session_id ORDER BY ts, event_id
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS iteration FROM a)
SELECT event_id, session_id, CAST(iteration AS BIGINT) AS iteration,
  CASE kind
    WHEN 'model' THEN '[model #' || CAST(iteration AS VARCHAR) || '] ' || coalesce(text, '')
    WHEN 'tool_call' THEN '[tool_call #' || CAST(iteration AS VARCHAR) || '] $ ' || coalesce(cmd, '')
    WHEN 'tool_result' THEN '[tool_result rc=' || coalesce(CAST(return_code AS VARCHAR), '') || ']' || chr(10)
         || coalesce(stdout, '') || CASE WHEN coalesce(stderr, '') <> '' THEN chr(10) || '[stderr]' || chr(10) || stderr ELSE '' END
    WHEN 'blocked' THEN '[BLOCKED] ' || coalesce(cmd, '') || ' (' || coalesce(text, '') || ')'
    WHEN 'error' THEN '[ERROR] ' || coalesce(text, '') END AS line
FROM i
""")
def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _agent_event_rows(spark, sf_dir)
    with_it = keyed_running_sum(rows, "session_id", F.to_date("ts"), [F.col("ts"), F.col("event_id")],
                                (F.col("kind") == "model").cast("int"), "iteration")
    return with_it.select("event_id", "session_id", F.col("iteration").cast("long").alias("iteration"),
                          event_line("kind", "text", "cmd", "stdout", "stderr", "return_code",
                                     "iteration").alias("line"))


@query("session_summary", "A4", sql=_AGENT_ROWS_SQL + """
SELECT session_id, CAST(count(*) AS BIGINT) AS n_events,
       CAST(count(*) FILTER (WHERE kind = 'model') AS BIGINT) AS iterations,
       CAST(count(*) FILTER (WHERE kind = 'tool_call') AS BIGINT) AS calls,
       CAST(count(*) FILTER (WHERE kind = 'blocked') AS BIGINT) AS blocked,
       CAST(count(*) FILTER (WHERE kind = 'skipped') AS BIGINT) AS skipped,
       CAST(count(*) FILTER (WHERE kind = 'tool_result' AND return_code = 0) AS BIGINT) AS results_ok,
       CAST(count(*) FILTER (WHERE kind = 'tool_result' AND return_code <> 0) AS BIGINT) AS results_failed,
       CAST(count(*) FILTER (WHERE kind = 'error') AS BIGINT) AS errors,
       arg_max(kind, (ts, event_id)) AS final_kind,
       count(*) FILTER (WHERE kind = 'model') >= 6 AS hit_max_iters
FROM a GROUP BY session_id
""")
def session_summary_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session_summary(_agent_event_rows(spark, sf_dir))
    return s.select("session_id", *[F.col(c).cast("long").alias(c) for c in (
        "n_events", "iterations", "calls", "blocked", "skipped", "results_ok", "results_failed",
        "errors")], "final_kind", "hit_max_iters")


@query("event_tail", "W1", sql=f"""
SELECT event_id, user_id, CAST(pos AS INTEGER) AS pos FROM (
  SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS pos
  FROM events) WHERE pos <= {TAIL_N}
""")
def event_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    out = tail_per_key(ev, "user_id", [F.col("ts").desc(), F.col("event_id").desc()], TAIL_N, "pos")
    return out.select("event_id", "user_id", F.col("pos").cast("int").alias("pos"))
