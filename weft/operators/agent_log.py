"""Agent-transcript analytics over *recorded* replies and events: tool-call
extraction (P8), tool payload (P9), command policy (P10, F3, F4, J1, J2),
approvals matched within a time-out (J3), display lines (P13) and session
summaries (A4).  Nothing is generated and no command is ever run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.functions.text import col_, is_ascii
from weft.operators.rules import NOT_WORD, java_pattern, read_rules
from weft.operators.substring_index import candidates
from weft.session import scratch_dir

# The tool-call tag pattern (dot matches newline; first call only).
TOOL_CALL_PATTERN = r"<tool_call>\s*(\{.*?\})\s*</tool_call>"
TOOL_CALL_RE = "(?sU)" + TOOL_CALL_PATTERN

# The always-blocked command patterns, in order (rule ids 1-7).
HARD_BLOCKED = [
    r"\brm\s+-[rRf]+[a-zA-Z]*\s+/(\s|$)",
    r"\bmkfs(\.|\s)",
    r"\bdd\s+.*\bof=/dev/",
    r":\s*\(\)\s*\{\s*:\s*\|\s*:\s*&\s*\}\s*;\s*:",
    r"\bshutdown\b|\breboot\b|\bhalt\b|\bpoweroff\b",
    r">\s*/dev/sd[a-z]\b",
    r"\bchmod\s+(-R\s+)?0?777\s+/(\s|$)",
]

# Java flags that give Python ``re`` semantics: (?d) only \n ends a line for
# ``.`` and ``$``; (?U) Unicode \s, \w and \b.  (?U) roughly doubles the
# cost of a match and changes nothing on ASCII input, so it is only used
# for rows that are not ASCII (see ``py_search``).
PY_RE_FLAGS = "(?dU)"
PY_RE_FLAGS_ASCII = "(?d)"

MODES = ("dry-run", "approve", "allow")
TOOL_OUTPUT_CHARS = 16384
TOOL_MESSAGE_CHARS = 8000
APPROVAL_TIMEOUT_S = 300

TOOL_CALL_SCHEMA = T.ArrayType(T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("args", T.StructType([T.StructField("cmd", T.StringType())])),
]))

# Rules of one CASE expression.
MAX_INLINE_RULES = 256


# ---------------------------------------------------------------- P8

def _tool_payload_text(t: Column) -> Column:
    return F.when(is_ascii(t), F.regexp_extract(t, "(?s)" + TOOL_CALL_PATTERN, 1)).otherwise(
        F.regexp_extract(t, TOOL_CALL_RE, 1))


def _parse_call(payload: Column) -> Column:
    return F.from_json(F.concat(F.lit("["), payload, F.lit("]")), TOOL_CALL_SCHEMA,
                       {"allowSingleQuotes": "false", "mode": "PERMISSIVE"})


def with_tool_call(df: DataFrame, text_col: str, status_col: str = "call_status",
                   cmd_col: str = "cmd") -> DataFrame:
    """Add ``call_status`` (``none``, ``malformed`` or ``ok``) and ``cmd``.
    Only the first call counts and ``name`` is not checked.

    Strict parse: the payload is parsed as a one-element JSON array with
    single quotes off, so trailing text, two objects or a raw newline inside a
    string are malformed (``from_json`` alone lets some through).  The steps
    are separate projections so the regex and the JSON parse run once per row.
    """
    d = df.withColumn("_tc_payload", _tool_payload_text(F.col(text_col)))
    d = d.withColumn("_tc_parsed", _parse_call(F.col("_tc_payload")))
    d = d.withColumn(cmd_col, F.when(F.size("_tc_parsed") == 1,
                                     F.col("_tc_parsed").getItem(0)["args"]["cmd"]))
    status = (F.when(F.col(text_col).isNull() | (F.col("_tc_payload") == ""), F.lit("none"))
              .when(F.col(cmd_col).isNull(), F.lit("malformed"))
              .otherwise(F.lit("ok")))
    return d.withColumn(status_col, status).drop("_tc_payload", "_tc_parsed")


def extract_tool_call(text) -> Column:
    """P8 as one expression: ``struct(call_status, cmd)``.  Prefer
    :func:`with_tool_call` on large inputs (it evaluates the parse once)."""
    t = col_(text)
    payload = _tool_payload_text(t)
    parsed = _parse_call(payload)
    cmd = F.when(F.size(parsed) == 1, parsed.getItem(0)["args"]["cmd"])
    status = (F.when(t.isNull() | (payload == ""), F.lit("none"))
              .when(cmd.isNull(), F.lit("malformed"))
              .otherwise(F.lit("ok")))
    return F.struct(status.alias("call_status"), cmd.alias("cmd"))


# ---------------------------------------------------------------- P9

def tool_payload(stdout, stderr, return_code) -> Column:
    """What goes back to the model after a command ran."""
    out = F.substring(F.coalesce(col_(stdout), F.lit("")), 1, TOOL_OUTPUT_CHARS)
    err = F.substring(F.coalesce(col_(stderr), F.lit("")), 1, TOOL_OUTPUT_CHARS)
    body = F.concat(out, F.when(err != "", F.concat(F.lit("\n[stderr]\n"), err)).otherwise(F.lit("")))
    cut = F.substring(body, 1, TOOL_MESSAGE_CHARS)
    return F.when(cut != "", cut).otherwise(
        F.concat(F.lit("[exit "), col_(return_code).cast("string"), F.lit("]")))


# ---------------------------------------------------------------- F3 / F4 / J1 / J2

def py_regex(pattern: str) -> str:
    return PY_RE_FLAGS + pattern


def py_search(c: Column, pattern: str) -> Column:
    """``re.search(pattern, c) is not None`` with Python's Unicode classes;
    ASCII rows take the cheaper non-Unicode matcher (same answer)."""
    return F.when(is_ascii(c), c.rlike(PY_RE_FLAGS_ASCII + pattern)).otherwise(
        c.rlike(PY_RE_FLAGS + pattern))


def first_match_rule(cmd, rules: list[tuple[int, str]]) -> Column:
    """F3 with a static rule list: id of the first pattern that *searches*
    true, null if none.  A CASE short-circuits like the loop's return."""
    c = col_(cmd)
    out = F.lit(None).cast("int")
    for rid, pat in reversed(list(rules)):
        out = F.when(py_search(c, pat), F.lit(rid)).otherwise(out)
    return out


def any_match(cmd, patterns: list[str]) -> Column:
    """F4 with a static list: does any pattern search true?  Empty -> false."""
    c = col_(cmd)
    if not patterns:
        return F.lit(False)
    e = F.lit(False)
    for p in patterns:
        e = e | F.coalesce(py_search(c, p), F.lit(False))
    return e


def default_block_rules() -> list[tuple[int, str]]:
    return [(i + 1, p) for i, p in enumerate(HARD_BLOCKED)]


def _few_rules(rules: DataFrame, id_col: str, pattern_col: str) -> list[tuple] | None:
    """Up to MAX_INLINE_RULES rules, first by id; None if there are more."""
    rows = (rules.select(id_col, pattern_col).where(F.col(pattern_col).isNotNull())
            .limit(MAX_INLINE_RULES + 1).collect())
    if len(rows) > MAX_INLINE_RULES:
        return None
    return [(r[0], java_pattern(str(r[1]))) for r in sorted(rows, key=lambda r: (r[0], str(r[1])))]


def classify_commands(df: DataFrame, cmd_col: str, rules: DataFrame, id_col: str = "rule_id",
                      pattern_col: str = "pattern", out_col: str = "block_rule") -> DataFrame:
    """First matching rule (lowest ``rule_id``) for every command; ``out_col`` has the
    type of ``id_col``.  Any number of rules.

    Up to MAX_INLINE_RULES rules are one CASE expression (no join, no shuffle).  More are
    looked up (same rows): each *distinct* command meets the rules whose rarest required
    word or gram it holds (:mod:`substring_index`) and is matched against those alone; rules without
    a required string are CASE expressions of MAX_INLINE_RULES rules over the distinct commands.
    Only those and the few go through the driver; the others are read in tasks."""
    kind = rules.schema[id_col].dataType
    few = _few_rules(rules, id_col, pattern_col)
    if few is not None:
        return df.withColumn(out_col, first_match_rule(cmd_col, few).cast(kind))
    cmds = df.select(F.col(cmd_col).alias("_cmd")).where("_cmd IS NOT NULL").distinct()
    hits = (_indexed_matches(cmds, read_rules(rules, id_col, pattern_col)).groupBy("_cmd").agg(F.min("_rid").alias("_rid"))
            .select("_cmd", F.col("_rid").cast(kind).alias(out_col)))
    return df.drop(out_col).join(hits, F.col(cmd_col) == F.col("_cmd"), "left").drop("_cmd")


def _indexed_matches(cmds: DataFrame, rules: DataFrame) -> DataFrame:
    """(_cmd, _rid) of matching rules (:func:`read_rules`), the first at least, of distinct commands."""
    spark = cmds.sparkSession
    folder = scratch_dir(spark, "rules")
    rules.write.parquet(folder)  # patterns are parsed once
    rules = spark.read.parquet(folder)
    keyed = rules.where(F.size("_lit") > 0).distinct()
    free = sorted((r[0], r[1]) for r in rules.where(F.size("_lit") == 0).select("_rid", "_pat").distinct().collect())
    pairs = candidates(cmds, keyed, "_cmd", "_parts", [], "_words", NOT_WORD) \
        .where(F.forall("_lit", lambda x: F.col("_cmd").contains(x)))
    # equal patterns one after the other: each is compiled once a run, not once a row
    pairs = pairs.sortWithinPartitions("_pat")
    hit = F.when(is_ascii("_cmd"), F.rlike("_cmd", F.concat(F.lit(PY_RE_FLAGS_ASCII), F.col("_pat")))) \
        .otherwise(F.rlike("_cmd", F.concat(F.lit(PY_RE_FLAGS), F.col("_pat"))))
    out = pairs.where(hit).select("_cmd", "_rid")
    for lo in range(0, len(free), MAX_INLINE_RULES):
        block = first_match_rule("_cmd", free[lo:lo + MAX_INLINE_RULES])
        out = out.unionByName(cmds.select("_cmd", block.cast("long").alias("_rid")).where("_rid IS NOT NULL"))
    return out


def flag_allowed(df: DataFrame, cmd_col: str, allow: DataFrame, pattern_col: str = "pattern",
                 out_col: str = "allowed") -> DataFrame:
    """Allow-list flag, by the same means as :func:`classify_commands`."""
    allow = allow.select(F.lit(0).alias("_id"), pattern_col)
    few = _few_rules(allow, "_id", pattern_col)
    if few is not None:
        return df.withColumn(out_col, any_match(cmd_col, [r[1] for r in few]))
    cmds = df.select(F.col(cmd_col).alias("_cmd")).where("_cmd IS NOT NULL").distinct()
    ok = _indexed_matches(cmds, read_rules(allow, "_id", pattern_col)).select("_cmd").distinct().withColumn("_ok", F.lit(True))
    return (df.join(ok, F.col(cmd_col) == F.col("_cmd"), "left")
            .withColumn(out_col, F.coalesce("_ok", F.lit(False))).drop("_cmd", "_ok"))


# ---------------------------------------------------------------- P10

def command_decision(block_rule, allowed, mode) -> Column:
    """P10: ``blocked`` in every mode; ``dry-run`` -> ``skipped``; ``allow`` ->
    ``auto_run`` if allow-listed else ``needs_approval``; ``approve`` ->
    ``needs_approval``; an unknown mode falls through to ``skipped``."""
    m = F.lit(mode) if isinstance(mode, str) else col_(mode)
    return (F.when(col_(block_rule).isNotNull(), F.lit("blocked"))
            .when(m == "allow", F.when(F.coalesce(col_(allowed), F.lit(False)), F.lit("auto_run"))
                  .otherwise(F.lit("needs_approval")))
            .when(m == "approve", F.lit("needs_approval"))
            .otherwise(F.lit("skipped")))


# ---------------------------------------------------------------- J3

def match_approvals(calls: DataFrame, decisions: DataFrame, key: str = "session_id",
                    ts: str = "ts", call_id: str = "event_id", decision_id: str = "event_id",
                    decision_col: str = "decision",
                    timeout_s: int = APPROVAL_TIMEOUT_S, splits: int | None = None) -> DataFrame:
    """Each pending call gets the first decision for the same key with
    ``call.ts <= decision.ts <= call.ts + timeout``; none -> denied.

    No pair enumeration: calls and decisions are unioned and, per (key, time
    bucket of width ``timeout``), a running minimum in descending time order
    hands each call the earliest later decision.  A decision is copied into
    its own and the previous bucket, which is all a call can reach, so a key
    holding a third of all rows is still split into buckets of bounded time.
    ``splits`` > 1 narrows the buckets to ``timeout / splits`` (each decision
    is then copied into ``splits + 1`` buckets) for keys that are hot even
    within one time-out; by default it follows from the largest bucket, which one
    aggregate over key and time finds, so that about BUCKET_ROWS rows meet.

    Output: the call columns plus ``decision_id``, ``decided_at``,
    ``approved`` and ``outcome`` (approved / rejected / timed_out).  When
    calls and decisions are rows of one table, :func:`match_approvals_in`
    reads it once.
    """
    call_cols = F.struct(*[F.col(c) for c in calls.columns])
    c = calls.select(F.col(key).alias("_k"), F.col(ts).alias("_ts"), F.col(call_id).alias("_id"),
                     F.lit(0).alias("_kind"), F.lit(None).cast("boolean").alias("_dec"),
                     call_cols.alias("_call"))
    d = decisions.select(F.col(key).alias("_k"), F.col(ts).alias("_ts"),
                         F.col(decision_id).alias("_id"), F.lit(1).alias("_kind"),
                         F.col(decision_col).cast("boolean").alias("_dec"),
                         F.lit(None).cast(c.schema["_call"].dataType).alias("_call"))
    return _first_decision(c.unionByName(d), timeout_s, splits)


def match_approvals_in(events: DataFrame, is_call: Column, is_decision: Column,
                       decision: Column, key: str = "session_id", ts: str = "ts",
                       id_col: str = "event_id", call_cols: list[str] | None = None,
                       timeout_s: int = APPROVAL_TIMEOUT_S, splits: int | None = None) -> DataFrame:
    """J3 over one event table holding both calls (``is_call``) and
    decisions (``is_decision``): one scan, one shuffle.  Output columns are
    ``call_cols`` (default: key, ts, id) of each call plus the decision
    columns of :func:`match_approvals`."""
    call_cols = call_cols or [id_col, key, ts]
    kind = F.when(is_call, F.lit(0)).when(is_decision, F.lit(1))
    both = events.where(is_call | is_decision).select(
        F.col(key).alias("_k"), F.col(ts).alias("_ts"), F.col(id_col).alias("_id"),
        kind.alias("_kind"),
        F.when(kind == 1, decision.cast("boolean")).alias("_dec"),
        F.when(kind == 0, F.struct(*[F.col(c) for c in call_cols])).alias("_call"))
    return _first_decision(both, timeout_s, splits)


#: Rows of one (key, time bucket) that J3 aims at; most splits of a time-out.
BUCKET_ROWS = 100_000
MAX_SPLITS = 256


def _splits(both: DataFrame, timeout_s: int) -> int:
    width = max(1, int(timeout_s) * 1_000_000)
    bucket = F.floor(F.unix_micros(F.col("_ts").cast("timestamp")) / F.lit(width))
    largest = (both.where(F.col("_k").isNotNull()).groupBy("_k", bucket.alias("b")).agg(F.count(F.lit(1)).alias("n"))
               .agg(F.max("n")).first()[0])
    return max(1, min(MAX_SPLITS, -(-(largest or 0) // BUCKET_ROWS)))


def _first_decision(both: DataFrame, timeout_s: int, splits: int | None = None) -> DataFrame:
    """Shared core: rows ``_k, _ts, _id, _kind (0 call / 1 decision), _dec,
    _call``.  Buckets are ``timeout / splits`` wide; a decision goes to its
    own bucket and the ``splits`` before it, which covers every call that can
    reach it."""
    splits = _splits(both, timeout_s) if splits is None else max(1, int(splits))
    width = max(1, int(timeout_s) * 1_000_000 // splits)
    b = F.floor(F.unix_micros(F.col("_ts").cast("timestamp")) / F.lit(width))
    buckets = F.when(F.col("_kind") == 1, F.array(*[b - i for i in range(splits + 1)])).otherwise(F.array(b))
    # a null key matches nothing: such rows are spread by their id
    buckets = F.when(F.col("_k").isNull(), F.array(F.xxhash64("_id"))).otherwise(buckets)
    rows = both.withColumn("_b", F.explode(buckets))
    w = (Window.partitionBy("_k", "_b")
         .orderBy(F.col("_ts").desc(), F.col("_kind").desc(), F.col("_id").desc())
         .rowsBetween(Window.unboundedPreceding, 0))
    nxt = F.min(F.when(F.col("_kind") == 1, F.struct(
        F.col("_ts").alias("t"), F.col("_id").alias("i"), F.col("_dec").alias("d")))).over(w)
    # A call row travels with its own columns, so no join back to the calls.
    found = (rows.withColumn("_n", nxt).where(F.col("_kind") == 0)
             .withColumn("_hit", F.col("_k").isNotNull() & (F.col("_n")["t"] <= F.col("_ts") + F.expr(f"INTERVAL {int(timeout_s)} SECONDS"))))
    dec = F.when(F.col("_hit"), F.col("_n")["d"])
    return found.select(
        "_call.*",
        F.when(F.col("_hit"), F.col("_n")["i"]).alias("decision_id"),
        F.when(F.col("_hit"), F.col("_n")["t"]).alias("decided_at"),
        F.coalesce(dec, F.lit(False)).alias("approved"),
        F.when(~F.coalesce(F.col("_hit"), F.lit(False)), F.lit("timed_out"))
         .when(dec, F.lit("approved")).otherwise(F.lit("rejected")).alias("outcome"))


# ---------------------------------------------------------------- P13 / A4

def event_line(kind, text, cmd, stdout, stderr, return_code, iteration) -> Column:
    """One display line per event kind.

    Fixed values, the line formats by kind: start ``▶ text``; model ``[model
    #i] text``; tool_call ``[tool_call #i] $ cmd``; tool_result ``[tool_result
    rc=N]`` newline stdout (newline ``[stderr]`` newline stderr); blocked
    ``[BLOCKED] cmd (text)``; skipped ``[skipped] cmd``; done ``■ text``;
    error ``[ERROR] text``; anything else its JSON."""
    k = col_(kind)
    it = col_(iteration).cast("string")
    s = lambda c: F.coalesce(col_(c).cast("string"), F.lit(""))
    return (F.when(k == "start", F.concat(F.lit("▶ "), s(text)))
            .when(k == "model", F.concat(F.lit("[model #"), it, F.lit("] "), s(text)))
            .when(k == "tool_call", F.concat(F.lit("[tool_call #"), it, F.lit("] $ "), s(cmd)))
            .when(k == "tool_result", F.concat(
                F.lit("[tool_result rc="), s(return_code), F.lit("]\n"), s(stdout),
                F.when(F.coalesce(col_(stderr), F.lit("")) != "",
                       F.concat(F.lit("\n[stderr]\n"), col_(stderr))).otherwise(F.lit(""))))
            .when(k == "blocked", F.concat(F.lit("[BLOCKED] "), s(cmd), F.lit(" ("), s(text), F.lit(")")))
            .when(k == "skipped", F.concat(F.lit("[skipped] "), s(cmd)))
            .when(k == "done", F.concat(F.lit("■ "), s(text)))
            .when(k == "error", F.concat(F.lit("[ERROR] "), s(text)))
            .otherwise(F.to_json(F.struct(
                k.alias("kind"), col_(text).alias("text"), col_(cmd).alias("cmd"), col_(stdout).alias("stdout"),
                col_(stderr).alias("stderr"), col_(return_code).alias("return_code"),
                col_(iteration).alias("iteration")))))


MAX_ITERS = 6


def session_summary(events: DataFrame, session: str = "session_id", kind: str = "kind",
                    order: list | None = None, return_code: str = "return_code",
                    max_iters: int = MAX_ITERS) -> DataFrame:
    """A4: per session counts by kind, results by return code, the final
    kind in ``order``.  Plain aggregates: partial aggregation runs map-side,
    so a session with a third of all events costs one small row per task."""
    order = order or [F.col("ts"), F.col("event_id")]
    k = F.col(kind)
    return events.groupBy(session).agg(
        F.count(F.lit(1)).alias("n_events"),
        F.count_if(k == "model").alias("iterations"),
        F.count_if(k == "tool_call").alias("calls"),
        F.count_if(k == "blocked").alias("blocked"),
        F.count_if(k == "skipped").alias("skipped"),
        F.count_if((k == "tool_result") & (F.col(return_code) == 0)).alias("results_ok"),
        F.count_if((k == "tool_result") & (F.col(return_code) != 0)).alias("results_failed"),
        F.count_if(k == "error").alias("errors"),
        F.max_by(k, F.struct(*order)).alias("final_kind"),
    ).withColumn("hit_max_iters", F.col("iterations") >= max_iters)
