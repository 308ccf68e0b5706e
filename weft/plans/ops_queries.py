"""Queries over operational tables: job outcomes (orders as jobs), device
samples (events as readings), the tier ladder, artifact matching and
first-source-wins listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators.ops_tables import (
    TIERS,
    dedupe_ladder,
    first_wins,
    group_rollup,
    group_value_stats,
    job_summary,
    keep_ids,
    ladder_lookup,
    latest_per_key,
    majority_subset,
    match_files,
    tier_ladder,
    union_roots,
    usage_band,
    usage_pct,
)
from weft.plans.registry import query
from weft.plans.tables import table

# ---------------------------------------------------------------- jobs

LINE_SQL = """CASE o_orderstatus WHEN 'F' THEN '[exit 0]'
  WHEN 'O' THEN '[exit ' || CAST(o_orderkey % 3 - 1 AS STRING) || ']'
  ELSE 'step ' || CAST(o_orderkey AS STRING) END"""


def job_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("job_id"), F.col("o_orderdate").alias("ts"),
        F.col("o_orderkey").alias("seq"), F.expr(LINE_SQL).alias("line"))


@query("job_summary", "A5 P11 P14", sql=f"""
WITH l AS (SELECT o_custkey AS job_id, o_orderdate AS ts, o_orderkey AS seq, {LINE_SQL} AS line FROM orders),
a AS (SELECT job_id, count(*) AS n_lines, min(ts) AS started_at, max(ts) AS last_ts,
             arg_max(line, (ts, seq)) AS last_line FROM l GROUP BY job_id),
r AS (SELECT *, TRY_CAST(nullif(regexp_extract(last_line, '^\\[exit (-?\\d+)\\]$', 1), '') AS INTEGER) AS return_code FROM a),
e AS (SELECT *, CASE WHEN return_code IS NOT NULL THEN last_ts END AS ended_at FROM r)
SELECT job_id, CAST(n_lines AS BIGINT) AS n_lines, started_at, return_code, ended_at,
       CAST(epoch(ended_at) - epoch(started_at) AS BIGINT) AS duration_s,
       CASE WHEN ended_at IS NULL THEN 'running' WHEN return_code = 0 THEN 'done' ELSE 'failed' END AS state
FROM e
""")
def job_summary_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = job_summary(job_log(spark, sf_dir))
    return s.select("job_id", F.col("n_lines").cast("long").alias("n_lines"), "started_at",
                    "return_code", "ended_at", F.col("duration_s").cast("long").alias("duration_s"),
                    "state")


def _case_sql(v: str, rungs: list[tuple[float, str]]) -> str:
    rungs = sorted(rungs)
    whens = " ".join(f"WHEN {v} >= {t} THEN '{n}'" for t, n in reversed(rungs[1:]))
    return f"CASE WHEN {v} IS NULL OR {v} <= 0 THEN 'cpu' {whens} ELSE '{rungs[0][1]}' END"


# ---------------------------------------------------------------- device samples

TOTAL_MB = 500.0
KEEP_DEVICES = (0, 1, 2)


def device_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return ev.select(
        F.col("user_id").alias("host"), F.pmod(k, F.lit(4)).alias("device_index"), "ts", "event_id",
        F.col("value").alias("used_mb"), F.lit(TOTAL_MB).alias("total_mb"))


_SAMPLES_SQL = f"""
WITH s AS (SELECT user_id AS host, CAST(json_extract_string(props, '$.k') AS INTEGER) % 4 AS device_index,
                  ts, event_id, value AS used_mb, {TOTAL_MB} AS total_mb FROM events),
lt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY host, device_index ORDER BY ts DESC, event_id DESC) AS rn
                      FROM s) WHERE rn = 1)
"""


@query("device_latest", "ST4 P12", sql=_SAMPLES_SQL + """
SELECT host, device_index, event_id, used_mb,
       CASE WHEN total_mb = 0 THEN 0.0 ELSE round_even(100.0 * used_mb / total_mb, 1) END AS pct,
       CASE WHEN round_even(100.0 * used_mb / total_mb, 1) >= 90 THEN 'crit'
            WHEN round_even(100.0 * used_mb / total_mb, 1) >= 70 THEN 'warn' ELSE 'ok' END AS band
FROM lt
""")
def device_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    lt = latest_per_key(device_samples(spark, sf_dir), ["host", "device_index"],
                        [F.col("ts"), F.col("event_id")])
    pct = usage_pct("used_mb", "total_mb")
    return lt.select("host", "device_index", "event_id", "used_mb", pct.alias("pct"),
                     usage_band(pct).alias("band"))


@query("host_rollup", "A2 A3 J4 ST4", sql=_SAMPLES_SQL + f"""
SELECT host, CAST(count(*) AS BIGINT) AS n, min(used_mb) AS min_value, max(used_mb) AS max_value,
       round(sum(used_mb), 2) AS sum_value,
       count(*) > 1 AND max(used_mb) - min(used_mb) > 1.0 AS heterogeneous,
       CASE WHEN count(*) > 1 THEN 'ddp' ELSE 'single' END AS strategy,
       list_sort(list(used_mb))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS upper_median,
       {_case_sql('min(used_mb)', [(t[1], t[0]) for t in TIERS])} AS tier
FROM lt GROUP BY host
""")
def host_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lt = latest_per_key(device_samples(spark, sf_dir), ["host", "device_index"],
                        [F.col("ts"), F.col("event_id")])
    roll = group_rollup(lt, "host", "used_mb")
    med = group_value_stats(lt, "host", "used_mb").select("host", "upper_median")
    # the tier follows the smallest device of the host
    out = ladder_lookup(roll.join(med, "host", "left"), "min_value", tier_ladder(spark))
    return out.select(
        "host", F.col("n").cast("long").alias("n"), "min_value", "max_value", "sum_value",
        "heterogeneous", "strategy", "upper_median", "tier")


@query("majority_devices", "F5 F7 A3", sql=_SAMPLES_SQL + f""",
k AS (SELECT * FROM s WHERE device_index IN {KEEP_DEVICES}),
m AS (SELECT host, count(*) AS n, list_sort(list(used_mb))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS med
      FROM k GROUP BY host),
w AS (SELECT k.host, count(*) FILTER (WHERE abs(k.used_mb - m.med) <= 1.0) AS n_within
      FROM k JOIN m USING (host) GROUP BY k.host)
SELECT k.event_id, k.host, k.device_index, k.used_mb
FROM k JOIN m USING (host) JOIN w USING (host)
WHERE m.n <= 1 OR w.n_within = 0 OR abs(k.used_mb - m.med) <= 1.0
""")
def majority_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = keep_ids(device_samples(spark, sf_dir), "device_index", KEEP_DEVICES)
    return majority_subset(s, "host", "used_mb").select("event_id", "host", "device_index", "used_mb")


# ---------------------------------------------------------------- J4


@query("quantity_tier", "J4", sql=f"""
SELECT l_orderkey, l_linenumber, {_case_sql('l_quantity', [(t[1], t[0]) for t in TIERS])} AS tier FROM lineitem
""")
def quantity_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return ladder_lookup(li, "l_quantity", tier_ladder(spark)).select(
        "l_orderkey", "l_linenumber", "tier")


def _doc_rungs() -> list[tuple[float, str]]:
    best: dict[int, tuple[float, str]] = {}
    for name, lo, max_len, *_ in TIERS:
        if max_len not in best or lo < best[max_len][0]:
            best[max_len] = (lo, name)
    return [(float(m), v[1]) for m, v in best.items()]


@query("doc_tier", "J4 P15", sql=f"""
WITH d AS (SELECT doc_id, {__import__('weft.plans.sql_snippets', fromlist=['x']).sql_token_count('text')} AS n_tokens FROM documents)
SELECT doc_id, n_tokens, {_case_sql('n_tokens', _doc_rungs())} AS tier FROM d
""")
def doc_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.functions.text import token_count

    d = table(spark, sf_dir, "documents").select("doc_id", token_count("text").alias("n_tokens"))
    ladder = dedupe_ladder(tier_ladder(spark), "max_length")
    return ladder_lookup(d, "n_tokens", ladder).select("doc_id", "n_tokens", "tier")


# ---------------------------------------------------------------- J5

FILE_SQL = """replace(p_name, ' ', '-') || '-' || p_type || '-' || CAST(p_partkey AS STRING)
  || CASE WHEN p_size % 5 = 0 THEN '.bin' ELSE '.gguf' END"""


@query("artifact_match", "J5 F6", sql=f"""
WITH f AS (SELECT p_brand AS repo_id, {FILE_SQL} AS file, p_partkey AS ord FROM part),
g AS (SELECT * FROM f WHERE suffix(lower(file), '.gguf')),
r AS (SELECT DISTINCT p_brand AS repo_id, upper(split_part(p_name, ' ', 2)) || '.GGUF' AS hint FROM part
      UNION SELECT DISTINCT p_brand, 'q4_k_m' FROM part),
j AS (SELECT r.repo_id, r.hint, g.file, g.ord,
             contains(lower(g.file), replace(lower(r.hint), '.gguf', '')) AS sub, g.file = r.hint AS ex
      FROM r LEFT JOIN g ON r.repo_id = g.repo_id)
SELECT repo_id, hint,
       coalesce(arg_min(file, ord) FILTER (WHERE sub), max(file) FILTER (WHERE ex)) AS file,
       CAST(count(*) FILTER (WHERE sub) AS BIGINT) AS n_matches,
       CASE WHEN count(*) FILTER (WHERE sub) > 0 THEN 'substring'
            WHEN count(*) FILTER (WHERE ex) > 0 THEN 'exact' END AS match_kind
FROM j GROUP BY repo_id, hint
""")
def artifact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    files = part.select(F.col("p_brand").alias("repo_id"), F.expr(FILE_SQL).alias("file"),
                        F.col("p_partkey").alias("ord"))
    reqs = part.select(F.col("p_brand").alias("repo_id"),
                       F.concat(F.upper(F.split_part("p_name", F.lit(" "), F.lit(2))),
                                F.lit(".GGUF")).alias("hint")) \
        .unionByName(part.select(F.col("p_brand").alias("repo_id"), F.lit("q4_k_m").alias("hint")))
    return match_files(reqs, files)


# ---------------------------------------------------------------- U1 / W4 / L2

@query("first_source", "U1 W4 L2", sql="""
WITH u AS (
  SELECT sha256(text) AS key, doc_id, 'primary' AS source, 0 AS priority,
         source || '/' || CAST(doc_id AS VARCHAR) AS path FROM documents WHERE lang = 'en'
  UNION ALL
  SELECT sha256(text), doc_id, 'mirror', 1, 'mirror/' || source || '/' || CAST(doc_id AS VARCHAR) FROM documents)
SELECT key, doc_id, source, path FROM (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY priority, path) AS rn FROM u) WHERE rn = 1
""")
def first_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("key", F.sha2("text", 256))
    primary = d.where(F.col("lang") == "en").select(
        "key", "doc_id", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"))
    mirror = d.select("key", "doc_id", F.concat_ws("/", F.lit("mirror"), "source",
                                                  F.col("doc_id").cast("string")).alias("path"))
    u = union_roots([("primary", primary), ("mirror", mirror)])
    return first_wins(u, "key", [F.col("priority"), F.col("path")]).select(
        "key", "doc_id", "source", "path").orderBy("path")
