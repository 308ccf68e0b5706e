"""Streams over table-derived files: the input is written from the driver
tables into a fresh folder, drained with ``availableNow`` and the sink read
back -- stream = batch where the semantics allow, checked against SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.plans.ops_queries import LINE_SQL, _SAMPLES_SQL
from weft.plans.file_queries import write_files
from weft.plans.record_queries import _LINES_SQL, jsonl_lines
from weft.plans.registry import query
from weft.plans.tables import table
from weft.session import scratch_dir
from weft.sources.log_source import follow_log
from weft.streaming.streams import (
    COUNTERS,
    approvals_stream,
    landing_to_prepared,
    latest_samples,
    log_tail,
    run_to_table,
    stream_counters,
    stream_log,
)


def _last_snapshot(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """Update-mode snapshots -> the newest row per key across batches."""
    snaps = spark.read.parquet(out)
    w = Window.partitionBy(*keys).orderBy(F.col("batch").desc())
    return snaps.withColumn("_r", F.rank().over(w)).where("_r = 1").drop("_r", "batch")


@query("stream_counters", "ST1 A1 SNK3", sql=_LINES_SQL + """
SELECT CAST(count(*) AS BIGINT) AS n_read, CAST(count(format) AS BIGINT) AS n_written,
       CAST(count(*) - count(format) AS BIGINT) AS n_skipped FROM t
""")
def stream_counters_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of several micro-batches and a restart, beside the output."""
    base = scratch_dir(spark, "st1c")
    lines = jsonl_lines(spark, sf_dir)
    for part in (F.col("rec_id") % 2 == 0, F.col("rec_id") % 2 != 0):  # the second half after the first run
        lines.where(part).select("value").write.mode("append").text(f"{base}/landing")
        q = landing_to_prepared(spark, f"{base}/landing", f"{base}/out", f"{base}/quarantine", glob="*.txt",
                                max_files_per_trigger=3)
        q.awaitTermination()
    return stream_counters(spark, f"{base}/out").agg(*[F.sum(c).alias(c) for c in COUNTERS])


@query("stream_log_follow", "SRC5", sql="""
SELECT event_type || '.log' AS file, 'event ' || event_id || ' of ' || user_id AS line FROM events WHERE event_id % 3 <> 0
UNION ALL SELECT event_type || '-2.log', 'event ' || event_id || ' of ' || user_id FROM events WHERE event_id % 3 = 0
""")
def stream_log_follow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of a follower with one checkpoint; more logs come in between."""
    base = scratch_dir(spark, "src5")
    ev = table(spark, sf_dir, "events")
    line = F.concat(F.lit("event "), F.col("event_id").cast("string"), F.lit(" of "), F.col("user_id").cast("string"))
    for part, end in ((F.col("event_id") % 3 != 0, ".log"), (F.col("event_id") % 3 == 0, "-2.log")):
        write_files(ev.where(part).select(F.concat("event_type", F.lit(end)).alias("name"), line.alias("line")), f"{base}/logs")
        q = (follow_log(spark, f"{base}/logs", glob="*.log", range_bytes=1 << 16).writeStream.format("parquet")
             .option("path", f"{base}/out").option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start())
        q.awaitTermination()
    return spark.read.parquet(f"{base}/out").select("file", "line")


@query("stream_prepared", "ST1 SRC4 P1 F2", sql=_LINES_SQL + """
SELECT format, text FROM t WHERE format IS NOT NULL
""")
def stream_prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = scratch_dir(spark, "st1")
    jsonl_lines(spark, sf_dir).select("value").write.text(f"{base}/landing")
    # The text writer names files part-*.txt; the landing glob is a parameter.
    q = landing_to_prepared(spark, f"{base}/landing", f"{base}/out", f"{base}/quarantine",
                            checkpoint=f"{base}/ckpt", glob="*.txt")
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out").select("format", "text")


TAIL = 50


@query("stream_log_tail", "ST2 SRC5 W1", sql=f"""
SELECT job_id, seq, line, CAST(pos AS INTEGER) AS pos FROM (
  SELECT CAST(o_custkey AS VARCHAR) AS job_id, o_orderkey AS seq, {LINE_SQL} AS line,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS pos FROM orders)
WHERE pos <= {TAIL}
""")
def stream_log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = scratch_dir(spark, "st2")
    (table(spark, sf_dir, "orders")
     .select(F.col("o_custkey").cast("string").alias("job_id"), F.col("o_orderkey").alias("seq"),
             F.expr(LINE_SQL).alias("line"))
     .write.json(f"{base}/logs"))
    tail = log_tail(stream_log(spark, f"{base}/logs"), TAIL)
    q, out = run_to_table(tail, spark, "st2", "update", checkpoint=f"{base}/ckpt")
    q.awaitTermination()
    snaps = spark.read.parquet(out)
    # newest snapshot per job holds its whole current tail
    w = Window.partitionBy("job_id")
    return (snaps.withColumn("_b", F.max("batch").over(w)).where(F.col("batch") == F.col("_b"))
            .select("job_id", "seq", "line", F.col("pos").cast("int").alias("pos")))


@query("stream_device_latest", "ST4 P12", sql=_SAMPLES_SQL + """
SELECT host, device_index, event_id, used_mb,
       CASE WHEN total_mb = 0 THEN 0.0 ELSE round_even(100.0 * used_mb / total_mb, 1) END AS pct,
       CASE WHEN round_even(100.0 * used_mb / total_mb, 1) >= 90 THEN 'crit'
            WHEN round_even(100.0 * used_mb / total_mb, 1) >= 70 THEN 'warn' ELSE 'ok' END AS band
FROM lt
""")
def stream_device_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.plans.ops_queries import device_samples

    base = scratch_dir(spark, "st4")
    samples = device_samples(spark, sf_dir)
    samples.write.parquet(f"{base}/in")
    stream = spark.readStream.schema(samples.schema).parquet(f"{base}/in")
    q, out = run_to_table(latest_samples(stream), spark, "st4", "update", checkpoint=f"{base}/ckpt")
    q.awaitTermination()
    last = _last_snapshot(spark, out, ["host", "device_index"])
    return last.select("host", "device_index", "event_id", "used_mb", "pct", "band")


APPROVAL_WINDOW_S = 86400
WATERMARK_DELAY = "1 hour"


@query("stream_approvals", "ST3 J3", sql=f"""
WITH e AS (SELECT event_id, ts, user_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
p AS (SELECT * FROM e WHERE event_type = 'purchase'),
c AS (SELECT * FROM e WHERE event_type = 'click'),
j AS (SELECT p.event_id, p.user_id, p.ts, c.event_id AS decision_id, c.ts AS decided_at, (c.k % 2 = 0) AS d,
             row_number() OVER (PARTITION BY p.event_id ORDER BY c.ts, c.event_id) AS rn
      FROM p LEFT JOIN c ON c.user_id = p.user_id AND c.ts >= p.ts
                        AND c.ts <= p.ts + INTERVAL {APPROVAL_WINDOW_S} SECOND)
SELECT event_id, user_id, ts, decision_id, decided_at, coalesce(d, false) AS approved,
       CASE WHEN decision_id IS NULL THEN 'timed_out' WHEN d THEN 'approved' ELSE 'rejected' END AS outcome
FROM j WHERE rn = 1
""")
def stream_approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and decisions as two streams.  After the table's rows, one
    end-of-input marker per stream (session -1, stamped past the last event
    by more than time-out + delay, computed in Spark from the table) moves
    the watermark so every real call is emitted; the marker is dropped."""
    base = scratch_dir(spark, "st3")
    ev = table(spark, sf_dir, "events").withColumn(
        "k", F.get_json_object("props", "$.k").cast("int"))
    calls = ev.where(F.col("event_type") == "purchase").select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("call_id"),
        F.col("ts").cast("timestamp").alias("ts"))
    decs = ev.where(F.col("event_type") == "click").select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("decision_id"),
        F.col("ts").cast("timestamp").alias("ts"), (F.pmod("k", F.lit(2)) == 0).alias("decision"))
    calls.write.parquet(f"{base}/calls")
    decs.write.parquet(f"{base}/decisions")
    end = ev.agg((F.max(F.col("ts").cast("timestamp"))
                  + F.expr(f"INTERVAL {3 * APPROVAL_WINDOW_S} SECONDS")).alias("ts"))
    end.select(F.lit(-1).cast("long").alias("session_id"), F.lit(-1).cast("long").alias("call_id"), "ts") \
        .write.mode("append").parquet(f"{base}/calls")
    end.select(F.lit(-1).cast("long").alias("session_id"), F.lit(-1).cast("long").alias("decision_id"), "ts",
               F.lit(False).alias("decision")).write.mode("append").parquet(f"{base}/decisions")
    cs = spark.readStream.schema("session_id BIGINT, call_id BIGINT, ts TIMESTAMP").parquet(f"{base}/calls")
    ds = spark.readStream.schema(
        "session_id BIGINT, decision_id BIGINT, ts TIMESTAMP, decision BOOLEAN").parquet(f"{base}/decisions")
    out_df = approvals_stream(cs, ds, timeout_s=APPROVAL_WINDOW_S, delay=WATERMARK_DELAY)
    q, out = run_to_table(out_df, spark, "st3", "append", checkpoint=f"{base}/ckpt")
    q.awaitTermination()
    res = spark.read.parquet(out).where(F.col("session_id") >= 0)
    return res.select(F.col("call_id").alias("event_id"), F.col("session_id").alias("user_id"),
                      F.col("ts").cast("timestamp_ntz").alias("ts"), "decision_id",
                      F.col("decided_at").cast("timestamp_ntz").alias("decided_at"), "approved", "outcome")
