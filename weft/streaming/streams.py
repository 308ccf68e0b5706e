"""Structured Streaming forms of the polling loops (ST1-ST4).

Every stream is checkpointed in the shared checkpoint folder, so a restart
(or a lost executor) resumes from the committed offsets and state; sinks are
idempotent per micro-batch.  ``trigger="available_now"`` drains what is there
and stops -- the batch-equivalent mode the tests use.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from weft.operators.agent_log import APPROVAL_TIMEOUT_S
from weft.operators.ops_tables import LOG_RING_LINES, usage_band, usage_pct
from weft.operators.records import SOURCE, normalize_lines, observe_counters, record_json
from weft.session import scratch_dir


def _trigger(writer, trigger: str | None):
    if trigger in (None, "available_now"):
        return writer.trigger(availableNow=True)
    return writer.trigger(processingTime=trigger)


# ---------------------------------------------------------------- SRC4 / ST1

def stream_landing(spark: SparkSession, landing_dir: str, glob: str = "*.jsonl",
                   max_files_per_trigger: int | None = None) -> DataFrame:
    """SRC4: new files in the landing folder, accepted only by name (glob)."""
    r = spark.readStream.format("text").option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(landing_dir)


def landing_to_prepared(spark: SparkSession, landing_dir: str, out_dir: str,
                        quarantine_dir: str, checkpoint: str | None = None,
                        trigger: str | None = "available_now", glob: str = "*.jsonl",
                        max_files_per_trigger: int | None = None) -> StreamingQuery:
    """ST1: uploads become canonical records; misfits go to quarantine.

    Per-row shape detection (the stream has no "first record").  Each
    micro-batch is written under ``batch=<id>`` with overwrite, so a
    replayed batch replaces its own output instead of duplicating it.  Its counters (A1) are
    observed on the write of the records and stored the same way, one row a batch, under
    ``<out_dir>/_counters`` (:func:`stream_counters`).

    The checkpoint belongs to the output: by default it is ``<out_dir>/_checkpoint``, so a
    restart with the same folders goes on where it stopped.
    """
    norm = normalize_lines(stream_landing(spark, landing_dir, glob, max_files_per_trigger), "value", policy="per_row")

    def write(batch: DataFrame, batch_id: int) -> None:
        # only what is written is kept between the two writes, not the parsed record and its fields
        fits = F.col("format").isNotNull()
        batch = batch.select("format", F.when(fits, F.col("text")).alias("text"),
                             F.when(fits, record_json("format", SOURCE)).alias("record"),
                             F.when(~fits, F.col("value")).alias("value")).persist()
        try:
            observed, seen = observe_counters(batch, f"prepared-{batch_id}")
            (observed.where(F.col("format").isNotNull())
             .select("format", "text", "record")
             .write.mode("overwrite").parquet(f"{out_dir}/batch={batch_id}"))
            (batch.where(F.col("format").isNull()).select("value")
             .write.mode("overwrite").parquet(f"{quarantine_dir}/batch={batch_id}"))
            counters = batch.sparkSession.createDataFrame(
                [tuple(int(seen.get[c]) for c in COUNTERS)], ", ".join(f"{c} BIGINT" for c in COUNTERS))
            counters.write.mode("overwrite").parquet(f"{out_dir}/_counters/batch={batch_id}")
        finally:
            batch.unpersist()

    w = norm.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint or f"{out_dir}/_checkpoint")
    return _trigger(w, trigger).start()


COUNTERS = ("n_read", "n_written", "n_skipped")


def stream_counters(spark: SparkSession, out_dir: str) -> DataFrame:
    """A1 of a stream: its counters by micro-batch (``batch``, ``n_read, n_written, n_skipped``)."""
    schema = ", ".join(f"{c} BIGINT" for c in (*COUNTERS, "batch"))
    return spark.read.schema(schema).parquet(f"{out_dir}/_counters").select("batch", *COUNTERS)


# ---------------------------------------------------------------- SRC5 / ST2

LOG_SCHEMA = T.StructType([
    T.StructField("job_id", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("line", T.StringType()),
])


def stream_log(spark: SparkSession, log_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """SRC5: log records ``{job_id, seq, line}`` from *rolled* files (the
    file source reads a file once; it does not follow appends).  The offsets
    in the checkpoint are each consumer's cursor: it sees only new lines.
    ``max_files_per_trigger`` paces the consumer (the rate limit)."""
    r = spark.readStream.schema(LOG_SCHEMA)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.json(log_dir)


TAIL_SCHEMA = "job_id STRING, seq LONG, line STRING, pos INT"
#: Salts of a job's second cut; rows a task holds before it hands cut rows on.
TAIL_SALTS = 16
CUT_ROWS = 1 << 17
#: Groups of jobs that share state and a call of Python (fixed: a restart must find its state).
JOB_GROUPS = 1 << 14
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def last_per_job(rows: pa.Table, n: int) -> pa.Table:
    """The ``n`` rows of the largest (seq, line) of every job, newest first."""
    rows = rows.sort_by([("job_id", "ascending"), ("seq", "descending"), ("line", "descending")]).combine_chunks()
    job = rows.column("job_id")
    if rows.num_rows < 2:
        return rows
    code = job.combine_chunks().dictionary_encode(null_encoding="encode") if isinstance(job, pa.ChunkedArray) \
        else job.dictionary_encode(null_encoding="encode")
    code = code.combine_chunks() if isinstance(code, pa.ChunkedArray) else code
    code = code.indices.to_numpy()
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    rank = np.arange(len(code)) - np.repeat(first, np.diff(np.append(first, len(code))))
    return rows.filter(pa.array(rank < n))


def _cut(n: int):
    """An Arrow stage that hands on at most ``n`` rows a job (and flush) of its task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, limit = 0, CUT_ROWS
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= limit:
                cut = last_per_job(pa.Table.from_batches(held), n)
                if cut.num_rows > limit // 2:  # many jobs: cutting here saves little
                    yield from cut.to_batches()
                    held, size = [], 0
                else:
                    held, size = cut.to_batches(), cut.num_rows
        if held:
            yield from last_per_job(pa.Table.from_batches(held), n).to_batches()
    return run


LINE_COLUMNS = ["job_id", "seq", "line"]
LINE_TYPES = [pa.string(), pa.int64(), pa.string()]


def _merge_tail(n: int, ttl_ms: int | None):
    """The last ``n`` lines of a group's jobs, newest first, as its state; idle groups expire after
    ``ttl_ms``.  State comes and goes with the rows' Arrow batches: no request a job."""
    def run(key, pdfs, state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = pa.table([pa.array([], t) for t in LINE_TYPES], LINE_COLUMNS)
        for pdf in pdfs:
            columns = [pa.array(pdf["job"], pa.string(), mask=~pdf["named"].to_numpy(bool)),
                       pa.array(pdf["seq"].to_numpy(), pa.int64(), mask=~pdf["counted"].to_numpy(bool)),
                       pa.array(pdf["line"], pa.string())]
            held = pa.concat_tables([held, pa.table(columns, LINE_COLUMNS)])
            if held.num_rows > CUT_ROWS:
                held = last_per_job(held, n)
        touched = set(held.column("job_id").to_pylist())
        if state.exists:
            old = [pa.array(list(c), t) for c, t in zip(state.get, LINE_TYPES, strict=True)]
            held = pa.concat_tables([held, pa.table(old, LINE_COLUMNS)])
        job, seq, line = (c.to_pylist() for c in last_per_job(held, n).columns)
        state.update((job, seq, line))
        if ttl_ms:
            state.setTimeoutDuration(ttl_ms)
        pos, place = [], 0
        for i, j in enumerate(job):
            place = place + 1 if i and j == job[i - 1] else 1
            pos.append(place)
        out = pd.DataFrame({"job_id": job, "seq": pd.array(seq, "Int64"), "line": line, "pos": pos})
        yield out[[j in touched for j in job]]
    return run


def use_rocksdb(spark: SparkSession) -> None:
    """State off the JVM heap."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if spark.conf.get(key, "") != ROCKSDB:
        spark.conf.set(key, ROCKSDB)


def log_tail(logs: DataFrame, n: int = LOG_RING_LINES, salts: int = TAIL_SALTS, ttl_ms: int | None = None) -> DataFrame:
    """ST2: the last ``n`` lines per job as bounded per-key state (at most n
    lines per job, never the whole log).  Update mode: each trigger emits the
    current tail of the jobs that received lines.  ``pos`` 1 is the newest.

    Three levels, so that no task receives a hot job's whole batch: where lines are read, at
    most n a job leave a task; these meet in ``salts`` parts a job, which leave n each; the
    state merges those.  Jobs are dealt to JOB_GROUPS groups (with ``ttl_ms``, each to its own), whose
    tails are one state: a trigger calls Python once a group that received lines.  With ``ttl_ms`` the state of a job that gets no lines for so long
    is dropped (its next line starts a new tail); such a query has a batch to run at any time, so it
    needs a processing-time trigger: ``available_now`` would not end.

    Unlike a ring compared by length, new lines keep arriving after the tail
    is full: the cursor is the source offset, not a list length."""
    use_rocksdb(logs.sparkSession)
    rows = logs.select("job_id", "seq", "line")
    parts = int(logs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = rows.mapInArrow(_cut(n), rows.schema)
    cut = cut.repartition(parts, "job_id", F.pmod(F.xxhash64("seq", "line"), F.lit(salts))).mapInArrow(_cut(n), rows.schema)
    # columns without nulls, which pandas would turn into floats
    cut = cut.select(F.pmod(F.xxhash64("job_id"), F.lit(JOB_GROUPS)).alias("part"), F.col("job_id").isNotNull().alias("named"),
                     F.coalesce("job_id", F.lit("")).alias("job"), F.col("seq").isNotNull().alias("counted"),
                     F.coalesce("seq", F.lit(0)).alias("seq"), "line")
    return cut.groupBy(*(("part", "named", "job") if ttl_ms else ("part",))).applyInPandasWithState(
        _merge_tail(n, ttl_ms), TAIL_SCHEMA, "jobs ARRAY<STRING>, seqs ARRAY<LONG>, lines ARRAY<STRING>", "Update",
        "ProcessingTimeTimeout" if ttl_ms else "NoTimeout")


def job_status(logs: DataFrame) -> DataFrame:
    """ST2 status per tick: lines so far and the newest line per job."""
    return logs.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_lines"),
                                      F.max_by("line", "seq").alias("last_line"),
                                      F.max("seq").alias("last_seq"))


# ---------------------------------------------------------------- ST3

def _first_decisions(timeout_us: int):
    """An Arrow stage: rows of a settled bucket (``key``, list ``rows``) -> its calls, each with
    its earliest decision.  One sorted sweep over all buckets of a batch; no pair is made."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("rows")
            bucket = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            is_call, number, us, decision = lists.flatten().flatten()
            call, at = is_call.to_numpy(zero_copy_only=False), us.to_numpy()
            said = decision.fill_null(False).to_numpy(zero_copy_only=False)
            ids, no_id = number.fill_null(0).to_numpy(), number.is_null().to_numpy(zero_copy_only=False)
            # at equal times calls before decisions, smaller ids first
            order = np.lexsort((said, ids, no_id, ~call, at, bucket))
            call, at, bucket = call[order], at[order], bucket[order]
            n = len(order)
            following = np.minimum.accumulate(np.where(call, n, np.arange(n))[::-1])[::-1][call]
            calls = np.flatnonzero(call)
            hit = np.minimum(following, n - 1)
            found = (following < n) & (bucket[hit] == bucket[calls]) & (at[hit] <= at[calls] + timeout_us)
            keys = batch.column("key").take(pa.array(bucket[calls]))
            found &= keys.is_valid().to_numpy(zero_copy_only=False)
            hits = pa.array(order[hit], mask=~found)
            out = [keys, number.take(pa.array(order[calls])), pa.array(at[calls]),
                   number.take(hits), us.take(hits), decision.take(hits)]
            yield pa.RecordBatch.from_arrays(out, ["key", "call_id", "us", "decision_id", "decided_us", "decision"])
    return run


def approvals_stream(calls: DataFrame, decisions: DataFrame, key: str = "session_id",
                     timeout_s: int = APPROVAL_TIMEOUT_S, delay: str = "10 minutes", splits: int = 1) -> DataFrame:
    """ST3: pending calls and decisions as two streams; each call gets its earliest decision with
    ``call.ts <= d.ts <= call.ts + timeout`` (ties: the smaller id).

    Both streams are dealt by (key, sliding window that starts every time-out / ``splits`` and
    reaches a time-out further), a call to its own window and a decision to that and the
    ``splits`` before it, so state is linear in the rows -- one row a call, ``splits`` + 1 a
    decision -- and a hot session is many groups.  A group's rows are one aggregate of Spark's own
    (no Python call a group); when the watermark (of both streams) has passed the window's end they
    leave the state and one sweep hands every call its decision.  A row is late once its window is
    settled.  A call without a decision, or of a null session, is ``timed_out``; a null decision
    counts as rejected.

    ``calls``: key, ``call_id``, ``ts``; ``decisions``: key, ``decision_id``,
    ``ts``, ``decision``.  Rows with a null ``ts`` take no part.
    """
    use_rocksdb(calls.sparkSession)
    splits = max(1, int(splits))
    timeout_us = int(timeout_s) * 1_000_000
    width = max(1, -(-timeout_us // splits))
    key_type = calls.schema[key].dataType
    c = calls.withWatermark("ts", delay).where(F.col("ts").isNotNull()).select(
        F.col(key).alias("key"), F.lit(True).alias("is_call"), F.col("call_id").cast("long").alias("id"), "ts",
        F.lit(None).cast("boolean").alias("decision"))
    d = decisions.withWatermark("ts", delay).where(F.col("ts").isNotNull() & F.col(key).isNotNull()).select(
        F.col(key).cast(key_type).alias("key"), F.lit(False).alias("is_call"),
        F.col("decision_id").cast("long").alias("id"), "ts",
        F.coalesce(F.col("decision").cast("boolean"), F.lit(False)).alias("decision"))
    # null sessions match nothing and are spread by their ids
    rows = c.unionByName(d).withColumns({
        "us": F.unix_micros(F.col("ts").cast("timestamp")),
        "spread": F.when(F.col("key").isNull(), F.pmod(F.xxhash64("id"), F.lit(64))).otherwise(0)})
    rows = rows.withColumn("span", F.window("ts", f"{(splits + 1) * width} microseconds", f"{width} microseconds"))
    own = F.col("ts") < F.col("span.start") + F.expr(f"INTERVAL '{width // 1_000_000}.{width % 1_000_000:06d}' SECOND")
    groups = rows.where(~F.col("is_call") | own).groupBy("key", "span", "spread").agg(
        F.collect_list(F.struct("is_call", "id", "us", "decision")).alias("rows"), F.max("is_call").alias("has_call"))
    result = T.StructType([T.StructField("key", key_type)] + [
        T.StructField(n, T.LongType()) for n in ("call_id", "us", "decision_id", "decided_us")]
        + [T.StructField("decision", T.BooleanType())])
    out = groups.where("has_call").select("key", "rows").mapInArrow(_first_decisions(timeout_us), result)
    found = F.col("decision_id").isNotNull()
    return out.select(
        F.col("key").alias(key), "call_id", F.timestamp_micros("us").alias("ts"), "decision_id",
        F.timestamp_micros("decided_us").alias("decided_at"), F.coalesce("decision", F.lit(False)).alias("approved"),
        F.when(~found, F.lit("timed_out")).when(F.col("decision"), F.lit("approved"))
         .otherwise(F.lit("rejected")).alias("outcome"))


# ---------------------------------------------------------------- ST4

def latest_samples(samples: DataFrame, keys: tuple[str, ...] = ("host", "device_index"),
                   ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """ST4: the newest reading per device (update mode), with P12's usage
    percent and band.  ``max_by`` keeps one row of state per device."""
    others = [c for c in samples.columns if c not in keys]
    latest = samples.groupBy(*keys).agg(
        F.max_by(F.struct(*others), F.struct(F.col(ts), F.col(tie))).alias("_r")).select(*keys, "_r.*")
    pct = usage_pct("used_mb", "total_mb")
    return latest.withColumn("pct", pct).withColumn("band", usage_band(F.col("pct")))


def run_to_table(df: DataFrame, spark: SparkSession, name: str, output_mode: str,
                 trigger: str | None = "available_now", checkpoint: str | None = None) -> tuple[StreamingQuery, str]:
    """Run a streaming DataFrame into parquet snapshots under the checkpoint
    folder (one folder per micro-batch for update-mode outputs)."""
    out = scratch_dir(spark, f"{name}-out")
    ck = checkpoint or scratch_dir(spark, f"{name}-ckpt")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    w = df.writeStream.outputMode(output_mode).foreachBatch(write).option("checkpointLocation", ck)
    q = _trigger(w, trigger).start()
    return q, out


# tasks get this module's functions with the plan and need not have the package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
