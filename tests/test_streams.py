import datetime as dt
import json
import os

from pyspark.sql import functions as F

from weft.operators.agent_log import match_approvals
from weft.operators.ops_tables import latest_per_key
from weft.streaming.streams import (
    approvals_stream,
    landing_to_prepared,
    latest_samples,
    log_tail,
    run_to_table,
    stream_log,
)


def _write_lines(path, lines):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")


def test_landing_stream_equals_batch(spark, tmp):
    _write_lines(f"{tmp}/land/a.jsonl", ['{"text":"a"}', "", '{"x":1}'])
    _write_lines(f"{tmp}/land/b.jsonl", ['{"prompt":"p","completion":"c"}'])
    _write_lines(f"{tmp}/land/skip.txt", ['{"text":"not accepted"}'])
    q = landing_to_prepared(spark, f"{tmp}/land", f"{tmp}/out", f"{tmp}/quar", checkpoint=f"{tmp}/ck")
    q.awaitTermination()
    got = sorted((r.format, r.text) for r in spark.read.parquet(f"{tmp}/out").collect())
    assert got == [("prompt_completion", "pc"), ("text", "a")]
    assert spark.read.parquet(f"{tmp}/quar").count() == 1
    # a restart with the same checkpoint sees only new files
    _write_lines(f"{tmp}/land/c.jsonl", ['{"text":"c"}'])
    q = landing_to_prepared(spark, f"{tmp}/land", f"{tmp}/out", f"{tmp}/quar", checkpoint=f"{tmp}/ck")
    q.awaitTermination()
    assert sorted(r.text for r in spark.read.parquet(f"{tmp}/out").collect()) == ["a", "c", "pc"]


def test_log_tail_keeps_last_n_and_keeps_following(spark, tmp):
    recs = [{"job_id": "j", "seq": i, "line": f"l{i}"} for i in range(10)]
    _write_lines(f"{tmp}/logs/0.json", [json.dumps(r) for r in recs])
    q, out = run_to_table(log_tail(stream_log(spark, f"{tmp}/logs"), 3), spark, "t", "update",
                          checkpoint=f"{tmp}/ck")
    q.awaitTermination()
    snap = spark.read.parquet(out)
    assert sorted(r.seq for r in snap.collect()) == [7, 8, 9]
    # more lines after the tail is full still arrive (no length cursor)
    _write_lines(f"{tmp}/logs/1.json", [json.dumps({"job_id": "j", "seq": 10, "line": "l10"})])
    q, out2 = run_to_table(log_tail(stream_log(spark, f"{tmp}/logs"), 3), spark, "t", "update",
                           checkpoint=f"{tmp}/ck")
    q.awaitTermination()
    last = spark.read.parquet(out2)
    assert sorted((r.seq, r.pos) for r in last.collect()) == [(8, 3), (9, 2), (10, 1)]


def test_latest_samples_stream_equals_batch(spark, tmp):
    t = dt.datetime(2024, 1, 1)
    rows = [(h, d, t + dt.timedelta(seconds=s), e, float(u), 500.0)
            for e, (h, d, s, u) in enumerate([(1, 0, 5, 100), (1, 0, 9, 460), (1, 1, 3, 360), (2, 0, 1, 10)])]
    schema = "host LONG, device_index INT, ts TIMESTAMP, event_id LONG, used_mb DOUBLE, total_mb DOUBLE"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp}/in")
    q, out = run_to_table(latest_samples(stream), spark, "s", "update", checkpoint=f"{tmp}/ck")
    q.awaitTermination()
    got = sorted((r.host, r.device_index, r.used_mb, r.band) for r in spark.read.parquet(out).collect())
    batch = latest_per_key(spark.read.parquet(f"{tmp}/in"), ["host", "device_index"],
                           [F.col("ts"), F.col("event_id")])
    assert got == sorted((r.host, r.device_index, r.used_mb, b) for r, b in
                         zip(batch.orderBy("host", "device_index").collect(), ["crit", "warn", "ok"]))


def test_approvals_stream(spark, tmp):
    t0 = dt.datetime(2024, 3, 1, 12, 0, 0)  # well after epoch 0: nothing is late
    s = lambda k: t0 + dt.timedelta(seconds=k)
    calls = [(1, 1, s(0)), (1, 2, s(100)), (2, 3, s(0))]
    decs = [(1, 11, s(50), True), (1, 12, s(60), False), (2, 13, s(301), True)]
    cs = "session_id LONG, call_id LONG, ts TIMESTAMP"
    ds = "session_id LONG, decision_id LONG, ts TIMESTAMP, decision BOOLEAN"
    spark.createDataFrame(calls, cs).write.parquet(f"{tmp}/c")
    spark.createDataFrame(decs, ds).write.parquet(f"{tmp}/d")
    # a later event on both sides moves the watermark past every time-out
    spark.createDataFrame([(9, 99, s(10_000))], cs).write.mode("append").parquet(f"{tmp}/c")
    spark.createDataFrame([(9, 98, s(10_000), True)], ds).write.mode("append").parquet(f"{tmp}/d")
    out_df = approvals_stream(spark.readStream.schema(cs).parquet(f"{tmp}/c"),
                              spark.readStream.schema(ds).parquet(f"{tmp}/d"),
                              timeout_s=300, delay="1 minute")
    q, out = run_to_table(out_df, spark, "a", "append", checkpoint=f"{tmp}/ck")
    q.awaitTermination()
    got = {r.call_id: (r.decision_id, r.outcome) for r in spark.read.parquet(out).collect()}
    assert got[1] == (11, "approved") and got[2] is not None and got[2][1] == "timed_out"
    assert got[3] == (None, "timed_out")
    # same answer as the batch operator on the same rows
    bc = spark.createDataFrame(calls, cs).withColumnRenamed("call_id", "event_id")
    bd = spark.createDataFrame(decs, ds).withColumnRenamed("decision_id", "event_id")
    batch = {r.event_id: (r.decision_id, r.outcome) for r in match_approvals(bc, bd, timeout_s=300).collect()}
    assert batch == {k: got[k] for k in (1, 2, 3)}


def test_job_status_per_tick(spark, tmp):
    from weft.streaming.streams import job_status

    _write_lines(f"{tmp}/logs/0.json", [json.dumps({"job_id": "j", "seq": i, "line": f"l{i}"}) for i in range(3)])
    _write_lines(f"{tmp}/logs/1.json", [json.dumps({"job_id": "j", "seq": 3, "line": "[exit 0]"})])
    # the file source takes files in modification-time order
    os.utime(f"{tmp}/logs/0.json", (1_700_000_000, 1_700_000_000))
    os.utime(f"{tmp}/logs/1.json", (1_700_000_100, 1_700_000_100))
    q, out = run_to_table(job_status(stream_log(spark, f"{tmp}/logs", max_files_per_trigger=1)), spark,
                          "st", "update", checkpoint=f"{tmp}/ck")
    q.awaitTermination()
    snaps = spark.read.parquet(out).orderBy("batch").collect()
    assert [(r.n_lines, r.last_line) for r in snaps] == [(3, "l2"), (4, "[exit 0]")]


def test_stream_counters_survive_a_restart_with_the_default_checkpoint(spark, tmp):
    from weft.streaming.streams import stream_counters

    for i in range(3):
        _write_lines(f"{tmp}/land/{i}.jsonl", ['{"text":"%d"}' % i, '{"n":%d}' % i, ""])
    for extra in (None, '{"text":"late"}', None):
        if extra:
            _write_lines(f"{tmp}/land/late.jsonl", [extra])
        landing_to_prepared(spark, f"{tmp}/land", f"{tmp}/out", f"{tmp}/quar", max_files_per_trigger=1).awaitTermination()
    got = [tuple(r)[1:] for r in stream_counters(spark, f"{tmp}/out").orderBy("batch").collect()]
    assert sorted(got) == [(1, 1, 0)] + [(2, 1, 1)] * 3
    assert sorted(r.text for r in spark.read.parquet(f"{tmp}/out").collect()) == ["0", "1", "2", "late"]
    assert spark.read.parquet(f"{tmp}/quar").count() == 3


def test_approvals_stream_of_a_hot_session_keeps_linear_state(spark, tmp):
    """A third of all rows in one session, null sessions, ties; splits change nothing."""
    import random

    rng = random.Random(6)
    t0 = dt.datetime(2024, 3, 1)
    s = lambda k: t0 + dt.timedelta(seconds=k)
    session = lambda i: 0 if i % 3 == 0 else None if i % 10 == 1 else rng.randint(1, 4)
    calls = [(session(i), i, s(rng.randint(0, 4000))) for i in range(500)]
    decs = [(session(i), 1000 + i, s(rng.randint(0, 4000)), rng.choice([True, False, None])) for i in range(500)]
    cs = "session_id LONG, call_id LONG, ts TIMESTAMP"
    ds = "session_id LONG, decision_id LONG, ts TIMESTAMP, decision BOOLEAN"
    want = {}
    for k, i, ts in calls:
        hits = [(d[2], d[1], bool(d[3])) for d in decs if k is not None and d[0] == k and 0 <= (d[2] - ts).total_seconds() <= 300]
        want[i] = (min(hits)[1], "approved" if min(hits)[2] else "rejected") if hits else (None, "timed_out")
    spark.createDataFrame(calls + [(99, -1, s(100_000))], cs).write.parquet(f"{tmp}/c")
    spark.createDataFrame(decs + [(99, -2, s(100_000), True)], ds).write.parquet(f"{tmp}/d")
    for splits in (1, 3):
        out_df = approvals_stream(spark.readStream.schema(cs).parquet(f"{tmp}/c"),
                                  spark.readStream.schema(ds).parquet(f"{tmp}/d"), timeout_s=300, delay="1 minute", splits=splits)
        q, out = run_to_table(out_df, spark, "hot", "append", checkpoint=f"{tmp}/ck{splits}")
        q.awaitTermination()
        got = {r.call_id: (r.decision_id, r.outcome) for r in spark.read.parquet(out).collect()}
        got.pop(-1, None)
        assert got == want
        # one row a call and splits + 1 a decision at most, never a pair
        state = sum(op["customMetrics"].get("rocksdbPutCount", 0) for p in q.recentProgress for op in p["stateOperators"])
        rows = max(p["numInputRows"] for p in q.recentProgress)
        assert rows == len(calls) + len(decs) + 2 and state < 40 * rows


def test_log_tail_cuts_a_hot_job_before_its_task(spark, tmp):
    from weft.streaming import streams

    table = __import__("pyarrow").table({"job_id": ["a"] * 6 + [None] * 3 + ["b"], "seq": [*range(6), 1, 2, 3, 7],
                                         "line": ["x"] * 10})
    cut = streams.last_per_job(table, 2).to_pylist()
    assert [(r["job_id"], r["seq"]) for r in cut] == [("a", 5), ("a", 4), ("b", 7), (None, 3), (None, 2)]
    big = spark.range(0, 60_000, numPartitions=6).select(F.lit("hot").alias("job_id"), F.col("id").alias("seq"),
                                                         F.col("id").cast("string").alias("line"))
    big.write.json(f"{tmp}/logs")
    seen = f"{tmp}/seen"
    tail = log_tail(stream_log(spark, f"{tmp}/logs"), 5, salts=4)
    plan = tail._jdf.queryExecution().logical().toString()
    assert plan.count("MapInArrow") == 2 and plan.index("MapInArrow") > 0
    q, out = run_to_table(tail, spark, "hot", "update", checkpoint=f"{tmp}/ck")
    q.awaitTermination()
    assert sorted(r.seq for r in spark.read.parquet(out).collect()) == list(range(59_995, 60_000))
    rows_in = [op["numRowsUpdated"] for p in q.recentProgress for op in p["stateOperators"]]
    assert max(rows_in) <= 10 and not os.path.exists(seen)


def test_log_tail_of_idle_jobs_expires(spark, tmp):
    import time

    def seen(out, line, seconds=40):
        end = time.time() + seconds
        while time.time() < end:
            try:
                rows = spark.read.parquet(out).collect()
            except Exception:  # noqa: BLE001  (no batch written yet)
                rows = []
            hit = [r.batch for r in rows if r.line == line]
            if hit:
                return sorted(r.line for r in rows if r.batch == hit[0])
            time.sleep(0.5)
        return None

    _write_lines(f"{tmp}/logs/0.json", [json.dumps({"job_id": "j", "seq": 1, "line": "old"})])
    tail = log_tail(stream_log(spark, f"{tmp}/logs"), 3, ttl_ms=500)
    q, out = run_to_table(tail, spark, "ttl", "update", trigger="200 milliseconds", checkpoint=f"{tmp}/ck")
    try:
        assert seen(out, "old") == ["old"]
        time.sleep(1.5)
        _write_lines(f"{tmp}/logs/1.json", [json.dumps({"job_id": "j", "seq": 2, "line": "new"})])
        assert seen(out, "new") == ["new"]
    finally:
        q.stop()


def test_approvals_stream_has_no_python_state_and_reaches_a_whole_timeout(spark, tmp):
    """state is Spark's own aggregate; windows that do not divide the time-out lose no decision."""
    us = lambda k: dt.datetime(2024, 3, 1) + dt.timedelta(microseconds=k)
    off = int((dt.datetime(2024, 3, 1) - dt.datetime(1970, 1, 1)).total_seconds() * 1_000_000) % 333_334
    off_old = int((dt.datetime(2024, 3, 1) - dt.datetime(1970, 1, 1)).total_seconds() * 1_000_000) % 333_333
    calls = [(1, 1, us(333_332 - off_old)), (2, 2, us(333_333 - off)), (None, 3, us(0)), (4, None, us(0)), (5, 5, us(0))]
    decs = [(1, 11, us(1_333_332 - off_old), True), (2, 12, us(1_333_334 - off), True), (4, 14, us(1), False),
            (5, None, us(7), True), (5, 15, us(7), None), (5, 16, us(7), True)]
    cs = "session_id LONG, call_id LONG, ts TIMESTAMP"
    ds = "session_id LONG, decision_id LONG, ts TIMESTAMP, decision BOOLEAN"
    spark.createDataFrame(calls + [(9, 99, us(10**9))], cs).write.parquet(f"{tmp}/c")
    spark.createDataFrame(decs + [(9, 98, us(10**9), True)], ds).write.parquet(f"{tmp}/d")
    out_df = approvals_stream(spark.readStream.schema(cs).parquet(f"{tmp}/c"),
                              spark.readStream.schema(ds).parquet(f"{tmp}/d"), timeout_s=1, delay="1 second", splits=3)
    assert "TransformWithState" not in out_df._jdf.queryExecution().logical().toString()
    q, out = run_to_table(out_df, spark, "w", "append", checkpoint=f"{tmp}/ck")
    q.awaitTermination()
    got = {r.session_id: (r.call_id, r.decision_id, r.outcome) for r in spark.read.parquet(out).collect()}
    got.pop(9, None)
    assert got == {1: (1, 11, "approved"), 2: (2, None, "timed_out"), None: (3, None, "timed_out"),
                   4: (None, 14, "rejected"), 5: (5, 15, "rejected")}


def test_log_tail_groups_jobs_and_keeps_nulls(spark, tmp):
    """jobs share a state and a call; only jobs with new lines are handed on."""
    big = 2**60
    recs = [(f"j{i % 5}", big + i, f"l{i}") for i in range(20)] + [(None, 1, "n"), (None, None, "o"), ("j9", 5, None)]
    schema = "job_id STRING, seq LONG, line STRING"
    spark.createDataFrame(recs, schema).coalesce(1).write.json(f"{tmp}/logs")
    tail = log_tail(stream_log(spark, f"{tmp}/logs"), 2)
    plan = tail._jdf.queryExecution().logical().toString()
    assert "TransformWithState" not in plan
    q, out = run_to_table(tail, spark, "g", "update", checkpoint=f"{tmp}/ck")
    q.awaitTermination()
    got = sorted(((r.job_id, r.pos, r.seq, r.line) for r in spark.read.parquet(out).collect()), key=str)
    want = [(f"j{j}", p, big + 20 - 5 * p + j, f"l{20 - 5 * p + j}") for j in range(5) for p in (1, 2)]
    assert got == sorted(want + [(None, 1, 1, "n"), (None, 2, None, "o"), ("j9", 1, 5, None)], key=str)
    _write_lines(f"{tmp}/logs/1.json", [json.dumps({"job_id": "j3", "seq": big + 99, "line": "new"})])
    q, out = run_to_table(log_tail(stream_log(spark, f"{tmp}/logs"), 2), spark, "g", "update", checkpoint=f"{tmp}/ck")
    q.awaitTermination()
    assert sorted((r.job_id, r.pos, r.line) for r in spark.read.parquet(out).collect()) == [("j3", 1, "new"), ("j3", 2, "l18")]


def test_landing_keeps_only_written_columns_between_its_writes(spark, tmp, monkeypatch):
    """the parsed record and its fields are not held beside what is written."""
    from pyspark.sql import DataFrame

    kept = []
    persist = DataFrame.persist
    for cls in {DataFrame, type(spark.range(1))}:
        if "persist" in vars(cls):
            persist = cls.persist
            monkeypatch.setattr(cls, "persist", lambda self, *a, _p=persist: (kept.append(self.columns), _p(self, *a))[1])
    _write_lines(f"{tmp}/land/a.jsonl", ['{"text":"a"}', '{"x":1}'])
    landing_to_prepared(spark, f"{tmp}/land", f"{tmp}/out", f"{tmp}/quar").awaitTermination()
    assert kept == [["format", "text", "record", "value"]]
    row = spark.read.parquet(f"{tmp}/out").drop("batch").collect()
    assert [tuple(r) for r in row][0][:2] == ("text", "a") and len(row) == 1
    assert [r.value for r in spark.read.parquet(f"{tmp}/quar").collect()] == ['{"x":1}']
