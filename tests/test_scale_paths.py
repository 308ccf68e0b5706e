"""The size- and skew-dependent code paths, forced on small inputs."""

import datetime as dt
import random

from pyspark.sql import functions as F

from weft.functions.chat import ChatTemplate, render_chat
from weft.operators import agent_log
from weft.operators.agent_log import match_approvals
from weft.operators.ops_tables import first_wins, group_value_stats
from weft.operators.ordering import keyed_running_sum
from weft.operators.records import limit_written
from weft.operators.sequences import token_length
from weft.sources.files import read_table
from weft.sources.sinks import write_run_meta


def test_limit_written_keys_of_any_type_and_ties(spark):
    rows = [(f"k{i % 50:03d}" if i % 7 else None, i % 3, "text" if i % 5 else None) for i in range(3000)]
    df = spark.createDataFrame(rows, "k STRING, v INT, format STRING").repartition(6)
    mapped = sorted([r[:2] for r in rows if r[2]], key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    for n in (1, 100, 1700, 2400, 5000):
        got = limit_written(df, n, [F.col("k"), F.col("v")]).collect()
        assert sorted(((r.k, r.v) for r in got), key=lambda r: (r[0] is not None, r[0] or "", r[1])) == mapped[:n]
    # ties on the order are taken by the rest of the row, whatever the partitions
    cut = [sorted(map(tuple, limit_written(d, 1000, [F.col("k")]).collect()), key=str) for d in (df, df.coalesce(1))]
    assert cut[0] == cut[1] and len(cut[0]) == 1000


def test_keyed_running_sum_with_hot_key(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(0 if i % 3 == 0 else i % 7, base + dt.timedelta(hours=i), i, 1) for i in range(600)]
    rows += [(None, base + dt.timedelta(hours=7 * i), 1000 + i, 1) for i in range(20)]  # a null key is a key
    df = spark.createDataFrame(rows, "k LONG, ts TIMESTAMP, id LONG, w INT")
    out = keyed_running_sum(df, "k", F.to_date("ts"), [F.col("ts"), F.col("id")], F.col("w"), "c")
    got = {r.id: r.c for r in out.collect()}
    seen = {}
    for k, ts, i, w in sorted(rows, key=lambda r: (r[1], r[2])):
        seen[k] = seen.get(k, 0) + w
        assert got[i] == seen[k]


def test_approvals_hot_session_matches_pairs(spark, monkeypatch):
    rng = random.Random(11)
    t0 = dt.datetime(2024, 1, 1)
    calls, decs = [], []
    for i in range(400):
        s = 0 if i % 3 == 0 else rng.randint(1, 5)   # session 0 holds a third
        ts = t0 + dt.timedelta(seconds=rng.randint(0, 5000))
        (calls if i % 2 else decs).append((i, s, ts, rng.random() < 0.5))
    c = spark.createDataFrame([(i, s, ts) for i, s, ts, _ in calls], "event_id LONG, session_id LONG, ts TIMESTAMP")
    d = spark.createDataFrame(decs, "event_id LONG, session_id LONG, ts TIMESTAMP, decision BOOLEAN")
    got = {r.event_id: r.decision_id for r in match_approvals(c, d, timeout_s=300).collect()}
    finer = {r.event_id: r.decision_id for r in match_approvals(c, d, timeout_s=300, splits=4).collect()}
    assert finer == got
    monkeypatch.setattr(agent_log, "BUCKET_ROWS", 3)  # splits follow from the largest bucket
    both = c.selectExpr("session_id _k", "ts _ts").unionByName(d.selectExpr("session_id _k", "ts _ts"))
    assert agent_log._splits(both, 300) > 1
    assert {r.event_id: r.decision_id for r in match_approvals(c, d, timeout_s=300).collect()} == got
    for i, s, ts, _ in calls:
        cands = [(dts, j) for j, ds, dts, _ in decs
                 if ds == s and ts <= dts <= ts + dt.timedelta(seconds=300)]
        assert got[i] == (min(cands)[1] if cands else None)


def test_first_wins_and_median_with_hot_key(spark):
    rows = [("hot" if i % 3 == 0 else f"k{i % 5}", i % 4, f"p{i:04d}", float(i % 17)) for i in range(300)]
    df = spark.createDataFrame(rows, "key STRING, priority INT, path STRING, v DOUBLE")
    got = {r.key: r.path for r in first_wins(df, "key", [F.col("priority"), F.col("path")]).collect()}
    for k in {r[0] for r in rows}:
        assert got[k] == min((p, path) for kk, p, path, _ in rows if kk == k)[1]
    med = {r.key: r.upper_median for r in group_value_stats(df, "key", "v").collect()}
    for k in med:
        vs = sorted(v for kk, _, _, v in rows if kk == k)
        assert med[k] == vs[len(vs) // 2]


def test_custom_template_and_tokenizer_udf(spark):
    t = ChatTemplate(prefix="{role}: ", suffix="\n", overrides={"system": ("", "\n\n")})
    df = spark.createDataFrame([([("system", "be brief"), ("user", "hi")],)],
                               "m ARRAY<STRUCT<role: STRING, content: STRING>>")
    assert df.select(render_chat("m", t).alias("t")).first().t == "be brief\n\nuser: hi\n"
    d = spark.createDataFrame([("abc",), ("hello world",)], "t STRING")
    n = [r.n for r in d.select(token_length("t", lambda xs: [len(x) for x in xs]).alias("n")).collect()]
    assert n == [3, 11]


def test_read_table_prunes_partitions(spark, tmp):
    df = spark.createDataFrame([(i, "train" if i % 2 else "test") for i in range(10)], "id INT, split STRING")
    df.write.partitionBy("split").parquet(f"{tmp}/t")
    t = read_table(spark, f"{tmp}/t", "train")
    assert sorted(r.id for r in t.collect()) == [1, 3, 5, 7, 9]
    plan = t._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan


def test_run_meta(spark, tmp):
    write_run_meta(spark, f"{tmp}/runs", {"lr": 1e-4}, {"n_written": 3}, world_size=2)
    write_run_meta(spark, f"{tmp}/runs", {"lr": 2e-4}, {"n_written": 4}, world_size=2)
    assert spark.read.parquet(f"{tmp}/runs").count() == 2


def test_upper_median_many_distinct_values(spark):
    rng = random.Random(4)
    rows = [("hot" if i % 3 == 0 else f"g{i % 7}", float(rng.randint(0, 5000))) for i in range(3001)]
    rows += [("single", 5.0), ("pair", 1.0), ("pair", 2.0), ("neg", -3.0), ("neg", 0.0), ("neg", -0.5),
             ("neg", 7.0)]
    df = spark.createDataFrame(rows, "g STRING, v DOUBLE")
    got = {r.g: (r.upper_median, r.n, r.n_within) for r in group_value_stats(df, "g", "v", per_octave=2).collect()}
    for g in {r[0] for r in rows}:
        vs = sorted(v for gg, v in rows if gg == g)
        m = vs[len(vs) // 2]
        assert got[g] == (m, len(vs), sum(1 for v in vs if abs(v - m) <= 1.0))
