"""Plan shape checks: the things that matter at scale."""

import re

SF = "/root/testdata/sf0.001"


def _executed(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("== Initial Plan ==")[0]  # AQE: the plan that ran


def test_packing_has_no_single_partition_window_over_rows(spark):
    from weft.plans.sequence_queries import chat_packs_df

    plan = _executed(chat_packs_df(spark, SF))
    lines = [ln.strip(" :+-") for ln in plan.split("\n")]
    exchanges = [ln for ln in lines if ln.startswith("Exchange ")]
    # the only SinglePartition exchange feeds the one-row-per-shard offsets
    single = [ln for ln in exchanges if ln.startswith("Exchange SinglePartition")]
    assert len(single) <= 1
    # turns are combined map-side per conversation and shuffled once (the
    # exchange is reused for the totals); only one row per conversation moves
    # to the range shards
    assert any(ln.startswith("ReusedExchange") for ln in lines)
    assert len([ln for ln in exchanges if ln.startswith("Exchange hashpartitioning(conv_id")]) == 1
    assert any("partial_sum" in ln for ln in lines)


def test_rule_classification_is_a_projection(spark):
    import __spark_entry__ as E

    plan = _executed(E.queries()["command_policy"](spark, SF))
    assert "Join" not in plan and "Exchange" not in plan


def test_tier_lookup_has_no_shuffle(spark):
    import __spark_entry__ as E

    plan = _executed(E.queries()["quantity_tier"](spark, SF))
    assert "Exchange" not in plan


def test_scan_prunes_columns(spark):
    import __spark_entry__ as E

    plan = _executed(E.queries()["doc_tokens"](spark, SF))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert "lang" not in schema and "source" not in schema


def test_tail_uses_group_limit(spark):
    import __spark_entry__ as E

    df = E.queries()["event_tail"](spark, SF)
    assert "WindowGroupLimit" in _executed(df)


def test_collect_messages_is_one_shuffle(spark):
    from weft.operators.records import collect_messages

    df = collect_messages(spark.read.parquet(f"{SF}/conversations.parquet"))
    plan = _executed(df)
    lines = [ln.strip(" :+-") for ln in plan.split("\n")]
    assert len([ln for ln in lines if ln.startswith("Exchange ")]) == 1


def test_many_rules_meet_commands_by_index(spark, monkeypatch):
    from weft.operators import agent_log

    monkeypatch.setattr(agent_log, "MAX_INLINE_RULES", 2)
    rules = spark.createDataFrame(agent_log.default_block_rules(), "rule_id INT, pattern STRING")
    cmds = spark.createDataFrame([("rm -rf /",), ("ls",)], "cmd STRING")
    plan = _executed(agent_log.classify_commands(cmds, "cmd", rules))
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_ladders_of_every_size_have_no_nested_loop(spark, monkeypatch):
    from weft.operators import ops_tables

    df = spark.createDataFrame([(1.0,), (20.0,)], "v DOUBLE")
    ladder = spark.range(5000).selectExpr("CAST(id AS DOUBLE) AS lo", "CAST(id AS STRING) AS name")
    plan = _executed(ops_tables.ladder_lookup(df, "v", ladder))
    assert "Join" not in plan and "Exchange" not in plan
    monkeypatch.setattr(ops_tables, "MAX_SEARCHED_LADDER", 2)
    plan = _executed(ops_tables.ladder_lookup(df, "v", ladder))
    assert "Join" not in plan


def test_tail_of_a_hot_key_is_a_tree_of_two_limits(spark):
    from pyspark.sql import functions as F

    from weft.operators.ops_tables import tail_per_key

    df = spark.range(0, 10000, numPartitions=50).select(F.when(F.col("id") >= 0, "hot").otherwise("x").alias("k"), "id")
    out = tail_per_key(df, "k", [F.col("id").desc()], 5, salts=4)
    plan = _executed(out)
    lines = [ln.strip(" :+-") for ln in plan.split("\n")]
    assert len([ln for ln in lines if ln.startswith("Window ")]) == 2 and plan.count("WindowGroupLimit") >= 3
    assert sorted(r.id for r in out.collect()) == list(range(9995, 10000))


def test_doc_packing_scans_and_tokenizes_once(spark):
    import __spark_entry__ as E

    for name in ("doc_packs", "hash_order_batches"):
        plan = _executed(E.queries()[name](spark, SF))
        lines = [ln.strip(" :+-") for ln in plan.split("\n")]
        assert len([ln for ln in lines if ln.startswith("FileScan")]) == 1, name
        assert any(ln.startswith("ReusedExchange") for ln in lines), name
