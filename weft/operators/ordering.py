"""Exact global running sums without a global window.

A running sum over the whole table (packing offsets, global row numbers) is,
written naively, ``sum(w) over (order by k)`` with no partition: Spark moves
every row to one task.  Here the same numbers come from three distributed
steps and one shuffle:

1. contiguous *range shards* of the order key: boundaries are approximate
   quantiles of the key (one small driver round trip, ``n_shards`` numbers),
   and each row finds its shard by binary search (``Bucketizer``);
2. rows are partitioned by shard number once; per-shard totals are summed on that
   partitioning, and their exclusive prefix sums (one row per shard, a proven
   bound) are broadcast back;
3. inside each shard a running sum in key order, plus the shard's offset.

The result equals the global window row for row.  The primary order key must
be (nearly) unique -- equal key values share a shard -- which holds for the
ids and hashes the callers use.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.session import scratch_dir

SHARD = "_shard"


def default_shards(df: DataFrame) -> int:
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(1, n)


def shard_bounds(df: DataFrame, key: str, n_shards: int) -> list[float]:
    """Strictly increasing inner boundaries of ``n_shards`` range shards."""
    if n_shards <= 1:
        return []
    probs = [i / n_shards for i in range(1, n_shards)]
    rel_err = 1.0 / (4 * n_shards)
    q = df.select(F.col(key).cast("double").alias(key)).approxQuantile(key, probs, rel_err)
    return sorted({float(b) for b in q if b is not None})


def with_range_shards(df: DataFrame, key: str, n_shards: int | None = None,
                      bounds: list[float] | None = None) -> DataFrame:
    """Add ``_shard`` (contiguous key ranges) and partition the rows by it.

    One shuffle.  Later ``groupBy(_shard, ...)`` and
    ``Window.partitionBy(_shard)`` reuse this partitioning without another.
    """
    dtype = df.schema[key].dataType
    if not isinstance(dtype, T.NumericType):
        raise TypeError(f"range shards need a numeric order key; {key} is {dtype.simpleString()} "
                        "(hash or rank it first, e.g. sequences.hash_order_key)")
    n_shards = n_shards or default_shards(df)
    if bounds is None:
        bounds = shard_bounds(df, key, n_shards)
    if not bounds:
        return df.withColumn(SHARD, F.lit(0)).repartition(SHARD)
    splits = [float("-inf")] + bounds + [float("inf")]
    tmp = f"{SHARD}_key"
    keyed = df.withColumn(tmp, F.col(key).cast("double"))
    b = Bucketizer(splits=splits, inputCol=tmp, outputCol=SHARD, handleInvalid="keep")
    out = b.transform(keyed).withColumn(SHARD, F.coalesce(F.col(SHARD).cast("int"), F.lit(0))).drop(tmp)
    # shard i is partition i (the last one takes NaN): no two shards meet by hash
    return out.repartitionById(len(bounds) + 2, F.col(SHARD))


def _measure(field: T.StructField) -> Column:
    c, t = F.col(field.name), field.dataType
    if isinstance(t, (T.StringType, T.BinaryType)):
        return F.octet_length(c)
    if isinstance(t, (T.ArrayType, T.MapType)):
        return F.size(c)
    return c if isinstance(t, T.AtomicType) else F.when(c.isNotNull(), 1)


def running_offsets(sharded: DataFrame, order: list, weight: str | Column,
                    start_col: str = "_start") -> DataFrame:
    """Exclusive global running sum of ``weight`` in ``order``.

    ``sharded`` must come from :func:`with_range_shards` (possibly followed by
    partition-preserving steps); ``order`` is the full, unique sort order whose
    first column is the shard key.
    """
    w = weight if isinstance(weight, Column) else F.col(weight)
    rows = sharded.withColumn("_w", w.cast("long"))
    # The totals read the same columns as the main branch (``_seen`` looks at each,
    # which keeps column pruning from narrowing their side), so both sides plan the
    # identical shard exchange and Spark reuses it: one scan, one shuffle.  The
    # aggregate holds numbers only: of strings and arrays their sizes.
    seen = [F.coalesce(F.max(_measure(f)).isNotNull().cast("int"), F.lit(0)) for f in sharded.schema if f.name != SHARD]
    totals = rows.groupBy(SHARD).agg(F.sum("_w").alias("_tot"), reduce(Column.__add__, seen).alias("_seen"))
    # One row per shard: a single-partition window here is bounded by n_shards.
    # (always true; the filter keeps ``_seen`` in the plan)
    offsets = totals.where(F.col("_seen") >= 0).select(
        SHARD,
        (F.sum("_tot").over(Window.orderBy(SHARD).rowsBetween(Window.unboundedPreceding, 0))
         - F.col("_tot")).alias("_off"),
    )
    inner = Window.partitionBy(SHARD).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.join(F.broadcast(offsets), SHARD, "left")
        .withColumn(start_col, F.col("_off") + F.sum("_w").over(inner) - F.col("_w"))
        .drop("_off", "_w")
    )


def global_row_number(df: DataFrame, order: list, key: str, rn_col: str = "rn",
                      n_shards: int | None = None) -> DataFrame:
    """1-based ``row_number() over (order by ...)`` computed shard-wise."""
    sharded = with_range_shards(df, key, n_shards)
    return running_offsets(sharded, order, F.lit(1), "_rn0").withColumn(
        rn_col, F.col("_rn0") + 1).drop("_rn0", SHARD)


def nth_key(keys: DataFrame, n: int) -> tuple[tuple, int, object] | None:
    """The ``n``-th row (from 1) of ``keys`` sorted by all its columns ascending, how many
    rows are smaller, and the schema; None if there are fewer than ``n`` rows.

    Keys are range-partitioned, sorted and written with their place (partition and
    row in it); one count a partition and one row come to the driver.
    """
    spark, names = keys.sparkSession, keys.columns
    parts = default_shards(keys)
    path = scratch_dir(spark, "keys")
    (keys.repartitionByRange(parts, *names).sortWithinPartitions(*names)
     .withColumn("_place", F.monotonically_increasing_id()).write.parquet(path))
    placed = spark.read.parquet(path)
    sizes = placed.groupBy(F.shiftright("_place", 33).alias("p")).count().orderBy("p").collect()
    before = 0
    for p, size in sizes:
        if before + size >= n:
            at = (p << 33) + n - before - 1
            row = placed.where(F.col("_place") == at).select(*names).first()
            schema = placed.select(*names).schema
            k = F.struct(*names)
            lit = F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, schema.fields, strict=True)])
            return tuple(row), placed.where(k < lit).count(), schema
        before += size
    return None


def keyed_running_sum(df: DataFrame, key: str, bucket: Column, order: list,
                      weight: Column, out_col: str) -> DataFrame:
    """Inclusive running sum of ``weight`` per ``key`` in ``order``, split by
    ``bucket`` (a coarse, order-compatible column such as the day).

    ``sum(w) over (partition by key order by ...)`` puts a hot key in one task.
    Here rows are partitioned by (key, bucket); per-bucket totals and their
    prefix over buckets (one row per key and bucket) are joined back, and the
    row-level window runs per (key, bucket).
    """
    d = (df.withColumn("_b", bucket).withColumn("_w", weight.cast("long"))
         .repartition(key, "_b"))
    tot = d.groupBy(key, "_b").agg(F.sum("_w").alias("_tot"))
    offs = tot.select(F.col(key).alias("_k"), F.col("_b").alias("_kb"), (F.sum("_tot").over(
        Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
        - F.col("_tot")).alias("_off"))
    inner = Window.partitionBy(key, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # null keys are a key of their own
    same = F.col(key).eqNullSafe(F.col("_k")) & F.col("_b").eqNullSafe(F.col("_kb"))
    return (d.join(offs, same, "left")
            .withColumn(out_col, F.col("_off") + F.sum("_w").over(inner))
            .drop("_b", "_w", "_off", "_k", "_kb"))
