"""Operational tables: job logs and outcomes (P11, P14, A5), device samples
(P12, A2, A3, F5, F7), tier ladder lookup (J4), artifact matching (J5),
per-key tails (W1), first-source-wins listings (W4, U1, L2).
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.functions.text import col_
from weft.operators.substring_index import candidates
from weft.session import scratch_dir

# ---------------------------------------------------------------- fixed values

# Training tiers: name, per-device memory threshold in GB, context length,
# batch size, gradient accumulation; ascending by threshold.
TIERS = [
    ("xxs-4gb", 3.0, 256, 1, 64),
    ("xs-6gb", 6.0, 512, 1, 32),
    ("s-8gb", 7.0, 1024, 1, 16),
    ("s-12gb", 10.0, 1024, 1, 16),
    ("m-24gb", 16.0, 2048, 2, 8),
    ("l-48gb", 32.0, 4096, 4, 4),
    ("xl-80gb", 64.0, 4096, 8, 2),
    ("xxl-96gb", 88.0, 8192, 16, 1),
]
CPU_TIER = ("cpu", 0.0, 512, 1, 8)
TIER_SCHEMA = "name STRING, lo DOUBLE, max_length INT, batch_size INT, grad_accum INT"

HETEROGENEITY_TOLERANCE_GB = 1.0
USAGE_WARN_PCT = 70
USAGE_CRIT_PCT = 90
EXIT_MARKER_RE = r"^\[exit (-?\d+)\]$"
LOG_RING_LINES = 4000
LOG_TAIL_LINES = 50
EVENT_TAIL = 200

MAX_SEARCHED_LADDER = 1 << 13


def tier_ladder(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TIERS, TIER_SCHEMA)


# ---------------------------------------------------------------- W1

TAIL_SALTS = 32


def tail_per_key(df: DataFrame, key: str, order_desc: list, n: int,
                 pos_col: str = "pos", salts: int = TAIL_SALTS) -> DataFrame:
    """The last ``n`` rows per key (``order_desc`` puts the newest first).

    A tree of two limits: rows of a key meet by the task that read them, modulo ``salts``, and
    leave n a salt; these meet by key.  Before each shuffle ``row_number() <= n`` lets Spark
    keep n rows a group and task (window group limit), so a hot key sends one task n x
    ``salts`` rows, however many tasks read it.
    """
    salted = df.withColumn("_salt", F.spark_partition_id() % F.lit(salts))
    first = Window.partitionBy(key, "_salt").orderBy(*order_desc)
    cut = salted.withColumn(pos_col, F.row_number().over(first)).where(F.col(pos_col) <= n).drop("_salt", pos_col)
    w = Window.partitionBy(key).orderBy(*order_desc)
    return cut.withColumn(pos_col, F.row_number().over(w)).where(F.col(pos_col) <= n)


# ---------------------------------------------------------------- P11 / P14 / A5

def exit_code(line) -> Column:
    """N from a closing ``[exit N]`` line, else null."""
    return F.nullif(F.regexp_extract(col_(line), EXIT_MARKER_RE, 1), F.lit("")).try_cast("int")


def job_state(running, return_code) -> Column:
    """Running -> done (rc 0) -> failed (rc != 0) -> idle."""
    rc = col_(return_code)
    return (F.when(F.coalesce(col_(running), F.lit(False)), F.lit("running"))
            .when(rc == 0, F.lit("done"))
            .when(rc.isNotNull(), F.lit("failed"))
            .otherwise(F.lit("idle")))


def job_summary(log: DataFrame, job: str = "job_id", ts: str = "ts", seq: str = "seq",
                line: str = "line") -> DataFrame:
    """A5: per job -- lines, start, end, return code from the closing marker,
    duration and state.  A job whose last line is not a marker is running.
    Aggregates only (partial aggregation map-side)."""
    last = F.max_by(F.col(line), F.struct(F.col(ts), F.col(seq)))
    agg = log.groupBy(job).agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.min(ts).alias("started_at"),
        F.max(ts).alias("_last_ts"),
        last.alias("_last_line"))
    rc = exit_code(F.col("_last_line"))
    return (agg.withColumn("return_code", rc)
            .withColumn("ended_at", F.when(F.col("return_code").isNotNull(), F.col("_last_ts")))
            # Wall-clock seconds between the two stamps, with no time-zone shift
            # (works for TIMESTAMP and TIMESTAMP_NTZ alike).
            .withColumn("duration_s", F.expr("timestampdiff(SECOND, started_at, ended_at)"))
            .withColumn("state", job_state(F.col("ended_at").isNull(), F.col("return_code")))
            .drop("_last_ts", "_last_line"))


# ---------------------------------------------------------------- P12

def usage_pct(used, total) -> Column:
    """100 * used / total to one place; 0 when total is 0."""
    t = col_(total)
    return F.when((t == 0) | t.isNull(), F.lit(0.0)).otherwise(
        F.bround(F.lit(100.0) * col_(used) / t, 1))


def usage_band(pct) -> Column:
    p = col_(pct)
    return (F.when(p >= USAGE_CRIT_PCT, F.lit("crit")).when(p >= USAGE_WARN_PCT, F.lit("warn"))
            .otherwise(F.lit("ok")))


def latest_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """ST4 in batch: the newest row per key as ``max_by(struct(*), order)``,
    an aggregate (map-side partial), not a window."""
    others = [c for c in df.columns if c not in keys]
    latest = F.max_by(F.struct(*others), F.struct(*order)).alias("_r")
    return df.groupBy(*keys).agg(latest).select(*keys, "_r.*")


# ---------------------------------------------------------------- A3 / F5 / F7 / A2

def keep_ids(df: DataFrame, col: str, ids) -> DataFrame:
    """membership filter; a list becomes ``isin`` (pushed to the scan), a
    DataFrame a left-semi join."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select(F.col(ids.columns[0]).alias(col)).distinct(), col, "left_semi")
    return df.where(F.col(col).isin(list(ids)))


BINS_PER_OCTAVE = 16
#: Parts of a value range in one narrowing step; distinct values a group may rank in one task.
NARROW_PARTS = 256
RANKED_VALUES = 1 << 14


def log_bin(c: Column, per_octave: int = BINS_PER_OCTAVE) -> Column:
    """An order-preserving coarse bin of a number without a pass over the
    data: ``per_octave`` bins per power of two, mirrored for negatives, 0 on
    its own; infinities and NaN (last) have bins of their own.  (``log2`` is
    monotone, so ``floor(log2(v) * k)`` never reorders.)"""
    v = c.cast("double")
    zero = F.lit(1100 * per_octave)  # more than the smallest double is below 1
    pos = zero + F.floor(F.log2(v) * per_octave)
    neg = -(zero + F.floor(F.log2(-v) * per_octave))
    return (F.when(F.isnan(v), F.lit(1 << 41)).when(v == float("inf"), F.lit(1 << 40)).when(v == -float("inf"), F.lit(-1 << 40))
            .when(v > 0, pos).when(v < 0, neg).otherwise(F.lit(0)).cast("long"))


def _bin_of_rank(binned: DataFrame, group: str, rank: str) -> DataFrame:
    """The bin of each group that holds its rank: ``group, _bin, _lo, _hi`` (its least and
    greatest value), ``_d`` (distinct values) and ``_r``, the rank left inside it.
    ``binned`` has one row a (group, bin) with ``_bc`` (rows) and the group's ``rank``."""
    w = Window.partitionBy(group).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    cum = binned.withColumn("_cum", F.sum("_bc").over(w))
    return (cum.where((F.col("_cum") >= F.col(rank)) & (F.col("_cum") - F.col("_bc") < F.col(rank)))
            .withColumn("_left", F.col(rank) - (F.col("_cum") - F.col("_bc"))))


def group_value_stats(df: DataFrame, group: str, value: str,
                      tol: float = HETEROGENEITY_TOLERANCE_GB,
                      per_octave: int = BINS_PER_OCTAVE) -> DataFrame:
    """A3 and the counts F7 needs, per group: ``n``, ``upper_median``
    (``sorted(v)[n // 2]``; not ``percentile_disc(0.5)``, the lower median)
    and ``n_within`` (rows with ``|v - median| <= tol``).  NaN sorts last, as in Spark.

    Exact selection, without sorting a hot group in one task:
    1. rows -> (group, value, count), a map-side partial aggregate, written once;
    2. values fall into order-preserving log bins (:func:`log_bin`); per
       (group, bin) counts and their running sum over a group's few bins
       find the bin that holds rank ``n // 2 + 1`` and the rank left in it;
    3. while some group's bin holds more than RANKED_VALUES distinct values, the bin's value
       range is cut into NARROW_PARTS equal parts and the part that holds the rank is found
       the same way (counts only; linear cuts never reorder values);
    4. the few distinct values left are ranked per group.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, "values")
    (df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("_c"))
     .withColumn("_bin", log_bin(F.col(value), per_octave)).write.parquet(path))
    hist = spark.read.parquet(path)

    def counted(rows: DataFrame, keys: list[str], *more: Column) -> DataFrame:
        return rows.groupBy(*keys, "_bin").agg(F.sum("_c").alias("_bc"), F.min(value).alias("_lo"),
                                               F.max(value).alias("_hi"), F.count(F.lit(1)).alias("_d"), *more)

    bins = counted(hist, [group]).withColumn("n", F.sum("_bc").over(Window.partitionBy(group)))
    bins = bins.withColumn("_r", F.floor(F.col("n") / 2) + 1)
    left = _stored(_bin_of_rank(bins, group, "_r").select(group, "n", F.col("_left").alias("_r"), "_lo", "_hi", "_d"))
    while (left.agg(F.max("_d")).first()[0] or 0) > RANKED_VALUES:
        small = left.where(F.col("_d") <= RANKED_VALUES)
        wide = left.where(F.col("_d") > RANKED_VALUES)
        inside = hist.select(group, value, "_c").join(wide, group).where(F.col(value).between(F.col("_lo"), F.col("_hi")))
        lo, v = F.col("_lo").cast("double"), F.col(value).cast("double")
        # halves first: the difference of two finite numbers may overflow
        part = F.floor((v / 2 - lo / 2) / (F.col("_hi").cast("double") / 2 - lo / 2) * NARROW_PARTS)
        inside = inside.withColumn("_bin", F.least(part, F.lit(NARROW_PARTS - 1))).drop("_lo", "_hi", "_d")
        parts = counted(inside, [group, "n", "_r"])
        narrowed = _bin_of_rank(parts, group, "_r").select(group, "n", F.col("_left").alias("_r"), "_lo", "_hi", "_d")
        left = _stored(small.unionByName(narrowed))
    cand = hist.select(group, value, "_c").join(left, group).where(F.col(value).between(F.col("_lo"), F.col("_hi")))
    wv = Window.partitionBy(group).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    med = (cand.withColumn("_cum2", F.sum("_c").over(wv))
           .where((F.col("_cum2") >= F.col("_r")) & (F.col("_cum2") - F.col("_c") < F.col("_r")))
           .select(group, F.col(value).alias("upper_median"), "n"))
    within = (hist.join(med.select(group, "upper_median"), group)
              .where(F.abs(F.col(value) - F.col("upper_median")) <= tol)
              .groupBy(group).agg(F.sum("_c").alias("n_within")))
    return med.join(within, group, "left").withColumn("n_within", F.coalesce("n_within", F.lit(0)))


def _stored(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read back: lineage is cut there."""
    path = scratch_dir(df.sparkSession, "ranks")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def majority_subset(df: DataFrame, group: str, value: str,
                    tol: float = HETEROGENEITY_TOLERANCE_GB, only_if_many: bool = True) -> DataFrame:
    """keep rows within ``tol`` of their group's upper median; groups of
    one row (``only_if_many``) and groups where nothing is within keep all.
    The per-group stats table (one row per group) is joined back; AQE turns
    that join into a broadcast when the stats stage is small."""
    stats = group_value_stats(df, group, value, tol).select(group, "upper_median", "n", "n_within")
    j = df.join(stats, group, "left")
    keep_all = (F.col("n_within") == 0) | F.col("n").isNull()
    if only_if_many:
        keep_all = keep_all | (F.col("n") <= 1)
    return j.where(keep_all | (F.abs(F.col(value) - F.col("upper_median")) <= tol)).drop(
        "upper_median", "n", "n_within")


def group_rollup(df: DataFrame, group: str, value: str,
                 tol: float = HETEROGENEITY_TOLERANCE_GB) -> DataFrame:
    """A2: count, min, max, sum (2 places), heterogeneous (max - min > tol
    when count > 1), strategy ``ddp`` if count > 1 else ``single``."""
    return df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(value).alias("min_value"),
        F.max(value).alias("max_value"),
        F.bround(F.sum(value), 2).alias("sum_value"),
    ).withColumn("heterogeneous", (F.col("n") > 1) & ((F.col("max_value") - F.col("min_value")) > tol)) \
     .withColumn("strategy", F.when(F.col("n") > 1, F.lit("ddp")).otherwise(F.lit("single")))


# ---------------------------------------------------------------- J4

def ladder_lookup(df: DataFrame, value: str, ladder: DataFrame, lo: str = "lo",
                  name: str = "name", out_col: str = "tier", floor_name: str = "cpu") -> DataFrame:
    """The highest rung whose threshold is <= value; below the first
    threshold the first rung; null or <= 0 gives ``floor_name``; infinity and
    NaN the last rung; without rungs every row gets ``floor_name``.

    A ladder is a dimension table.  Up to MAX_SEARCHED_LADDER rungs its thresholds go to the tasks
    as one sorted array, and each row finds its rung by binary search: a projection, no join
    and no shuffle of the rows (plan test).  Longer ladders, which no task should hold whole, are
    merged by range (:func:`_merge_ladder`).  Both give the same rows (test).
    Thresholds that are null or NaN are no rungs; of equal thresholds the last by name counts.
    """
    rungs = ladder.select(F.col(lo).cast("double").alias("_lo"), F.col(name).alias("_nm")).where(
        F.col("_lo").isNotNull() & ~F.isnan("_lo")).groupBy("_lo").agg(F.max("_nm").alias("_nm"))
    some = rungs.limit(MAX_SEARCHED_LADDER + 1).collect()
    if not some:
        return df.withColumn(out_col, F.lit(floor_name))
    v = F.col(value)
    low = v.isNull() | (v <= 0)
    if len(some) > MAX_SEARCHED_LADDER:
        return _merge_ladder(df, value, rungs, out_col, floor_name)
    some.sort()
    if len(some) == 1:
        return df.withColumn(out_col, F.when(low, F.lit(floor_name)).otherwise(F.lit(some[0][1])))
    # intervals start at every rung but the first, which also takes what lies below it
    starts = [r[0] for r in some[1:]]
    splits = [float("-inf"), *(x for x in starts if abs(x) != float("inf")), float("inf")]
    names = F.lit([r[1] for r in some])
    at = Bucketizer(splits=splits, inputCol="_v", outputCol="_at", handleInvalid="keep")
    found = at.transform(df.withColumn("_v", F.coalesce(F.nanvl(v.cast("double"), F.lit(0.0)), F.lit(0.0))))
    tier = F.when(low, F.lit(floor_name)).when(v.cast("double") >= some[-1][0], F.lit(some[-1][1])) \
        .otherwise(F.get(names, F.col("_at").cast("int")))
    return found.withColumn(out_col, tier).drop("_v", "_at")


def _merge_ladder(df: DataFrame, value: str, rungs: DataFrame, out_col: str, floor_name: str,
                  rows_per_task: int = 1 << 20) -> DataFrame:
    """The as-of merge: rows and rungs are dealt by range of value and sorted together, and the
    last rung is carried forward.  Range bounds are rungs, so a range starts with its own first
    rung and needs nothing from the range before.  A range with many rows (one value
    may hold a third of them) is dealt over several tasks, its rungs copied to each."""
    spark = df.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted({b for b in rungs.approxQuantile("_lo", [i / shards for i in range(1, shards)], 0.25 / shards)
                     if abs(b) != float("inf")})
    v = F.col(value).cast("double")
    low = v.isNull() | (v <= 0)
    # Bucketizer searches half-open ranges; NaN counts as infinity
    ranged = Bucketizer(splits=[float("-inf"), *bounds, float("inf")], inputCol="_lo", outputCol="_shard",
                        handleInvalid="keep") if bounds else None

    def dealt(x: DataFrame) -> DataFrame:
        x = ranged.transform(x) if ranged else x.withColumn("_shard", F.lit(0))
        return x.withColumn("_shard", F.col("_shard").cast("int"))

    at = F.when(F.isnan(v), F.lit(float("inf"))).otherwise(v)
    rows = dealt(df.select(F.struct(*df.columns).alias("_row"), F.when(low, F.lit(None)).otherwise(at).alias("_lo"))
                 .where(F.col("_lo").isNotNull()))
    sizes = rows.groupBy("_shard").count().collect()  # one number a range
    copies = F.lit(1)
    for shard, n in sizes:
        if n > rows_per_task:
            copies = F.when(F.col("_shard") == shard, F.lit(-(-n // rows_per_task))).otherwise(copies)
    rows = rows.withColumn("_part", F.pmod(F.monotonically_increasing_id(), copies).cast("int"))
    steps = dealt(rungs).withColumn("_part", F.explode(F.sequence(F.lit(0), copies - 1)))
    first = rungs.agg(F.min_by("_nm", "_lo")).first()[0]
    both = rows.withColumn("_nm", F.lit(None).cast("string")).unionByName(
        steps.withColumn("_row", F.lit(None).cast(rows.schema["_row"].dataType)))
    w = Window.partitionBy("_shard", "_part").orderBy("_lo", F.col("_row").isNotNull()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    merged = both.withColumn("_tier", F.last("_nm", ignorenulls=True).over(w)).where(F.col("_row").isNotNull())
    merged = merged.select("_row.*", F.coalesce("_tier", F.lit(first)).alias(out_col))
    return merged.unionByName(df.where(low).withColumn(out_col, F.lit(floor_name)))


def dedupe_ladder(ladder: DataFrame, threshold: str, order: str = "lo") -> DataFrame:
    """Keep the lowest rung per repeated threshold value (e.g. max_length)."""
    return ladder.groupBy(threshold).agg(F.min_by("name", order).alias("name")).withColumnRenamed(
        threshold, "lo")


# ---------------------------------------------------------------- J5

def match_files(requests: DataFrame, files: DataFrame, repo: str = "repo_id",
                hint: str = "hint", file: str = "file", order: str = "ord",
                suffix: str = ".gguf") -> DataFrame:
    """Each (repo, hint) to the first file (in ``order``) of its repo whose
    lower-cased name contains the lower-cased hint with every ``suffix``
    removed; with no such file, an exact name match; else null.

    Requests are made distinct first.  A hint meets the files of its repo that hold
    its rarest gram (:mod:`substring_index`) and no others, so the pairs tested are few beside
    files x hints, whatever the repo's size; the exact name match is an equi-join.
    """
    req = requests.select(repo, hint).distinct().withColumn(
        "_needle", F.replace(F.lower(F.col(hint)), F.lit(suffix), F.lit("")))
    fl = files.where(F.lower(F.col(file)).endswith(suffix)).select(
        repo, F.col(file).alias("_file"), F.lower(F.col(file)).alias("_low"), F.col(order).alias("_ord"))
    hits = (hint_candidates(req, fl, repo).where(F.col("_low").contains(F.col("_needle")))
            .groupBy(repo, "_needle").agg(F.min_by("_file", "_ord").alias("_sub_file"),
                                          F.count(F.lit(1)).alias("n_matches")))
    same = fl.select(repo, F.col("_file").alias(hint)).distinct().withColumn("_exact", F.col(hint))
    # merge: a listing of many files may look small enough for a broadcast, by its size on disk
    found = req.join(hits.hint("merge"), [repo, "_needle"], "left").join(same.hint("merge"), [repo, hint], "left")
    return found.select(
        repo, hint,
        F.coalesce("_sub_file", "_exact").alias("file"),
        F.coalesce(F.col("n_matches"), F.lit(0)).cast("long").alias("n_matches"),
        F.when(F.col("_sub_file").isNotNull(), F.lit("substring"))
         .when(F.col("_exact").isNotNull(), F.lit("exact")).alias("match_kind"))


def hint_candidates(requests: DataFrame, files: DataFrame, repo: str) -> DataFrame:
    """The (file, needle) pairs that J5 tests: ``files`` (repo, _low, ..) that hold the rarest gram
    of a ``_needle`` of their repo."""
    needles = requests.where(F.col(repo).isNotNull()).select(repo, "_needle").distinct()
    return candidates(files, needles, "_low", "_needle", [repo])


# ---------------------------------------------------------------- U1 / W4 / L2

def union_roots(listings: list[tuple[str, DataFrame]]) -> DataFrame:
    """Listings in priority order, labelled ``source`` and ``priority``."""
    out = None
    for i, (label, df) in enumerate(listings):
        d = df.withColumn("source", F.lit(label)).withColumn("priority", F.lit(i))
        out = d if out is None else out.unionByName(d)
    return out


def first_wins(df: DataFrame, key: str, order: list) -> DataFrame:
    """One row per key, the first in ``order`` (priority, then path).
    ``min_by`` over a struct is an aggregate: a key present in a third of
    all rows is reduced map-side, never gathered into one window task."""
    others = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("_r")).select(
        key, "_r.*")
