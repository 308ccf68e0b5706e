"""Mixing sources to target weights: Sainte-Lague apportionment of token blocks.

1. Every source gets a target: its weight's part of ``share`` times all words,
   never above ``cap`` times its own words; what a stopped target leaves over is
   shared again by weight until none is above.
2. The words are seats given to the sources of highest quotients target / (2 s + 1), then
   gathered into blocks of equal size (``block_words``; smaller for a source whose target is
   only a few of them); a source's blocks are given to its shards the same way, by the
   shards' words.
3. In each shard documents stand in a seeded order on a line of words, cut into
   blocks.  A quota of q blocks takes every block ``q // blocks`` times and the
   rest by a seeded permutation, so no block is taken more than ``cap`` times (rounded
   up) and a document never more than that.

``taken`` counts the words of a document in taken blocks, repeats counted.
``copies`` is a plan in whole documents: with the documents of a shard in order of size, the running
sum of taken / size is rounded, so a shard's copies hold its taken words to within its largest
document.  Both are the same in every run (the order is a hash of seed, id and text).

Shards: a source has as many as its words need at ``SHARD_WORDS`` each (more
words a shard if there would be over ``MAX_SHARDS``), so a source with a third of
all rows is spread over many tasks.

Cases: null or empty text has size 0 and takes nothing; a null source is a
source of its own, last in order; equal rows are interchangeable (they share a shard, whatever the
partitions, so that reruns agree); an empty table gives an empty result; columns named like
the added ones are replaced, others keep any name.
"""

from __future__ import annotations

from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Words of a block; least words of a shard; most shards of a mix (about).
BLOCK_WORDS = 64
#: Blocks that a source's target holds at least (down to blocks of one word).
LEAST_BLOCKS = 32
SHARD_WORDS = 1 << 16
MAX_SHARDS = 1 << 20


def n_words(text: str) -> F.Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a column (null: 0)."""
    runs = F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+"))
    return F.coalesce(runs, F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], share: float, cap: float) -> list[float]:
    """Shares of ``share * sum(sizes)`` by weight, each at most ``cap * size``."""
    left = share * sum(sizes)
    out = [0.0] * len(sizes)
    open_ = [i for i, s in enumerate(sizes) if s > 0]
    while open_:
        total = sum(weights[i] for i in open_)
        stopped = [i for i in open_ if left * weights[i] / total > cap * sizes[i]]
        if not stopped:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in stopped:
            out[i] = cap * sizes[i]
            open_.remove(i)
        left -= sum(out[i] for i in stopped)
    return out


def sainte_lague(votes: np.ndarray, seats: int, limit: np.ndarray | None = None) -> np.ndarray:
    """Seats by highest quotients votes / (2 s + 1); ties to the earlier entry.

    The quotient of the last seat is found by bisection, then the few seats at
    the edge one by one, so the work does not grow with the number of seats.
    ``limit`` bounds an entry's seats.
    """
    votes = np.asarray(votes, dtype=np.float64)
    n = len(votes)
    limit = np.full(n, seats) if limit is None else np.minimum(limit, seats).astype(np.int64)
    seats = int(min(seats, limit[votes > 0].sum())) if n else 0
    out = np.zeros(n, dtype=np.int64)
    if seats <= 0 or not (votes > 0).any():
        return out

    def at(q: float) -> np.ndarray:  # seats whose quotient is q or more
        return np.minimum(np.floor((votes / q + 1) / 2).astype(np.int64), limit)

    lo, hi = votes[votes > 0].min() / (2.0 * seats + 3), votes.max() * 1.01
    while at(lo).sum() < seats:
        lo /= 2
    for _ in range(200):
        mid = (lo * hi) ** 0.5
        if at(mid).sum() >= seats:
            lo = mid
        else:
            hi = mid
        if hi / lo < 1 + 1e-15:
            break
    out = at(hi)
    for _ in range(seats - int(out.sum())):
        q = np.where(out < limit, votes / (2 * out + 1), -1.0)
        out[int(np.argmax(q))] += 1
    return out


def mix(docs: DataFrame, weights: list[float], share: float = 1.5, cap: float = 2.0, source_col: str = "source",
        id_col: str = "doc_id", text_col: str = "text", seed: int = 20, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` plus ``size, source_size, target, taken, copies`` (they replace
    columns of those names).  ``weights`` repeat over the sources in code point
    order, null last.

    One row a source and one number a shard reach the driver: sources are what
    the mix is configured by, and a shard stands for ``SHARD_WORDS`` words.
    """
    spark = docs.sparkSession
    added = ("size", "source_size", "target", "taken", "copies")
    docs = docs.drop(*added)
    sized = docs.select(F.struct(*docs.columns).alias("row"), n_words(text_col).alias("size"), F.col(source_col).alias("source"),
                        F.col(id_col).alias("id"),
                        F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("order"))
    per_source = sized.groupBy("source").agg(F.sum("size").alias("size")).collect()
    per_source = sorted(((r["source"], int(r["size"])) for r in per_source), key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [s for _, s in per_source]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share, cap)
    blocks_of = [int(max(1, min(block_words, g // LEAST_BLOCKS))) for g in goal]
    shard_words = max(SHARD_WORDS, -(-sum(sizes) // MAX_SHARDS))
    shards = [max(1, -(-s // shard_words)) for s in sizes]
    plan = spark.createDataFrame([(name, s, t, k, b, i) for i, ((name, s), t, k, b) in
                                  enumerate(zip(per_source, goal, shards, blocks_of, strict=True))],
                                 "name string, source_size long, target double, shards int, block int, number int")
    # a few columns a source: joined by hash, broadcast by Spark while it is small
    line = sized.join(plan, F.col("source").eqNullSafe(F.col("name"))).drop("name", "source")
    line = line.withColumn("shard", F.pmod(F.xxhash64("order"), F.col("shards")).cast("int"))

    quotas = _quotas(line, goal, blocks_of, cap)
    w = Window.partitionBy("number", "shard")
    line = line.withColumn("end", F.sum("size").over(
        w.orderBy("order", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    line = line.join(quotas, ["number", "shard"])
    begin, end, width = F.col("end") - F.col("size"), F.col("end"), F.col("block")

    def once_more(block):  # a seeded permutation of the shard's blocks puts this one among the drawn
        return F.pmod(F.col("a") * block + F.col("b"), F.col("blocks")) < F.col("rest")

    def overlap(block):
        words = F.least(end, (block + 1) * width) - F.greatest(begin, block * width)
        return F.when(once_more(block), words).otherwise(0).cast("long")

    some = F.col("size") > 0
    hit = F.sequence(F.floor(begin / width), F.floor((end - 1) / width))
    drawn = F.aggregate(F.transform(hit, overlap), F.lit(0).cast("long"), lambda x, y: x + y)
    line = line.withColumn("taken", F.when(some, F.col("each") * F.col("size") + drawn).otherwise(0).cast("long"))
    part = F.when(some, F.col("taken") / F.col("size")).otherwise(0.0)
    upto = F.sum(part).over(w.orderBy("size", "order", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # rounded first: sums of the same parts must not differ by their order
    rounded = F.floor(F.round(upto, 6) + 0.5)
    before = F.floor(F.round(upto - part, 6) + 0.5)
    line = line.withColumn("copies", F.when(some, F.least(rounded - before, F.ceil(part))).otherwise(0).cast("int"))
    # documents of one size side by side would make batches of very different weight
    return line.sortWithinPartitions("number", "shard", "order", "id").select("row.*", *added)


def _quotas(line: DataFrame, goal: list[float], blocks_of: list[int], cap: float) -> DataFrame:
    """(number, shard, blocks, each, rest, a, b) of every shard: each
    block is taken ``each`` times, and those with ``(a * block + b) mod
    blocks < rest`` once more.

    A source's seats are known here; its shards' are computed where its shard
    sizes meet, one group a source of at most MAX_SHARDS rows.
    """
    words_of = sainte_lague(np.array(goal), int(round(sum(goal))))

    def allot(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        number = int(key[0])
        pdf = pdf.sort_values("shard")
        words = pdf["words"].to_numpy()
        width = blocks_of[number]
        blocks = -(-words // width)
        quota = sainte_lague(words, int(round(words_of[number] / width)), np.floor(blocks * cap).astype(np.int64))
        n = np.maximum(blocks, 1)
        steps, shifts = [], []
        for shard, k in zip(pdf["shard"], n, strict=True):
            rng = np.random.default_rng([number, int(shard)])
            step = int(rng.integers(1, k + 1))
            while gcd(step, int(k)) != 1:
                step += 1
            steps.append(step)
            shifts.append(int(rng.integers(0, k)))
        return pd.DataFrame({"number": number, "shard": pdf["shard"], "blocks": n, "each": quota // n,
                             "rest": quota % n, "a": steps, "b": shifts})

    return (line.groupBy("number", "shard").agg(F.sum("size").alias("words"))
            .groupBy("number").applyInPandas(
                allot, "number int, shard int, blocks long, each long, rest long, a long, b long"))
