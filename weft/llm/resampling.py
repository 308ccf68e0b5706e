"""Target-distribution importance resampling over hashed n-grams.

A document's words (lower-case only A-Z; runs of bytes that are digits, a-z or
not ASCII) are written with one space between them, and the running CRC register
of that normalised text is stored once at every word's start and end.  The CRC-32
of any run of 1 to 3 words then follows from two stored registers (``crc.py``), so no
n-gram is ever built as a string.  Its bucket is that CRC modulo ``BUCKETS``.

1. Bucket counts of all documents and of all target texts: one array a task, summed
   in Spark; two vectors of ``BUCKETS`` numbers reach the driver.
2. A bucket's gain is floor(1000 ln((t + 1)(S + BUCKETS) / ((s + 1)(T + BUCKETS)))),
   a document's weight the sum of gains of its n-grams, its score the weight plus
   seeded Gumbel noise floor(-1000 ln(-ln((h + 0.5) / 2^32))), h the first 8 hex digits
   of sha256("<seed>:<id>").
3. Of the documents with at least ``min_words`` words, the ``percent`` per cent
   (rounded down) of the highest scores are drawn, ties to the smaller id.  Narrow rows are
   range-partitioned by the whole order (a last key splits equal rows), sorted and
   written; a row's rank is its place in its partition plus the sizes of the earlier ones.

Cases: null or empty text has no n-gram, weight 0 and is never drawn; a null id counts
as empty text in the noise and comes last among ties; equal rows get different
ranks; an empty table gives an empty result, an empty target table T = 0.  Columns named
like the added ones are replaced.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.llm import crc
from weft.llm.knn import stored
from weft.llm.words import slices, text_buffer

BUCKETS = 10_000
MAX_WORDS = 3
ADDED = ("n_features", "weight", "score", "rank")

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, end, doc): all words, one space behind each; word i is
    ``bytes[start[i]:end[i]]``, the words of row d are ``doc[d] .. doc[d + 1] - 1``."""
    word = _WORD[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    cut = offsets[:-1][offsets[:-1] < len(data)]
    first[cut] |= word[cut]  # a text's first byte starts a word
    at = np.flatnonzero(first)
    doc = np.searchsorted(at, offsets, side="left")
    kept = _LOWER[data[word]]
    begin = np.cumsum(word)[at] - 1 if len(at) else np.zeros(0, np.int64)  # place among the kept bytes
    size = np.diff(np.append(begin, len(kept)))
    start = begin + np.arange(len(at))
    out = np.full(len(kept) + len(at), 32, dtype=np.uint8)
    inside = np.ones(len(out), dtype=bool)
    inside[start + size] = False
    out[inside] = kept
    return out, start, start + size, doc


def ngram_buckets(col: pa.Array, buckets: int = BUCKETS) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """([(first words, buckets) of the runs of 1, 2, .. MAX_WORDS words], doc)."""
    data, start, end, doc = normalised(*text_buffer(col))
    edges = np.empty(2 * len(start), dtype=np.int64)
    edges[0::2], edges[1::2] = start, end
    registers = crc.running(data, edges)
    left, right = registers[0::2], registers[1::2]
    last = np.repeat(doc[1:], np.diff(doc))  # end of each word's document
    runs = []
    for n in range(1, MAX_WORDS + 1):
        i = np.flatnonzero(np.arange(len(start)) + n <= last)
        j = i + n - 1
        runs.append((i, (crc.of_spans(left[i], right[j], end[j] - start[i]) % np.uint32(buckets)).astype(np.int64)))
    return runs, doc


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """N-grams of the whole table in each bucket."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for s in slices(batch, "text", 1 << 20):
                for _, b in ngram_buckets(s.column("text"), buckets)[0]:
                    total += np.bincount(b, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "bucket long, n long")
    for b, n in rows.groupBy("bucket").agg(F.sum("n")).collect():
        out[b] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    b = float(len(source))
    s_all, t_all = float(source.sum()) + b, float(target.sum()) + b
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all)))
                     for s, t in zip(source.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def noise(key: str, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", seed: int = 42,
          keep: list[str] | None = None) -> DataFrame:
    """(row, id, n_words, n_features, weight, score): ``row`` holds the columns ``keep``
    (default: all but the added names)."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ADDED] or [id_col]
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch, "text", 1 << 20):
                runs, doc = ngram_buckets(s.column("text"), len(shared.value))
                words = np.diff(doc)
                per_word = np.zeros(doc[-1], dtype=np.int64)
                for i, b in runs:
                    per_word[i] += shared.value[b]
                total = np.concatenate([[0], np.cumsum(per_word)])
                weight = total[doc[1:]] - total[doc[:-1]]
                number = sum(np.maximum(words - n, 0) for n in range(MAX_WORDS))
                extra = np.array([noise(k or "", seed) for k in s.column("key").to_pylist()], dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [s.column("row"), s.column("id"), *map(pa.array, (words, number, weight, weight + extra))], names)

    names = ["row", "id", "n_words", "n_features", "weight", "score"]
    narrow = docs.select(F.struct(*keep).alias("row"), F.col(id_col).alias("id"),
                         F.col(id_col).cast("string").alias("key"), F.col(text_col).alias("text"))
    schema = T.StructType([*(narrow.schema[c] for c in ("row", "id")),
                           *(T.StructField(c, T.LongType()) for c in names[2:])])
    return narrow.mapInArrow(run, schema)


def draw(weighed: DataFrame, percent: int = 5, min_words: int = 20) -> DataFrame:
    """``weighed`` plus ``rank`` (null if not drawn).  ``weighed`` is read more than
    once: pass a written table."""
    spark = weighed.sparkSession
    able = F.col("n_words") >= min_words
    quota = percent * weighed.where(able).count() // 100
    order = [able.desc(), F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("salt")]
    salted = weighed.withColumn("salt", F.monotonically_increasing_id())
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = stored(salted.repartitionByRange(parts, *order).sortWithinPartitions(*order)
                    .withColumn("place", F.monotonically_increasing_id()), "ranked")
    # the upper bits of ``place`` are the partition, the lower 33 the row in it
    part = F.shiftright("place", 33).alias("part")
    sizes = placed.groupBy(part).agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    out = placed.withColumn("part", part).join(F.broadcast(before), "part")  # a row a partition
    rank = F.col("before") + F.col("place") % (1 << 33) + 1
    return out.withColumn("rank", F.when(able & (rank <= quota), rank)).drop("part", "before", "place", "salt")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             target_text: str = "text", percent: int = 5, min_words: int = 20, seed: int = 42,
             keep: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` (columns ``keep``, default all) plus ``n_features, weight,
    score, rank``; rank 1, 2, .. marks the drawn rows."""
    gain = gains(bucket_counts(docs, text_col), bucket_counts(target, target_text))
    weighed = stored(weigh(docs, gain, id_col, text_col, seed, keep), "weighed")
    return draw(weighed, percent, min_words).select("row.*", *ADDED)
