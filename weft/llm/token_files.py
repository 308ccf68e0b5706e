"""Token files: patched frame-of-reference blocks of token ids.

A segment holds the ids of consecutive documents as blocks of ``BLOCK`` ids.  A
block subtracts its minimum and packs every difference at the width of its
``PERCENTILE``-th percentile; the few wider differences keep their low bits there
and go, in full, to an exception list of (position, value).  An index of block
starts gives random access to any block, and a document table maps documents to
id ranges.

A segment's bytes (little endian):

    magic "PFOR1\\0\\0\\0", n_ids, n_blocks, n_exceptions        4 x u64
    index        n_blocks x (byte start u64, minimum u32, width u8, first exception u64)
    exceptions   positions n x u64, values n x u32
    packed       each block's bits, least significant first, padded to bytes

Segments are rows of a Parquet table in the shared folder -- (segment, n_docs,
n_tokens, doc ids, lengths, bytes) -- so that Spark's commit protocol writes them
on any store and a lost executor leaves nothing half-written.  Rows are in
ascending id order (nulls first; equal ids by their text's hash).  One segment
is bounded by ``SEGMENT_IDS`` (a longer document is a segment of its own).
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weft.llm.bpe import WordIds, read_spec
from weft.llm.words import ranges, slices

MAGIC = b"PFOR1\0\0\0"
HEAD = struct.Struct("<8sQQQ")
INDEX = np.dtype([("at", "<u8"), ("least", "<u4"), ("width", "u1"), ("exception", "<u8")])
BLOCK = 1024
PERCENTILE = 95
SEGMENT_IDS = 1 << 20
#: Up to so many segments their offsets (16 bytes each) are broadcast.
BROADCAST_SEGMENTS = 1 << 20
SEGMENTS = "segment long, doc_ids array<long>, lengths array<long>, n_tokens long, bytes binary"


def _bits(x: np.ndarray) -> np.ndarray:
    """Bit length of non-negative numbers below 2^32 (exact in double)."""
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


def encode_segment(ids: np.ndarray, block: int = BLOCK, percentile: int = PERCENTILE) -> bytes:
    ids = np.ascontiguousarray(ids, dtype=np.uint32)
    n = len(ids)
    n_blocks = -(-n // block)
    index = np.zeros(n_blocks, dtype=INDEX)
    if not n:
        return HEAD.pack(MAGIC, 0, 0, 0)
    padded = np.concatenate([ids, np.full(n_blocks * block - n, ids[-1], dtype=np.uint32)]).reshape(n_blocks, block)
    least = padded.min(axis=1)
    rest = padded - least[:, None]
    size = np.full(n_blocks, block, dtype=np.int64)
    size[-1] = n - (n_blocks - 1) * block
    need = _bits(rest)
    width = np.sort(need, axis=1)[:, min(block - 1, block * percentile // 100)]
    wide = need > width[:, None]
    wide.reshape(-1)[n:] = False
    position = np.flatnonzero(wide.reshape(-1))
    n_bytes = -(-size * width // 8)
    index["at"] = np.cumsum(n_bytes) - n_bytes
    index["least"], index["width"] = least, width
    index["exception"] = np.searchsorted(position, np.arange(n_blocks) * block)
    packed = bytearray(int(n_bytes.sum()))
    out = np.frombuffer(packed, dtype=np.uint8)
    for w in np.unique(width):
        if not w:
            continue
        rows = np.flatnonzero(width == w)
        bits = np.unpackbits(rest[rows].view(np.uint8).reshape(len(rows), block, 4), axis=2, bitorder="little",
                             count=None)[:, :, :w].reshape(len(rows), -1)
        b = np.packbits(bits, axis=1, bitorder="little")
        for r, i in enumerate(rows):
            a = int(index["at"][i])
            out[a:a + n_bytes[i]] = b[r, :n_bytes[i]]
    return b"".join([HEAD.pack(MAGIC, n, n_blocks, len(position)), index.tobytes(),
                     position.astype("<u8").tobytes(), ids[position].astype("<u4").tobytes(), bytes(packed)])


def decode_segment(data: bytes, first_block: int = 0, last_block: int | None = None,
                   block: int = BLOCK) -> np.ndarray:
    """Ids of blocks ``first_block .. last_block - 1`` (all by default)."""
    magic, n, n_blocks, n_exceptions = HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a token segment")
    at = HEAD.size
    index = np.frombuffer(data, INDEX, n_blocks, at)
    at += n_blocks * INDEX.itemsize
    position = np.frombuffer(data, "<u8", n_exceptions, at).astype(np.int64)
    at += 8 * n_exceptions
    value = np.frombuffer(data, "<u4", n_exceptions, at)
    at += 4 * n_exceptions
    last = n_blocks if last_block is None else min(last_block, n_blocks)
    if first_block >= last:
        return np.zeros(0, np.uint32)
    base, count = first_block * block, min(last * block, n) - first_block * block
    out = np.zeros((last - first_block, block), dtype=np.uint32)
    width = index["width"][first_block:last].astype(np.int64)
    packed = np.frombuffer(data, np.uint8, offset=at)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        if w:
            length = block * int(w) // 8 + 8
            raw = np.zeros((len(rows), -(-block * int(w) // 8)), dtype=np.uint8)
            for r, i in enumerate(rows):
                a = int(index["at"][first_block + i])
                piece = packed[a:a + min(raw.shape[1], length)]
                raw[r, :len(piece)] = piece
            bits = np.unpackbits(raw, axis=1, bitorder="little")[:, :block * w].reshape(len(rows), block, w)
            full = np.zeros((len(rows), block, 32), dtype=np.uint8)
            full[:, :, :w] = bits
            out[rows] = np.packbits(full, axis=2, bitorder="little").view("<u4")[:, :, 0]
    out += index["least"][first_block:last, None]
    flat = out.reshape(-1)[:count]
    mine = slice(*np.searchsorted(position, [base, base + count]))
    flat[position[mine] - base] = value[mine]
    return flat


def byte_lengths(t: Tokenizer, suffix: str = "") -> np.ndarray:
    """Bytes that each id of a byte-level vocabulary stands for (one symbol a byte)."""
    vocabulary = t.get_vocab(with_added_tokens=False)
    size = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
    for token, i in vocabulary.items():
        size[i] = len(token.removesuffix(suffix) if suffix else token)
    return size


def encode_runs(t: Tokenizer, size: np.ndarray, pieces: list[str], between: str,
                group: int = 512) -> tuple[np.ndarray, np.ndarray] | None:
    """(ids, number of ids of each piece) of pieces encoded ``group`` at a time, ``between`` them
    a string that yields no id; the ids' byte lengths tell where a piece ends.  None if they do
    not add up."""
    texts = [between.join(pieces[i:i + group]) for i in range(0, len(pieces), group)]
    ids = np.array([i for e in t.encode_batch_fast(texts, add_special_tokens=False) for i in e.ids], dtype=np.int64)
    ends = np.cumsum([len(x) if x.isascii() else len(x.encode()) for x in pieces], dtype=np.int64)
    total = np.cumsum(size[ids])
    if not len(total) or not len(ends) or total[-1] != ends[-1]:
        return (ids, np.zeros(0, np.int64)) if not len(ends) else None
    stop = np.searchsorted(total, ends)
    if (total[stop] != ends).any():
        return None
    return ids, np.diff(stop + 1, prepend=0)


def interleave(first: np.ndarray, a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(ids, numbers) of a list whose entries ``first`` come from ``a``, the others from ``b``."""
    n = np.empty(len(first), dtype=np.int64)
    at = np.empty(len(first), dtype=np.int64)
    n[first], n[~first] = a[1], b[1]
    at[first] = np.cumsum(a[1]) - a[1]
    at[~first] = len(a[0]) + np.cumsum(b[1]) - b[1]
    return np.concatenate([a[0], b[0]]).astype(np.int64)[ranges(at, n)], n


def library_tokenizer(spec: str) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    t = Tokenizer.from_str(spec)
    t.no_truncation()
    t.no_padding()
    return t


def marked_words(spec: str, group: int = 512):
    """``encode_words`` by the tokenizers library, for any file.

    Words are joined by a special token of the file, whose id marks the ends
    (the library cuts texts there before anything else); words that could hold
    the start of a special token, or all without such a token, go one by one.
    """
    t = library_tokenizer(spec)
    added = list(t.get_added_tokens_decoder().items())
    mark = next(((i, a.content) for i, a in added
                 if a.special and not (a.lstrip or a.rstrip or a.single_word or a.normalized)), None)
    starts = {a.content[0] for _, a in added}

    def encode(batch: list[str]) -> list[list[int]]:
        return [e.ids for e in t.encode_batch_fast(batch, add_special_tokens=False)]

    def encode_words(batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        together = np.array([mark is not None and not any(c in w for c in starts) for w in batch], dtype=bool)
        run = [w for w, x in zip(batch, together, strict=True) if x]
        texts = [mark[1].join(run[i:i + group]) for i in range(0, len(run), group)]
        flat = np.array([x for row in encode(texts) for x in (*row, mark[0])], dtype=np.int64)
        ends = np.flatnonzero(flat == mark[0]) if run else np.zeros(0, np.int64)
        many = (flat[flat != mark[0]] if run else flat, np.diff(ends, prepend=-1) - 1)
        rows = encode([w for w, x in zip(batch, together, strict=True) if not x])
        single = (np.array([i for r in rows for i in r], dtype=np.int64), np.array([len(r) for r in rows], dtype=np.int64))
        return interleave(together, many, single)

    return encode_words


def library_words(spec: str):
    """``encode_words`` by the tokenizers library, for words without white space.

    A file of byte-level symbols whose rules drop white space (it has an end-of-word suffix) takes words
    of Latin-1 letters joined by spaces: normalising and lower-casing leave their byte lengths, so
    the ids' lengths give the ends (checked every time).  Other words, and other files, go through
    :func:`marked_words`.
    """
    marked = marked_words(spec)
    suffix = json.loads(spec)["model"].get("end_of_word_suffix")
    if not suffix:
        return marked
    t = library_tokenizer(spec)
    size = byte_lengths(t, suffix)
    starts = {a.content[0] for a in t.get_added_tokens_decoder().values()}
    # white space inside a word, special tokens
    other = re.compile("[" + re.escape("".join(sorted({"\x85", "\xa0", *starts}))) + "]").search

    def encode_words(batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = np.array([(w.isascii() or max(w) <= "\xff") and other(w) is None for w in batch], dtype=bool)
        got = encode_runs(t, size, [w for w, x in zip(batch, plain, strict=True) if x], " ") if plain.any() else None
        if got is None:
            return marked(batch)
        return got if plain.all() else interleave(plain, got, marked([w for w, x in zip(batch, plain, strict=True) if not x]))

    return encode_words


@lru_cache(maxsize=4)
def _library(spec: str) -> WordIds:
    """Each distinct word is encoded once while the cache holds it."""
    return WordIds(library_words(spec))


def write(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
          end_id: int = 2) -> None:
    """Encode ``text_col`` (null: empty), append ``end_id`` to each document and
    write segments in ascending id order to ``path``.

    Texts are range-partitioned by id before encoding, so one partition is one
    run of the order and the encoding is done once; a hot id is cut by its
    text's hash.
    """
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(read_spec(tokenizer))  # one fixed file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = _library(spec.value)
        part = TaskContext.get().partitionId() << 32
        held: list[np.ndarray] = []
        keys: list[int | None] = []
        lengths: list[int] = []
        size = seq = 0

        def flush():
            ids = np.concatenate(held) if held else np.zeros(0, np.uint32)
            return pa.RecordBatch.from_arrays(
                [pa.array([part + seq]), pa.array([keys], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())),
                 pa.array([len(ids)], pa.int64()), pa.array([encode_segment(ids)], pa.binary())],
                ["segment", "doc_ids", "lengths", "n_tokens", "bytes"])

        for batch in batches:
            for s in slices(batch, "t", 2 << 20):
                ids, offsets = library.encode(s.column("t"))
                n = np.diff(offsets)
                # the end id behind every document
                out = np.full(len(ids) + len(n), end_id, dtype=np.uint32)
                keep = np.ones(len(out), dtype=bool)
                keep[np.cumsum(n + 1) - 1] = False
                out[keep] = ids
                held.append(out)
                keys += s.column("k").to_pylist()
                lengths += (n + 1).tolist()
                size += len(out)
                if size >= SEGMENT_IDS:
                    yield flush()
                    held, keys, lengths, size, seq = [], [], [], 0, seq + 1
        if lengths:
            yield flush()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t"))
     .withColumn("h", F.xxhash64("t"))
     .repartitionByRange(n, "k", "h").sortWithinPartitions("k", "h")
     .select("k", "t").mapInArrow(run, SEGMENTS)
     .write.mode("overwrite").option("compression", "none").parquet(path))


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row a document, from the files: (doc_id, start, n_tokens, ids);
    ``start`` counts the ids of all documents before it."""
    files = spark.read.schema(SEGMENTS).parquet(path)
    # one number a segment (a million ids): running totals over the segments
    totals = _offsets(files.select("segment", "n_tokens"))
    if files.count() <= BROADCAST_SEGMENTS:  # else a shuffle join
        totals = F.broadcast(totals)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = decode_segment(batch.column("bytes")[i].as_buffer())
                lengths = np.array(batch.column("lengths")[i].as_py(), dtype=np.int64)
                ends = np.cumsum(lengths)
                bounds = np.concatenate([[0], ends]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_ids")[i].values, pa.array(ends - lengths + batch.column("offset")[i].as_py()),
                     pa.array(lengths), pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids.astype(np.int32)))],
                    ["doc_id", "start", "n_tokens", "ids"])

    return (files.join(totals, "segment").select("doc_ids", "lengths", "bytes", "offset")
            .mapInArrow(run, "doc_id long, start long, n_tokens long, ids array<int>"))


def _offsets(segments: DataFrame) -> DataFrame:
    """(segment, offset): ids of all earlier segments.

    A segment number is (partition, place in it); partitions are summed first,
    so the only ordered window over everything has one row a partition.
    """
    from pyspark.sql import Window

    s = segments.withColumn("part", F.shiftright("segment", 32))
    inner = s.withColumn("before", F.sum("n_tokens").over(Window.partitionBy("part").orderBy("segment")) - F.col("n_tokens"))
    parts = s.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    return inner.join(parts, "part").select("segment", (F.col("before") + F.col("base")).alias("offset"))


def crc_of_ids(df: DataFrame, ids_col: str = "ids", out: str = "ids_crc32") -> DataFrame:
    """``df`` with the unsigned crc32 of the ids as little-endian u32 in place
    of ``ids_col``."""
    def run(batches):
        for batch in batches:
            col = batch.column(ids_col)
            values = col.values.to_numpy(zero_copy_only=False).astype("<u4")
            off = col.offsets.to_numpy()
            crc = [zlib.crc32(values[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(crc, pa.int64())], [*keep, out])

    from pyspark.sql import types as T

    keep = [c for c in df.columns if c not in (ids_col, out)]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(out, T.LongType())])
    return df.mapInArrow(run, schema)
