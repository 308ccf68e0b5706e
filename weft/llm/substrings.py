"""Substring dedup: Rabin-Karp hashes of every fixed-length word window,
counted in Spark; repeated windows merge into maximal removal intervals.

A word is removed when it lies in a window of ``length`` consecutive words
whose word sequence also starts in a document with a smaller id.  Windows are
judged on the input.  Cases:

* null or empty text: no words, nothing removed;
* fewer words than ``length``: no window, nothing removed;
* a null id is greater than every id; equal ids never remove each other;
* repeats inside one document stay (no smaller id has them).

Window hashes have 64 bits and are not compared word by word: among n distinct
windows the expected number of false matches is n^2 / 2^65 (under 0.001 for 10^8
windows).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from weft.llm import chunks as C
from weft.llm.words import Words, ranges, text_buffer, window_hashes, window_starts, words

NULL_ID = np.iinfo(np.int64).max


def _ids(rows: pa.Table, name: str) -> np.ndarray:
    return rows.column(name).combine_chunks().cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False)


class _Windows:
    """Windows of a chunk whose rows are sorted by id: distinct hashes in order
    of first appearance, so the first appearance has the chunk's smallest id."""

    def __init__(self, rows: pa.Table, id_col: str, text: str, length: int, n_buckets: int):
        self.data, self.offsets = text_buffer(rows.column(text))
        self.words: Words = words(self.data, self.offsets)
        self.ids = _ids(rows, id_col)
        self.at, counts = window_starts(self.words.doc, length)
        h = window_hashes(self.words.hash, length)[self.at]
        self.row = np.repeat(np.arange(len(self.ids)), counts)
        _, first, self.which = np.unique(h, return_index=True, return_inverse=True)
        # distinct hashes are numbered by value; they are sent by position
        self.order = np.argsort(first)
        self.first = first
        self.hash = h[first]
        bucket = (self.hash[self.order] % np.uint64(n_buckets)).astype(np.int64)
        pos, self.bounds = C.by_bucket(bucket, n_buckets)
        self.sent = self.order[pos]  # distinct-hash numbers, grouped by bucket

    def of(self, b: int) -> np.ndarray:
        return self.sent[self.bounds[b]:self.bounds[b + 1]]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50,
                   normalise: bool = False) -> DataFrame:
    """``docs`` with every repeated window cut out of ``text_col``, plus
    ``n_words`` and ``n_removed`` (they replace columns of those names).

    A text that loses words becomes its kept words joined by one space; others
    stay as they are, or are joined the same way with ``normalise``.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_words", "n_removed")
    n = C.n_buckets(spark)
    chunks = C.write_chunks(docs, text_col, sort=id_col, name="substr")

    def emit(cid: int, rows: pa.Table) -> Iterator[dict]:
        w = _Windows(rows, id_col, text_col, length, n)
        for b in range(n):
            k = w.of(b)
            if not len(k):
                continue
            row = w.row[w.first[k]]  # ascending
            used, counts = np.unique(row, return_counts=True)
            yield {"bucket": [b], "chunk_id": [cid], "hash": [w.hash[k].tobytes()],
                   "ids": [C.pack(w.ids[used])], "counts": [C.pack(counts.astype(np.uint32))]}

    def judge(b: int, parts: pa.Table) -> Iterator[dict]:
        hashes = [np.frombuffer(x.as_buffer(), np.uint64) for x in parts.column("hash")]
        ids = [np.repeat(C.unpack(i, np.int64), C.unpack(c, np.uint32)) for i, c in
               zip(parts.column("ids").to_pylist(), parts.column("counts").to_pylist(), strict=True)]
        h, d = np.concatenate(hashes), np.concatenate(ids)
        order = np.argsort(h)
        hs = h[order]
        start = np.flatnonzero(np.concatenate([[True], hs[1:] != hs[:-1]]))
        least = np.minimum.reduceat(d[order], start)
        later = np.empty(len(h), dtype=bool)
        later[order] = d[order] > np.repeat(least, np.diff(np.append(start, len(h))))
        lo = 0
        for cid, x in zip(parts.column("chunk_id").to_pylist(), hashes, strict=True):
            yield {"chunk_id": [cid], "bucket": [b], "later": [C.pack(np.packbits(later[lo:lo + len(x)]))]}
            lo += len(x)

    def cut(cid: int, rows: pa.Table, answer: dict) -> Iterator[pa.Table]:
        w = _Windows(rows, id_col, text_col, length, n)
        later = np.zeros(len(w.hash), dtype=bool)
        for b, x in answer.items():
            k = w.of(b)
            later[k] = np.unpackbits(C.unpack(x["later"], np.uint8))[:len(k)].astype(bool)
        # also repeated inside the chunk, behind its smallest id
        repeated = later[w.which] | (w.ids[w.row] > w.ids[w.row[w.first]][w.which])
        kept, removed = _keep(w, w.at[repeated], length)
        text = kept
        if not normalise:
            given = rows.column(text_col).combine_chunks().cast(pa.large_string())
            text = pa.compute.if_else(pa.array(removed > 0), kept, given)
        out = rows.set_column(rows.column_names.index(text_col), text_col, text)
        yield (out.append_column("n_words", pa.array(w.words.counts.astype(np.int64)))
                  .append_column("n_removed", pa.array(removed)))

    parts = C.map_chunks(chunks, emit, "bucket int, chunk_id long, hash binary, ids binary, counts binary")
    answers = C.reduce_buckets(parts, judge, "chunk_id long, bucket int, later binary")
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in docs.schema),
                           T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    return C.join_chunks(chunks, [answers], cut, schema)


def _keep(w: _Windows, starts: np.ndarray, length: int) -> tuple[pa.Array, np.ndarray]:
    """(kept words of every row joined by one space, number of removed words).

    Overlapping windows merge into maximal intervals through a running sum of
    +1 at a window's first word and -1 behind its last.
    """
    total = len(w.words.hash)
    edge = np.zeros(total + length + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + length, -1)
    keep = np.cumsum(edge)[:total] == 0
    before = np.concatenate([[0], np.cumsum(keep)])
    doc = w.words.doc
    n_kept = before[doc[1:]] - before[doc[:-1]]
    s, e = w.words.start[keep], w.words.end[keep]
    size = e - s + 1  # a space behind each word
    out = w.data[np.minimum(ranges(s, size), max(len(w.data) - 1, 0))] if len(s) else np.zeros(0, np.uint8)
    ends = np.cumsum(size)
    out[ends - 1] = 32
    byte = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n_kept)])]
    # drop the space behind the last kept word of each row
    last = byte[1:][n_kept > 0] - 1
    final = np.ones(len(out), dtype=bool)
    final[last] = False
    offsets = np.concatenate([[0], np.cumsum(np.diff(byte) - (n_kept > 0))])
    arr = pa.LargeStringArray.from_buffers(len(n_kept), pa.py_buffer(offsets.astype(np.int64).tobytes()),
                                           pa.py_buffer(out[final].tobytes()))
    return arr, (np.diff(doc) - n_kept).astype(np.int64)
