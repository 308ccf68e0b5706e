"""Vectorised word kernels over Arrow string columns.

A word is a maximal run of bytes other than ``\\x20 \\x09-\\x0D`` -- on UTF-8
that is exactly ``[^\\x20\\x09-\\x0D]+``.  Words are hashed straight from the
Arrow buffer: polynomial prefix sums modulo two primes below 2^31, with fixed random
bases, give the hash of any span as one subtraction and one multiplication by an
inverse power for each prime, so no Python object is made per word.  (Modulo a power
of two some words agree for every base; modulo a prime two different words of n
letters agree for at most n of its bases.)  The same trick over word hashes gives the
Rabin-Karp hash of every fixed-length window.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: (prime, base for bytes, base for words).
FIELDS = ((2147483647, 1526217869, 1189704413), (2147483629, 1910353871, 762391867))
LENGTH_STEP = np.uint64(0xD6E8FEB86659FD93)
#: Bytes (or words) hashed at a time; it bounds the power tables and temporaries.
PIECE = 1 << 18

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
IDENTITY = np.arange(256, dtype=np.uint64) + np.uint64(1)
ASCII_LOWER = IDENTITY.copy()
ASCII_LOWER[65:91] += np.uint64(32)

_tables: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def _powers(prime: int, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo ``prime`` for i < n."""
    have = _tables.get((prime, base))
    if have is None or len(have[0]) < n:
        size = max(n, PIECE + 1)
        out = []
        for b in (base, pow(base, -1, prime)):
            t = np.ones(size, dtype=np.uint64)
            done = 1
            while done < size:  # t[done + i] = t[i] * b^done
                more = min(done, size - done)
                t[done:done + more] = t[:more] * np.uint64(pow(b, done, prime)) % np.uint64(prime)
                done += more
            out.append(t)
        have = _tables[prime, base] = (out[0], out[1])
    return have


def _span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray, for_words: bool) -> np.ndarray:
    """62-bit hashes of ``values[start[i]:end[i]]``, at most PIECE values or so.

    Sums of PIECE products do not overflow: bytes times 31 bits, or reduced products.
    """
    out = np.zeros(len(start), dtype=np.uint64)
    for prime, byte_base, word_base in FIELDS:
        p = np.uint64(prime)
        power, inverse = _powers(prime, word_base if for_words else byte_base, len(values) + 1)
        prefix = np.zeros(len(values) + 1, dtype=np.uint64)
        terms = (values % p) * power[:len(values)] % p if for_words else values * power[:len(values)]
        np.cumsum(terms, out=prefix[1:])
        h = (prefix[end] - prefix[start]) % p * inverse[start] % p
        out = (out << np.uint64(31)) | h
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):  # zero chunks
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.large_string())
    col = col.cast(pa.large_string())
    if col.null_count:
        col = pc.fill_null(col, "")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[col.offset:col.offset + len(col) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    raw = raw[offsets[0]:offsets[-1]]
    return raw, offsets - offsets[0]


@dataclass
class Words:
    """Words of a column: byte spans, hashes, and the first word of each row."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    doc: np.ndarray  # len(rows) + 1 word offsets

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.doc)


def _cut(data: np.ndarray, offsets: np.ndarray, pos: int) -> int:
    """End of the piece starting at ``pos``: a row boundary or white space."""
    n = len(data)
    end = pos + PIECE
    if end >= n:
        return n
    k = int(np.searchsorted(offsets, end, side="right")) - 1
    if offsets[k] > pos:
        return int(offsets[k])
    spaces = np.flatnonzero(SPACE[data[pos:end]])
    if len(spaces):
        return pos + int(spaces[-1]) + 1
    while end < n:  # one word longer than a piece
        nxt = min(end + PIECE, n)
        stop = int(offsets[np.searchsorted(offsets, end, side="left")])
        spaces = np.flatnonzero(SPACE[data[end:nxt]])
        here = end + int(spaces[0]) + 1 if len(spaces) else nxt
        if stop <= here:
            return stop
        if len(spaces):
            return here
        end = nxt
    return n


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = IDENTITY) -> Words:
    """Spans and hashes of all words; ``table`` maps bytes before hashing."""
    starts, ends, hashes = [], [], []
    pos, n = 0, len(data)
    while pos < n:
        stop = _cut(data, offsets, pos)
        b = data[pos:stop]
        word = ~SPACE[b]
        edge = np.zeros(len(b) + 1, dtype=bool)
        lo, hi = np.searchsorted(offsets, [pos, stop], side="left")
        edge[offsets[lo:hi + 1][offsets[lo:hi + 1] <= stop] - pos] = True
        edge[0] = edge[-1] = True
        first = word.copy()
        first[1:] &= ~word[:-1] | edge[1:-1]
        last = word.copy()
        last[:-1] &= ~word[1:] | edge[1:-1]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        h = _span_hashes(table[b], s, e, False)
        h += (e - s).astype(np.uint64) * LENGTH_STEP
        starts.append(s + pos)
        ends.append(e + pos)
        hashes.append(mix(h))
        pos = stop
    if starts:
        start, end, h = np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)
    else:
        start = end = np.zeros(0, np.int64)
        h = np.zeros(0, np.uint64)
    return Words(start, end, h, np.searchsorted(start, offsets, side="left"))


def word_pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(all words as a binary array, first word of each row)."""
    word = ~SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    cut = offsets[:-1][offsets[:-1] < len(data)]
    first[cut] = word[cut]  # a text's first byte starts a word
    at = np.flatnonzero(first)
    ends = np.append(np.cumsum(word)[at] - 1, np.count_nonzero(word))
    return binary_array(data[word], ends), np.searchsorted(at, offsets, side="left")


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The binary values ``data[offsets[i]:offsets[i + 1]]``, without a copy."""
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(offsets) - 1,
        [None, pa.py_buffer(np.ascontiguousarray(offsets, dtype=np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def value_hashes(values: pa.Array) -> np.ndarray:
    """A hash of every value of a large binary array; equal bytes have equal hashes."""
    _, off, raw = values.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[values.offset:values.offset + len(values) + 1]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    out = np.empty(len(values), dtype=np.uint64)
    lo = 0
    while lo < len(values):  # about PIECE bytes at a time, one value at least
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + PIECE, side="right")) - 1)
        part = offsets[lo:hi + 1] - offsets[lo]
        h = _span_hashes(IDENTITY[data[offsets[lo]:offsets[hi]]], part[:-1], part[1:], False)
        out[lo:hi] = mix(h + np.diff(part).astype(np.uint64) * LENGTH_STEP)
        lo = hi
    return out


def column_words(col: pa.Array, table: np.ndarray = IDENTITY) -> Words:
    return words(*text_buffer(col), table)


def window_hashes(h: np.ndarray, length: int) -> np.ndarray:
    """Rabin-Karp hash of every ``length`` consecutive entries of ``h``
    (row boundaries are the caller's business)."""
    n = len(h) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, dtype=np.uint64)
    for lo in range(0, n, PIECE):
        hi = min(lo + PIECE, n)
        part = h[lo:hi + length - 1]
        at = np.arange(hi - lo)
        out[lo:hi] = mix(_span_hashes(part, at, at + length, True))
    return out


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenation of ``arange(s, s + c)`` for all pairs."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, dtype=np.int64)
    keep = counts > 0
    s, c = starts[keep], counts[keep]
    first = np.cumsum(c) - c
    out[0] = s[0]
    out[first[1:]] = s[1:] - (s[:-1] + c[:-1] - 1)
    return np.cumsum(out)


def window_starts(doc: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(word index of every whole window, number of windows of each row)."""
    counts = np.maximum(np.diff(doc) - length + 1, 0)
    return ranges(doc[:-1], counts), counts


def slices(batch: pa.RecordBatch | pa.Table, text: str, max_bytes: int = 4 << 20, max_rows: int = 4096):
    """Consecutive slices of at most ``max_rows`` rows and about ``max_bytes`` of
    text each (one row at least)."""
    n = batch.num_rows
    if not n:
        return
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0)
    size = np.cumsum(np.asarray(size.to_numpy(zero_copy_only=False) if isinstance(size, pa.Array)
                                else size.to_numpy(), dtype=np.int64))
    lo = 0
    while lo < n:
        base = size[lo - 1] if lo else 0
        hi = max(lo + 1, min(lo + max_rows, int(np.searchsorted(size, base + max_bytes, side="right"))))
        yield batch.slice(lo, hi - lo)
        lo = hi
