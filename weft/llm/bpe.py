"""BPE encoding and decoding with a contiguous rank array.

The tokenizer file (``tokenizers`` JSON: NFC, white space, lower case, a split
pattern, byte-level symbols, an end-of-word suffix) gives vocabulary and merges;
no tokenizer is trained.  For every distinct word a row of a matrix holds its
part boundaries (as symbol ids) and, in a second matrix, the ranks of adjacent
parts.  All words of one length are scanned together: find the minimum rank of
each row, join that pair, delete its boundary, and look up only the two
neighbouring ranks again, until no row has a known pair.  Words longer than
``LONG`` symbols use a heap of ranks instead, whose work does not grow with the
square of the length.

Texts are cut at ``\\x20 \\x09-\\x0D`` first (the pattern never crosses them), so a
word is encoded once per task and its ids are gathered for each occurrence.

Cases: null text is empty (no ids, empty decoded text); special tokens of the
file are recognised in the text, as the library does by default; ids outside
the vocabulary are skipped in decoding.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

from weft.llm.chunks import release
from weft.llm.words import ranges, slices, text_buffer, value_hashes, word_pieces

LONG = 256
#: Distinct words, and their bytes, whose ids a Python worker keeps at a time.
CACHE_WORDS = 3 << 17
CACHE_BYTES = 1 << 26
#: The same for ``encode``, whose workers share an executor with those of ``decode``.
RANKED_WORDS = 1 << 18
NONE = np.int64(1) << np.int64(40)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    table = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [table[b] for b in range(256)]


class Bpe:
    """Vocabulary, merge ranks and text rules of one tokenizer file."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        key = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], dtype=np.int64)
        joined = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        order = np.argsort(key, kind="stable")
        self.key = np.append(key[order], np.iinfo(np.int64).max)
        self.rank = np.append(order.astype(np.int64), NONE)
        self.joined = np.append(joined[order], -1)
        self.by_pair = {int(k): (int(r), int(j)) for k, r, j in zip(self.key, self.rank, self.joined)}
        symbols = byte_symbols()
        self.symbol = np.array([vocab.get(s, -1) for s in symbols], dtype=np.int64)
        self.last = np.array([vocab.get(s + self.suffix, -1) for s in symbols], dtype=np.int64)
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split, regex.ASCII)
        self.byte_of = {c: b for b, c in enumerate(symbols)}
        # the library's normaliser and splitter (without the vocabulary): their Unicode
        # tables are of its version
        rules = Tokenizer.from_str(json.dumps({**spec, "added_tokens": [], "model": {**model, "vocab": {}, "merges": []}}))
        self.normalise, self.split = rules.normalizer.normalize_str, rules.pre_tokenizer.pre_tokenize_str
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        text = [""] * self.size
        for t, i in (*vocab.items(), *self.special.items()):
            text[i] = t
        self.text = text

    # -- one word to pre-tokens --------------------------------------------
    def pre_tokens(self, word: str) -> list[bytes | int]:
        """Byte strings to merge, or ids of special tokens."""
        out: list[bytes | int] = []
        parts = self.specials.split(word) if self.specials is not None and "<" in word else [word]
        for part in parts:
            if part in self.special:
                out.append(self.special[part])
            elif part.isascii():
                out.extend(x.encode() for x in self.pattern.findall(part.lower()))
            elif part:
                pieces = self.split(self.normalise(part))
                out.extend(bytes(map(self.byte_of.__getitem__, x)) for x, _ in pieces)
        return out

    # -- merging ----------------------------------------------------------
    def _look_up(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged id) of symbol pairs; NONE where they don't merge."""
        pair = a * self.size + b
        at = np.searchsorted(self.key, pair)
        hit = (self.key[at] == pair) & (a >= 0) & (b >= 0)
        return np.where(hit, self.rank[at], NONE), self.joined[at]

    def merge_all(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first, number): token i has ids ``ids[first[i]:first[i] + number[i]]``."""
        by_length: dict[int, list[int]] = {}
        for i, t in enumerate(tokens):
            by_length.setdefault(len(t), []).append(i)
        number = np.zeros(len(tokens), dtype=np.int64)
        groups: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        for n, which in by_length.items():
            if not n:
                continue
            if n > LONG:
                rows = [self._merge_long(tokens[i]) for i in which]
                number[which] = [len(r) for r in rows]
                ids += rows
            else:
                raw = np.frombuffer(b"".join([tokens[i] for i in which]), dtype=np.uint8).reshape(len(which), n)
                done = self._merge_rows(raw)
                known = done >= 0
                number[which] = known.sum(axis=1)
                ids.append(done[known])
            groups.append(np.array(which))
        first = np.zeros(len(tokens), dtype=np.int64)
        if groups:
            order = np.concatenate(groups)
            first[order] = np.cumsum(number[order]) - number[order]
        return np.concatenate(ids) if ids else np.zeros(0, np.int64), first, number

    def _merge_rows(self, raw: np.ndarray) -> np.ndarray:
        """Ids of words of one length, -1 behind a row's last."""
        m, n = raw.shape
        done = np.full((m, n), -1, dtype=np.int64)
        ids = self.symbol[raw]
        ids[:, -1] = self.last[raw[:, -1]]
        row = np.arange(m)  # the word of every live row
        # a guard column on each side spares the border cases
        part = np.full((m, n + 2), -1, dtype=np.int64)
        part[:, 1:-1] = ids
        rank = np.full((m, n + 1), NONE, dtype=np.int64)
        if n > 1:
            rank[:, 1:n], _ = self._look_up(ids[:, :-1], ids[:, 1:])
        width = n
        while len(row):
            at = np.argmin(rank, axis=1)
            live = rank[np.arange(len(row)), at] < NONE
            if not live.all():
                stop = ~live
                done[row[stop], :width] = part[stop, 1:width + 1]
                row, part, rank, at = row[live], part[live], rank[live], at[live]
                if not len(row):
                    break
            k = np.arange(len(row))
            # every live row has lost the same number of boundaries so far
            _, joined = self._look_up(part[k, at], part[k, at + 1])
            keep = np.ones(part.shape, dtype=bool)
            keep[k, at + 1] = False
            part = part[keep].reshape(len(row), -1)
            part[k, at] = joined
            keep = np.ones(rank.shape, dtype=bool)
            keep[k, at] = False
            rank = rank[keep].reshape(len(row), -1)
            rank[k, at - 1], _ = self._look_up(part[k, at - 1], joined)
            rank[k, at], _ = self._look_up(joined, part[k, at + 1])
            width -= 1
        return done

    def _merge_long(self, token: bytes) -> np.ndarray:
        ids = self.symbol[np.frombuffer(token, dtype=np.uint8)]
        ids[-1] = self.last[token[-1]]
        part = ids.tolist()
        n = len(part)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []

        def push(i: int) -> None:
            j = after[i]
            if j < n and (hit := self.by_pair.get(part[i] * self.size + part[j])) and part[i] >= 0 and part[j] >= 0:
                heapq.heappush(heap, (hit[0], i, part[i], part[j]))

        for i in range(n - 1):
            push(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if part[i] == a else n
            if j >= n or part[j] != b:
                continue
            part[i] = self.by_pair[a * self.size + b][1]
            part[j] = -2  # gone
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return np.array([p for p in part if p >= 0], dtype=np.int64)

    def encode_words(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of ids of each)."""
        number: dict[bytes | int, int] = {}
        which: list[int] = []
        counts = []
        for w in batch:
            pre = self.pre_tokens(w)
            counts.append(len(pre))
            for x in pre:
                which.append(number.setdefault(x, len(number)))
        special = [(i, x) for x, i in number.items() if isinstance(x, int)]
        ids, first, n = self.merge_all([x if isinstance(x, bytes) else b"" for x in number])
        for i, x in special:
            first[i], n[i] = len(ids), 1
            ids = np.append(ids, x)
        at = np.array(which, dtype=np.int64)
        per_word = np.bincount(np.repeat(np.arange(len(batch)), counts), weights=n[at], minlength=len(batch))
        return ids[ranges(first[at], n[at])], per_word.astype(np.int64)


class WordIds:
    """Ids of the pieces of texts; each distinct piece is encoded once while the
    cache (of at most ``CACHE_WORDS`` pieces and ``CACHE_BYTES`` bytes) holds it.  A full
    cache keeps the pieces that were met again since they came.

    Pieces are found by a hash and told apart by their bytes: one whose hash is that of
    another piece in the cache is not kept.  ``cut`` gives the pieces of a buffer as
    a binary array and the first piece of each row.
    """

    def __init__(self, encode_words, cut=word_pieces, most: int = CACHE_WORDS):
        self.encode_words, self.cut, self.most = encode_words, cut, most
        self.known = pa.array([], pa.large_binary())
        self.hash = np.zeros(0, np.uint64)  # ascending, and the place in ``known`` of each
        self.place = np.zeros(0, np.int64)
        self.at = np.zeros(0, np.int64)
        self.n = np.zeros(0, np.int64)
        self.met = np.zeros(0, bool)
        self.ids = np.zeros(0, np.int32)

    def _thin(self) -> None:
        keep = np.flatnonzero(self.met)
        size = pc.binary_length(self.known).to_numpy()
        if 2 * len(keep) > self.most or 2 * int(size[keep].sum()) > CACHE_BYTES:
            keep = keep[:0]
        self.known = self.known.take(pa.array(keep))
        self._index()
        self.ids = self.ids[ranges(self.at[keep], self.n[keep])]
        self.n = self.n[keep]
        self.at = np.cumsum(self.n) - self.n
        self.met = np.zeros(len(keep), bool)

    def _index(self) -> None:
        h = value_hashes(self.known)
        self.place = np.argsort(h, kind="stable")
        self.hash = h[self.place]

    def _find(self, distinct: pa.Array, h: np.ndarray) -> np.ndarray:
        """Place of each value in the cache; -1 if it is not there, -2 if another one has its hash."""
        if not len(self.hash):
            return np.full(len(h), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        same = np.flatnonzero(self.hash[at] == h)
        k = np.full(len(h), -1, dtype=np.int64)
        place = self.place[at[same]]
        equal = pc.equal(self.known.take(pa.array(place)), distinct.take(pa.array(same))).to_numpy(zero_copy_only=False)
        k[same] = np.where(equal, place, -2)
        return k

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, row offsets)."""
        pieces, doc = self.cut(*text_buffer(col))
        if not len(pieces):
            return np.zeros(0, np.int32), np.zeros(len(doc), np.int64)
        if len(self.known) > self.most or self.known.nbytes > CACHE_BYTES:
            self._thin()
        coded = pieces.dictionary_encode()
        which = coded.indices.to_numpy()
        h = value_hashes(coded.dictionary)
        k = self._find(coded.dictionary, h)
        self.met[k[k >= 0]] = True
        unknown = np.flatnonzero(k < 0)
        if len(unknown):
            new = coded.dictionary.take(pa.array(unknown))
            got, n = self.encode_words(new.cast(pa.large_string()).to_pylist())
            clash = k[unknown] == -2
            k[unknown] = np.arange(len(self.known), len(self.known) + len(new))
            # pieces of one hash: the first is found from now on
            by = np.argsort(h[unknown], kind="stable")
            by = by[~clash[by]]
            by = by[np.concatenate([[True], h[unknown][by][1:] != h[unknown][by][:-1]])] if len(by) else by
            where = np.searchsorted(self.hash, h[unknown][by])
            self.hash = np.insert(self.hash, where, h[unknown][by])
            self.place = np.insert(self.place, where, k[unknown][by])
            self.known = pa.concat_arrays([self.known, new])
            self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(n) - n])
            self.n = np.concatenate([self.n, n])
            self.met = np.concatenate([self.met, np.zeros(len(new), bool)])
            self.ids = np.concatenate([self.ids, np.asarray(got).astype(np.int32)])
        n = self.n[k][which]
        out = self.ids[ranges(self.at[k][which], n)]
        ends = np.concatenate([[0], np.cumsum(n)])
        return out, ends[doc]


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


@lru_cache(maxsize=4)
def _model(spec: str) -> Bpe:
    return Bpe(json.loads(spec))


@lru_cache(maxsize=4)
def _encoder(spec: str) -> WordIds:
    return WordIds(_model(spec).encode_words, most=RANKED_WORDS)


def _with(schema: T.StructType, *fields: T.StructField) -> T.StructType:
    names = {f.name for f in fields}
    return T.StructType([*(f for f in schema if f.name not in names), *fields])


def encode(docs: DataFrame, path: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` plus ``out`` (array<int>), the ids of ``text_col``; a column of
    that name is replaced.  ``path`` names the tokenizer file on the driver;
    its text goes to the tasks."""
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(path))  # one fixed file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_to_ids = _encoder(spec.value)
        for batch in batches:
            release()
            for s in slices(batch, text_col, 1 << 19):
                ids, offsets = words_to_ids.encode(s.column(text_col))
                col = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*(s.column(c) for c in keep), col], [*keep, out])

    keep = [c for c in docs.columns if c != out]
    return docs.mapInArrow(run, _with(docs.schema, T.StructField(out, T.ArrayType(T.IntegerType(), True))))


def decode(docs: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` plus ``out``: token strings joined by one space, which is what
    the library gives for a file without a decoder (skip_special_tokens off)."""
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(spec.value)
        raw = [t.encode() + b" " for t in model.text]
        size = np.array([len(x) for x in raw], dtype=np.int64)
        begin = np.cumsum(size) - size
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        for batch in batches:
            release()
            lo = 0
            col = batch.column(ids_col)
            n_ids = np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(col), 0).to_numpy(zero_copy_only=False))
            while lo < batch.num_rows:  # about half a million ids at a time
                base = n_ids[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(n_ids, base + (1 << 19), side="right")))
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in keep), _join(part.column(ids_col), data, begin, size, model.size)],
                    [*keep, out])
                lo = hi

    keep = [c for c in docs.columns if c != out]
    return docs.mapInArrow(run, _with(docs.schema, T.StructField(out, T.StringType(), True)))


def _join(col: pa.Array, data: np.ndarray, begin: np.ndarray, size: np.ndarray, vocabulary: int) -> pa.Array:
    counts = pa.compute.fill_null(pa.compute.list_value_length(col), 0).to_numpy(zero_copy_only=False)
    ids = col.flatten().cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(counts)), counts)
    good = (ids >= 0) & (ids < vocabulary)
    ids, row = ids[good], row[good]
    per_row = np.bincount(row, minlength=len(counts))
    text = data[ranges(begin[ids], size[ids])]
    ends = np.concatenate([[0], np.cumsum(size[ids])])[np.concatenate([[0], np.cumsum(per_row)])]
    final = np.ones(len(text), dtype=bool)
    final[ends[1:][per_row > 0] - 1] = False  # no space behind the last
    offsets = np.concatenate([[0], np.cumsum(np.diff(ends) - (per_row > 0))])
    big = pa.LargeStringArray.from_buffers(len(counts), pa.py_buffer(offsets.astype(np.int64).tobytes()),
                                           pa.py_buffer(text[final].tobytes()))
    return big.cast(pa.string())
