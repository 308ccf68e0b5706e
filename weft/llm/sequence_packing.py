"""Sum-of-squares online packing of token sequences.

Documents are encoded and placed in the order they come, each partition on its own.
What a document holds beyond whole windows of ``length`` ids is one item.  With N(h)
the number of open windows filled to level h, an item of size s goes to the open
window (or a new one) whose choice makes the sum of N(h)^2 over the partially filled
levels smallest: least N(h + s) - N(h), a new window counting as N(0) = 1/2 and a full one as
N(length) = -1/2; ties to the fullest.  N is one array of ``length + 1`` levels.

Windows that stay open at the end of a partition (or once over ``MAX_OPEN`` are open, which
bounds a task's memory) are closed by cutting: the emptiest give pieces to fill the fullest
exactly.  At most one is left; its ids are cut at powers of two, lengths that need no
padding.  So no sequence is padded, whatever the lengths of the documents are.

Cases: null or empty text is one piece holding the end id; every row is packed, repeated rows
and ids too; a document's pieces are told apart by ``start``; an empty table gives an empty
result; only the id and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.llm.bpe import WordIds, read_spec
from weft.llm.token_files import byte_lengths, encode_runs, interleave, library_tokenizer, marked_words
from weft.llm.words import SPACE, binary_array, slices

LENGTH = 2048
END_ID = 1
#: Open windows a task holds (8 KB each at 2048 ids).
MAX_OPEN = 4096
#: Ids a task holds back before it gives rows out.
OUT_IDS = 1 << 19

#: Marks in front of which a word may be cut (fixed values).
STOPS = ",.;:!?"
_STOP = np.zeros(256, dtype=bool)
_STOP[[ord(c) for c in STOPS]] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_LAST_OF_TWO = np.zeros(256, dtype=bool)  # C2 85, C2 A0: white space of two bytes
_LAST_OF_TWO[[0x85, 0xA0]] = True


def spaced_pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(pieces as a binary array, first piece of each row): texts cut in front of
    each run of ASCII white space that does not continue other white space, and between
    a letter a-z and one of ``STOPS``.

    No match of the byte-level split pattern crosses such a cut: its alternatives
    reach from white space into a word, never back, and one that holds a letter ends with
    letters.
    """
    space = SPACE[data]
    first = space.copy()
    first[1:] &= ~space[:-1]
    at = np.flatnonzero(first)
    at = at[at > 0]
    # Unicode white space before the run belongs to the same run
    b1, b2, b3 = data[at - 1], data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
    two = (b2 == 0xC2) & _LAST_OF_TWO[b1]
    general = (b3 == 0xE2) & (((b2 == 0x80) & ((b1 <= 0x8A) | (b1 == 0xA8) | (b1 == 0xA9) | (b1 == 0xAF)))
                              | ((b2 == 0x81) & (b1 == 0x9F)))
    other = ((b3 == 0xE1) & (b2 == 0x9A) & (b1 == 0x80)) | ((b3 == 0xE3) & (b2 == 0x80) & (b1 == 0x80))
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[at[~(two | ((b1 >= 0x80) & (general | other)))]] = True
    cut[offsets[:-1]] = True
    cut[1:-1] |= _LETTER[data[:-1]] & _STOP[data[1:]]
    start = np.flatnonzero(cut[:-1])
    return binary_array(data, np.append(start, len(data))), np.searchsorted(start, offsets, side="left")


class Window:
    __slots__ = ("fill", "pieces")

    def __init__(self):
        self.fill = 0
        self.pieces: list[tuple] = []  # (document, first id, ids)

    def add(self, doc, start: int, ids: np.ndarray) -> None:
        self.pieces.append((doc, start, ids))
        self.fill += len(ids)


class Packer:
    """Online packing of one partition; ``emit(window)`` gets closed windows."""

    def __init__(self, length: int, emit, max_open: int | None = None):
        self.length, self.emit, self.max_open = length, emit, max_open or MAX_OPEN
        self._clear()

    def _clear(self) -> None:
        self.level = np.zeros(self.length + 1)
        self.level[0], self.level[-1] = 0.5, -0.5
        self.open: list[list[Window]] = [[] for _ in range(self.length)]
        self.n_open = 0

    def choose(self, size: int) -> int:
        """The level whose window takes an item (0: a new window)."""
        n = self.level[:self.length + 1 - size]
        cost = np.where(n > 0, self.level[size:] - n, np.inf)
        return len(cost) - 1 - int(np.argmin(cost[::-1]))

    def add(self, doc, ids: np.ndarray) -> None:
        whole = len(ids) // self.length * self.length
        for lo in range(0, whole, self.length):
            w = Window()
            w.add(doc, lo, ids[lo:lo + self.length])
            self.emit(w)
        if whole == len(ids):
            return
        rest = ids[whole:].copy() if whole else ids  # not a view of a long document
        h = self.choose(len(rest))
        if h:
            w = self.open[h].pop()
            self.level[h] -= 1
            self.n_open -= 1
        else:
            w = Window()
        w.add(doc, whole, rest)
        if w.fill == self.length:
            self.emit(w)
            return
        self.open[w.fill].append(w)
        self.level[w.fill] += 1
        self.n_open += 1
        if self.n_open > self.max_open:
            left = self.top_up()
            self._clear()
            if left is not None:
                self.open[left.fill].append(left)
                self.level[left.fill] += 1
                self.n_open = 1

    def top_up(self) -> Window | None:
        """Close all open windows but one by cutting pieces of the emptiest."""
        rows = [w for stack in reversed(self.open) for w in stack]
        lo, hi = 0, len(rows) - 1
        while lo < hi:
            need = self.length - rows[lo].fill
            doc, start, ids = rows[hi].pieces.pop()
            rows[hi].fill -= len(ids)
            rows[lo].add(doc, start, ids[:need])
            if len(ids) > need:
                rows[hi].add(doc, start + need, ids[need:])
            if rows[lo].fill == self.length:
                self.emit(rows[lo])
                lo += 1
            if not rows[hi].fill:
                hi -= 1
        return rows[lo] if lo == hi and rows[lo].fill else None

    def finish(self) -> None:
        left = self.top_up()
        self._clear()
        if left is None:
            return
        cut = Window()
        room = 1 << (left.fill.bit_length() - 1)
        rest = left.fill
        for doc, start, ids in left.pieces:
            while len(ids):
                part = ids[:room - cut.fill]
                cut.add(doc, start, part)
                start, ids = start + len(part), ids[len(part):]
                if cut.fill == room:
                    self.emit(cut)
                    rest -= room
                    cut, room = Window(), 1 << max(rest.bit_length() - 1, 0)


def library_pieces(spec: str):
    """``encode_words`` of pieces by the tokenizers library.

    Pieces that start with white space and end without are encoded end to end: the split
    pattern parts them again, and the ids' byte lengths tell where each piece ends.  The
    rest, and what may touch a special token, goes through :func:`marked_words`.
    """
    t = library_tokenizer(spec)
    size = byte_lengths(t)
    starts = {a.content[0] for a in t.get_added_tokens_decoder().values()}
    marked = marked_words(spec)
    special = re.compile("[" + re.escape("".join(sorted(starts))) + "]").search if starts else lambda x: None

    def encode_pieces(batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = np.array([x[0] in " \t\n\v\f\r" and not x[-1].isspace() and special(x) is None for x in batch],
                         dtype=bool)
        got = encode_runs(t, size, [x for x, p in zip(batch, plain, strict=True) if p], "") if plain.any() else None
        if got is None:
            return marked(batch)
        return got if plain.all() else interleave(plain, got, marked([x for x, p in zip(batch, plain, strict=True) if not p]))

    return encode_pieces


@lru_cache(maxsize=4)
def _library(spec: str) -> WordIds:
    if any(set(t["content"]) & {*STOPS, *" \t\n\v\f\r"} for t in json.loads(spec).get("added_tokens", [])):
        raise ValueError("a special token holds a character at which texts are cut")
    return WordIds(library_pieces(spec), spaced_pieces)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
         end_id: int = END_ID) -> DataFrame:
    """One row a piece: (<id>, start, length, doc_tokens, sequence_id, offset, ids).

    ``start`` counts the document's ids before the piece, ``offset`` the sequence's;
    ``doc_tokens`` includes the end id.  A sequence lies in one task, its pieces one
    after the other.  ``tokenizer`` names a byte-level BPE file on the driver.
    """
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(tokenizer))  # one fixed file
    names = [id_col, "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    schema = T.StructType([docs.schema[id_col], *(T.StructField(c, T.LongType()) for c in names[1:-1]),
                           T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = _library(spec.value)
        part = TaskContext.get().partitionId() << 32
        closed: list[Window] = []
        packer = Packer(length, closed.append)
        made = 0
        kind = None

        def rows() -> pa.RecordBatch:
            nonlocal made
            number = np.repeat(np.arange(len(closed)), [len(w.pieces) for w in closed])
            pieces = [p for w in closed for p in w.pieces]
            size = np.array([len(p[2]) for p in pieces], dtype=np.int64)
            ends = np.cumsum(size)
            first = np.concatenate([[0], np.cumsum([w.fill for w in closed])])[:-1]
            out = pa.RecordBatch.from_arrays(
                [pa.array([p[0][0] for p in pieces], kind), pa.array([p[1] for p in pieces], pa.int64()), pa.array(size),
                 pa.array([p[0][1] for p in pieces], pa.int64()), pa.array(part + made + number),
                 pa.array(ends - size - first[number]),
                 pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)),
                                          pa.array(np.concatenate([p[2] for p in pieces])))], names)
            made += len(closed)
            closed.clear()
            return out

        for batch in batches:
            kind = batch.column("id").type
            for s in slices(batch, "text", 2 << 20):
                ids, offsets = library.encode(s.column("text"))
                bounds = offsets.tolist()
                for key, a, b in zip(s.column("id").to_pylist(), bounds[:-1], bounds[1:], strict=True):
                    packer.add((key, b - a + 1), np.append(ids[a:b], np.int32(end_id)))
                    if len(closed) * length > OUT_IDS:
                        yield rows()
        packer.finish()
        if closed:
            yield rows()

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def sequences(pieces: DataFrame, length: int = LENGTH, pad_id: int = 0) -> DataFrame:
    """One row a sequence: (sequence_id, ids, n_ids, starts); ``ids`` are padded to
    ``length`` unless their number is a power of two, ``starts`` are the pieces' offsets.
    A group is one sequence, ``length`` ids at most."""
    whole = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    ids = F.flatten(F.transform("p", lambda x: x["ids"]))
    n = F.size("ids")
    power = n.bitwiseAND(n - 1) == 0
    pad = F.array_repeat(F.lit(pad_id), F.when(power, 0).otherwise(F.lit(length) - n))
    return (whole.select("sequence_id", ids.alias("ids"), F.transform("p", lambda x: x["offset"]).alias("starts"))
            .select("sequence_id", F.concat("ids", pad).alias("ids"), n.alias("n_ids"), "starts"))
