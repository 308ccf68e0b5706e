"""Language ID: blended-spectrum string kernel, Nystroem landmarks, one-versus-rest
kernel ridge regression, scored by batched matrix products.

The kernel of two texts counts the character n-grams of 1 to ``N`` letters they
share (presence, not frequency), normalised: |x & y| / sqrt(|x| |y|).  Grams are
taken from the lower-cased text with every run of other characters read as one
blank, and are hashed to ``2^GRAM_BITS`` presence bits.  Landmarks L (the same number
of training texts a language) give Nystroem features k(x, L) K_LL^(-1/2); ridge
regression on them has one output a language.  A batch of texts is scored as

    P (batch x bits) @ G (bits x landmarks), scaled, @ W (landmarks x languages)

Only the fit uses a sample: at most ``SAMPLE`` training texts over all languages
(the smallest of a hash, about evenly by language); prediction covers every whole
text, in pieces where it is long.

Cases: null text, or one without a letter, is ``und`` with score 0; so is every
text if no training row has a language.  Rows without a language are not learned
from.  Ties go to the first language by code point.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.operators.ops_tables import tail_per_key
from weft.llm.words import mix

N = 3
GRAM_BITS = 14
SAMPLE = 2400
LANDMARKS = 256
RIDGE = 1e-2
UNKNOWN = "und"
#: Characters looked at in one step; a longer text's presence bits are merged.
PIECE = 1 << 18


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(sys.maxunicode + 1)])


def presence(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(rows x 2^GRAM_BITS presence bits, whether a row has a letter)."""
    letters = _letters()
    out = np.zeros((len(texts), 1 << GRAM_BITS), dtype=bool)
    some = np.zeros(len(texts), dtype=bool)
    flat = out.reshape(-1)
    lo = 0
    while lo < len(texts):  # texts together until a piece is full
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi] or "") <= PIECE):
            size += len(texts[hi] or "") + 1
            hi += 1
        if hi == lo + 1 and size > PIECE:
            t = texts[lo]
            parts = [(lo, t[a:a + PIECE + N - 1]) for a in range(0, len(t), PIECE)]
        else:
            parts = [(-1, "\n".join(t or "" for t in texts[lo:hi]))]
        for row, t in parts:
            low = t.lower()
            if row < 0:
                pieces = [(t or "").lower() for t in texts[lo:hi]]
                low = "".join("\n" + p for p in pieces)
                rows = np.repeat(np.arange(lo, hi), [len(p) + 1 for p in pieces])
            else:
                low = "\n" + low
                rows = np.full(len(low), row)
            code = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            letter = letters[np.minimum(code, sys.maxunicode)]
            some[rows[letter]] = True
            keep = letter.copy()
            keep[1:] |= letter[:-1]  # the first of a run of others is the blank
            keep[0] = True
            code = np.where(letter, code, np.uint32(32))[keep].astype(np.uint64)
            rows, letter = rows[keep], letter[keep]
            h = np.zeros(len(code), dtype=np.uint64)
            for n in range(1, N + 1):
                h = h[:len(code) - n + 1] * np.uint64(1 << 21) + code[n - 1:]
                same = (rows[:len(h)] == rows[n - 1:]) & (letter[:len(h)] | letter[n - 1:])
                bit = mix(h[same] + np.uint64(n * 0x9E3779B97F4A7C15 % 2 ** 64)) >> np.uint64(64 - GRAM_BITS)
                flat[rows[:len(h)][same] * (1 << GRAM_BITS) + bit.astype(np.int64)] = True
        lo = hi
    return out, some


class Model:
    """Landmark bits and weights: at most LANDMARKS x 2^GRAM_BITS bits."""

    def __init__(self, names: list[str], landmarks: np.ndarray, weights: np.ndarray):
        self.names = names
        used = landmarks.any(axis=0) if len(landmarks) else np.zeros(1 << GRAM_BITS, bool)
        self.used = np.flatnonzero(used)
        self.grams = np.ascontiguousarray(landmarks[:, used].T.astype(np.float32))
        self.norm = np.sqrt(np.maximum(landmarks.sum(axis=1), 1)).astype(np.float32) if len(landmarks) else None
        self.weights = weights.astype(np.float32)

    def outputs(self, bits: np.ndarray) -> np.ndarray:
        size = np.sqrt(np.maximum(bits.sum(axis=1), 1)).astype(np.float32)
        k = (bits[:, self.used].astype(np.float32) @ self.grams) / size[:, None] / self.norm
        return np.concatenate([k, np.ones((len(k), 1), np.float32)], axis=1) @ self.weights

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        bits, some = presence(texts)
        if not self.names:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        y = self.outputs(bits)
        best = y.argmax(axis=1)
        score = np.where(some, np.clip(y[np.arange(len(y)), best], 0, 1), 0.0)
        return [self.names[b] if s else UNKNOWN for b, s in zip(best, some, strict=True)], score.astype(float)


def fit(names: list[str], labels: np.ndarray, bits: np.ndarray) -> Model:
    """Ridge regression of +1 / 0 targets on Nystroem features; every language
    has the same total weight.  ``bits`` are the sample's presence bits."""
    if not names:
        return Model([], np.zeros((0, 1 << GRAM_BITS), bool), np.zeros((1, 1)))
    per = max(1, LANDMARKS // len(names))
    marks = np.concatenate([np.flatnonzero(labels == i)[:per] for i in range(len(names))])
    size = np.sqrt(np.maximum(bits.sum(axis=1), 1))
    dense = bits.astype(np.float32)
    k = (dense @ dense[marks].T) / size[:, None] / size[marks]
    value, vector = np.linalg.eigh(k[marks].astype(np.float64))
    good = value > 1e-6 * value.max()
    whiten = vector[:, good] / np.sqrt(value[good])
    x = np.concatenate([k @ whiten, np.ones((len(k), 1))], axis=1)
    y = np.eye(len(names))[labels]
    weight = 1.0 / np.maximum(np.bincount(labels, minlength=len(names)), 1)[labels]
    gram = (x * weight[:, None]).T @ x + RIDGE * len(names) / x.shape[1] * np.eye(x.shape[1])
    w = np.linalg.solve(gram, (x * weight[:, None]).T @ y)
    return Model(names, bits[marks], np.concatenate([whiten @ w[:-1], w[-1:]]))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          learn: Column | None = None, sample: int = SAMPLE) -> Model:
    """Fit on a bounded sample of the rows that ``learn`` selects and that have a
    language: at most ``sample`` distinct rows, an equal number a language, copies once.  Texts stay
    on the executors; the sample's presence bits (2 KB a text) come to the driver."""
    rows = docs.where(F.col(lang_col).isNotNull())
    if learn is not None:
        rows = rows.where(learn)
    counts = sorted((r[0], r[1]) for r in rows.groupBy(lang_col).count().collect())
    if not counts:
        return fit([], np.zeros(0, int), np.zeros((0, 1 << GRAM_BITS), bool))
    names = [name for name, _ in counts]
    per = max(1, sample // len(names))
    # of each language the ``per`` distinct rows (id and text) of the smallest 128-bit hashes
    hashed = rows.where(F.col(text_col).rlike(r"\p{L}")).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.lit(1), F.col(id_col), F.col(text_col)).alias("f1"),
        F.xxhash64(F.lit(2), F.col(text_col), F.col(id_col)).alias("f2"))
    keys = tail_per_key(hashed.select("lang", "f1", "f2").distinct(), "lang", [F.col("f1"), F.col("f2")], per)
    picked = hashed.join(F.broadcast(keys.select("lang", "f1", "f2")), ["lang", "f1", "f2"], "left_semi")  # ``sample`` rows

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()  # at most ``sample``
        for batch in batches:
            fresh = []
            for k in zip(*(batch.column(c).to_pylist() for c in ("lang", "f1", "f2")), strict=True):
                fresh.append(k not in seen)
                seen.add(k)
            batch = batch.filter(pa.array(fresh, pa.bool_()))
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                bits, some = presence(part.column("text").to_pylist())
                packed = np.packbits(bits, axis=1)
                col = pa.array([p.tobytes() if s else None for p, s in zip(packed, some, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("lang", "f1", "f2")), col], ["lang", "u", "f2", "bits"])

    got = (picked.mapInArrow(pack, "lang string, u long, f2 long, bits binary").where("bits IS NOT NULL")
           .groupBy("lang", "u", "f2").agg(F.first("bits").alias("bits")).collect())
    got.sort(key=lambda r: (r["lang"], r["u"], bytes(r["bits"])))
    number = {name: i for i, name in enumerate(names)}
    taken = dict.fromkeys(names, 0)
    keep = []
    for r in got:
        taken[r["lang"]] += 1
        if taken[r["lang"]] <= per:
            keep.append(r)
    present = [name for name in names if taken[name]]
    number = {name: i for i, name in enumerate(present)}
    if not present:
        return fit([], np.zeros(0, int), np.zeros((0, 1 << GRAM_BITS), bool))
    bits = np.unpackbits(np.array([np.frombuffer(r["bits"], np.uint8) for r in keep]), axis=1).astype(bool)
    return fit(present, np.array([number[r["lang"]] for r in keep]), bits)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without ``text_col``, plus ``lang_pred`` and ``score`` (they
    replace columns of those names).  Only the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size: LANDMARKS rows of bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            names: list[str] = []
            scores: list[np.ndarray] = []
            texts = batch.column(text_col)
            for lo in range(0, batch.num_rows, 128):
                a, b = m.predict(texts.slice(lo, 128).to_pylist())
                names += a
                scores.append(b)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(names, pa.string()),
                 pa.array(np.concatenate(scores) if scores else np.zeros(0))], [*keep, "lang_pred", "score"])

    keep = [c for c in docs.columns if c not in (text_col, "lang_pred", "score")]
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(run, schema)
