"""Quality classifier: a weak-label model and a hashed linear scorer.

Heuristic labellers look at each text and vote good, bad or abstain; they
overlap and err.  Expectation-maximisation estimates, from vote patterns alone,
how often each labeller gives each vote to good and to bad texts, and the share
of good texts.  The posterior of a text's pattern is its soft label, on which a
logistic regression over hashed features (word shapes, character classes, repeats) is fitted; that
scorer, not the votes, decides, so it also judges texts on which all abstain.

The vote patterns are counted over all texts (at most 3^8 rows).  The scorer is
fitted on the ``SAMPLE`` distinct texts with the smallest hashes (all, if there are
fewer), each once however often it occurs; every text is scored whole.  No human
labels are used.

Cases: a text without words (null or empty) has score 0 and is rejected; an
empty table gives an empty result; equal texts get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.llm.neardup import _stored
from weft.llm.words import column_words, mix, slices, text_buffer

ABSTAIN, BAD, GOOD = 0, 1, 2
LABELLERS = ("symbols", "capitals", "shouting", "tables", "repeated_words", "vocabulary", "sentences", "plain_bytes")
BUCKETS = 1 << 10
SAMPLE = 8_000
THRESHOLD = 0.5

UPPER, LOWER, DIGIT, SYMBOL, HIGH = 1, 2, 4, 8, 16
_KIND = np.zeros(256, np.uint8)
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = UPPER, LOWER, DIGIT, HIGH
for _c in b"#$%&*+<=>@\\^_`{|}~":
    _KIND[_c] = SYMBOL
#: Letters, digits and the marks of ordinary sentences.
_PLAIN = (_KIND & (UPPER | LOWER | DIGIT | HIGH)) > 0
_PLAIN[list(b".,;:'\"()-?/")] = True


def _per_row(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask)])
    return total[offsets[1:]] - total[offsets[:-1]]


def statistics(col: pa.Array) -> dict[str, np.ndarray]:
    """Counts of every text that the labellers and the scorer look at."""
    data, offsets = text_buffer(col)
    w = column_words(col)
    n = w.counts
    kind = _KIND[data]
    row = np.repeat(np.arange(len(n)), n)
    edge = lambda f: f(kind, w.start) if len(w.start) else np.zeros(0, np.uint8)
    any_kind = edge(np.bitwise_or.reduceat)
    # spaces between words belong to no kind, so reduceat up to the next word is the word's own
    upper = (any_kind & (UPPER | LOWER)) == UPPER
    symbol = (any_kind & SYMBOL) > 0
    bang = np.zeros(len(n), np.int64)
    if len(data) > 1:
        double = (data[:-1] == 33) & (data[1:] == 33)
        bang = _per_row(np.append(double, False), offsets)
    h = w.hash
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    distinct = np.unique(mix(h + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
    last = data[w.end - 1] if len(h) else np.zeros(0, np.uint8)
    stops = (last == 46) | (last == 63) | (last == 33) | (last == 44)
    count = lambda mask: np.bincount(row[mask], minlength=len(n))
    return {"words": n, "symbol": count(symbol), "upper": count(upper & (w.end - w.start > 1)), "bang": bang,
            "bar": _per_row(data == 124, offsets), "again": count(again),
            "distinct": np.bincount(row[distinct], minlength=len(n)), "stops": count(stops),
            "plain": _per_row(_PLAIN[data], offsets),
            "space": _per_row((data == 32) | (data == 10), offsets), "bytes": np.diff(offsets)}


def votes(s: dict[str, np.ndarray]) -> np.ndarray:
    """(rows x labellers) votes; the labellers read overlapping evidence."""
    n = np.maximum(s["words"], 1)
    some = s["words"] > 0

    def vote(x, bad_above, good_below, at_least=1):
        out = np.where(x >= bad_above, BAD, np.where(x <= good_below, GOOD, ABSTAIN))
        return np.where(some & (s["words"] >= at_least), out, ABSTAIN)

    ink = np.maximum(s["bytes"] - s["space"], 1)
    return np.stack([
        vote(s["symbol"] / n, 0.15, 0.02),
        vote(s["upper"] / n, 0.15, 0.03),
        vote(s["bang"] / n, 0.10, 0.01),
        vote(s["bar"] / n, 0.12, 0.005),
        vote(s["again"] / n, 0.10, 0.02),
        vote(-s["distinct"] / n, -0.25, -0.45, 30),
        vote(-s["stops"] / n, -0.02, -0.06, 30),
        vote(-s["plain"] / ink, -0.90, -0.97),
    ], axis=1).astype(np.uint8)


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray, np.ndarray]:
    """(share of good, P(vote | class) as class x labeller x vote, posterior of
    good for every pattern) by expectation-maximisation, started from the vote
    majority."""
    bad, good = (patterns == BAD).sum(axis=1), (patterns == GOOD).sum(axis=1)
    # one sound alarm outweighs several labellers that find nothing
    q = np.where(bad > 0, 0.1, np.where(good > 0, 0.9, 0.5)).astype(float)
    total = max(counts.sum(), 1)
    prior, table = 0.5, None
    for _ in range(rounds):
        prior = float(np.clip((q * counts).sum() / total, 1e-3, 1 - 1e-3))
        table = np.empty((2, patterns.shape[1], 3))
        for c, weight in enumerate(((1 - q) * counts, q * counts)):
            for v in (ABSTAIN, BAD, GOOD):
                table[c, :, v] = (weight[:, None] * (patterns == v)).sum(axis=0) + 1
            table[c] /= table[c].sum(axis=1, keepdims=True)
        cols = np.arange(patterns.shape[1])
        logs = np.log(table[:, cols[None], patterns]).sum(axis=2)
        new = 1 / (1 + np.exp(np.clip(np.log(1 - prior) + logs[0] - np.log(prior) - logs[1], -500, 500)))
        if np.abs(new - q).max() < 1e-9:
            q = new
            break
        q = new
    return prior, table, q


def features(col: pa.Array, s: dict[str, np.ndarray]) -> np.ndarray:
    """(rows x BUCKETS) hashed features: shares of word shapes (the kinds of a
    word's bytes, first, last, length class) and of repeats, scaled by square root."""
    data, _ = text_buffer(col)
    w = column_words(col)
    n = len(w.counts)
    row = np.repeat(np.arange(n), w.counts)
    out = np.zeros((n, BUCKETS), np.float32)
    if len(w.start):
        kind = _KIND[data]
        shape = np.bitwise_or.reduceat(kind, w.start).astype(np.uint64)
        last = data[w.end - 1].astype(np.uint64)
        last = np.where(last >= 128, np.uint64(128), np.where(_KIND[data[w.end - 1]] & (UPPER | LOWER), np.uint64(97), last))
        length = np.minimum(np.log2(w.end - w.start + 1).astype(np.uint64), np.uint64(6))
        again = np.zeros(len(row), np.uint64)
        again[1:] = ((w.hash[1:] == w.hash[:-1]) & (row[1:] == row[:-1])).astype(np.uint64)
        pair = shape.copy()
        pair[1:] = np.where(row[1:] == row[:-1], shape[:-1] * np.uint64(64) + shape[1:], shape[1:])
        for salt, f in enumerate((shape, last, length, again, pair, shape * np.uint64(1024) + last)):
            slot = (mix(f * np.uint64(31) + np.uint64((salt + 1) * 0x9E3779B97F4A7C15 % 2 ** 64))
                    % np.uint64(BUCKETS)).astype(np.int64)
            out += np.bincount(row * BUCKETS + slot, minlength=n * BUCKETS).reshape(n, BUCKETS)
    out /= np.maximum(w.counts, 1)[:, None]
    fresh = s["distinct"] / np.maximum(s["words"], 1)
    out[:, 0] = np.where(s["words"] >= 30, 1 - fresh, 0)
    return np.sqrt(out)


class Model:
    def __init__(self, posterior: dict[int, float], weights: np.ndarray):
        self.posterior, self.weights = posterior, weights

    def score(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(scorer's probability of good, posterior of the votes)."""
        s = statistics(col)
        x = features(col, s) @ self.weights[:-1] + self.weights[-1]
        p = np.where(s["words"] > 0, 1 / (1 + np.exp(-np.clip(x, -50, 50))), 0.0)
        q = np.array([self.posterior.get(int(c), 0.5) for c in code(votes(s))])
        return p, np.where(s["words"] > 0, q, 0.0)


def code(v: np.ndarray) -> np.ndarray:
    return (v.astype(np.int64) * 3 ** np.arange(v.shape[1])).sum(axis=1)


def logistic(x: np.ndarray, q: np.ndarray, ridge: float = 1e-3, rounds: int = 30) -> np.ndarray:
    """Soft-label logistic regression by Newton steps, both classes weighing the
    same in total."""
    x = np.concatenate([x, np.ones((len(x), 1), x.dtype)], axis=1).astype(np.float64)
    weight = q / max(q.sum(), 1e-9) + (1 - q) / max((1 - q).sum(), 1e-9)
    b = np.zeros(x.shape[1])
    target = (q / max(q.sum(), 1e-9)) / np.maximum(weight, 1e-300)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (weight * (p - target)) + ridge * b
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b))
        step = np.linalg.solve(h, g)
        b -= step
        if np.abs(step).max() < 1e-6:
            break
    return b


def _smallest(distinct: DataFrame, sample: int) -> tuple[int, int] | None:
    """The ``sample``-th smallest (f1, f2), or the largest if there are fewer.
    Counts of ``f1`` by its upper 16 bits (65,536 at most) bound what is sorted."""
    upper = F.shiftright("f1", 48)
    counts = sorted(distinct.groupBy(upper.alias("u")).count().collect())
    if not counts:
        return None
    total = np.cumsum([n for _, n in counts])
    edge = counts[min(int(np.searchsorted(total, sample)), len(counts) - 1)][0]
    rows = distinct.where(upper <= edge).orderBy("f1", "f2").limit(sample).collect()
    return rows[-1]["f1"], rows[-1]["f2"]


def train(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Bounded results reach the driver: counts of vote patterns and of hash
    ranges, and the hashes and features of at most ``sample`` texts: those with the
    smallest 128-bit hashes among the distinct texts with words (equal texts once)."""
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch, "text", 1 << 20):
                stats = statistics(s.column("text"))
                yield pa.RecordBatch.from_arrays([s.column("f1"), s.column("f2"), pa.array(code(votes(stats)))],
                                                 ["f1", "f2", "pattern"]).filter(pa.array(stats["words"] > 0))

    texts = docs.select(F.xxhash64(F.lit(9), text_col).alias("f1"),
                        F.xxhash64(F.lit(1), F.reverse(text_col)).alias("f2"), F.col(text_col).alias("text"))
    looked = _stored(texts.mapInArrow(look, "f1 long, f2 long, pattern long"), "looked")
    rows = looked.groupBy("pattern").agg(F.count("*").alias("n")).collect()
    rows.sort()
    width = len(LABELLERS)
    codes = np.array([r[0] for r in rows], dtype=np.int64)
    patterns = (codes[:, None] // 3 ** np.arange(width)) % 3
    counts = np.array([r[1] for r in rows], dtype=np.float64)
    last = _smallest(looked.select("f1", "f2").distinct(), sample)
    if last is None:
        return Model({}, np.zeros(BUCKETS + 1))
    _, _, q = estimate(patterns, counts)
    posterior = dict(zip(codes.tolist(), q.tolist(), strict=True))

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()  # at most ``sample``
        for batch in batches:
            for s in slices(batch, "text", 1 << 20):
                fresh = []
                for k in zip(s.column("f1").to_pylist(), s.column("f2").to_pylist(), strict=True):
                    fresh.append(k not in seen)
                    seen.add(k)
                s = s.filter(pa.array(fresh, pa.bool_()))
                stats = statistics(s.column("text"))
                x = features(s.column("text"), stats)
                for r, c in enumerate(code(votes(stats)).tolist()):
                    if stats["words"][r]:
                        at = np.flatnonzero(x[r])
                        yield pa.RecordBatch.from_pydict({
                            "f1": s.column("f1").slice(r, 1), "f2": s.column("f2").slice(r, 1),
                            "pattern": pa.array([c], pa.int64()), "at": pa.array([at.astype(np.uint16).tobytes()]),
                            "x": pa.array([x[r][at].tobytes()])})

    picked = texts.where((F.col("f1") < last[0]) | ((F.col("f1") == last[0]) & (F.col("f2") <= last[1])))
    picked = picked.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    got = picked.mapInArrow(collect, "f1 long, f2 long, pattern long, at binary, x binary") \
        .groupBy("f1", "f2").agg(F.first(F.struct("pattern", "at", "x")).alias("r")).select("r.*").collect()
    got.sort(key=lambda r: (r[0], bytes(r[1]), bytes(r[2])))
    x = np.zeros((len(got), BUCKETS), np.float32)
    for i, r in enumerate(got):
        x[i, np.frombuffer(r["at"], np.uint16)] = np.frombuffer(r["x"], np.float32)
    return Model(posterior, logistic(x, np.array([posterior[r["pattern"]] for r in got])))


def classify(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` plus ``quality_score``, ``weak_label`` (posterior of the votes)
    and ``keep``; columns of those names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size
    added = ("quality_score", "weak_label", "keep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch, text_col, 1 << 20):
                p, q = shared.value.score(s.column(text_col))
                yield pa.RecordBatch.from_arrays([*(s.column(c) for c in keep), pa.array(p), pa.array(q),
                                                  pa.array(p >= threshold)], [*keep, *added])

    keep = [c for c in docs.columns if c not in added]
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("quality_score", T.DoubleType()),
                           T.StructField("weak_label", T.DoubleType()), T.StructField("keep", T.BooleanType())])
    return docs.mapInArrow(run, schema)
