"""LM scoring: Katz backoff with Good-Turing discounts (order 2).

Tokens are the words of a text plus one end token; the context of the first
word is a start marker.  With counts c and contexts' totals t:

* seen pair:    P(w | v) = d2(c) * c / t(v)
* unseen pair:  P(w | v) = alpha(v) * P(w),  alpha(v) = (1 - sum of the seen
  pairs' probabilities) / (1 - sum of P over the words seen after v)
* unigram:      P(w) = d1(c) * c / N, and the mass the discounts free goes to
  one unknown word, so that the V + 1 words sum to one
* a context never seen in training has alpha = 1.

``d(r)`` is Katz's Good-Turing discount for r <= K (counts of counts over all
training data), 1 above.  A discount that is not in (0, 1] (too few counts to
estimate it) is replaced by 1.  A context, or the unigram level, without any
discounted count gets one extra observation in its denominator, so some mass is
always left and every distribution still sums to one exactly.

Counts live in tables partitioned by bucket in the shared folder; documents are
never joined row by token (see ``chunks``).  A context too frequent for one
bucket is split by its following word, and only its sums are merged.

Cases: null text is empty (the end token alone); a null id is neither learned
from nor held out; no training data gives log10 P = 0 for every token.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.llm import chunks as C
from weft.llm.words import ASCII_LOWER, column_words, mix

K = 5
END = np.uint64(0xE17D)
HELD = "held_out"
ADDED = ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def good_turing(n_r: list[int]) -> np.ndarray:
    """Discounts d(0..K+1): index by min(count, K + 1); d(0) is unused."""
    d = np.ones(K + 2)
    if n_r[1] > 0:
        common = (K + 1) * n_r[K + 1] / n_r[1]
        for r in range(1, K + 1):
            if n_r[r] > 0 and common < 1:
                x = ((r + 1) * n_r[r + 1] / (r * n_r[r]) - common) / (1 - common)
                if 0 < x <= 1:
                    d[r] = x
    return d


class Unigrams:
    """P(w) and the add-0.1 base from counts; a few numbers, whatever the data."""

    def __init__(self, total: int, types: int, n_r: list[int]):
        self.total, self.types = total, types
        self.d = good_turing(n_r)
        free = sum(n_r[r] * r * (1 - self.d[r]) for r in range(1, K + 1))
        self.denominator = total + (0 if free > 0 else 1)
        self.unknown = (free if free > 0 else 1.0) / self.denominator

    def p(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.d[np.minimum(c, K + 1)] * c / self.denominator, self.unknown)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.total + 0.1 * (self.types + 1)))


class _Tokens:
    """Token stream of a chunk: distinct hashes and each token's number among
    them; every row ends with END.  START is number ``start``."""

    def __init__(self, rows: pa.Table, text: str, flag: str):
        w = column_words(rows.column(text), ASCII_LOWER)
        n = len(w.counts)
        self.train = rows.column(flag).to_numpy().astype(bool)
        self.counts = w.counts + 1
        self.doc = np.repeat(np.arange(n), self.counts)
        h = np.empty(len(w.hash) + n, dtype=np.uint64)
        self.last = np.cumsum(self.counts) - 1
        end = np.zeros(len(h), dtype=bool)
        end[self.last] = True
        h[end], h[~end] = END, w.hash
        self.hash, self.which = np.unique(h, return_inverse=True)
        self.in_train = self.train[self.doc]

    def buckets(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        return C.by_bucket((self.hash % np.uint64(n)).astype(np.int64), n)


class _Pairs:
    """Distinct (context, word) pairs of a chunk, grouped by bucket."""

    def __init__(self, t: _Tokens, ids: np.ndarray, counts: np.ndarray, start_id: int, n_train_docs: int,
                 hot: int, n_buckets: int):
        start = len(t.hash)  # number of START
        self.ids = np.append(ids, np.uint64(start_id))
        self.counts = np.append(counts, 0)
        self.totals = np.append(counts, n_train_docs)
        context = np.empty_like(t.which)
        context[1:] = t.which[:-1]
        first = t.last - t.counts + 1
        context[first] = start
        pair, self.which = np.unique((context.astype(np.uint64) << np.uint64(32)) | t.which.astype(np.uint64),
                                     return_inverse=True)
        self.context = (pair >> np.uint64(32)).astype(np.int64)
        self.word = (pair & np.uint64(0xFFFFFFFF)).astype(np.int64)
        self.trained = np.bincount(self.which[t.in_train], minlength=len(pair))
        # a context above ``hot`` is split by word
        split = np.maximum(-(-self.totals[self.context] // hot), 1).astype(np.uint64)
        self.split = split > 1
        salt = np.where(self.split, mix(self.ids[self.word] + np.uint64(1)) % split, 0).astype(np.uint64)
        bucket = (mix(self.ids[self.context] * np.uint64(0x9E3779B97F4A7C15) + salt) % np.uint64(n_buckets))
        self.order, self.bounds = C.by_bucket(bucket.astype(np.int64), n_buckets)

    def of(self, b: int) -> np.ndarray:
        """Pair numbers of a bucket; pairs of one context are adjacent."""
        return self.order[self.bounds[b]:self.bounds[b + 1]]

    def runs(self, k: np.ndarray) -> np.ndarray:
        """First position of every context in ``k``."""
        c = self.context[k]
        return np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))


def _counts(answer: dict, t: _Tokens, n: int) -> tuple[np.ndarray, np.ndarray]:
    order, bounds = t.buckets(n)
    c, ids = np.zeros(len(t.hash), np.int64), np.zeros(len(t.hash), np.uint64)
    for b, x in answer.items():
        k = order[bounds[b]:bounds[b + 1]]
        c[k] = C.unpack(x["counts"], np.int64)
        ids[k] = C.unpack(x["ranks"], np.uint64) * np.uint64(n) + np.uint64(b + 1)
    return c, ids


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          train: Column | None = None, held_out: Column | None = None) -> DataFrame:
    """``docs`` without ``text_col``, plus ``held_out, n_tokens, n_known,
    train_tokens, base_score, score`` (they replace columns of those names).

    ``train`` marks the rows to learn from (default: crc32 of the id modulo 10
    is not 0), ``held_out`` fills the column of that name (default: it is 0).
    """
    spark = docs.sparkSession
    n = C.n_buckets(spark)
    fold = F.crc32(F.col(id_col).cast("string").cast("binary")) % 10
    train = F.coalesce(fold != 0, F.lit(False)) if train is None else train
    held_out = F.coalesce(fold == 0, F.lit(False)) if held_out is None else held_out
    # whether a row is learned from travels under a name that no other column has
    flag = next(x for x in (f"_train{'_' * i}" for i in range(len(docs.columns) + 1)) if x not in docs.columns)
    kept = [F.col(c) for c in docs.columns if c not in ADDED]
    docs = docs.select(*kept, train.alias(flag), held_out.alias(HELD))
    chunks = C.write_chunks(docs, text_col, name="katz")

    # -- unigrams ---------------------------------------------------------
    def words_of(cid: int, rows: pa.Table) -> Iterator[dict]:
        t = _Tokens(rows, text_col, flag)
        c = np.bincount(t.which[t.in_train], minlength=len(t.hash))
        order, bounds = t.buckets(n)
        for b in range(n):
            k = order[bounds[b]:bounds[b + 1]]
            if len(k):
                yield {"bucket": [b], "chunk_id": [cid], "hash": [t.hash[k].tobytes()], "counts": [C.pack(c[k])],
                       "docs": [int(t.train.sum()) if b == int(END % np.uint64(n)) else 0]}

    def count_words(b: int, parts: pa.Table) -> Iterator[dict]:
        hashes = [np.frombuffer(x, np.uint64) for x in parts.column("hash").to_pylist()]
        c = np.concatenate([C.unpack(x, np.int64) for x in parts.column("counts").to_pylist()])
        h, which = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(which, weights=c, minlength=len(h)).astype(np.int64)
        n_r = np.bincount(np.minimum(total, K + 2), minlength=K + 3)
        lo = 0
        for cid, x in zip(parts.column("chunk_id").to_pylist(), hashes, strict=True):
            k = which[lo:lo + len(x)]
            yield {"chunk_id": [cid], "bucket": [b], "counts": [C.pack(total[k])],
                   "ranks": [C.pack(k.astype(np.uint64))], "stats": [None]}
            lo += len(x)
        docs_seen = sum(parts.column("docs").to_pylist())
        yield {"chunk_id": [None], "bucket": [b], "counts": [None], "ranks": [None],
               "stats": [[int(total.sum()), int((total > 0).sum()), docs_seen, *map(int, n_r[1:K + 2])]]}

    parts = C.map_chunks(chunks, words_of, "bucket int, chunk_id long, hash binary, counts binary, docs long")
    uni = _stored(C.reduce_buckets(parts, count_words,
                                   "chunk_id long, bucket int, counts binary, ranks binary, stats array<long>"))
    total, types, train_docs, *n_r = _sums(uni, 3 + K + 1)
    unigrams = Unigrams(total, types, [0, *n_r])
    uni = uni.where("chunk_id IS NOT NULL").drop("stats")
    hot = max(total // (4 * n), 1)
    start_id = 0  # words count from 1

    def pairs_of(t: _Tokens, answer: dict) -> _Pairs:
        c, ids = _counts(answer, t, n)
        return _Pairs(t, ids, c, start_id, train_docs, hot, n)

    # -- pairs ------------------------------------------------------------
    def ask(cid: int, rows: pa.Table, answer: dict) -> Iterator[dict]:
        p = pairs_of(_Tokens(rows, text_col, flag), answer)
        for b in range(n):
            k = p.of(b)
            if len(k):
                run = p.runs(k)
                yield {"bucket": [b], "chunk_id": [cid],
                       "contexts": [C.pack(_narrow(p.ids[p.context[k[run]]]))],
                       "split": [C.pack(np.packbits(p.split[k[run]]))],
                       "lengths": [C.pack(np.diff(np.append(run, len(k))).astype(np.uint32))],
                       "words": [C.pack(_narrow(p.ids[p.word[k]]))],
                       "word_counts": [C.pack(p.counts[p.word[k]])],
                       "trained": [C.pack(p.trained[k])],
                       "wide": [bool(p.ids.max() > np.iinfo(np.uint32).max)]}

    def count_pairs(b: int, parts: pa.Table) -> Iterator[dict]:
        cols = {c: parts.column(c).to_pylist() for c in parts.column_names}
        kind = [np.uint64 if x else np.uint32 for x in cols["wide"]]
        contexts = [C.unpack(x, k) for x, k in zip(cols["contexts"], kind, strict=True)]
        lengths = [C.unpack(x, np.uint32) for x in cols["lengths"]]
        size = [int(x.sum()) for x in lengths]
        v = np.concatenate([np.repeat(c, x) for c, x in zip(contexts, lengths, strict=True)]).astype(np.uint64)
        w = np.concatenate([C.unpack(x, k) for x, k in zip(cols["words"], kind, strict=True)]).astype(np.uint64)
        wc = np.concatenate([C.unpack(x, np.int64) for x in cols["word_counts"]])
        c = np.concatenate([C.unpack(x, np.int64) for x in cols["trained"]])
        if any(cols["wide"]):
            order = np.lexsort((w, v))
        else:
            order = np.argsort((v << np.uint64(32)) | w)
        v, w = v[order], w[order]
        new = np.concatenate([[True], (v[1:] != v[:-1]) | (w[1:] != w[:-1])])
        first = np.flatnonzero(new)
        total = np.add.reduceat(c[order], first)
        number = np.cumsum(new) - 1  # pair number of every sorted entry
        count = np.empty(len(order), dtype=np.int64)
        count[order] = total[number]
        # sums of every context over its distinct seen pairs
        fresh = np.concatenate([[True], v[first][1:] != v[first][:-1]])
        at = np.flatnonzero(fresh)
        low = np.where(total > 0, unigrams.p(wc[order][first]), 0.0)
        sums = np.empty((len(at), K + 2))  # pairs with count 1..K, tokens, P of the seen words
        for r in range(1, K + 1):
            sums[:, r - 1] = np.add.reduceat((total == r).astype(np.int64), at)
        sums[:, K] = np.add.reduceat(total, at)
        sums[:, K + 1] = np.add.reduceat(low, at)
        context = np.empty(len(order), dtype=np.int64)
        context[order] = (np.cumsum(fresh) - 1)[number]
        hot_rows: dict[int, np.ndarray] = {}
        lo = 0
        for i, cid in enumerate(cols["chunk_id"]):
            k = slice(lo, lo + size[i])
            lo += size[i]
            run = np.concatenate([[0], np.cumsum(lengths[i])[:-1]]).astype(np.int64)
            cut = np.unpackbits(C.unpack(cols["split"][i], np.uint8))[:len(run)].astype(bool)
            own = context[k][run]
            for x, j in zip(contexts[i][cut].tolist(), own[cut].tolist(), strict=True):
                hot_rows[x] = sums[j]
            back = _needs_weight(count[k], run) & ~cut
            # which counts 1..K this context has
            has = ((sums[own, :K] > 0) << np.arange(K)).sum(axis=1)
            yield {"chunk_id": [cid], "bucket": [b], "counts": [C.pack(count[k])],
                   "has": [C.pack(has.astype(np.uint8))], "sums": [C.pack(sums[own[back]].T)],
                   "hot": [None], "stats": [None]}
        n_r = [int((total == r).sum()) for r in range(1, K + 2)]
        yield {"chunk_id": [None], "bucket": [b], "counts": [None], "has": [None], "sums": [None],
               "hot": [[(x, s.tolist()) for x, s in hot_rows.items()]], "stats": [n_r]}

    pairs = C.join_chunks(chunks, [uni], ask,
                          "bucket int, chunk_id long, contexts binary, split binary, lengths binary, words binary, "
                          "word_counts binary, trained binary, wide boolean")
    bi = _stored(C.reduce_buckets(pairs, count_pairs,
                                  "chunk_id long, bucket int, counts binary, has binary, sums binary, "
                                  "hot array<struct<context:long, sums:array<double>>>, stats array<long>"))
    d2 = good_turing([0, *_sums(bi, K + 1)])
    hot_sums = _hot(bi)  # fewer than 4 * buckets contexts are above total / (4 * buckets)
    bi = bi.where("chunk_id IS NOT NULL").drop("stats", "hot")

    # -- scores -----------------------------------------------------------
    def evaluate(cid: int, rows: pa.Table, uni_answer: dict, bi_answer: dict) -> Iterator[pa.Table]:
        t = _Tokens(rows, text_col, flag)
        p = pairs_of(t, uni_answer)
        logp = np.empty(len(p.context))
        for b, x in bi_answer.items():
            k = p.of(b)
            c = C.unpack(x["counts"], np.int64)
            run = p.runs(k)
            at = np.cumsum(np.bincount(run, minlength=len(k))) - 1  # context of every pair
            has = C.unpack(x["has"], np.uint8).astype(np.int64)
            cut = p.split[k[run]]
            sums = np.zeros((len(run), K + 2))
            back = _needs_weight(c, run) & ~cut
            sums[back] = C.unpack(x["sums"], np.float64).reshape(K + 2, -1).T
            for j in np.flatnonzero(cut):
                s = hot_sums[int(p.ids[p.context[k[run[j]]]])]
                sums[j], has[j] = s, ((s[:K] > 0) << np.arange(K)).sum()
            total = p.totals[p.context[k]]
            # no discounted pair: one extra observation leaves some mass
            flat = (has & discounted) == 0
            free = (sums[:, :K] * np.arange(1, K + 1) * (1 - d2[1:K + 1])).sum(axis=1)
            extra = flat.astype(np.int64)[at]
            seen = c > 0
            with np.errstate(divide="ignore", invalid="ignore"):
                p_seen = d2[np.minimum(c, K + 1)] * c / (total + extra)
                left = np.where(flat, 1.0, free) / (sums[:, K] + flat)
                alpha = np.where(sums[:, K] > 0, left / (1 - sums[:, K + 1]), 1.0)
            p_back = alpha[at] * unigrams.p(p.counts[p.word[k]])
            logp[k] = np.log10(np.where(seen, p_seen, p_back))
        c = p.counts[t.which]
        m = len(t.counts)
        out = rows.drop_columns([text_col, flag])
        for name, value in (("n_tokens", t.counts.astype(np.int64)),
                            ("n_known", np.bincount(t.doc, weights=c > 0, minlength=m).astype(np.int64)),
                            ("train_tokens", np.full(m, total_tokens, dtype=np.int64)),
                            ("base_score", np.bincount(t.doc, weights=unigrams.base(c), minlength=m)),
                            ("score", np.bincount(t.doc, weights=logp[p.which], minlength=m))):
            out = out.append_column(name, pa.array(value))
        yield out

    total_tokens = total
    discounted = int(((d2[1:K + 1] < 1) << np.arange(K)).sum())
    keep = [f for f in docs.schema if f.name not in (text_col, flag)]
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in keep),
                           *(T.StructField(x, T.LongType()) for x in ("n_tokens", "n_known", "train_tokens")),
                           *(T.StructField(x, T.DoubleType()) for x in ("base_score", "score"))])
    return C.join_chunks(chunks, [uni, bi], evaluate, schema)


def _needs_weight(c: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Contexts (by first position) with an unseen pair."""
    return np.add.reduceat((c == 0).astype(np.int64), run) > 0 if len(run) else np.zeros(0, bool)


def _narrow(ids: np.ndarray) -> np.ndarray:
    return ids.astype(np.uint32) if not len(ids) or ids.max() <= np.iinfo(np.uint32).max else ids


def _stored(df: DataFrame) -> DataFrame:
    from weft.session import scratch_dir

    path = scratch_dir(df.sparkSession, "katz-counts")
    df.write.option("compression", "none").partitionBy("bucket").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _sums(df: DataFrame, n: int) -> list[int]:
    """Sums of the ``stats`` arrays (one row a bucket)."""
    row = df.where("chunk_id IS NULL").agg(*(F.sum(F.col("stats")[i]) for i in range(n))).first()
    return [int(x or 0) for x in row]


def _hot(df: DataFrame) -> dict[int, np.ndarray]:
    rows = (df.where("chunk_id IS NULL").select(F.explode("hot").alias("h"))
            .groupBy(F.col("h.context").alias("context"))
            .agg(*(F.sum(F.col("h.sums")[i]).alias(f"s{i}") for i in range(K + 2))).collect())
    return {r[0]: np.array(r[1:], dtype=float) for r in rows}
