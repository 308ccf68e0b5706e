"""Approximate nearest neighbours: a vantage-point tree per shard.

Rows are hashed to shards of about ``SHARD_ROWS``; each shard's tree is built
from all its rows and stored.  A node holds a vantage point and the median
distance mu of the rest to it.  Searching with the k-th distance tau found so
far, the triangle inequality allows skipping a side whose gap |d - mu| to the
query exceeds tau; here a side is skipped already if the gap exceeds ``factor`` *
tau.  Factor 1 is exact search; smaller factors skip more and may miss some.
Queries run through a tree together (a batch splits at every node), and the
shards' k nearest are merged.  Distances are Euclidean in double precision on the
original vectors; ties go to the smaller id.

Cases: vectors that are null, empty, zero, or hold null or non-finite components
take no part, nor do rows without an id; only vectors of a query's length are its
candidates; a query with fewer than k candidates gets all of them; rows of one id are one
query (its smallest vector), never each other's candidates, and one candidate each for others;
many equal vectors make one large leaf.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.knn import matrix, ranked, stored, valid

SHARD_ROWS = 4096
QUERY_BLOCK = 2048
LEAF = 64
#: Recall at 10 stays above 0.9 on clustered vectors of 64 dimensions (see tests).
FACTOR = 0.8


class Tree:
    """Vantage-point tree in flat arrays; leaves are ranges of ``order``."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, nodes=None, order=None):
        self.ids, self.x = ids, x
        if nodes is not None:
            self.nodes, self.order = nodes, order
            return
        self.order = np.arange(len(ids))
        rows: list[list[float]] = []  # vantage, mu, inside, outside, lo, hi
        rng = np.random.default_rng(5)

        def build(lo: int, hi: int) -> int:
            me = len(rows)
            rows.append([-1, 0, -1, -1, lo, hi])
            if hi - lo <= LEAF:
                return me
            v = int(rng.integers(lo, hi))
            self.order[[lo, v]] = self.order[[v, lo]]
            rest = self.order[lo + 1:hi]
            d = distances(x[self.order[lo]][None], x[rest])[0]
            by = np.argsort(d, kind="stable")
            half = len(by) // 2
            mu = d[by[half]]
            if d[by[0]] == d[by[-1]]:  # copies: nothing to split
                return me
            cut = int(np.searchsorted(d[by], mu, side="right"))
            if cut == len(by):
                cut = int(np.searchsorted(d[by], mu, side="left"))
                mu = d[by[cut - 1]]
            self.order[lo + 1:hi] = rest[by]
            rows[me][0], rows[me][1] = self.order[lo], mu
            rows[me][2] = build(lo + 1, lo + 1 + cut)
            rows[me][3] = build(lo + 1 + cut, hi)
            return me

        if len(ids):
            build(0, len(ids))
        self.nodes = np.array(rows, dtype=np.float64).reshape(-1, 6)

    def search(self, qid: np.ndarray, q: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """(distances, ids) of each query's k nearest found; inf where fewer."""
        best = np.full((len(q), k), np.inf)
        who = np.full((len(q), k), np.iinfo(np.int64).max)

        def offer(active: np.ndarray, rows: np.ndarray) -> np.ndarray:
            d = distances(q[active], self.x[rows])
            ids = np.broadcast_to(self.ids[rows], d.shape)
            e = np.where(qid[active][:, None] == ids, np.inf, d)
            all_d = np.concatenate([best[active], e], axis=1)
            all_i = np.where(np.isinf(all_d), np.iinfo(np.int64).max, np.concatenate([who[active], ids], axis=1))
            keep = np.lexsort((all_i, all_d), axis=1)[:, :k]
            best[active] = np.take_along_axis(all_d, keep, axis=1)
            who[active] = np.take_along_axis(all_i, keep, axis=1)
            return d

        def visit(node: int, active: np.ndarray) -> None:
            v, mu, inside, outside, lo, hi = self.nodes[node]
            if not len(active):
                return
            if v < 0:
                for a in range(int(lo), int(hi), 4 * LEAF):
                    offer(active, self.order[a:min(a + 4 * LEAF, int(hi))])
                return
            d = offer(active, np.array([int(v)]))[:, 0]
            near = d <= mu
            visit(int(inside), active[near])
            visit(int(outside), active[~near])
            limit = factor * best[active, -1] * (1 + 1e-12)
            cross = np.abs(d - mu) <= limit
            visit(int(outside), active[near & cross])
            visit(int(inside), active[~near & cross])

        if len(self.nodes):
            step = 256
            for a in range(0, len(q), step):
                visit(0, np.arange(a, min(a + step, len(q))))
        return best, who


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances, each summed over its own differences."""
    out = np.empty((len(a), len(b)))
    step = max(1, (1 << 20) // max(1, b.size))
    for lo in range(0, len(a), step):
        diff = a[lo:lo + step, None, :] - b[None]
        out[lo:lo + step] = np.sqrt((diff * diff).sum(axis=2))
    return out


def build_index(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(shard, dim, ids, x, nodes, row_order): one stored tree a shard, holding
    every row that takes part."""
    rows = _rows(vectors, id_col, vec_col)
    shards = max(1, -(-rows.count() // SHARD_ROWS))

    def build(key, table):
        ids = table.column("id").to_numpy()
        by = np.argsort(ids, kind="stable")
        ids, x = ids[by], matrix(table.column("v"))[by]
        t = Tree(ids, x)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "dim": pa.array([x.shape[1]], pa.int32()),
                         "ids": [ids.tobytes()], "x": [x.tobytes()], "nodes": [t.nodes.tobytes()],
                         "row_order": [t.order.astype(np.int64).tobytes()]})

    return stored(rows.select("id", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard"))
                  .groupBy("shard", "dim").applyInArrow(
                      build, "shard long, dim int, ids binary, x binary, nodes binary, row_order binary"), "vp-trees")


def _rows(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    some = F.exists(vec_col, lambda x: x != 0)
    return (vectors.where(valid(vec_col) & some & F.col(id_col).isNotNull())
            .select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")))


def search(index: DataFrame, queries: DataFrame, k: int = 10, factor: float = FACTOR, id_col: str = "vec_id",
           vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, <id>, score): each query's k nearest rows found, without
    the row of its own id.  Queries go to every shard in blocks."""
    asked = _rows(queries, id_col, vec_col).groupBy("id").agg(F.min("v").alias("v"))
    q = stored(asked.withColumn("dim", F.size("v")), "vp-queries")
    blocks = max(1, -(-q.count() // QUERY_BLOCK))
    trees = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    last = index.agg(F.max("shard")).first()[0]
    everywhere = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last or 0).cast("long")))
    asked = (q.withColumn("block", F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(blocks)).cast("int"))
             .withColumn("shard", everywhere))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        if left.num_rows and right.num_rows:
            r = {c: right.column(c)[0].as_py() for c in ("ids", "x", "nodes", "row_order", "dim")}
            ids = np.frombuffer(r["ids"], np.int64)
            tree = Tree(ids, np.frombuffer(r["x"]).reshape(len(ids), r["dim"]),
                        np.frombuffer(r["nodes"]).reshape(-1, 6), np.frombuffer(r["row_order"], np.int64))
            qid = left.column("id").to_numpy()
            d, who = tree.search(qid, matrix(left.column("v")), k, factor)
            a, b = np.nonzero(np.isfinite(d))
            for o, x in zip(out, (qid[a], who[a, b], d[a, b]), strict=True):
                o.append(x)
        return pa.table({c: np.concatenate(o) for c, o in zip(("query_id", "id", "score"), out, strict=True)})

    keys = ["shard", "dim", "block"]
    found = asked.groupBy(*keys).cogroup(trees.groupBy(*keys)).applyInArrow(run, "query_id long, id long, score double")
    return ranked(found, k, F.col("score"), id_col)
