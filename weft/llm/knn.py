"""Exact top-k inner product: a Voronoi kNN join.

Vectors x (integers) become points (x, sqrt(M - |x|^2)) with M the largest |x|^2,
queries (q, 0): then |q' - x'|^2 = |q|^2 + M - 2 q.x, so nearest points are highest
inner products.  Points and queries are grouped by their nearest pivot.

From per-group summaries alone -- radius of each query group, least and largest
distance and the k smallest distances of each point group -- follows a bound
theta of every query group: no query in it has its k-th neighbour farther away.
A point p of group j goes to query group i only if

    |pivot_i, pivot_j| - radius_i - theta_i  <=  |p, pivot_j|

(the triangle inequality), which replicates what may be needed and nothing else.
Each query group meets its points in blocks of at most ``BLOCK_ROWS`` points and
``BLOCK_QUERIES`` queries, solved locally; the blocks' k best of a query are
merged.  So a cell with a third of all rows is many blocks.  Scores are exact
integers; ties go to the smaller id.

Cases: vectors that are null, empty, or hold null or non-finite components take
no part, nor do rows without an id; vectors of another length than a query's are
not its candidates; a query with fewer than k candidates gets all of them.  Rows of one id are never
each other's candidates; they are one query (its smallest vector) and, for other queries,
as many candidates as there are rows.  Components are integers below 2^53 in absolute value
(``whole`` leaves out what is larger); a score beyond a long is the nearest long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.session import scratch_dir

PIVOTS = 32
BLOCK_ROWS = 1 << 14
BLOCK_QUERIES = 1 << 11
#: Slack of the bounds for rounding, relative to the largest length.
SLACK = 1e-6


def valid(vec: str) -> Column:
    """A vector with components, all of them finite."""
    ok = F.forall(F.col(vec), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.col(vec).isNotNull() & (F.size(vec) > 0) & ok


def whole(vec: str, scale: float) -> Column:
    """floor(scale * x) of every component; null where one is 2^53 or more, which a double
    no longer holds exactly."""
    scaled = F.transform(vec, lambda x: F.floor(F.lit(scale) * x.cast("double")))
    fits = F.forall(F.col(vec), lambda x: F.abs(F.lit(scale) * x.cast("double")) < float(1 << 53))
    return F.when(fits, scaled.cast("array<long>"))


def matrix(col: pa.Array | pa.ChunkedArray, dtype=np.float64) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(col), -1)


def stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def best(query: np.ndarray, rows: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's k best entries: highest score, then smallest row id."""
    order = np.lexsort((rows, -score, query))
    q = query[order]
    first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, int)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return order[rank < k]


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id",
          vec_col: str = "vec", pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, <id>, score): the k highest inner products of every query
    row with all other rows.  ``vec_col`` holds integers (array<bigint>)."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"), is_query.alias("q")) \
        .where(F.col("id").isNotNull() & (F.size("v") > 0)) \
        .withColumn("dim", F.size("v")) \
        .withColumn("len2", F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    rows = stored(rows.select("id", "v", "dim", "len2", F.coalesce("q", F.lit(False)).alias("q")), "knn-rows")
    parts = []
    for r in rows.groupBy("dim").agg(F.max("len2").alias("m")).orderBy("dim").collect():
        parts.append(_join(rows.where(F.col("dim") == r["dim"]), r["dim"], r["m"], k, pivots))
    if not parts:
        out = spark.createDataFrame([], "query_id long, id long, score long")
    else:
        from functools import reduce

        out = reduce(DataFrame.unionByName, parts)
    return ranked(out, k, F.col("score").desc(), id_col)


def ranked(found: DataFrame, k: int, order: Column, id_col: str) -> DataFrame:
    """The k best of every query over all blocks; Spark keeps k rows a query in
    each task before the shuffle (window group limit)."""
    w = Window.partitionBy("query_id").orderBy(order, "id")
    return (found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", "rank", F.col("id").alias(id_col), "score"))


def _lift(v: np.ndarray, m: float, query: np.ndarray) -> np.ndarray:
    rest = np.sqrt(np.maximum(float(m) - (v * v).sum(axis=1), 0.0))
    return np.concatenate([v, np.where(query, 0.0, rest)[:, None]], axis=1)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None] - 2 * (x @ y.T)
    return np.sqrt(np.maximum(d, 0))


def _join(rows: DataFrame, dim: int, m: float, k: int, n_pivots: int) -> DataFrame:
    spark = rows.sparkSession
    # pivots: a fixed number of points and of queries, smallest by a hash
    def some(df, n):
        return df.select("v").orderBy(F.xxhash64("id"), "id").limit(n).collect()

    half = max(1, n_pivots // 2)
    p = np.concatenate([_lift(np.array([r[0] for r in got], dtype=float).reshape(len(got), dim), m, np.full(len(got), q))
                        for q, got in ((False, some(rows, half)), (True, some(rows.where("q"), half)))])
    p = np.unique(p, axis=0)
    slack = SLACK * (np.sqrt(float(m)) + 1)

    def assign(batches):
        for batch in batches:
            v = matrix(batch.column("v"))
            is_q = batch.column("q").to_numpy(zero_copy_only=False).astype(bool)
            d = _distances(_lift(v, m, np.zeros(len(v), bool)), p)
            dq = _distances(_lift(v, m, np.ones(len(v), bool)), p)
            near, near_q = d.argmin(axis=1), dq.argmin(axis=1)
            at = np.arange(len(v))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("v"), batch.column("q"),
                 pa.array(near.astype(np.int32)), pa.array(d[at, near]),
                 pa.array(np.where(is_q, near_q, -1).astype(np.int32)), pa.array(dq[at, near_q])],
                ["id", "v", "q", "cell", "d", "qcell", "qd"])

    placed = stored(rows.select("id", "v", "q").mapInArrow(
        assign, "id long, v array<bigint>, q boolean, cell int, d double, qcell int, qd double"), "knn-cells")

    # one row a query id
    asked = stored(placed.where("q").groupBy("id").agg(F.min(F.struct("v", "qcell", "qd")).alias("x"))
                   .select("id", "x.*"), "knn-asked")

    # summaries: one row a cell, the least distances of k + 1 ids (a query's id is not its own candidate)
    def nearest(ids: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        by = np.lexsort((ids, d))
        _, first = np.unique(ids[by], return_index=True)
        by = by[np.sort(first)][:k + 1]
        return ids[by], d[by]

    def summary(batches):
        near: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            cell, d, ids = (batch.column(c).to_numpy() for c in ("cell", "d", "id"))
            for c in np.unique(cell):
                old = near.get(c, (np.zeros(0, np.int64), np.zeros(0)))
                near[c] = nearest(np.concatenate([old[0], ids[cell == c]]), np.concatenate([old[1], d[cell == c]]))
        yield pa.RecordBatch.from_pydict({
            "cell": pa.array([c for c, x in near.items() for _ in x[0]], pa.int32()),
            "id": pa.array([int(y) for x in near.values() for y in x[0]], pa.int64()),
            "d": pa.array([float(y) for x in near.values() for y in x[1]], pa.float64())})

    least = placed.select("cell", "id", "d").mapInArrow(summary, "cell int, id long, d double")
    least = least.groupBy("cell", "id").agg(F.min("d").alias("d")).groupBy("cell").agg(
        F.slice(F.sort_array(F.collect_list(F.struct("d", "id"))), 1, k + 1).alias("near")).collect()
    radius = {r[0]: (r[1], r[2]) for r in asked.groupBy("qcell").agg(F.max("qd"), F.count("*")).collect()}
    sizes = {r[0]: r[1] for r in placed.groupBy("cell").count().collect()}
    apart = _distances(p, p)
    reach: dict[int, float] = {}  # query cell -> radius + theta
    for i, (r, _) in radius.items():
        upper = np.concatenate([r + apart[i, row["cell"]] + np.array([x["d"] for x in row["near"]]) for row in least])
        _, upper = nearest(np.array([x["id"] for row in least for x in row["near"]], dtype=np.int64), upper)
        theta = upper[k] if len(upper) > k else np.inf
        reach[i] = r + theta + slack
    # a point of cell j goes to query cell i if its distance to pivot j is at least this
    bound = {j: {i: apart[i, j] - reach[i] for i in radius} for j in sizes}
    splits = {i: max(1, -(-sum(n for j, n in sizes.items()) // BLOCK_ROWS)) for i in radius}
    blocks = {i: max(1, -(-n // BLOCK_QUERIES)) for i, (_, n) in radius.items()}
    targets = sorted(radius)

    def spread(batches):
        for batch in batches:
            ids, cell = batch.column("id").to_numpy(), batch.column("cell").to_numpy()
            d = batch.column("d").to_numpy()
            for i in targets:
                least_d = np.array([bound[c][i] for c in cell.tolist()])
                at = np.flatnonzero(d >= least_d)
                if not len(at):
                    continue
                split = (ids[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(splits[i])
                for b in range(blocks[i]):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), i, np.int32)), pa.array(split.astype(np.int32)),
                         pa.array(np.full(len(at), b, np.int32)), batch.column("id").take(pa.array(at)),
                         batch.column("v").take(pa.array(at))], ["qcell", "split", "block", "id", "v"])

    def copies(batches):
        for batch in batches:
            ids, cell = batch.column("id").to_numpy(), batch.column("qcell").to_numpy()
            for c in np.unique(cell).tolist():
                at = np.flatnonzero(cell == c)
                b = (ids[at].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(33)) % np.uint64(blocks[c])
                for s in range(splits[c]):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cell[at]), pa.array(np.full(len(at), s, np.int32)), pa.array(b.astype(np.int32)),
                         batch.column("id").take(pa.array(at)), batch.column("v").take(pa.array(at))],
                        ["qcell", "split", "block", "id", "v"])

    schema = "qcell int, split int, block int, id long, v array<bigint>"
    keys = ["qcell", "split", "block"]
    points = placed.select("id", "v", "cell", "d").mapInArrow(spread, schema)
    queries = asked.select("id", "v", "qcell").mapInArrow(copies, schema)

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            qid, rid = left.column("id").to_numpy(), right.column("id").to_numpy()
            q, v = matrix(left.column("v"), np.int64), matrix(right.column("v"), np.int64)
            # exact in double where every partial sum stays below 2^53
            most = float(np.abs(q).max()) * float(np.abs(v).max()) * dim
            small = most < 2.0 ** 53
            step = max(1, (1 << 22) // len(v))
            for lo in range(0, len(q), step):
                if small:
                    s = (q[lo:lo + step].astype(float) @ v.T.astype(float)).astype(np.int64)
                elif most < 2.0 ** 63:
                    s = q[lo:lo + step] @ v.T
                else:  # beyond a long: exact integers, cut to its range
                    s = np.clip(q[lo:lo + step].astype(object) @ v.T.astype(object), -2 ** 63 + 1, 2 ** 63 - 1).astype(np.int64)
                own = qid[lo:lo + step][:, None] == rid[None]
                a, b = np.nonzero(~own & (s >= _kth(np.where(own, np.iinfo(np.int64).min, s), k)[:, None]))
                keep = best(a, rid[b], s[a, b], k)
                out.append((qid[lo:lo + step][a[keep]], rid[b[keep]], s[a[keep], b[keep]]))
        cols = [np.concatenate([np.zeros(0, np.int64), *(o[i] for o in out)]) for i in range(3)]
        return pa.table(dict(zip(("query_id", "id", "score"), cols, strict=True)))

    return queries.groupBy(*keys).cogroup(points.groupBy(*keys)).applyInArrow(solve, "query_id long, id long, score long")


def _kth(s: np.ndarray, k: int) -> np.ndarray:
    """The k-th highest of each row (the lowest if there are fewer)."""
    if s.shape[1] <= k:
        return s.min(axis=1)
    return np.partition(s, -k, axis=1)[:, -k]
