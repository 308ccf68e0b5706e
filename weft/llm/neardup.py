"""MinHash near-dedup: ProbMinHash signatures of weighted shingles, banding,
exact verification, classes.

Elements are the shingles (five words) of a text, weighted by how often they
occur.  Every element sends a Poisson process of arrivals with its weight as
rate; an arrival hits a random register, a register keeps the element that
arrives first.  A row stops as soon as no later arrival can be first anywhere.
Two registers agree with the probability Jaccard similarity

    J_P(a, b) = sum over d of 1 / sum over e of max(a_e / a_d, b_e / b_d)

of the weights (plain Jaccard where all weights are equal).  ``BANDS`` bands of
``ROWS`` registers propose candidates (a pair at 0.8 is missed with probability
(1 - 0.8^6)^32 = 6e-5), their exact J_P decides, and linked texts form classes.

No bucket is expanded into pairs.  Identical texts are one representative.  In a
bucket, members are first compared with one centre.  Buckets that then still hold
several classes are settled inside tasks: the members' shingles become a matrix,
products of it give the shared weight of every member outside the largest class
and every other member, and pairs whose shared weight allows the bound get their
exact J_P.  Only links that merge classes leave the task.  No estimate and no limit
on partners takes part in this.  A bucket too large for one task is cut into
blocks, and every two blocks meet in a task of their own.

Cases: a text without words (null, empty) is a class of its own, however often
it occurs; a text of one to four words is one shingle; texts, not ids, are compared,
so ids may be shared or null; the class id is the smallest id of the class, null ids
aside.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.chunks import release
from weft.llm.words import column_words, mix, ranges, slices, window_hashes, window_starts
from weft.session import scratch_dir

WORDS = 5
BANDS, ROWS = 32, 6
SIMILARITY = 0.8
#: A pair is dropped without an exact comparison if its estimate is lower by
#: this much: five standard errors of BANDS * ROWS registers.
MARGIN = 0.15
#: Members, and bytes of their texts, that a bucket may have to be settled in one
#: task; larger ones are cut into blocks of half that.
LOCAL, LOCAL_BYTES = 4096, 32 << 20
#: Sums of fractions that make exactly the bound may come out this much lower.
ROUNDING = 1e-9
#: Shingles (columns) of one matrix product.
COLUMNS = 2048
_TIME, _REGISTER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def shingles(col: pa.Array, length: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, weight) of the distinct shingles of a text column, by row."""
    w = column_words(col)
    at, counts = window_starts(w.doc, length)
    h = window_hashes(w.hash, length)[at] if len(at) else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(counts)), counts)
    few = np.flatnonzero((w.counts > 0) & (w.counts < length))
    if len(few):
        short = w.hash[w.doc[few]].copy()
        for k in range(1, length - 1):
            more = w.counts[few] > k
            short[more] = mix(short[more] * _TIME + w.hash[w.doc[few][more] + k])
        row, h = np.concatenate([row, few]), np.concatenate([h, mix(short)])
    key = mix(h + row.astype(np.uint64) * _REGISTER)
    _, first, weight = np.unique(key, return_index=True, return_counts=True)
    order = np.argsort(row[first], kind="stable")
    first = first[order]
    return row[first], h[first], weight[order]


def prob_min_hash(row: np.ndarray, h: np.ndarray, weight: np.ndarray, n_rows: int, m: int) -> np.ndarray:
    """Signatures (n_rows x m): the element that arrives first at each register."""
    best = np.full(n_rows * m, np.inf)
    time = np.zeros(len(h))
    slots, times, elements = [], [], []
    live = np.arange(len(h))
    k = 0
    while len(live):
        k += 1
        of_time, of_register = (np.uint64(k * int(c) % 2 ** 64) for c in (_TIME, _REGISTER))
        u = (mix(h[live] + of_time) >> np.uint64(11)).astype(np.float64) + 0.5
        time[live] -= np.log(u * 2.0 ** -53) / weight[live]
        slot = row[live] * m + (mix(h[live] ^ of_register) % np.uint64(m)).astype(np.int64)
        t = time[live]
        early = t < best[slot]
        slots.append(slot[early])
        times.append(t[early])
        elements.append(h[live][early])
        np.minimum.at(best, slots[-1], times[-1])
        last = best.reshape(n_rows, m).max(axis=1)
        live = live[t < last[row[live]]]
    out = np.zeros(n_rows * m, dtype=np.uint64)
    if slots:
        slot, t, e = np.concatenate(slots), np.concatenate(times), np.concatenate(elements)
        first = t == best[slot]
        out[slot[first]] = e[first]
    return out.reshape(n_rows, m)


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.tile(np.arange(bands, dtype=np.uint64) * _TIME, (len(signature), 1))
    s = signature.reshape(len(signature), bands, rows)
    for r in range(rows):
        out = mix(out * _REGISTER + s[:, :, r])
    return out


def probability_jaccard(a: dict[int, float], b: dict[int, float]) -> float:
    """J_P of two weight maps, in O(n log n): elements sorted by a / b split the
    maximum into two sums."""
    keys = list(a.keys() | b.keys())
    if not keys:
        return 1.0
    x = np.array([a.get(k, 0.0) for k in keys])
    y = np.array([b.get(k, 0.0) for k in keys])
    return _jp(x, y)


def _jp(x: np.ndarray, y: np.ndarray) -> float:
    with np.errstate(divide="ignore"):
        order = np.argsort(-(x / y), kind="stable")
    x, y = x[order], y[order]
    both = (x > 0) & (y > 0)
    # e before d in this order has a_e / a_d >= b_e / b_d
    before, behind = np.cumsum(x), y.sum() - np.cumsum(y)
    return float((1.0 / (before[both] / x[both] + behind[both] / y[both])).sum())


def similarities(left: pa.Array, right: pa.Array, length: int = WORDS) -> np.ndarray:
    """Exact J_P of every pair of texts."""
    n = len(left)
    ra, ha, wa = shingles(left, length)
    rb, hb, wb = shingles(right, length)
    row, h = np.concatenate([ra, rb]), np.concatenate([ha, hb])
    x = np.concatenate([wa, np.zeros(len(wb))])
    y = np.concatenate([np.zeros(len(wa)), wb])
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (h[1:] != h[:-1])])[:len(row)]
    at = np.flatnonzero(new)
    x, y = (np.add.reduceat(v[order], at) if len(at) else v for v in (x, y))
    row = row[at]
    shared = np.bincount(row[(x > 0) & (y > 0)], minlength=n)
    total = np.bincount(row, minlength=n)
    out = shared / np.maximum(total, 1)
    # unequal weights: the general formula, row by row
    uneven = np.unique(row[(x > 1) | (y > 1)])
    bounds = np.searchsorted(row, [uneven, uneven + 1])
    for r, lo, hi in zip(uneven, *bounds, strict=True):
        out[r] = _jp(x[lo:hi], y[lo:hi])
    return out


def _stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back: lineage is cut, and a lost
    executor takes nothing with it."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """(id, label): the smallest id reachable over ``edges`` (u, v), for ids in
    edges.  Every round each node joins its smallest neighbour, pointers are
    doubled up to their roots and the graph is contracted: log n rounds."""
    labels = None
    edges = edges.where("u != v")
    while True:
        both = edges.union(edges.select("v", "u"))
        parent = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("p"))
        parent = _rooted(_stored(parent, "parents"))
        p = parent.withColumnsRenamed({"u": "id", "p": "label"})
        if labels is None:
            labels = p
        else:
            labels = labels.join(p.select(F.col("id").alias("label"), F.col("label").alias("next")), "label", "left") \
                .select("id", F.coalesce("next", "label").alias("label"))
        up = edges.join(parent, "u").select(F.col("p").alias("u"), "v")
        up = up.join(parent.withColumnRenamed("u", "v"), "v").select("u", F.col("p").alias("v"))
        edges = _stored(up.where("u != v").distinct(), "edges")
        if edges.isEmpty():
            return labels


def _rooted(parent: DataFrame) -> DataFrame:
    """(u, p) with p doubled until it is a root."""
    while True:
        above = parent.select(F.col("u").alias("p"), F.col("p").alias("q"))
        up = _stored(parent.join(above, "p").select("u", "p", "q"), "parents")
        if up.where("p != q").isEmpty():
            return parent
        parent = up.select("u", F.col("q").alias("p"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    similarity: float = SIMILARITY) -> DataFrame:
    """(id, class_id): the class of every row's text."""
    signed, classes = _classes(docs, id_col, text_col, similarity)
    with_words = signed.where("some").select("id", "f1", "f2").join(classes, ["f1", "f2"]).select("id", "class_id")
    without = signed.where("NOT some").select("id", F.col("id").alias("class_id"))
    return with_words.unionByName(without)


def _prints(text: str) -> list[Column]:
    return [F.xxhash64(text).alias("f1"), F.xxhash64(F.lit(1), F.reverse(text)).alias("f2")]


def _classes(docs: DataFrame, id_col: str, text_col: str, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Signed rows, and (f1, f2, class_id, first) of every text with words; ``first``
    marks the one text of the class with the smallest id (then hashes)."""
    m = BANDS * ROWS
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch, "text", 1 << 20):
                row, h, weight = shingles(s.column("text"))
                sig = prob_min_hash(row, h, weight, s.num_rows, m)
                bands = band_hashes(sig, BANDS, ROWS).view(np.int64).reshape(-1)
                some = np.bincount(row, minlength=s.num_rows) > 0
                col = pa.FixedSizeListArray.from_arrays(pa.array(bands), BANDS).cast(pa.list_(pa.int64()))
                short = [r.tobytes() for r in (sig & np.uint64(255)).astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([s.column("id"), s.column("f1"), s.column("f2"), pa.array(some), col,
                                                  pa.array(short, pa.binary()),
                                                  pa.compute.binary_length(s.column("text")).cast(pa.int64())],
                                                 ["id", "f1", "f2", "some", "bands", "sig", "size"])
            release()

    prints = base.select("id", *_prints("text"), "text")
    signed = _stored(prints.mapInArrow(
        sign, "id long, f1 long, f2 long, some boolean, bands array<long>, sig binary, size long"), "signed")

    # identical texts: one representative, numbered once (what is written stays)
    texts = signed.where("some").groupBy("f1", "f2").agg(F.min("id").alias("id"),
                                                         F.first(F.struct("bands", "sig", "size")).alias("r"))
    texts = _stored(texts.sortWithinPartitions("f1", "f2").select(
        "f1", "f2", "id", F.monotonically_increasing_id().alias("rep"), "r.bands", "r.sig", "r.size"), "texts")
    members = texts.select(F.col("rep").alias("id"), "size", F.explode("bands").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("centre")).where("n > 1")
    members = _stored(members.join(sizes, "bucket"), "members")
    found = members.select("id").distinct()
    signatures = _stored(texts.select(F.col("rep").alias("id"), "sig").join(found, "id", "left_semi"), "signatures")
    labels = signatures.select("id", F.col("id").alias("label"))
    # texts of candidates, moved once, copies met in a task as one
    wanted = texts.select("f1", "f2", F.col("rep").alias("id")).join(found, "id", "left_semi")
    candidates = _stored(prints.groupBy("f1", "f2").agg(F.first("text").alias("text")).hint("merge")
                         .join(wanted, ["f1", "f2"]).select("id", "text"), "candidates")

    def merge(links: DataFrame, labels: DataFrame) -> DataFrame:
        links = _stored(links, "links")
        between = (links.join(labels.select(F.col("id").alias("x"), F.col("label").alias("u")), "x")
                   .join(labels.select(F.col("id").alias("y"), F.col("label").alias("v")), "y")
                   .select("u", "v").where("u != v").distinct())
        moved = components(between).select(F.col("id").alias("label"), F.col("label").alias("to"))
        return _stored(labels.join(moved, "label", "left").select("id", F.coalesce("to", "label").alias("label")),
                       "labels")

    # every member meets the centre of its bucket
    stars = members.where("id != centre").select(F.col("centre").alias("x"), F.col("id").alias("y")).distinct()
    labels = merge(_verify(_likely(stars, signatures, similarity - MARGIN), candidates, similarity), labels)
    left = members.where("id != centre AND n > 2").select("bucket", "id", "size")
    labels = merge(_settle(_unsettled(left.join(labels, "id")), candidates, similarity), labels)

    tagged = _stored(texts.select("f1", "f2", "id", "rep").join(labels.withColumnRenamed("id", "rep"), "rep", "left")
                     .select("f1", "f2", "id", F.coalesce("label", "rep").alias("label")), "tagged")
    per = tagged.groupBy("label").agg(F.min("id").alias("class_id"), F.min(
        F.struct(F.col("id").isNull().alias("none"), "id", "f1", "f2")).alias("r"))
    return signed, tagged.join(per, "label").select(
        "f1", "f2", "class_id", ((F.col("f1") == F.col("r.f1")) & (F.col("f2") == F.col("r.f2"))).alias("first"))


def _unsettled(tagged: DataFrame) -> DataFrame:
    """(part, id, size, label, main): members of buckets that hold several classes;
    ``main`` marks the largest class.  A bucket is one part, or every two of its
    blocks are."""
    per = tagged.groupBy("bucket", "label").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    per = per.groupBy("bucket").agg(F.max(F.struct("n", "label")).alias("m"), F.count("*").alias("classes"),
                                    F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    blocks = F.when((F.col("n") <= LOCAL) & (F.col("bytes") <= LOCAL_BYTES), 1).otherwise(
        F.greatest(F.ceil(F.col("n") * 2 / LOCAL), F.ceil(F.col("bytes") * 2 / LOCAL_BYTES)))
    per = per.where("classes > 1").select("bucket", F.col("m.label").alias("largest"), blocks.cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1),
                        lambda k: F.xxhash64("bucket", F.least(F.col("own"), k), F.greatest(F.col("own"), k)))
    return (tagged.join(per, "bucket").withColumn("own", own)
            .select(F.explode(meets).alias("part"), "id", "size", "label",
                    (F.col("label") == F.col("largest")).alias("main")))


def _likely(pairs: DataFrame, signatures: DataFrame, least: float) -> DataFrame:
    """Pairs whose signatures do not rule the similarity out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                    for c in ("sx", "sy"))
            yield batch.select(["x", "y"]).filter(pa.array((a == b).mean(axis=1) >= least))

    both = (pairs.join(signatures.select(F.col("id").alias("y"), F.col("sig").alias("sy")), "y")
            .join(signatures.select(F.col("id").alias("x"), F.col("sig").alias("sx")), "x"))
    return both.select("x", "y", "sx", "sy").mapInArrow(run, "x long, y long")


def _settle(tagged: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Links between different classes of a part, by exact similarity: enough of
    them to merge what belongs together.

    Parts are bundled by hash to spare a group each; a bundle holds some 16 MB of
    texts beside its largest part.
    """
    spark = tagged.sparkSession
    tagged = _stored(tagged, "unsettled")
    total = tagged.agg(F.sum("size")).first()[0] or 0
    bundles = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // (LOCAL_BYTES // 2))

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part").to_numpy()
        order = np.argsort(part, kind="stable")
        ids, label = table.column("id").to_numpy(), table.column("label").to_numpy()
        minor = ~table.column("main").to_numpy().astype(bool)
        _, one, which = np.unique(ids, return_index=True, return_inverse=True)
        sets = _Sets(pa.RecordBatch.from_arrays([table.column("text").combine_chunks().take(pa.array(one))], ["text"]))
        bounds = np.append(np.flatnonzero(np.diff(part[order], prepend=part[order][0] - 1)), len(ids))
        xs, ys = [], []
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            k = order[lo:hi]
            for a, b in _links(sets, which[k], label[k], minor[k], similarity):
                xs.append(ids[k[a]])
                ys.append(ids[k[b]])
        del sets
        release()
        return pa.table({"x": pa.array(xs, pa.int64()), "y": pa.array(ys, pa.int64())})

    return (tagged.withColumn("bundle", F.pmod(F.xxhash64("part"), F.lit(bundles))).drop("size")
            .hint("merge").join(texts, "id")
            .groupBy("bundle").applyInArrow(run, "x long, y long").distinct())


class _Sets:
    """Shingles of some texts, those of text i at ``bounds[i]:bounds[i + 1]``."""

    def __init__(self, batch: pa.RecordBatch):
        rows, hashes, weights, n = [], [], [], 0
        for s in slices(batch, "text", 1 << 20):
            row, h, weight = shingles(s.column("text"))
            rows.append(row + n)
            hashes.append(h)
            weights.append(weight.astype(np.int32))
            n += s.num_rows
        row = np.concatenate(rows)
        self.hash, self.weight = np.concatenate(hashes), np.concatenate(weights)
        self.bounds = np.searchsorted(row, np.arange(n + 1))
        self.total = np.bincount(row, weights=self.weight, minlength=n)
        self.even = np.bincount(row, weights=self.weight > 1, minlength=n) == 0


def _links(sets: _Sets, which: np.ndarray, label: np.ndarray, minor: np.ndarray,
           similarity: float) -> Iterator[tuple[int, int]]:
    """Similar pairs of different classes among the texts ``which``, each of them
    merging two classes.

    No term of J_P exceeds the smaller share that its element has of either text,
    so both texts must have ``similarity`` of their weight in shared elements.  Nor
    does the term of d exceed max(a_d, b_d) / sum over e of max(a_e, b_e): with n
    shared elements of weight A in one text and B in the other, and with all weights
    1 or more, J_P is at most (A + B - n) / (weight of both texts - n).  Where all
    weights are equal that is J_P itself.
    """
    mine = np.flatnonzero(minor)
    counts = sets.bounds[which + 1] - sets.bounds[which]
    at = ranges(sets.bounds[which], counts)
    row = np.repeat(np.arange(len(which)), counts)
    _, column, often = np.unique(sets.hash[at], return_inverse=True, return_counts=True)
    shared = (often > 1)[column]  # elements of one text alone add nothing
    row, column, weight = row[shared], (np.cumsum(often > 1) - 1)[column[shared]], sets.weight[at][shared]
    own = (np.searchsorted(row, np.arange(len(which) + 1)), column, weight)
    order = np.argsort(column, kind="stable")
    row, column, weight = row[order], column[order], weight[order]
    of_x = np.zeros((len(mine), len(which)), np.float32)  # weight of x in elements of both
    all_even = sets.even[which].all()
    of_y, number = (of_x, of_x) if all_even else (np.zeros_like(of_x), np.zeros_like(of_x))
    for k in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        lo, hi = np.searchsorted(column, [k, k + COLUMNS])
        w = np.zeros((len(which), min(COLUMNS, int(column[hi - 1]) + 1 - k)), np.float32)
        w[row[lo:hi], column[lo:hi] - k] = weight[lo:hi]
        has = (w > 0).astype(np.float32)
        of_x += w[mine] @ has.T
        if not all_even:
            of_y += has[mine] @ w.T
            number += has[mine] @ has.T
    total = sets.total[which]
    likely = ((of_x >= (similarity - ROUNDING) * total[mine][:, None])
              & (of_y >= (similarity - ROUNDING) * total[None]) & (label[mine][:, None] != label[None]))
    a, b = np.nonzero(likely)
    even = sets.even[which[mine[a]]] & sets.even[which[b]]
    x, y, n = (v[a, b].astype(np.float64) for v in (of_x, of_y, number))
    value = (x + y - n) / (total[mine[a]] + total[b] - n)
    good = value >= similarity - ROUNDING
    a, b, even = mine[a[good]], b[good], even[good]
    label = label.copy()
    bounds = np.append(np.flatnonzero(np.diff(a, prepend=-1)), len(a))
    for sure in (True, False):
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            i = a[lo]
            other = b[lo:hi][(even[lo:hi] == sure) & (label[b[lo:hi]] != label[i])]
            if sure:  # one of each class is enough
                other = other[np.unique(label[other], return_index=True)[1]]
            else:
                other = other[_exact(i, other, total, *own) >= similarity - ROUNDING]
            for j in other:
                if label[j] != label[i]:
                    label[label == label[j]] = label[i]
                    yield i, j


def _exact(i: int, others: np.ndarray, total: np.ndarray, bounds: np.ndarray, column: np.ndarray,
           weight: np.ndarray) -> np.ndarray:
    """J_P of row i and others.  In the order of ``_jp`` elements of one text alone
    come first or last, so their sums are what the shared ones leave."""
    mine = slice(bounds[i], bounds[i + 1])
    place = np.full(int(column.max(initial=-1)) + 1, -1)
    place[column[mine]] = np.arange(mine.stop - mine.start)
    out = np.zeros(len(others))
    step = max(1, (1 << 19) // max(1, mine.stop - mine.start))
    for lo in range(0, len(others), step):
        rows = others[lo:lo + step]
        counts = bounds[rows + 1] - bounds[rows]
        at = ranges(bounds[rows], counts)
        c = place[column[at]]
        y = np.zeros((len(rows), mine.stop - mine.start))
        y[np.repeat(np.arange(len(rows)), counts)[c >= 0], c[c >= 0]] = weight[at][c >= 0]
        x = np.where(y > 0, weight[mine].astype(np.float64), 0.0)
        order = np.argsort(np.divide(y, x, out=np.zeros_like(y), where=y > 0), axis=1)
        x, y = (np.take_along_axis(v, order, axis=1) for v in (x, y))
        before = (total[i] - x.sum(axis=1))[:, None] + np.cumsum(x, axis=1)
        behind = total[rows][:, None] - np.cumsum(y, axis=1)
        both = y > 0
        behind, before = behind[both] / y[both], before[both] / x[both]
        term = np.zeros(y.shape)
        term[both] = 1.0 / (before + behind)
        out[lo:lo + step] = term.sum(axis=1)
    return out


def _verify(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Pairs whose exact similarity reaches the bound.  The second join's key may
    be a hot centre: Spark splits its partition (sort-merge, skew join)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch, "ty", 1 << 20):
                good = similarities(s.column("tx"), s.column("ty")) >= similarity - ROUNDING
                yield s.select(["x", "y"]).filter(pa.array(good))
            release()

    pairs = _stored(pairs, "pairs")
    full = (pairs.hint("merge").join(texts.select(F.col("id").alias("y"), F.col("text").alias("ty")), "y")
            .hint("merge").join(texts.select(F.col("id").alias("x"), F.col("text").alias("tx")), "x"))
    return full.select("x", "y", "tx", "ty").mapInArrow(run, "x long, y long")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class: that of its smallest id, of several rows
    with that id the text of the smallest hash and the smallest row; null ids come
    last.  Texts without words all stay."""
    _, classes = _classes(docs, id_col, text_col, SIMILARITY)
    some = F.coalesce(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    row, i = F.struct(*(F.col(c) for c in docs.columns)), F.col(id_col).cast("long")
    best = F.min(F.struct("none", "i", "row")).getField("row")
    if "map<" in docs.schema.simpleString():  # maps have no order
        best = F.min_by("row", F.struct("none", "i", F.to_json("row")))
    # copies met in a task leave it as one
    rows = docs.where(some).select(*_prints(text_col), i.isNull().alias("none"), i.alias("i"), row.alias("row")) \
        .groupBy("f1", "f2").agg(best.alias("row"))
    kept = rows.join(classes.where("first").select("f1", "f2"), ["f1", "f2"], "left_semi").select("row.*")
    return kept.unionByName(docs.where(~some))
