"""Spelling variant grouping by dynamic programming over sorted word lists.

``vocabulary`` counts the letter runs of whole texts (map-side, then summed in Spark).
``near_words`` finds all pairs of words one edit apart.  A pair whose shorter word has m
code points is cut at K - 1 fixed places of m; its first difference lies in one part i, and
everything before and behind that part is equal in both words.  So the words are listed K times
for m = their length and K times for one less, under the key (m, i, text before, text behind),
and each pair meets under exactly one key.  A list holds words that differ only within a
K-th of their length; K doubles until no list is longer than ``LIST_WORDS`` (or the parts
are single letters, where the alphabet bounds a list).

A list is sorted, with the common prefix length (LCP) of neighbours.  Every word scans the
words behind it: rows of the edit matrix, three cells wide around the diagonal, are kept per
depth; the next word starts from the row at its LCP with the one before; and a row whose least
cell exceeds one edit skips all words that share that prefix.  The scans of a bucket of
lists advance together, one row each at a time, in numpy.

A word's form is its near word of largest count (ties: smallest in code point order) if that
is at least ``ratio`` times its own; roots follow forms by pointer doubling in Spark joins
(counts grow by ``ratio`` at every step, so there are few steps).

Cases: null or empty text has no run; a null id counts as empty text in the damage; repeated
rows count again; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm import crc
from weft.llm.chunks import release
from weft.llm.knn import stored
from weft.llm.words import binary_array, slices, text_buffer

#: Distinct words a task counts before it gives them out.
HELD_WORDS = 1 << 18
PARTS = 4
LIST_WORDS = 1 << 15
#: Listed words a Python task gets at a time (about).
BUCKET_ROWS = 1 << 16

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), 0xC3]] = True  # C3 leads U+00C0..U+00FF


def letter_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(lower-cased runs as a binary array, first run of each row)."""
    letter = _LETTER[data]
    letter[1:] |= data[:-1] == 0xC3
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    cut = offsets[:-1][offsets[:-1] < len(data)]
    first[cut] = letter[cut]
    at = np.flatnonzero(first)
    ends = np.append(np.cumsum(letter)[at] - 1, np.count_nonzero(letter))
    return binary_array(_LOWER[data[letter]], ends), np.searchsorted(at, offsets, side="left")


def count_runs(col: pa.Array, keys: list[str | None], damage: int, min_length: int, held: dict[bytes, int]) -> None:
    """Add the column's words to ``held``.  ``damage`` d > 0: where d divides the CRC-32
    h of "<key>:<run>", the run loses its code point h % length."""
    runs, doc = letter_runs(*text_buffer(col))
    if not len(runs):
        return
    coded = runs.dictionary_encode()
    which, distinct = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    points = pc.utf8_length(coded.dictionary.cast(pa.large_string())).to_numpy()
    whole = np.ones(len(which), dtype=bool)
    if damage:
        of_key = np.array([zlib.crc32(f"{k or ''}:".encode()) for k in keys], dtype=np.uint32)
        of_run = np.fromiter(map(zlib.crc32, distinct), np.uint32, len(distinct))
        size = np.fromiter(map(len, distinct), np.int64, len(distinct))
        # equal runs of a row are damaged alike
        h = crc.combine(np.repeat(of_key, np.diff(doc)), of_run[which], size[which]).astype(np.int64)
        hit = np.flatnonzero(h % damage == 0)
        whole[hit] = False
        hit = hit[points[which[hit]] > min_length]
        code, number = np.unique((which[hit].astype(np.int64) << 32) | (h[hit] % points[which[hit]]), return_counts=True)
        for c, n in zip(code.tolist(), number.tolist(), strict=True):
            t, p = distinct[c >> 32].decode(), c & 0xFFFFFFFF
            word = (t[:p] + t[p + 1:]).encode()
            held[word] = held.get(word, 0) + n
    count = np.bincount(which[whole], minlength=len(distinct))
    for i in np.flatnonzero((count > 0) & (points >= min_length)).tolist():
        word = distinct[i]
        held[word] = held.get(word, 0) + int(count[i])


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damage: int = 0, min_length: int = 7,
               min_count: int = 2) -> DataFrame:
    """(word, n): words of at least ``min_length`` code points that occur at least ``min_count``
    times in the whole table.  ``min_length`` is 4 or more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}

        def out():
            words = pa.array(list(held), pa.binary()).cast(pa.string())
            batch = pa.RecordBatch.from_arrays([words, pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return batch

        for batch in batches:
            for s in slices(batch, "text", 2 << 20):
                count_runs(s.column("text"), s.column("key").to_pylist(), damage, min_length, held)
                if len(held) >= HELD_WORDS:
                    yield out()
        yield out()

    rows = docs.select(F.col(id_col).cast("string").alias("key"), F.col(text_col).alias("text"))
    return (rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= min_count))


def listed(words: DataFrame, parts: int, shortest: int) -> DataFrame:
    """(m, part, before, behind, middle, n): every word under its 2 * ``parts`` keys."""
    m = words.withColumn("len", F.length("word")).withColumn("m", F.explode(F.array("len", F.col("len") - 1)))
    m = m.where(F.col("m") >= shortest)
    p = m.withColumn("parts", F.least(F.lit(parts), "m")).withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))
    p = p.withColumn("lo", F.expr("part * m div parts")).withColumn("rest", F.expr("m - (part + 1) * m div parts"))
    return p.select(F.col("m").cast("int"), (F.col("part") - F.col("parts") + 1).cast("int").alias("part"),
                    F.expr("substring(word, 1, lo)").alias("before"),
                    F.expr("substring(word, len - rest + 1, rest)").alias("behind"),
                    F.expr("substring(word, lo + 1, len - lo - rest)").alias("middle"), "n")


KEYS = ("m", "part", "before", "behind")


def common_prefixes(code: np.ndarray, start: np.ndarray, size: np.ndarray, new_list: np.ndarray) -> np.ndarray:
    """LCP of each word with the one before it; -1 at the first word of a list."""
    lcp = np.where(new_list, -1, 0)
    at = np.flatnonzero(~new_list)
    depth = 0
    while len(at):
        at = at[(size[at] > depth) & (size[at - 1] > depth)]
        at = at[code[start[at] + depth] == code[start[at - 1] + depth]]
        depth += 1
        lcp[at] = depth
    return lcp


def scan(code: np.ndarray, start: np.ndarray, size: np.ndarray, lcp: np.ndarray) -> Iterator[tuple]:
    """(a, b, is_prefix) of all pairs a < b of one list that are one edit apart.

    ``code`` holds the words' code points one after the other; lists are sorted.
    """
    n = len(start)
    # the next word, behind word j, that shares less with its predecessor than j does
    follow, stack = [n] * (n + 1), []
    for j, x in enumerate([*lcp.tolist(), -1]):
        while stack and stack[-1][0] > x:
            follow[stack.pop()[1]] = j
        stack.append((x, j))
    follow = np.array(follow)
    lcp = np.append(lcp, -1)
    base = np.cumsum(size + 3) - (size + 3)
    # rows by depth: cells of the diagonals -1, 0, 1; for a word against its own prefix 1, 0, 1
    rows = np.tile(np.array([1, 0, 1], dtype=np.int8), (int((size + 3).sum()), 1))
    rows[base, 0] = 2  # depth 0 has no cell left of the first column
    rows[base + size, 2] = 2
    far = np.int8(2)

    q = np.flatnonzero(lcp[1:] >= 0)
    j = q + 1
    d = lcp[j]
    while len(q):
        d = d + 1
        la, top = size[q], base[q]
        b = code[start[j] + d - 1]
        above = rows[top + d - 1]
        last = len(code) - 1

        def differs(t):  # letter t of the scanning word against b (t may lie outside)
            return (code[np.clip(start[q] + t, 0, last)] != b).astype(np.int8)

        left = np.minimum(above[:, 1] + 1, above[:, 0] + differs(d - 2))
        left = np.where((d - 1 <= la) & (d >= 2), left, np.where(d == 1, np.int8(1), far))
        mid = np.minimum(np.minimum(above[:, 2], left) + 1, above[:, 1] + differs(d - 1))
        mid = np.where(d <= la, mid, far)
        right = np.minimum(mid + 1, above[:, 2] + differs(d))
        right = np.where(d + 1 <= la, right, far)
        row = np.minimum(np.stack([left, mid, right], axis=1), far)
        rows[top + d] = row
        dead = row.min(axis=1) > 1
        end = ~dead & (d == size[j])
        k = la - d + 1  # the cell of the whole scanning word
        hit = np.flatnonzero(end & (k >= 0) & (k <= 2))
        hit = hit[row[hit, k[hit]] == 1]
        if len(hit):
            longer = d[hit] == la[hit] + 1
            prefix = longer & (rows[top[hit] + np.minimum(la[hit], d[hit]), 1] == 0)
            yield q[hit], j[hit], prefix
        # a dead row skips the words that share it, a finished word leads to the next
        go = np.flatnonzero(dead | end)
        if len(go):
            to = j[go] + 1
            deep = np.where(dead[go], d[go], np.iinfo(np.int64).max)
            climb = np.flatnonzero(lcp[to] >= deep)
            while len(climb):
                to[climb] = follow[to[climb]]
                climb = climb[lcp[to[climb]] >= deep[climb]]
            j[go] = to
            d[go] = lcp[to]
            if (d[go] < 0).any():
                keep = np.ones(len(q), dtype=bool)
                keep[go[d[go] < 0]] = False
                q, j, d = q[keep], j[keep], d[keep]


def _pairs_of_bucket(key: tuple, table: pa.Table) -> pa.Table:
    """Near-word counts and best near words of the bucket's words."""
    t = table.sort_by([*((c, "ascending") for c in KEYS), ("middle", "ascending")]).combine_chunks()
    new_list = np.ones(t.num_rows, dtype=bool)
    new_list[1:] = False
    for c in KEYS:
        col = t.column(c)
        new_list[1:] |= pc.not_equal(col.slice(1), col.slice(0, t.num_rows - 1)).to_numpy()
    alone = new_list & np.append(new_list[1:], True)
    t, new_list = t.filter(pa.array(~alone)), new_list[~alone]
    none = pa.table({"word": pa.array([], pa.string()), "near": pa.array([], pa.int64()),
                     "best_n": pa.array([], pa.int64()), "best": pa.array([], pa.string())})
    if not t.num_rows:
        return none
    middle = t.column("middle")
    size = pc.utf8_length(middle).to_numpy().astype(np.int64)
    code = np.frombuffer("".join(middle.to_pylist()).encode("utf-32-le"), dtype=np.uint32)
    start = np.cumsum(size) - size
    m, part, n = (t.column(c).to_numpy() for c in ("m", "part", "n"))
    short = pc.utf8_length(t.column("before")).to_numpy() + size + pc.utf8_length(t.column("behind")).to_numpy() == m
    found = [(a[keep], b[keep]) for a, b, prefix in scan(code, start, size, common_prefixes(code, start, size, new_list))
             # both one longer than m: theirs is the key of m + 1.  First difference
             # behind this part: theirs is a later part (0 is the last one)
             for keep in [(short[a] | short[b]) & ~(prefix & (part[a] < 0))]]
    if not found:
        return none
    a, b = (np.concatenate([f[i] for f in found]) for i in (0, 1))
    one, other = np.concatenate([a, b]), np.concatenate([b, a])
    word = pc.binary_join_element_wise(t.column("before"), middle, t.column("behind"), "")
    place = np.empty(t.num_rows, dtype=np.int64)
    place[pc.sort_indices(word).to_numpy()] = np.arange(t.num_rows)
    order = np.lexsort((place[other], -n[other], one))
    one, other = one[order], other[order]
    first = np.flatnonzero(np.concatenate([[True], one[1:] != one[:-1]]))
    out = pa.table({"word": word.take(pa.array(one[first])), "near": pa.array(np.diff(np.append(first, len(one)))),
                    "best_n": pa.array(n[other[first]]), "best": word.take(pa.array(other[first]))})
    release()
    return out


def near_words(words: DataFrame, parts: int = PARTS) -> DataFrame:
    """(word, n, n_near, best, best_n): every word of ``words`` (word, n; distinct) with its number of
    words one edit away and the one of largest n.  ``words`` is read more than once: pass a written table."""
    shortest, longest = words.agg(F.min(F.length("word")), F.max(F.length("word"))).first()
    while True:
        rows = listed(words, parts, shortest or 0)
        total, most = rows.groupBy(F.xxhash64(*KEYS)).agg(F.count("*").alias("c")).agg(F.sum("c"), F.max("c")).first()
        if not total or most <= LIST_WORDS or parts >= longest:
            break
        parts *= 2
    buckets = max(1, -(-(total or 0) // BUCKET_ROWS))
    found = (rows.withColumn("bucket", F.pmod(F.xxhash64(*KEYS), F.lit(buckets)))
             .groupBy("bucket").applyInArrow(_pairs_of_bucket, "word string, near long, best_n long, best string"))
    zero = words.select("word", "n", F.lit(0).cast("long").alias("near"), F.lit(None).cast("long").alias("best_n"),
                        F.lit(None).cast("string").alias("best"))
    every = zero.unionByName(found.withColumn("n", F.lit(None).cast("long")))
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("k"), "best")))
    return (every.groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), best.alias("b"))
            .select("word", "n", "n_near", F.col("b.best").alias("best"), (-F.col("b.k")).alias("best_n")))


def group_variants(words: DataFrame, ratio: int = 10, parts: int = PARTS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every row of ``words`` (word, n)."""
    words = stored(words, "words")
    has = F.col("best_n") >= F.col("n") * ratio
    rows = stored(near_words(words, parts).select("word", F.when(has, F.col("best")).alias("form"), "n", "n_near",
                                                  F.when(has, F.col("best_n")).alias("form_n")), "forms")
    roots = rows.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    while True:  # twice the steps each time
        roots = stored(roots, "roots")
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        joined = roots.join(ahead, "root", "left")
        if joined.where(F.col("ahead").isNotNull()).isEmpty():
            break
        roots = joined.select("word", F.coalesce("ahead", "root").alias("root"))
    return (rows.join(roots, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
