"""Training-data operators against brute force, exact round trips and held-out
accuracy, with nulls, empty and long texts, ties, repeats, empty tables and
clashing column names."""

import hashlib
import json
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = [(0, None), (1, ""), (2, " \t\n"), (3, "Éa b  c " * 40), (4, "Éa b  c " * 40), (None, "x y z"), (5, "one"),
        (5, "one"), (6, "w" * 70000 + " tail"), (7, " ".join(f"k{i}" for i in range(3000))), (8, "日本 語 <|endoftext|> it's")]


@pytest.fixture(scope="module")
def edge(spark):
    from weft.llm.ship import ship_package

    ship_package(spark)
    rows = [(d, t, "en" if d != 3 else None, None if d == 4 else "s", 7) for d, t in EDGE]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words long")


@pytest.mark.parametrize("piece", [7, 64, 1 << 20])
def test_words_and_windows(piece, monkeypatch):
    from weft.llm import words as W

    monkeypatch.setattr(W, "PIECE", piece)
    texts = [t for _, t in EDGE if not t or len(t) < 5000] + ["a b", "", "c"]
    w = W.column_words(pa.array(texts))
    want = [WORD.findall(t or "") for t in texts]
    assert w.counts.tolist() == [len(x) for x in want]
    flat = [x for r in want for x in r]
    assert len(set(zip(flat, w.hash.tolist(), strict=True))) == len(set(flat)) == len(set(w.hash.tolist()))
    grams = [tuple(flat[i:i + 3]) for i in range(len(flat) - 2)]
    h = W.window_hashes(w.hash, 3).tolist()
    assert len(set(zip(grams, h, strict=True))) == len(set(grams)) == len(set(h))


def test_substrings(spark, edge):
    from weft.llm.substrings import remove_repeats

    out = remove_repeats(edge, length=5, normalise=True)
    assert out.columns.count("n_words") == 1
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in out.collect()), key=str)
    key = lambda d: float("inf") if d is None else d
    least = {}
    docs = [(d, WORD.findall(t or "")) for d, t in EDGE]
    for d, w in docs:
        for i in range(len(w) - 4):
            k = tuple(w[i:i + 5])
            least[k] = min(least.get(k, float("inf")), key(d))
    want = []
    for d, w in docs:
        gone = set()
        for i in range(len(w) - 4):
            if least[tuple(w[i:i + 5])] < key(d):
                gone |= set(range(i, i + 5))
        want.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    assert got == sorted(want, key=str)
    assert remove_repeats(edge.limit(0), length=5).count() == 0


def test_bpe_and_files_equal_the_library(spark, edge, tmp):
    import public_tokenizers
    from tokenizers import Tokenizer

    from weft.llm import bpe, token_files

    path = public_tokenizers.path("word_bpe_49k.json")
    tk = Tokenizer.from_file(path)
    docs = edge.select("doc_id", "text").withColumn("ids", F.lit(1))
    out = bpe.decode(bpe.encode(docs, path), path).collect()
    for r in out:
        ids = tk.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == ids
        assert r["decoded"] == tk.decode(ids, skip_special_tokens=False)
    token_files.write(docs, tmp + "/t", path)
    rows = sorted(token_files.read(spark, tmp + "/t").collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == sorted((d for d, _ in EDGE), key=lambda d: (d is not None, d))
    at = 0
    for r in rows:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) and r["ids"][-1] == 2
        at += r["n_tokens"]
    assert sorted(map(tuple, (r["ids"][:-1] for r in rows))) == sorted(tuple(r["ids"]) for r in out)
    token_files.write(docs.limit(0), tmp + "/e", path)
    assert token_files.read(spark, tmp + "/e").count() == 0


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025, 5000])
@pytest.mark.parametrize("top", [1, 2, 49408, 2 ** 32])
def test_pfor_round_trip(n, top):
    from weft.llm.token_files import decode_segment, encode_segment

    rng = np.random.default_rng(n)
    x = np.where(rng.random(n) < 0.9, rng.integers(0, max(1, top // 300), n), rng.integers(0, top, n)).astype(np.uint32)
    data = encode_segment(x)
    assert (decode_segment(data) == x).all()
    assert (decode_segment(data, 1, 3) == x[1024:3072]).all()


def test_katz(spark, edge):
    from weft.llm import katz

    out = katz.score(edge.select("doc_id", "text")).collect()
    fold = lambda d: None if d is None else zlib.crc32(str(d).encode()) % 10
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    docs = [(d, [*WORD.findall(low(t)), None]) for d, t in EDGE]
    c = Counter(x for d, w in docs if fold(d) not in (None, 0) for x in w)
    n, v = sum(c.values()), len(c)
    want = sorted((str(d), len(w), sum(c[x] > 0 for x in w), n,
                   round(sum(float(np.log10((c[x] + 0.1) / (n + 0.1 * (v + 1)))) for x in w), 4)) for d, w in docs)
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in out)
    assert got == want
    assert all(r["score"] <= 1e-9 for r in out)
    assert katz.score(edge.limit(0).select("doc_id", "text")).count() == 0
    clash = edge.select("doc_id", "text").withColumns({c: F.lit("u") for c in ("_train", "_held", "score", "n_known", "chunk_id")})
    again = katz.score(clash)
    assert again.where("_train = 'u' AND _held = 'u' AND chunk_id = 'u'").count() == len(EDGE) and again.columns.count("score") == 1
    assert sorted((str(r["doc_id"]), r["n_known"]) for r in again.collect()) == sorted((w[0], w[2]) for w in want)


def test_katz_mass_of_two_word_texts(spark):
    """Two-word texts with one first word, over the vocabulary and an unknown
    word, hold less than all probability."""
    from weft.llm import katz
    from weft.llm.ship import ship_package

    ship_package(spark)
    rng = np.random.default_rng(1)
    train = [(1, " ".join(f"w{int(x)}" for x in rng.zipf(1.6, 30) if x < 60)) for _ in range(60)]
    vocab = sorted({w for _, t in train for w in t.split()})
    ask = [(0, f"{w} {x}") for w in vocab[:3] for x in [*vocab, "never"]] + [(0, w) for w in vocab[:3]]
    df = spark.createDataFrame(train + ask, "doc_id long, text string")
    out = katz.score(df.withColumn("t", F.col("text")), train=F.col("doc_id") == 1, held_out=F.col("doc_id") == 0)
    p = {r["t"]: r["score"] for r in out.where("held_out").collect()}
    assert len(p) == len(set(x for _, x in ask)) and all(s < 0 for s in p.values())
    first = {w: sum(10 ** p[f"{w} {x}"] for x in [*vocab, "never"]) + 10 ** p[w] for w in vocab[:3]}
    # P(w) * sum over x of P(x | w) P(end | x) + P(w) P(end | w) stays below P(w) <= 1
    assert all(0 < s < 1 for s in first.values())


def test_good_turing():
    from weft.llm.katz import good_turing

    assert (good_turing([0, 0, 0, 0, 0, 0, 0]) == 1).all()
    d = good_turing([0, 100, 40, 20, 12, 8, 5])
    assert d[1] == pytest.approx((0.8 - 0.3) / 0.7) and (d[1:6] <= 1).all() and d[6] == 1


def test_prob_min_hash_estimates_probability_jaccard():
    from weft.llm import neardup as N

    a, b = Counter({1: 3, 2: 1, 3: 2, 5: 1}), Counter({1: 1, 2: 1, 3: 4, 4: 1})
    exact = sum(1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in a.keys() | b.keys()) for d in a.keys() & b.keys())
    assert N.probability_jaccard(a, b) == pytest.approx(exact)
    h = np.array([*a, *b], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    s = N.prob_min_hash(np.repeat([0, 1], [len(a), len(b)]), h, np.array([*a.values(), *b.values()], float), 2, 8192)
    assert (s[0] == s[1]).mean() == pytest.approx(exact, abs=0.03)


def test_near_duplicates(spark, edge):
    from weft.llm import neardup as N

    rng = np.random.default_rng(4)
    base = [[f"t{x}" for x in rng.integers(0, 500, 60)] for _ in range(4)]
    rows = [(d, t) for d, t in EDGE if d is not None]
    for i in range(40):
        w = list(base[i % 4])
        for _ in range(i % 3):
            w[int(rng.integers(60))] = "z"
        rows.append((100 + i, " ".join(w)))
    got = sorted(tuple(r) for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())

    def grams(t):
        w = WORD.findall(t or "")
        return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else None

    g = [(d, grams(t)) for d, t in rows]
    label = list(range(len(g)))
    for i in range(len(g)):
        for j in range(i):
            if g[i][1] and g[j][1] and N.probability_jaccard(g[i][1], g[j][1]) >= 0.8:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {}
    for (d, _), x in zip(g, label, strict=True):
        least[x] = min(least.get(x, d), d)
    assert got == sorted((d, least[x]) for (d, _), x in zip(g, label, strict=True))
    assert N.near_duplicates(edge.limit(0)).count() == 0


def test_near_duplicates_of_shared_and_null_ids(spark):
    from weft.llm import neardup as N
    from weft.llm.ship import ship_package

    ship_package(spark)
    a, b, c, e = (" ".join(f"{k}{i}" for i in range(60)) for k in "abce")
    near = lambda t: t + " end"
    rows = [(1, a, 0), (1, a, 0), (1, a, 1), (2, near(a), 0),  # a repeated row, and a near copy
            (3, b, 0), (3, c, 0), (4, near(b), 0), (5, near(c), 0), (0, c, 0),  # one id, two texts
            (None, e, 0), (7, e, 0), (8, near(e), 0),  # a copy with a null id
            (None, "only null", 0), (None, "only null", 0), (None, None, 0), (9, "", 0), (9, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(3)
    got = Counter(tuple(r) for r in N.near_duplicates(docs).collect())
    assert got == Counter({(1, 1): 3, (2, 1): 1, (3, 3): 1, (4, 3): 1, (3, 0): 1, (5, 0): 1, (0, 0): 1, (None, 7): 1,
                           (7, 7): 1, (8, 7): 1, (None, None): 3, (9, 9): 2})
    kept = Counter(tuple(r) for r in N.deduplicate(docs).collect())
    assert kept == Counter([(1, a, 0), (3, b, 0), (0, c, 0), (7, e, 0), (None, "only null", 0), (None, None, 0),
                            (9, "", 0), (9, "", 0)])


def _lookalikes(n, seed):
    """Texts around the bound, some with repeated words."""
    rng = np.random.default_rng(seed)
    base = [f"t{x}" for x in rng.integers(0, 90, 70)] + ["a b c d e f"] * 4
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(int(rng.integers(0, 5))):
            w[int(rng.integers(70))] = f"z{i}"
        out.append(" ".join(w + ["a b c d e f"] * int(rng.integers(0, 4)) * (i % 2)))
    return out


def _classes(texts, similarity):
    import pyarrow as pa
    from weft.llm import neardup as N

    label = np.arange(len(texts))
    for i in range(len(texts)):
        like = N.similarities(pa.array([texts[i]] * len(texts)), pa.array(texts)) >= similarity - N.ROUNDING
        for x in np.unique(label[like]):
            label[label == x] = label[i]
    return {frozenset(np.flatnonzero(label == x).tolist()) for x in np.unique(label)}


@pytest.mark.parametrize("seed", range(4))
def test_settling_finds_the_classes_of_all_pairs(seed):
    import pyarrow as pa
    from weft.llm import neardup as N

    texts = _lookalikes(60, seed)
    sets = N._Sets(pa.RecordBatch.from_arrays([pa.array(texts)], ["text"]))
    label = np.arange(60)
    for i, j in N._links(sets, np.arange(60), label, label > 0, 0.8):
        label[label == label[i]] = label[j]
    assert {frozenset(np.flatnonzero(label == x).tolist()) for x in np.unique(label)} == _classes(texts, 0.8)


def test_exact_similarity_of_uneven_texts():
    import pyarrow as pa
    from weft.llm import neardup as N

    texts = _lookalikes(30, 9)
    h = [dict(zip(*np.unique(np.array(t.split()), return_counts=True), strict=True)) for t in texts]
    keys = sorted(set().union(*h))
    w = np.array([[x.get(k, 0) for k in keys] for x in h])
    row, column = np.nonzero(w)
    out = N._exact(0, np.arange(30), w.sum(axis=1), np.searchsorted(row, np.arange(31)), column, w[row, column])
    assert out == pytest.approx([N.probability_jaccard(h[0], x) for x in h])


def test_near_duplicates_in_blocks(spark, monkeypatch):
    from weft.llm import neardup as N

    texts = list(dict.fromkeys(_lookalikes(60, 3)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(N, "LOCAL", 8)
    groups = {}
    for r in N.near_duplicates(docs).collect():
        groups.setdefault(r["class_id"], set()).add(r["id"])
    assert set(map(frozenset, groups.values())) == _classes(texts, 0.8)


def test_components_of_a_chain(spark):
    from weft.llm.neardup import components

    out = components(spark.createDataFrame([(i, i + 1) for i in range(30)], "u long, v long")).collect()
    assert len(out) == 31 and {r["label"] for r in out} == {0}


def test_sainte_lague_and_mix(spark, edge):
    from weft.llm import mixing as M

    votes = np.random.default_rng(0).integers(1, 999, 30)
    for seats in (0, 1, 7, 200):
        want = np.zeros(30, int)
        for _ in range(seats):
            want[np.argmax(votes / (2 * want + 1))] += 1
        assert (M.sainte_lague(votes, seats) == want).all()
    assert M.targets([10, 10, 10], [3, 1, 2], 1.5, 2.0) == pytest.approx([20, 25 / 3, 50 / 3])
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source")
    a = M.mix(docs, [3, 1, 2]).drop("text").toPandas().sort_values("doc_id")
    assert a.equals(M.mix(docs.repartition(7), [3, 1, 2]).drop("text").toPandas().sort_values("doc_id").set_index(a.index))
    assert (a.taken <= 2 * a["size"]).all() and (a.copies <= 2).all()
    g = a.groupby("source").agg(t=("taken", "sum"), target=("target", "first"))
    assert (abs(g.t / g.target - 1) < 0.05).all()
    out = M.mix(edge.withColumn("size", F.lit("x")), [3, 1, 2])
    assert {r["doc_id"]: r["size"] for r in out.collect()}[0] == 0
    assert M.mix(edge.limit(0), [3, 1, 2]).count() == 0


def test_language(spark, edge):
    from weft.llm import language
    from weft.llm.queries import QUERIES

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    p = QUERIES["op1_language_id"](spark, SF).where("held_out").join(docs, "doc_id").toPandas()
    assert len(p) > 20 and (p.lang == p.lang_pred).mean() > 0.95
    model = language.train(edge)
    out = {r["doc_id"]: r for r in language.predict(edge, model).collect()}
    assert all(out[d]["lang_pred"] == "und" and out[d]["score"] == 0 for d in (0, 1, 2))
    assert out[8]["lang_pred"] == "en"
    none = language.train(edge.limit(0))
    assert {r["lang_pred"] for r in language.predict(edge, none).collect()} == {"und"}


def test_quality(spark, edge):
    from weft.llm import quality
    from weft.llm.queries import QUERIES

    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    p = QUERIES["op9_quality"](spark, "/root/testdata/sf0.01").join(labels, "doc_id").toPandas()
    assert not p.keep[p.quality == 0].any() and p.keep[p.quality == 1].mean() > 0.95
    out = {r["doc_id"]: r for r in quality.classify(edge, quality.train(edge)).collect()}
    assert not out[0]["keep"] and not out[2]["keep"]
    assert quality.classify(edge.limit(0), quality.train(edge.limit(0))).count() == 0


def test_quality_sample_is_bounded_and_of_distinct_texts(spark, monkeypatch):
    from weft.llm import quality
    from weft.llm.ship import ship_package

    ship_package(spark)
    texts = [f"Text {i}, of some plain words." if i % 2 else f"#x{i} @@ || {i} $$ %%" for i in range(300)]
    blank = [" " * i for i in range(200)]
    sizes, fit = [], quality.logistic
    monkeypatch.setattr(quality, "logistic", lambda x, q: sizes.append(len(x)) or fit(x, q))
    for hot in (texts[0], texts[1], texts[2], texts[3]):
        docs = spark.createDataFrame([(t,) for t in texts + [hot] * 150 + blank], "text string").repartition(5)
        quality.train(docs, sample=100)
        quality.train(docs, sample=1000)
    assert sizes == [100, 300] * 4


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=6).astype(np.float32)]) for i in range(600)]
    rows += [(1000 + i, [0.5] * 6) for i in range(300)]  # one hot vector
    rows += [(2000, None), (2100, []), (2200, [1.0, None, 0.0]), (2300, [float("nan")] * 6), (2400, [0.0] * 6),
             (None, [1.0] * 6), (2500, [1.0, 2.0])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_voronoi_top_k(spark, vectors):
    from weft.llm import knn
    from weft.llm.ship import ship_package

    ship_package(spark)
    whole = F.transform("embedding", lambda x: F.floor(1024 * x.cast("double")).cast("long"))
    df = vectors.where(knn.valid("embedding")).select("vec_id", whole.alias("vec"))
    got = {}
    for r in knn.top_k(df, F.col("vec_id") % 100 == 0, k=10, pivots=8).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    rows = [(r[0], np.array(r[1])) for r in df.collect() if r[0] is not None]
    for q, v in rows:
        if q % 100 == 0:
            s = sorted((-int(v @ x), i) for i, x in rows if i != q and len(x) == len(v))[:10]
            assert sorted(got.pop(q, [])) == [(n + 1, i, -d) for n, (d, i) in enumerate(s)]
    assert not got
    assert knn.top_k(df.limit(0), F.lit(True)).count() == 0


@pytest.mark.parametrize("factor", [1.0, 0.8])
def test_vantage_point_trees(spark, vectors, factor, monkeypatch):
    from weft.llm import vptree
    from weft.llm.ship import ship_package

    ship_package(spark)
    monkeypatch.setattr(vptree, "SHARD_ROWS", 300)
    index = vptree.build_index(vectors)
    found = {}
    for r in vptree.search(index, vectors.where("vec_id % 100 = 0"), 10, factor).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    rows = [(r[0], np.array(r[1], dtype=float)) for r in vectors.collect()
            if r[0] is not None and r[0] < 2000]
    hits = total = 0
    for q, v in rows:
        if q % 100 == 0:
            want = sorted((float(np.sqrt(((v - x) ** 2).sum())), i) for i, x in rows if i != q)[:10]
            got = sorted(found[q])
            hits += len({i for _, i, _ in got} & {i for _, i in want})
            total += 10
            if factor == 1.0:
                assert [(i, pytest.approx(d)) for _, i, d in got] == [(i, d) for d, i in want]
    assert hits / total >= 0.9
    assert vptree.search(index, vectors.limit(0)).count() == 0


def test_pipeline_stages(spark):
    """The stages, run one by one, against what each promises of its input."""
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    P.ship_package(spark)
    good = P.keep_good(spark, docs, SF).cache()
    assert good.columns == docs.columns and 0 < good.count() < docs.count()
    single = P.drop_near_duplicates(spark, good, SF).cache()
    assert single.columns == docs.columns
    assert single.select("text").distinct().count() == single.count()
    cut = P.cut_repeats(spark, single, SF).cache()
    assert cut.columns == docs.columns and cut.count() == single.count()
    seen = {}
    for d, t in sorted((r["doc_id"], r["text"]) for r in single.select("doc_id", "text").collect()):
        w = WORD.findall(t)
        for i in range(len(w) - 49):
            seen.setdefault(tuple(w[i:i + 50]), d)
    repeated = {d for d, t in ((r["doc_id"], r["text"]) for r in single.collect())
                for w in [WORD.findall(t)] for i in range(len(w) - 49) if seen[tuple(w[i:i + 50])] < d}
    changed = {r[0] for r in single.select("doc_id", F.col("text").alias("a")).join(cut.select("doc_id", "text"), "doc_id")
               .where("a != text").collect()}
    assert changed == repeated
    mixed = P.mix_sources(spark, cut, SF).cache()
    assert mixed.columns == docs.columns and mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    out = P.encode(spark, mixed, SF)
    assert out.count() == mixed.count()
    assert [n for n, _ in P.STAGES] == ["quality_classifier", "near_duplicates", "substring_dedup", "mix_sources", "bpe"]
    assert json.dumps(P.ORACLE_SQL) == "null" and hashlib.sha256(b"").hexdigest()


def thue_morse():
    """Two words with equal polynomial hashes modulo 2^64, whatever the base."""
    t = "a"
    for _ in range(11):
        t += t.translate(str.maketrans("ab", "ba"))
    return t, t.translate(str.maketrans("ab", "ba"))


def test_unicode_texts_equal_the_library(spark, tmp):
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    from weft.llm import bpe, token_files
    from weft.llm.ship import ship_package

    ship_package(spark)
    rng = random.Random(7)
    pool = [*"abEΣς'.,!1éé日 \t<>|", "'s", "\x85", "\xa0", "࢏", "Ᲊ", "֌", "İ", "‿", "<|endoftext|>", "\U0001f600"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(20))) for _ in range(2500)]
    texts += ["".join(chr(rng.choice([rng.randrange(0x3000), rng.randrange(0xD800), 0x10000 + rng.randrange(0x20000)]))
                      for _ in range(8)) for _ in range(3000)]
    texts += ["x " + w for w in thue_morse()]
    path = public_tokenizers.path("word_bpe_49k.json")
    tk = Tokenizer.from_file(path)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    want = {d: tk.encode(t, add_special_tokens=False).ids for d, t in enumerate(texts)}
    out = {r["doc_id"]: r for r in bpe.decode(bpe.encode(docs, path), path).collect()}
    assert [d for d in want if out[d]["ids"] != want[d]] == []
    assert [d for d in want if out[d]["decoded"] != tk.decode(want[d], skip_special_tokens=False)] == []
    token_files.write(docs, tmp + "/u", path)
    back = {r["doc_id"]: r["ids"] for r in token_files.read(spark, tmp + "/u").collect()}
    assert [d for d in want if back[d] != want[d] + [2]] == []


def test_words_are_not_confused(spark):
    from weft.llm import katz
    from weft.llm.ship import ship_package
    from weft.llm.substrings import remove_repeats

    ship_package(spark)
    a, b = thue_morse()
    frame = " ".join(f"f{i}" for i in range(49))
    docs = spark.createDataFrame([(1, f"{frame} {a}"), (2, f"{frame} {b}"), (3, f"{frame} {a}")], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in remove_repeats(docs, length=50).collect()} == {1: 0, 2: 0, 3: 50}
    out = katz.score(docs, train=F.col("doc_id") == 1, held_out=F.col("doc_id") == 2).collect()
    assert {r["doc_id"]: r["n_known"] for r in out} == {1: 51, 2: 50, 3: 51}


def test_language_sample_is_bounded_and_of_distinct_rows(spark, monkeypatch):
    from weft.llm import language
    from weft.llm.ship import ship_package

    ship_package(spark)
    rows = [(i, f"some words number {i} of plain text {'abc'[i % 3]}{i}", "en" if i % 2 else "fr") for i in range(400)]
    sizes, fit = [], language.fit
    monkeypatch.setattr(language, "fit", lambda names, labels, bits: sizes.append(len(bits)) or fit(names, labels, bits))
    for hot in range(6):
        docs = spark.createDataFrame(rows + [rows[hot]] * 3000, "doc_id long, text string, lang string").repartition(4)
        model = language.train(docs.withColumn("score", F.lit("x")), sample=100)
        language.train(docs, sample=10_000)
    assert sizes == [100, 400] * 6
    out = language.predict(docs.withColumn("lang_pred", F.lit(1)).withColumn("score", F.lit("x")), model)
    assert out.columns.count("lang_pred") == 1 and dict(out.dtypes)["score"] == "double"


def test_mix_of_small_sources_and_copies(spark):
    from weft.llm.mixing import mix
    from weft.llm.ship import ship_package

    ship_package(spark)
    rows = [(0, "a b c", "tiny"), (1, "x", "one")]
    rows += [(10 + i, " ".join(["w"] * (1 + i * 7 % 90)), "small") for i in range(12)]
    rows += [(100 + i, " ".join(["w"] * (1 + i * 31 % 700)), "big") for i in range(900)] + [(9000, " ".join(["v"] * 30000), "big")]
    rows += [(5000 + i, None, None) for i in range(3)] + [(7000 + i, "n n n n n", None) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs = docs.withColumns({c: F.lit(c) for c in ("_order", "order", "_source", "end", "number", "shard", "row", "block", "name")})
    out = mix(docs, [3, 1, 2], share=1.5, cap=2.0)
    assert out.columns == [*docs.columns, "size", "source_size", "target", "taken", "copies"]
    assert out.where("_order = '_order' AND row = 'row' AND end = 'end' AND shard = 'shard'").count() == len(rows)
    pdf = out.toPandas()
    assert (pdf.taken <= 2 * pdf["size"]).all() and (pdf.copies <= 2).all() and (pdf.copies >= 0).all()
    for _, g in pdf.groupby(pdf.source.fillna("~")):
        target, largest = g.target.iloc[0], g["size"].max()
        assert abs(g.taken.sum() - target) <= max(1.0, 0.05 * target)
        assert abs((g.copies * g["size"]).sum() - target) <= max(1.0, 0.05 * target) + largest
    assert pdf[pdf.source == "tiny"].taken.sum() >= 3


@pytest.mark.parametrize("which", ["knn", "vptree"])
def test_search_with_repeated_rows_and_clashing_columns(spark, which, monkeypatch):
    from weft.llm import knn, vptree
    from weft.llm.ship import ship_package

    ship_package(spark)
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=5).astype(np.float32)]) for i in range(250)]
    rows += [rows[100]] * 20 + [rows[0]] * 3 + [rows[7]] * 4 + [(200, [9.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns(
        {c: F.lit("u") for c in ("id", "v", "q", "dim", "cell", "rank", "score", "query_id")}).repartition(4)
    ask = F.col("vec_id") % 100 == 0
    if which == "knn":
        ints = df.select("vec_id", knn.whole("embedding", 1024.0).alias("vec"), "id", "q", "rank", "score")
        got = knn.top_k(ints, ask, k=10, pivots=6).collect()
        data = [(r["vec_id"], np.array(r["vec"])) for r in ints.collect()]
    else:
        monkeypatch.setattr(vptree, "SHARD_ROWS", 100)
        got = vptree.search(vptree.build_index(df), df.where(ask), 10, 1.0).collect()
        data = [(i, np.array(np.float32(x), dtype=float)) for i, x in rows]
    for q in (0, 100, 200):
        v = min((tuple(x) for i, x in data if i == q))
        if which == "knn":
            want = sorted((-int(np.array(v) @ x), i) for i, x in data if i != q)[:10]
            mine = sorted((-r["score"], r["vec_id"]) for r in got if r["query_id"] == q)
            assert mine == want
        else:
            want = sorted(float(np.sqrt(((np.array(v) - x) ** 2).sum())) for i, x in data if i != q)[:10]
            assert [r["score"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == pytest.approx(want)
        assert sorted(r["rank"] for r in got if r["query_id"] == q) == list(range(1, 11))


def test_top_k_of_huge_components(spark):
    from weft.llm import knn
    from weft.llm.ship import ship_package

    ship_package(spark)
    rows = [(0, [1.0, 2.0]), (1, [3e16, 0.0]), (2, [1e12, -1e12]), (3, [5e11, 1.0]), (4, [-1e12, 0.0]), (100, [1e12, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ints = df.select("vec_id", knn.whole("embedding", 1024.0).alias("vec"))
    assert [r["vec_id"] for r in ints.where("vec IS NULL").collect()] == [1]
    got = [(r["vec_id"], r["score"]) for r in knn.top_k(ints, F.col("vec_id") == 100, k=10).orderBy("rank").collect()]
    top = 2 ** 63 - 1
    assert got == [(2, top), (3, top), (0, 1024 * 1024 * 10 ** 12), (4, -top)]


def test_pipeline_of_odd_tables(spark, tmp, monkeypatch):
    """Nulls in any column, repeated rows, further columns, nothing left, nothing at all."""
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    odd = docs.withColumns({c: F.when(F.col("doc_id") % 7 != i, F.col(c)) for i, c in enumerate(docs.columns) if c != "doc_id"})
    odd = odd.unionByName(docs.limit(5)).unionByName(docs.limit(5)).withColumns({c: F.lit("u") for c in ("size", "keep", "ids", "id")})
    odd = odd.withColumn("doc_id", F.when(F.col("doc_id") % 11 != 3, F.col("doc_id")))
    for name, table in (("odd", odd), ("bad", odd.withColumn("text", F.lit(None).cast("string"))), ("none", odd.limit(0))):
        table.write.parquet(f"{tmp}/{name}/documents.parquet")
        out = P.run(spark, f"{tmp}/{name}")
        assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        rows = out.collect()
        assert (len(rows) > 10) if name == "odd" else rows == []
        kept = Counter(r["doc_id"] for r in rows if r["doc_id"] is not None)
        assert all(n <= 2 for n in kept.values())
