"""Importance resampling, sequence packing and spelling variants against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
LOWER = {c: c + 32 for c in range(65, 91)}
EDGE = [(0, None), (1, ""), (2, " \t\n"), (3, "Éa b  c " * 40), (4, "Éa b  c " * 40), (None, "x y z " * 9), (5, "one two"),
        (5, "one two"), (5, "other"), (6, "w" * 70000 + " tail"), (7, " ".join(f"k{i}" for i in range(3000))),
        (8, "日本 語 <|endoftext|> it's"), (9, "word " * 30), (9, "word " * 30), (None, None)]


@pytest.fixture(scope="module")
def edge(spark):
    from weft.llm.ship import ship_package

    ship_package(spark)
    rows = [(d, t, 1, "r", 2.0, 3) for d, t in EDGE]
    return spark.createDataFrame(rows, "doc_id long, text string, rank int, row string, weight double, ids int")


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")


@pytest.mark.parametrize("piece", [256, 1024, 1 << 20])
def test_crc_of_spans(piece, monkeypatch):
    from weft.llm import crc

    monkeypatch.setattr(crc, "PIECE", piece)
    rng = np.random.default_rng(piece)
    for n in (0, 1, 255, 256, 257, 1024, 3000):
        data = rng.integers(0, 256, n).astype(np.uint8)
        at = crc.running(data, np.arange(n + 1))
        i, j = np.sort(rng.integers(0, n + 1, (2, 60)), axis=0)
        assert crc.of_spans(at[i], at[j], j - i).tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(i, j, strict=True)]
    for size in (0, 3, 256, 70000, 1 << 17):
        a, b = b"first", bytes(rng.integers(0, 256, size).astype(np.uint8))
        got = crc.combine(np.array([zlib.crc32(a)]), np.array([zlib.crc32(b)]), np.array([size]))
        assert got[0] == zlib.crc32(a + b)


def resampled(docs, target, percent, least):
    word = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def grams(t):
        w = word.findall((t or "").translate(LOWER))
        return len(w), [zlib.crc32(" ".join(w[i:i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]

    docs = [(d, *grams(t)) for d, t in docs]
    s, t = Counter(b for _, _, x in docs for b in x), Counter(b for x in target for b in grams(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in range(10000)]
    rows = []
    for d, n, x in docs:
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in x)
        rows.append([d, len(x), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k in range(percent * len(able) // 100):
        able[k][4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def test_resampling(spark, edge):
    from weft.llm.queries import QUERIES
    from weft.llm.resampling import resample

    target = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = QUERIES["op11_importance_resampling"](spark, SF)
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint"] * 5
    texts = [r["text"] for r in target.collect()]
    assert sorted(map(tuple, got.collect()), key=str) == resampled(documents(spark).collect(), texts, 5, 20)
    out = resample(edge.repartition(3), target, percent=60, min_words=3)
    assert out.columns == ["doc_id", "text", "row", "ids", "n_features", "weight", "score", "rank"]
    got = sorted((tuple(r) for r in out.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)
    assert got == resampled(EDGE, texts, 60, 3)
    assert resample(edge.limit(0), target).count() == 0
    assert resample(edge, target.limit(0)).where("rank IS NOT NULL").count() == 0  # 5 % of few documents
    assert resample(edge, target, keep=["doc_id"]).columns == ["doc_id", "n_features", "weight", "score", "rank"]


def odd_texts(n, seed):
    rng = random.Random(seed)
    pool = [*"ab'.,!1\t\n \r\x1c\x85\xa0é日ſİ     　​֌࢏Ᲊ", " ", "  ",
            "<|endoftext|>", "'s", " x", "\U0001f600"]
    some = ["".join(rng.choice(pool) for _ in range(rng.randrange(30))) for _ in range(n // 2)]
    return some + ["".join(chr(rng.randrange(0xD800)) for _ in range(8)) for _ in range(n - n // 2)]


def byte_level():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def test_packing_equals_the_library(spark, edge):
    from tokenizers import Tokenizer

    from weft.llm import sequence_packing as S

    tk = Tokenizer.from_file(byte_level())
    texts = [t for _, t in EDGE] + odd_texts(3000, 3) + [r["text"] for r in documents(spark).collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    out = S.pack(docs, byte_level())
    rows = out.collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for d, t in enumerate(texts):
        at, ids = 0, []
        for r in sorted(by_doc[d], key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] == len(r["ids"]) > 0
            at += r["length"]
            ids += r["ids"]
        assert ids == tk.encode(t or "", add_special_tokens=False).ids + [1] and {r["doc_tokens"] for r in by_doc[d]} == {at}
    fills = []
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        fills.append(at)
    assert max(fills) == 2048 and all(f & (f - 1) == 0 for f in fills)
    assert sum(f < 2048 for f in fills) <= 11 * 3  # the powers of two of one window a partition
    for r in S.sequences(out, 2048).collect():
        assert r["n_ids"] == len(r["ids"]) and r["starts"][0] == 0
    out = S.pack(edge, byte_level())
    assert out.columns == ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    assert out.agg(F.countDistinct("doc_id")).first()[0] == 10 and out.where("start = 0").count() == len(EDGE)
    assert S.pack(edge.limit(0), byte_level()).count() == 0
    again = S.pack(edge, byte_level()).collect()
    assert again == S.pack(edge, byte_level()).collect()


def test_sum_of_squares_rule():
    """Every placement against the sum of squares of all possible ones."""
    from weft.llm.sequence_packing import Packer

    rng = np.random.default_rng(1)
    done = []
    p = Packer(40, done.append, max_open=1000)
    for i in range(2000):
        size = int(rng.integers(1, 40))
        counts = [len(x) for x in p.open]
        results = {}
        for h in [0, *(h for h in range(1, 40) if counts[h])]:
            if h + size <= 40:
                after = list(counts) + [0]
                after[h] -= h > 0
                after[h + size] += 1
                results[h] = sum(x * x for x in after[1:40])
        h = p.choose(size)
        assert results[h] == min(results.values()) and h == max(k for k, v in results.items() if v == min(results.values()))
        p.add(i, np.full(size, i))
    open_ = p.n_open
    assert open_ == sum(map(len, p.open)) < 200
    p.finish()
    assert sum(w.fill < 40 for w in done) <= 6 and sum(w.fill for w in done) == sum(len(x[2]) for w in done for x in w.pieces)


def test_packing_bounds_its_open_windows():
    from weft.llm.sequence_packing import Packer

    done = []
    p = Packer(64, done.append, max_open=10)
    for i in range(1000):  # nothing fits with anything
        p.add(i, np.full(40 + i % 5, i))
        assert p.n_open <= 10
    p.finish()
    ids = Counter(x for w in done for _, _, part in w.pieces for x in part.tolist())
    assert ids == Counter({i: 40 + i % 5 for i in range(1000)})
    assert all(w.fill & (w.fill - 1) == 0 for w in done)


def variants(counts, ratio):
    words = sorted(counts)
    near = {w: [] for w in words}
    shape = {}
    for w in words:  # one deleted place, or one open place
        for i in range(len(w)):
            shape.setdefault((w[:i], w[i + 1:]), set()).add(w)
    for w in words:
        around = set()
        for i in range(len(w) + 1):
            around |= shape.get((w[:i], w[i + 1:]), set()) if i < len(w) else set()
            around |= shape.get((w[:i], w[i:]), set())
            if i < len(w) and w[:i] + w[i + 1:] in counts:
                around.add(w[:i] + w[i + 1:])
        near[w] = sorted(around - {w}, key=lambda x: (-counts[x], x))
    form = {w: near[w][0] for w in words if near[w] and counts[near[w][0]] >= ratio * counts[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return [(w, form.get(w), root(w), counts[w], len(near[w]), counts.get(form.get(w))) for w in words]


def damaged(docs):
    c = Counter()
    for d, t in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            c[w[:h % len(w)] + w[h % len(w) + 1:] if h % 31 == 0 else w] += 1
    return {w: n for w, n in c.items() if n >= 2 and len(w) >= 7}


def test_spelling(spark, edge):
    from weft.llm import spelling as S
    from weft.llm.queries import QUERIES

    got = QUERIES["op13_spelling_variants"](spark, SF)
    assert dict(got.dtypes) == {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint",
                                "form_n": "bigint"}
    assert sorted(map(tuple, got.collect())) == variants(damaged(documents(spark).collect()), 10)
    rows = [(d, (t or "") + " Éèàbcdeñ ÉÈàbcdeñ éèàbcde") for d, t in EDGE]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    words = S.vocabulary(docs, damage=31)
    assert {r["word"]: r["n"] for r in words.collect()} == damaged(rows)
    assert S.vocabulary(edge, min_length=4).columns == ["word", "n"]
    assert S.group_variants(S.vocabulary(edge.limit(0))).count() == 0


@pytest.mark.parametrize("seed,alphabet,longest,parts", [(0, "ab", 12, 4), (1, "abé", 9, 4), (2, "abc", 9, 1), (3, "ab", 16, 16),
                                                         (4, "abcdefghÿ", 8, 2)])
def test_near_words_of_dense_lists(spark, seed, alphabet, longest, parts):
    from weft.llm import spelling as S
    from weft.llm.ship import ship_package

    ship_package(spark)
    rng = random.Random(seed)
    counts = {"".join(rng.choice(alphabet) for _ in range(rng.randrange(7, longest + 1))): rng.choice([2, 3, 20, 30, 200, 3000])
              for _ in range(700)}
    counts["z" * 5000] = 9
    counts["z" * 5001] = 90
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert sorted(map(tuple, S.group_variants(words, parts=parts).collect())) == variants(counts, 10)


def test_long_lists_are_cut_finer(spark, monkeypatch):
    from weft.llm import spelling as S
    from weft.llm.ship import ship_package

    ship_package(spark)
    monkeypatch.setattr(S, "LIST_WORDS", 20)
    counts = {f"{'common' * 5}{a}{b}{c}{'ending' * 3}": 2 + ord(a) for a in "abcdefg" for b in "abcd" for c in "abcdef"}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert sorted(map(tuple, S.group_variants(words).collect())) == variants(counts, 10)


def test_word_cache_tells_words_by_bytes():
    """Words whose polynomial hashes modulo 2^64 agree for every base."""
    from weft.llm import words as W
    from weft.llm.bpe import WordIds

    t = "a"
    for _ in range(11):
        t += t.translate(str.maketrans("ab", "ba"))
    pair = [t, t.translate(str.maketrans("ab", "ba"))]
    cache = WordIds(lambda batch: (np.arange(len(batch)) + 7, np.ones(len(batch), np.int64)))
    ids, offsets = cache.encode(pa.array([f"x {pair[0]}", None, f"{pair[1]} x"]))
    assert ids.tolist() == [7, 8, 9, 7] and offsets.tolist() == [0, 2, 2, 4]
    assert cache.encode(pa.array(pair))[0].tolist() == [8, 9]
    assert len(set(W.column_words(pa.array(pair)).hash.tolist())) == 2
