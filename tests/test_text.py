"""Python str semantics of the Column helpers, checked against Python itself."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from weft.functions.text import PY_SPACE_CHARS, is_ascii, py_strip, token_count

ALPHABET = list(PY_SPACE_CHARS) + list("ab,é€😀​") + ["\x1c"]


def test_space_set_is_pythons():
    every = {chr(i) for i in range(0x110000) if chr(i).isspace()}
    assert set(PY_SPACE_CHARS) == every


def test_strip_split_match_python(spark):
    @settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.lists(st.text(alphabet=ALPHABET, max_size=30), min_size=1, max_size=60))
    def check(texts):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, t STRING")
        rows = df.select("i", py_strip("t").alias("s"), token_count("t").alias("n"),
                         is_ascii("t").alias("a")).orderBy("i").collect()
        for r, t in zip(rows, texts):
            assert r.s == t.strip()
            assert r.n == len(t.split())
            assert r.a == t.isascii()

    check()
