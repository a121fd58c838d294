import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chatloom.functions import pytext as t

SIGNS = "ab \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0    　é中😀-_.'İß"


def test_white_space_is_that_of_python():
    assert set(t.WS) == {chr(i) for i in range(0x110000) if chr(i).isspace()}


def test_strip_and_lines_equal_python(spark):
    rng = random.Random(7)
    texts = ["", "\n", "a\r\nb\r", *("".join(rng.choices(SIGNS, k=rng.randrange(12))) for _ in range(3000))]
    rows = spark.createDataFrame([(x,) for x in texts], "x string").select("x", t.py_strip(F.col("x")).alias("s"), t.split_lines(F.col("x")).alias("l"), t.is_blank(F.col("x")).alias("b")).collect()
    for r in rows:
        assert r["s"] == r["x"].strip()
        assert r["l"] == r["x"].splitlines()
        assert r["b"] == (not r["x"].strip())


def test_labels_and_numbers(spark):
    rows = [("English", "english", "english", True), (" en ", "en", "en", True), ("en_GB", "en-gb", "en-gb", True), ("english us", "english-us", "english us", False), (None, None, None, False), ("", "", "", False)]
    df = spark.createDataFrame([(r[0],) for r in rows], "x string")
    got = df.select("x", t.label_script(F.col("x")), t.label_notebook(F.col("x")), t.is_english_notebook(F.col("x"))).collect()
    assert [tuple(g) for g in got] == rows
    numbers = spark.createDataFrame([("1",), (" 1 ",), ("1.0",), (None,), ("x",)], "x string").select(t.try_int(F.col("x"))).collect()
    assert [r[0] for r in numbers] == [1, 1, None, None, None]


def test_missing_by_type(spark):
    df = spark.createDataFrame([(None, None, None), (" ", float("nan"), []), ("a", 1.0, [1])], "s string, d double, a array<int>")
    got = df.select(*[t.is_missing(F.col(c), k) for c, k in df.dtypes]).collect()
    assert [tuple(r) for r in got] == [(True, True, True), (True, True, True), (False, False, False)]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(max_size=20), min_size=1, max_size=20))
def test_hash_ignores_outer_white_space(texts):
    import hashlib

    for x in texts:
        assert hashlib.sha256(x.strip().encode("utf-8", "surrogatepass")).hexdigest() == hashlib.sha256(f" {x}\n".strip().encode("utf-8", "surrogatepass")).hexdigest()


def test_prompt_hash(spark):
    import hashlib

    rows = spark.createDataFrame([(" a\n",), ("a",), ("A",), (None,)], "x string").select(t.prompt_hash(F.col("x"))).collect()
    h = [hashlib.sha256(x.encode()).hexdigest() for x in ("a", "a", "A", "")]
    assert [r[0] for r in rows] == h
