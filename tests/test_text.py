import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioquery.functions import estimate as E
from folioquery.functions import text as T
from folioquery.functions import tokens as K
from folioquery.functions import vectors as V


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'double' if isinstance(v, float) else 'boolean' if isinstance(v, bool) else 'int'}" for k, v in cols.items()))
    return df.select(expr).first()[0]


def test_stems(spark, rows):
    want = {"colonization": "colonize", "relational": "relate", "happiness": "happi", "ponies": "poni", "abed": "ab", "running": "runn", "cat": "cat", "cats": "cat", "is": "is", "national": "nation", "hopefulness": "hopeful", "agreement": "agree", "été": "été"}
    df = spark.createDataFrame([(w,) for w in want], "word string")
    got = dict(rows(T.stemmed_vocabulary(df, "word")))
    assert got == want


def test_tokens(spark):
    assert one(spark, T.tokens(F.col("t")), t="The a b cd, efg É9 running!") == ["cd", "efg", "é9", "running"]
    assert one(spark, T.tokens(F.col("t"), False), t="The a") == ["the"]
    assert one(spark, T.tokens(F.col("t")), t=None) == []
    assert len(T.STOP_WORDS) == len(set(T.STOP_WORDS)) == 203


@pytest.mark.parametrize(
    ("text", "kind", "mode"),
    [("compare a and b", "comparison", "semantic"), ("A vs. B", "comparison", "semantic"), ("please recap it", "summary", "semantic"), ("list all items", "list", "keyword"), ("what are the rules", "list", "keyword"), ("define entropy", "definition", "hybrid"), ("what is a shard", "definition", "hybrid"), ("show me the file", "navigation", "keyword"), ("who is Ann", "factual", "hybrid"), ("ready?", "factual", "hybrid"), ("annual report", "unknown", "hybrid"), (None, "unknown", "hybrid")],
)
def test_query_kinds(spark, text, kind, mode):
    k = T.query_kind(F.col("t"))
    assert one(spark, F.struct(k.alias("k"), T.suggested_mode(k).alias("m")), t=text) == (kind, mode)


def test_headings_and_lists(spark):
    h = T.is_heading(F.col("t"), F.col("s"), F.col("b"))
    for t, s, b, want in (("Intro", 14.0, False, True), ("small", 10.0, False, False), ("bold", 10.0, True, True), ("1.2 Overview", 10.0, False, True), ("ALL CAPS", 10.0, False, True), ("123 456", 10.0, False, False), ("Chapter 3 x", 10.0, False, True), (" ", 20.0, True, False)):
        assert one(spark, h, t=t, s=s, b=b) is want, t
    for t, want in (("• a", True), ("1) a", True), ("(2) a", True), ("a. b", True), ("plain", False), ("", False), (None, False)):
        assert one(spark, T.is_list_item(F.col("t")), t=t) is want
    for s, b, want in ((24.0, False, 1), (20.0, False, 2), (16.0, False, 3), (14.0, False, 4), (12.0, True, 5), (12.0, False, 6)):
        assert one(spark, T.heading_level(F.col("s"), F.col("b")), s=s, b=b) == want


def test_snippets(spark):
    assert one(spark, T.highlighted(F.col("t"), ["hello", "world"], "<b>", "</b>"), t="hello world foo bar") == "<b>hello</b> <b>world</b> foo bar"
    cut = one(spark, T.highlighted(F.col("t"), [], "", ""), t="a" * 300)
    assert cut == "a" * 200 + "..."
    s = one(spark, T.snippet(F.col("t"), F.lit("Needle"), "[", "]"), t="x" * 90 + " needle " + "y" * 300)
    assert s.startswith("...x") and "[needle]" in s and s.endswith("...")
    assert one(spark, T.snippet(F.col("t"), F.lit("q")), t=None) is None
    assert one(spark, T.excerpt(F.col("t"), F.lit(2), 1), t="a b c d e") == "...b c d..."


def test_normalized(spark):
    assert one(spark, T.normalized(F.col("t")), t="  Hello,\n\t World! (x) ") == "hello world x"
    assert one(spark, T.image_format(F.col("t")), t="JPG") == "jpeg"
    assert one(spark, T.file_format(F.col("t")), t="/a/b.PDF") == "pdf"
    assert one(spark, T.file_format(F.col("t")), t="/a/b.txt") is None


@settings(max_examples=1, deadline=None)
@given(st.just(0))
def test_estimates_agree(spark, _):
    import random

    random.seed(3)
    signs = "abc ÄÖ\n\t.,!?0123456789–—()日本  éñ"
    texts = ["", "a", *["".join(random.choice(signs) for _ in range(random.randint(1, 300))) for _ in range(200)]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r[0]: r[1] for r in df.select("i", K.estimate(F.col("t"))).collect()}
    assert got == {i: E.estimate(t) for i, t in enumerate(texts)}


def test_truncation_and_budget(spark, rows):
    long = "word " * 200
    short = one(spark, K.truncated(F.col("t"), 20), t=long)
    assert short.endswith("word...") and E.estimate(short) <= 22
    assert one(spark, K.truncated(F.col("t"), 20), t="short") == "short"
    assert one(spark, K.truncated(F.col("t"), 20), t=None) is None
    b = K.TokenBudget(10)
    assert b.add(6) and not b.add(5) and b.remaining == 4 and not b.exhausted and b.usage() == 60.0
    b.reset()
    assert b.remaining == 10


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(V.cosine_distance(F.col("a"), F.col("b"))).collect()] == [0.0, 1.0, 2.0, 1.0, 1.0]
    v = spark.createDataFrame([([1.0, 2.0],), ([0.0, 0.0],), ([float("nan"), 1.0],), ([float("inf"), 1.0],), (None,), ([1.0],), ([None, 1.0],)], "v array<float>")
    assert [r[0] for r in v.select(V.usable(F.col("v"), 2)).collect()] == [True, False, False, False, False, False, False]


def test_times(spark):
    for t, want in (("2024-05-06T07:08:09Z", "2024-05-06 07:08:09"), ("2024-05-06", "2024-05-06 00:00:00"), ("", None), ("soon", None), (None, None)):
        got = one(spark, V.parsed_time(F.col("t")).cast("string"), t=t)
        assert got == want
