"""Problem 10."""

import random

import pytest
from pyspark.sql import functions as F

from folioquery.llm import truncation as T

S = "doc_id long, source string, text string"
NOUNS = ["ledger", "compressor", "catalogue", "dashboard", "instrument", "warehouse", "turbine", "cartridge"]
VERBS = ["transferred", "documented", "calibrated", "inspected", "summarised"]


def sentence(r):
    return f"The {r.choice(NOUNS)} {r.choice(VERBS)} the {r.choice(NOUNS)} after the {r.choice(['handover', 'deadline'])}."


@pytest.fixture(scope="module")
def judged(spark):
    r = random.Random(4)
    data, want = [], {}
    ends = ["", "\nKind regards, the office", "\n- the late compressor", "\nRef: A7K2Q9", "\nhttps://docs.example/a/17", "\nFinal catalogue", "</p>", "\n-- Records desk", ' "', " )"]
    for i in range(400):
        text = "\n".join([r.choice(["Late dashboard", "Final turbine"]), *(sentence(r) for _ in range(r.randint(3, 8))), "- the late compressor", sentence(r)])
        source, cut = r.choice(["a", "b", None]), False
        kind = i % 8
        if kind == 0:
            text, cut = text + "\nThe " + r.choice(["compres", "catalo", "dashbo", "instru"]), True
        elif kind == 1:
            text, cut = text + f"\nThe {r.choice(NOUNS)} {r.choice(VERBS)} the", True
        elif kind == 2:
            text, cut = text[: r.randint(60, 90)].rsplit(" ", 1)[0] + " the...", True
        elif kind == 3 and len(text) > 200:
            text, source, cut = text[:200], "form", True
            cut = not text.rstrip().endswith(".") and not text.endswith(("dashboard", "turbine"))
        else:
            text += r.choice(ends)
        data.append((i, source, text))
        want[i] = cut
    dirty = [(900, "a", None), (901, "a", ""), (902, "a", " \n "), (903, "a", data[1][2]), (903, "a", data[1][2]), (904, None, "word " * 40_000 + ".")]
    df = spark.createDataFrame([*data, *dirty], S).withColumn("rank", F.lit(1)).withColumn("tail", F.lit("x"))
    return df, {x["doc_id"]: x["cut"] for x in T.judged(df).collect()}, want


def test_accuracy(judged):
    _, got, want = judged
    tp = sum(got[i] and want[i] for i in want)
    assert tp / sum(want.values()) > 0.95
    assert tp / sum(got[i] for i in want) > 0.95


def test_edges(judged, rows):
    df, got, _ = judged
    assert not any(got[i] for i in (900, 901, 902, 904)) and got[903]
    why = dict(rows(T.reasons(df)))
    assert set(why) == {i for i, cut in got.items() if cut} and set(why.values()) <= {"word", "limit", "phrase", "sentence", "ellipsis", "broken"}
    found = rows(T.found(df))
    assert len(found) == len(set(found))
    by = {r["source"]: r for r in T.rates(df).collect()}
    assert by["form"]["rate"] > 0.8 and sum(r["documents"] for r in by.values()) == df.count()


def test_empty(spark, rows):
    assert rows(T.found(spark.createDataFrame([], S))) == []
    assert rows(T.rates(spark.createDataFrame([], S))) == []


def test_trie(spark, rows):
    long = "a" * 70
    words = spark.createDataFrame([("cat", 3), ("cart", 2), ("dog", 1), (long + "b", 4), (long + "c" * 200_000, 2), ("a" * 66, 9)], "key string, a long")
    got = dict(rows(T.trie(words)))
    assert {k: v for k, v in got.items() if k[0] == "c"} == {"c": 5, "ca": 5, "car": 2}
    assert got["a"] == got["a" * 64] == 15 and max(map(len, got)) == 64
    asked = spark.createDataFrame([(long,), ("a" * 66,), (long + "b",), ("a" * 69 + "x",), ("c",), (long + "cc",)], "node string")
    assert dict(rows(T.deeper(words, asked))) == {long: 6, "a" * 66: 6, long + "cc": 2}


def test_limits(spark, rows):
    tails = lambda n: [(f"t{i}",) for i in range(n)]
    data = [("s", 100, 100, "open", "line", t) for (t,) in tails(14)] + [("s", i * 7, i * 7, "open", "line", f"u{i}") for i in range(2, 11)]
    data += [("copies", 100, 100, "open", "line", "same")] * 50 + [("done", 100, 100, "end", "line", t) for (t,) in tails(50)] + [("many", 60 + i % 200, 60 + i % 200, "open", "line", f"w{i}") for i in range(6000)]
    data += [("rare", 60 + i % 200, 60 + i % 200, "end", "line", f"w{i}") for i in range(6000)] + [("rare", 200, 200, "open", "line", t) for (t,) in tails(12)]  # under 1 % of a source
    ends = spark.createDataFrame(data, "source string, chars long, bytes long, mark string, shape string, tail string")
    assert rows(T.limits(ends)) == [(s, u, n) for s, n in (("rare", 200), ("s", 100)) for u in ("bytes", "chars")]
