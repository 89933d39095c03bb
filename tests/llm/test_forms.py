"""Problem 4."""

import random
import unicodedata

import pytest
from hypothesis import given
from hypothesis import strategies as st

from folioquery.llm import lookalike as L


@pytest.mark.parametrize(
    ("a", "b"),
    [("ﬁn", "fin"), ("ﬀi", "ﬃ"), ("ｂｒａ１", "bra1"), ("dеplаk", "deplak"), ("bumօ", "bumo"), ("a​́", "á"), ("x y", "x y"), ("x y", "x y"), ("Рalo", "Palo"), ("é", "é"), ("K", "K"), ("ё", "ë"), ("a\r\nb", "a\nb"), ("ｶﾞ", "ガ"), ("so­ft", "soft"), ("ĳ", "ij"), ("ﻻ", "لا"), ("ό", "ó")],
)
def test_alike(a, b):
    f = L.default_forms()
    assert f.rewrite(a) == f.rewrite(b)


@pytest.mark.parametrize(("a", "b"), [("a", "A"), ("e", "é"), ("O", "0"), ("l", "1"), ("-", "–"), ("'", "’"), ('"', "“"), ("x²", "x2"), ("a b", "ab"), ("ß", "ss"), ("ı", "i"), ("I", "l"), ("в", "b"), ("a  b", "a b"), ("ſ", "s"), ("①", "1")])
def test_different(a, b):
    f = L.default_forms()
    assert f.rewrite(a) != f.rewrite(b)


@given(st.text(max_size=60))
def test_form_is_stable(text):
    f = L.default_forms()
    once = f.rewrite(text)
    assert f.rewrite(once) == once
    assert f.rewrite(unicodedata.normalize("NFD", text)) == once
    assert f.rewrite("﻿" + text + "⁠") == f.rewrite(text)


def test_frequent_member_wins():
    f = L.Forms({"о": 900, "o": 5})
    assert f.rewrite("o") == f.rewrite("о") == f.rewrite("ο") == "о" and not f.plain
    g = L.Forms({"ﬁ": 10_000, "fi": 1})
    assert g.rewrite("ﬁ") == g.rewrite("fi")


def test_columns(spark, rows, crowded):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "ａ\tb"), (4, "plain"), (5, "ё" * 50_000)], "k int, t string")
    got = dict(rows(L.canonical(crowded(df), "t", "form", L.default_forms()), "k", "form"))
    assert got == {1: None, 2: "", 3: "a b", 4: "plain", 5: "ë" * 50_000}
    assert dict(rows(L.canonical(df, "t", "t", L.default_forms()), "k", "t"))[3] == "a b"


def test_pairs_against_brute_force(spark, rows, crowded):
    random.seed(6)
    forms = L.default_forms()
    swaps = {"a": "аａ", "o": "оο", "e": "е", " ": "  "}
    data = []
    for i in range(300):
        base = random.choice(["a cat", "one", "no end", "xyz", "é", ""])
        s = "".join(random.choice(swaps.get(c, c) + c) if random.random() < 0.3 else c for c in base)
        data.append((f"d{i % 90}/{i}", unicodedata.normalize(random.choice(["NFC", "NFD"]), s)))
    data += [(None, "one"), ("k", None), data[0], data[0]]
    df = spark.createDataFrame(data, "key string, text string")
    want = set()
    full = sorted({(k, t) for k, t in data if k and t})
    for i, (k, t) in enumerate(full):
        want |= {(min(k, q), max(k, q)) for q, u in full[i + 1 :] if t != u and forms.rewrite(t) == forms.rewrite(u)}
    assert set(rows(L.alike_pairs(crowded(df), forms))) == want and len(want) > 100


def test_found(spark, rows, crowded):
    b = spark.createDataFrame([("d", "1", "соde"), ("d", "2", "code"), ("d", "2", "code"), ("d", "3", None), (None, "4", "code"), ("d", "5", "Code")], "document_id string, block_id string, content string")
    t = spark.createDataFrame([("ｔerm",), ("term",), ("term",), ("",), (None,)], "term string")
    assert rows(L.found(crowded(b), crowded(t))) == [("content", "d/1", "d/2"), ("term", "term", "ｔerm")]
    assert rows(L.found(b.limit(0), t.limit(0))) == []
