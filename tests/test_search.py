import math

import pytest
from pyspark.sql import functions as F

from folioquery.errors import InvalidQuery
from folioquery.operators import filters as flt
from folioquery.operators import index as ix
from folioquery.operators import search as S

B = "document_id string, block_id string, block_key long, type string, content string, sequence int, is_heading boolean, section string, page int"


@pytest.fixture(scope="module")
def corpus(spark):
    data = [
        ("d1", "b1", 1, "text", "machine learning algorithms for data analysis", 0, False, None, 1),
        ("d1", "b2", 2, "text", "deep learning neural networks", 1, False, None, 1),
        ("d1", "b3", 3, "heading", "natural language processing", 2, True, None, 2),
        ("d2", "b1", 4, "text", "learning learning", 0, False, "s", 1),
        ("d2", "b2", 5, "image", "learning.png", 1, False, None, 1),
        ("d2", "b3", 6, "text", None, 2, None, None, None),
    ]
    blocks = spark.createDataFrame(data, B)
    posts = ix.postings(blocks, stemming=False)
    return blocks, posts, ix.document_stats(blocks, posts)


def test_postings(corpus, rows):
    blocks, posts, stats = corpus
    got = {(t, d, b): (p, tf, n) for t, d, b, p, tf, n in rows(posts)}
    assert got["learning", "d2", "b1"] == ([0, 1], 1.0, 2)
    assert got["learning", "d1", "b1"] == ([1], 0.2, 5)
    assert not any(b == "b2" and d == "d2" for _, d, b in got)
    assert rows(stats) == [("d1", 12, 11, 4.0), ("d2", 2, 1, 2 / 3)]
    assert rows(ix.document_frequency(posts).filter("term = 'learning'")) == [("learning", 2)]


def test_bm25_by_hand(spark, corpus, rows):
    blocks, posts, stats = corpus
    q = spark.createDataFrame([(1, "learning data data"), (2, "the of"), (3, None)], "query_id long, query_text string")
    got = {(d, b): s for _, d, b, s in rows(S.bm25(q, posts, stats))}

    def part(df, tf, size, avg):
        return math.log((2 - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / avg))

    assert got["d1", "b1"] == pytest.approx(part(2, 0.2, 5, 4) + 2 * part(1, 0.2, 5, 4), abs=1e-8)
    assert got["d2", "b1"] == pytest.approx(part(2, 1.0, 2, 2 / 3), abs=1e-8)
    assert set(got) == {("d1", "b1"), ("d1", "b2"), ("d2", "b1")}


def test_boost_and_least(spark, corpus, rows):
    blocks, posts, stats = corpus
    q = spark.createDataFrame([(1, "language")], "query_id long, query_text string")
    s = S.bm25(q, posts, stats)
    plain = rows(s)[0][3]
    assert rows(S.boosted(s, blocks), "score")[0][0] == pytest.approx(1.5 * plain)
    assert rows(S.boosted(s, blocks, min_score=1.2 * plain)) == []


def test_boolean_and_phrase(corpus, rows):
    _, posts, _ = corpus
    assert rows(S.boolean_matches(posts, "learning AND deep")) == [("d1", "b2")]
    assert rows(S.boolean_matches(posts, "learning NOT deep NOT machine")) == [("d2", "b1")]
    assert rows(S.boolean_matches(posts, '"deep learning"')) == [("d1", "b2")]
    assert rows(S.boolean_matches(posts, '"learning deep"')) == []
    with pytest.raises(InvalidQuery):
        S.boolean_matches(posts, " ")


HIT = "query_id long, document_id string, block_id string, score double"


def test_fusion(spark, rows):
    k = S.top(spark.createDataFrame([(1, "d1", "b1", 1.0), (1, "d2", "b2", 0.8)], HIT), 10)
    v = S.top(spark.createDataFrame([(1, "d2", "b2", 0.9), (1, "d3", "b3", 0.7)], HIT), 10)
    f = S.top(S.fuse(k, v), 10)
    got = {r["document_id"]: r for r in f.collect()}
    assert got["d2"]["rank"] == 1 and (got["d2"]["keyword_rank"], got["d2"]["vector_rank"]) == (2, 1)
    assert got["d3"]["keyword_rank"] == 3 and got["d1"]["vector_rank"] == 3
    swapped = {r["document_id"]: r["score"] for r in S.fuse(v, k, 0.3, 0.7).collect()}
    assert swapped == pytest.approx({r["document_id"]: r["score"] for r in S.fuse(k, v, 0.7, 0.3).collect()})
    assert rows(S.fuse(k, v, 7.0, -1.0), "score") == rows(S.fuse(k, v), "score")


def test_normalize_and_diversify(spark, rows):
    n = S.normalized(spark.createDataFrame([(1, "a", "x", 10.0), (1, "b", "x", 5.0), (1, "c", "x", 2.5), (2, "a", "x", 0.0)], HIT))
    assert rows(n, "query_id", "score") == [(1, 0.25), (1, 0.5), (1, 1.0), (2, 0.0)]
    d = S.diversified(spark.createDataFrame([(1, "a", str(i), float(i)) for i in range(5)] + [(1, "b", "0", 9.0)], HIT), 2)
    assert rows(d, "document_id", "block_id") == [("a", "3"), ("a", "4"), ("b", "0")]
    assert rows(S.cited(d), "citation", "document_id") == [("[1]", "b"), ("[2]", "a"), ("[3]", "a")]
    kw = spark.createDataFrame([(1, "a", "x", 2.0)], HIT)
    assert rows(S.hybrid(kw, None), "score") == [(1.0,)]
    assert rows(S.hybrid(kw, kw, mode="semantic"), "score") == [(1.0,)]


def test_nearest_against_brute_force(spark, rows):
    import numpy as np

    x = np.random.default_rng(1).standard_normal((60, 8)).astype(np.float32)
    v = spark.createDataFrame([(i, "m", x[i].tolist()) for i in range(60)], "vec_id long, model string, vector array<float>")
    q = v.filter("vec_id < 7").withColumnRenamed("vec_id", "query_id")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u[:7] @ u.T
    s[np.arange(7), np.arange(7)] = -2
    want = sorted((i, int(j)) for i in range(7) for j in np.argsort(-s[i])[:3])
    assert rows(S.nearest(q, v, 3, block=3), "query_id", "vec_id") == sorted(want, key=lambda t: tuple(map(str, t))) or set(rows(S.nearest(q, v, 3, block=3), "query_id", "vec_id")) == set(want)
    assert rows(S.nearest(q, v.limit(0), 3)) == []


def test_context_sections(corpus, rows):
    blocks, _, _ = corpus
    assert rows(S.context(blocks, 1).filter("document_id = 'd1'"), "block_id", "before", "after") == [("b1", [], ["b2"]), ("b2", ["b1"], ["b3"]), ("b3", ["b2"], [])]
    more = blocks.unionByName(blocks.sparkSession.createDataFrame([("d1", "b4", 9, "text", "x", 3, False, None, 2)], B))
    s = dict(rows(ix.sections(more, F.coalesce("is_heading", F.lit(False))).filter("document_id = 'd1'"), "block_id", "section_now"))
    assert s == {"b1": None, "b2": None, "b3": None, "b4": "natural language processing"}


def test_filters(spark, rows):
    d = spark.createDataFrame([("a", "crm", "pdf", 3, "e1"), ("b", "web", "docx", 9, ""), ("c", None, None, None, None)], "document_id string, source string, format string, page_count int, external_id string")
    t = spark.createDataFrame([("a", "lang", "en"), ("a", "kind", "x"), ("b", "lang", "fr")], "document_id string, tag_key string, tag_value string")
    v = spark.createDataFrame([("b", "1")], "document_id string, block_id string")
    ids = lambda f: [r[0] for r in rows(f.apply(d, t, v), "document_id")]
    assert flt.Filter().is_empty() and ids(flt.Filter()) == ["a", "b", "c"]
    assert ids(flt.Filter(sources=["crm", "docx"])) == ["a", "b"]
    assert ids(flt.Filter(tags={"lang": "en", "kind": "x"})) == ["a"]
    assert ids(flt.Filter(tags={"lang": "!en"})) == ["b", "c"]
    assert ids(flt.Filter(min_pages=4, max_pages=9)) == ["b"]
    assert ids(flt.Filter(has_embeddings=True)) == ["b"] and ids(flt.Filter(has_embeddings=False)) == ["a", "c"]
    assert ids(flt.Filter(document_ids=[])) == []
    assert ids(flt.Filter(external_ids=["e1"])) == ["a"]


def test_unique_blocks_and_postings(spark, rows, crowded):
    b = spark.createDataFrame([("d", "1", 1, "old"), ("d", "1", 2, "new"), (None, "1", 3, "x"), ("d", None, 4, "x")], "document_id string, block_id string, block_key long, content string")
    assert rows(ix.unique_blocks(crowded(b)), "document_id", "block_id", "content") == [("d", "1", "new")]
    p = spark.createDataFrame([("t", "d", "1", [0], 0.5), ("t", "d", "1", [0], 0.5), ("", "d", "1", [0], 0.5), (None, "d", "1", None, None), ("u", "d", "1", None, None)], "term string, document_id string, block_id string, positions array<int>, term_frequency double")
    assert rows(ix.unique_postings(crowded(p)), "term") == [("t",), ("u",)]


@pytest.fixture(scope="module")
def many(spark):
    """Blocks of few words, so that scores tie, and queries that share terms."""
    words = "learn deep net data tree graph".split()
    text = lambda i, k: " ".join(words[(i * 7 + j * j * 3 + i // 5) % 6] for j in range(1 + (i + k) % 4))
    data = [(f"d{i % 13}", f"b{i}", i, "text", text(i, 1), i, i % 5 == 0, None, 1) for i in range(200)]
    blocks = spark.createDataFrame(data, B)
    posts = ix.postings(blocks, stemming=False)
    queries = [(i, " ".join(words[(i + j * (i % 3)) % 6] for j in range(1 + i % 4))) for i in range(24)] + [(24, "tree data"), (25, "data tree"), (26, "absent"), (27, None)]
    return spark.createDataFrame(queries, "query_id long, query_text string"), posts, ix.document_stats(blocks, posts), blocks


@pytest.mark.parametrize("part", [10_000, 60])
@pytest.mark.parametrize("how", ["plain", "kept", "boosted", "least"])
def test_best_is_the_top_of_all(many, rows, part, how):
    q, posts, stats, blocks = many
    s = S.bm25(q, posts, stats)
    kept = blocks.filter("document_id in ('d1', 'd2', 'd5')").select("document_id").distinct()
    least = 0.5
    want, opts = {
        "plain": (s, {}),
        "kept": (flt.restricted(s, kept), {"kept": kept}),
        "boosted": (S.boosted(s, blocks), {"blocks": blocks}),
        "least": (S.boosted(s, blocks, least), {"blocks": blocks, "min_score": least}),
    }[how]
    cols = ["query_id", "document_id", "block_id", F.round("score", 7).alias("score"), "rank"]
    assert rows(S.best(q, posts, stats, 5, part=part, **opts), *cols) == rows(S.top(want, 5), *cols)
    assert how == "least" or rows(S.top(want, 5), "query_id")


def test_best_with_weights_below_zero(spark, many, rows):
    """More documents have a term than have statistics."""
    q, posts, stats, _ = many
    few = stats.filter("document_id in ('d1', 'd2')")
    cols = ["query_id", "document_id", "block_id", F.round("score", 7).alias("score"), "rank"]
    assert rows(S.best(q, posts, few, 4), *cols) == rows(S.top(S.bm25(q, posts, few), 4), *cols)


@pytest.mark.parametrize("name", ["bm25_batch", "bm25_min_score", "bm25_heading_boost", "search_filtered"])
def test_queries_make_no_row_for_every_match(spark, monkeypatch, name):
    from folioquery.plans import catalog

    monkeypatch.setattr(S, "bm25", None)
    assert catalog.queries()[name](spark, "/root/testdata/sf0.001").count() > 0


@pytest.mark.parametrize("name", ["hybrid_search", "agent_search", "search_diagnostics"])
def test_whole_searches_make_no_row_for_every_match(spark, monkeypatch, name):
    from folioquery.plans import catalog

    monkeypatch.setattr(S, "bm25", None)
    catalog.queries()[name](spark, "/root/testdata/sf0.001")  # the plan is enough


def test_nearest_in_parts_of_any_size(spark, rows):
    """Many equal similarities, own rows skipped, more rows than a product holds."""
    import numpy as np

    r = np.random.default_rng(3)
    x = r.integers(-1, 2, (9_000, 4)).astype(float)
    x[:, 0] = 1
    v = spark.createDataFrame([(i, "m", y.tolist()) for i, y in enumerate(x)], "vec_id long, model string, vector array<float>").repartition(4)
    q = v.filter("vec_id % 900 = 0").withColumnRenamed("vec_id", "query_id")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = set()
    for i in range(0, 9_000, 900):
        s = np.round(u @ u[i], 9)
        s[i] = -2
        want |= {(i, int(j), n + 1) for n, j in enumerate(np.lexsort((np.arange(9_000), -s))[:5])}
    for opts in ({}, {"block": 3, "part": 700}):
        assert set(rows(S.nearest(q, v, 5, **opts), "query_id", "vec_id", "rank")) == want
