import pytest

from folioquery.errors import InvalidQuery
from folioquery.operators import embedding
from folioquery.operators import index as ix
from folioquery.operators import unified as U
from folioquery.operators.filters import Filter

HASH = embedding.HashProvider(dimension=32)


@pytest.fixture(scope="module")
def tables(spark):
    b = [("d1", "b0", "Pumps", 0, "heading", None), ("d1", "b1", "the pump moves cold water", 1, "text", "Pumps"), ("d1", "b2", "", 2, "image", "Pumps"), ("d1", "b3", "valves close", 3, "text", "Pumps"), ("d2", "b1", "cold water for the garden pump", 0, "text", None), ("d3", "b1", None, 0, "text", None)]
    blocks = spark.createDataFrame([(d, i, c, s, t, x, t == "heading", 1) for d, i, c, s, t, x in b], "document_id string, block_id string, content string, sequence int, type string, section string, is_heading boolean, page int")
    docs = spark.createDataFrame([("d1", "one", "crm", "pdf", "e1"), ("d2", "two", "kb", "pdf", None), ("d3", None, None, None, None)], "document_id string, name string, source string, format string, external_id string")
    posts = ix.postings(blocks, stemming=False)
    v = embedding.embedded(blocks.selectExpr("document_id", "block_id", "content", "hash(document_id, block_id)::long as vec_id"), HASH)
    tags = spark.createDataFrame([("d1", "lang", "en")], "document_id string, tag_key string, tag_value string")
    images = spark.createDataFrame([("i1", "d1", "Pumps", "png")], "image_id string, document_id string, section string, format string")
    return U.Tables(docs, blocks, posts, ix.document_stats(blocks, posts), v, tags, images)


def queries(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, query_text string")


def test_everything(spark, tables, rows, crowded):
    o = U.Options(context_window=1, images=True, metadata=True, pre="<b>", post="</b>")
    got = {(r["query_id"], r["document_id"], r["block_id"]): r for r in U.search_store(crowded(queries(spark, "cold water", "", None, "zzz")), tables, o, HASH).collect()}
    r = got[0, "d1", "b1"]
    assert r["snippet"] == "the pump moves <b>cold water</b>" and r["images"] == ["images/i1.png"] and r["source"] == "crm" and r["tags"] == {"lang": "en"}
    assert [x["block_id"] for x in r["context"]] == ["b0", "b1", "b2"]
    assert (0, "d2", "b1") in got and got[0, "d2", "b1"]["images"] is None
    assert {k[0] for k in got} <= {0, 3}


def test_modes_and_filters(spark, tables, rows):
    q = queries(spark, "cold water")
    for mode, provider in (("keyword", HASH), ("semantic", HASH), ("hybrid", None)):
        r = U.ranked(q, tables, U.Options(mode=mode), provider)
        assert {("d1", "b1"), ("d2", "b1")} <= set(rows(r, "document_id", "block_id"))
    one = U.ranked(q, tables, U.Options(where=Filter(sources=["kb"])), HASH)
    assert {r[0] for r in rows(one, "document_id")} == {"d2"}
    assert {r[0] for r in rows(U.search_in_document("d1", q, tables, U.Options(), HASH), "document_id")} == {"d1"}
    assert rows(U.search_in_document("none", q, tables, U.Options(), HASH)) == []
    assert rows(U.ranked(q, tables, U.Options(max_results=1), HASH), "rank") == [(1,)]
    with pytest.raises(InvalidQuery):
        U.Options(mode="other")


def test_agents_and_diagnosis(spark, tables, rows):
    q = queries(spark, "what is cold water", "nothing")
    a = U.for_agents(q, tables, U.Options(context_window=1), HASH).collect()
    mine = [r for r in a if r["query_id"] == 0]
    assert {r["kind"] for r in mine} == {"factual"} and {r["citation"] for r in mine} == {f"[{i + 1}]" for i in range(len(mine))}
    assert {r["total_tokens"] for r in mine} == {sum(r["tokens"] for r in mine)}
    d = {r["query_id"]: r for r in U.diagnosed(q, tables, U.Options(min_score=0.9), HASH).collect()}
    assert d[0]["keyword_results"] == 2 and d[0]["returned"] + d[0]["filtered_by_score"] == len(mine)
    assert d[1]["keyword_results"] == 0
