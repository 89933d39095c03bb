import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from folioquery.operators import lifecycle as L
from folioquery.sources import records


@pytest.fixture(scope="module")
def store(spark):
    docs = spark.createDataFrame([("d1", "crm"), ("d2", "crm"), ("d3", "kb"), ("d4", None)], "document_id string, source string")
    blocks = spark.createDataFrame([("d1", "b1", "text", "one"), ("d1", "b2", "text", "two"), ("d2", "b1", "heading", "three"), ("d3", "b1", "image", "i"), ("d3", "b2", "text", " ")], "document_id string, block_id string, type string, content string")
    vectors = spark.createDataFrame([("d1", "b1", [1.0], "h", "m", 1), ("d1", "b1", [2.0], "h", "m", 1), ("d2", "b1", None, "h", "m", 1), ("dx", "b9", [1.0], "h", "m", 1)], "document_id string, block_id string, vector array<float>, text_hash string, model string, dimension int")
    return docs, blocks, vectors


def test_states(store, rows):
    docs, blocks, vectors = store
    assert rows(L.unembedded(blocks, vectors), "document_id", "block_id") == [("d1", "b2"), ("d2", "b1")]
    assert rows(L.incomplete(blocks, vectors)) == [("d1", 2, 1)]
    assert rows(L.pending(docs, vectors), "document_id") == [("d2",), ("d3",), ("d4",)]
    st = {r[0]: r[1:] for r in rows(L.status(blocks, vectors))}
    assert st == {"d1": (2, 1, False, 50.0), "d2": (1, 0, False, 0.0), "d3": (0, 0, True, 100.0)}
    by = {r["source"]: r for r in L.by_source(docs, blocks, vectors).collect()}
    assert (by["crm"]["documents"], by["crm"]["blocks"], by["crm"]["missing"]) == (2, 3, 2)
    h = L.health(docs, blocks, vectors).first()
    assert (h["orphans"], h["incomplete"], h["pending"], h["healthy"]) == (1, 1, 3, False)


def test_source_stats_without_vectors(spark, store):
    docs, blocks, vectors = store
    by = {r["source"]: r for r in L.by_source(docs, blocks, vectors.limit(0)).collect()}
    assert (by["crm"]["documents"], by["crm"]["blocks"], by["crm"]["missing"]) == (2, 3, 3)


def test_hashes_and_duplicates(spark, rows):
    b = spark.createDataFrame([("a", "text", "Hello, World"), ("a", "text", "Two"), ("b", "text", "two!"), ("b", "text", "hello world"), ("c", "text", "other"), ("c", "image", "x")], "document_id string, type string, content string")
    h = L.content_hashes(b)
    assert rows(L.duplicates(h, "content_hash", "content_hash")) == [("b", "a", "content_hash", 1.0)]
    d = spark.createDataFrame([("a", "s"), ("b", "s"), ("c", ""), ("d", ""), ("e", None)], "document_id string, checksum string")
    assert rows(L.duplicates(d, "checksum", "checksum"), "document_id", "duplicate_of") == [("b", "a")]


def test_alike_against_brute_force(spark, rows):
    random.seed(5)
    data = [(f"d{i:03d}", random.choice("xyz") + str(random.randint(0, 9)), random.randint(1, 4000), random.randint(1, 3)) for i in range(120)] + [("n1", None, None, None)]
    d = spark.createDataFrame(data, "document_id string, name string, size_bytes long, page_count int")
    want = set()
    for w, n, s, p in data:
        if s is None:
            continue
        near = sorted(x for x, m, t, q in data if x != w and t is not None and (m == n or (t, q) == (s, p) or s * 95 // 100 <= t <= s * 105 // 100))
        want |= {(w, x) for x in near[:10]}
    assert set(rows(L.alike(d, d), "wanted_id", "document_id")) == want


def test_upsert(spark, rows):
    s = "document_id string, source string, external_id string, name string, created_at timestamp_ntz, imported_at timestamp_ntz"
    t = datetime(2024, 1, 1)
    old = spark.createDataFrame([("d1", "s", "e", "old", t, t), ("d2", "s", "", "own", t, t)], s)
    new = spark.createDataFrame([("d3", "s", "e", "new", datetime(2025, 1, 1), datetime(2025, 1, 1)), ("d4", "z", "e", "else", None, None)], s)
    assert rows(L.upserted(old, new), "document_id", "name", "created_at") == [("d2", "own", t), ("d3", "new", t), ("d4", "else", None)]
    assert rows(L.without(old, old.filter("document_id = 'd1'")), "document_id") == [("d2",)]


def test_records(spark, rows):
    from folioquery.schemas import ENTRIES

    e = [("", "first", None, {"k": "v"}), ("x", "second", "t", None)]
    r = spark.createDataFrame([("src", "n", None, {"a": "1"}, "ext", None, e), ("", "n", None, None, None, None, e), ("s", " ", None, None, None, None, e), ("s", "n", None, None, None, None, [])], ENTRIES)
    good, bad = records.checked(r)
    assert rows(bad, "error") == [("missing name",), ("missing source",), ("no entries",)]
    docs, blocks, tags = records.ingested(good)
    assert rows(blocks, "block_id", "content", "section", "sequence") == [("entry_1", "first", "src", 0), ("x", "second", "src", 1)]
    assert rows(tags, "tag_key", "tag_value") == [("a", "1")]
    assert docs.first()["format"] == "customdata" and docs.first()["document_id"] == records.ingested(good)[0].first()["document_id"]


def test_store_stats(spark, store, rows):
    docs, blocks, vectors = store
    terms = spark.createDataFrame([("a",), ("a",), ("",), (None,)], "term string")
    assert dict(rows(L.store_stats(docs, blocks, terms, vectors))) == {"documents": 4, "blocks": 5, "images": 1, "terms": 1, "embedded_blocks": 2}
    assert L.vector_info(vectors.withColumn("created_at", F.lit(None).cast("timestamp"))).first()["vectors"] == 4
