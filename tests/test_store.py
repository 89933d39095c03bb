from datetime import datetime

import pytest
from pyspark.sql import functions as F

from folioquery.errors import StoreError
from folioquery.operators import embedding
from folioquery.operators.store import Store, ordered

D = "document_id string, name string, source string, external_id string, created_at timestamp, updated_at timestamp"
B = "document_id string, block_id string, type string, content string, sequence int"
T = "document_id string, tag_key string, tag_value string"
T0, T1 = datetime(2025, 1, 1), datetime(2025, 2, 1)


@pytest.fixture
def store(spark, tmp_path, crowded):
    s = Store(spark, str(tmp_path / "store"), after=3)
    docs = spark.createDataFrame([("d1", "one", "crm", "e1", T0, T0), ("d2", "two", "kb", None, T0, None), ("d2", "late", "kb", None, T0, T1), (None, "x", "kb", None, T0, T0), ("d3", None, None, "", None, None)], D)
    blocks = spark.createDataFrame([("d1", "b1", "text", "alpha beta alpha", 0), ("d1", "b2", "text", None, 1), ("d2", "b1", "heading", "gamma", 0), ("d2", "b1", "heading", "gamma", 0), ("d9", "b1", "text", "stray", 0)], B)
    tags = spark.createDataFrame([("d1", "k", "v"), ("d1", "k", "v"), ("d2", "k", None), ("d9", "k", "v")], T)
    assert s.save("1", crowded(docs), crowded(blocks), crowded(tags), stemming=False)
    return s


def test_saved(store, rows):
    assert rows(store.table("documents"), "document_id", "name") == [("d1", "one"), ("d2", "late"), ("d3", None)]
    assert rows(store.table("blocks"), "document_id", "block_id") == [("d1", "b1"), ("d1", "b2"), ("d2", "b1")]
    assert rows(store.table("postings").select("term", "document_id", F.array_join("positions", ","))) == [("alpha", "d1", "0,2"), ("beta", "d1", "1"), ("gamma", "d2", "0")]
    assert rows(store.table("stats"), "document_id", "total_terms") == [("d1", 3), ("d2", 1)]
    assert rows(store.table("tags")) == [("d1", "k", "v"), ("d2", "k", None)]
    assert store.table("vectors").count() == store.table("images").count() == 0
    assert rows(store.by_external_id("crm", "e1"), "document_id") == rows(store.document("d1"), "document_id") == [("d1",)]


def test_a_replacement_ends_all_rows_and_keeps_the_first_time(spark, store, rows):
    new = spark.createDataFrame([("d1", "new", "crm", "e1", T1, T1)], D)
    assert store.save("2", new, spark.createDataFrame([("d1", "b7", "text", "delta", 0)], B), stemming=False)
    assert not store.save("2", new.limit(0))  # is there already
    assert rows(store.document("d1"), "name", "created_at") == [("new", T0)]
    assert rows(store.table("blocks"), "document_id", "block_id") == [("d1", "b7"), ("d2", "b1")]
    assert rows(store.table("postings"), "term") == [("delta",), ("gamma",)]
    assert rows(store.table("tags")) == [("d2", "k", None)]
    before = {t: rows(store.table(t).select("document_id")) for t in ("documents", "blocks", "tags", "postings", "stats")}
    store.delete("3", spark.createDataFrame([("d2",)], "document_id string"))
    assert rows(store.table("documents"), "document_id") == [("d1",), ("d3",)] and store.table("tags").count() == 0
    store.delete("4", spark.createDataFrame([], "document_id string"))  # and the folders are merged
    assert store.info()["folders"]["ended"] == 0 and store.info()["folders"]["blocks"] == 1
    assert {t: rows(store.table(t).select("document_id")) for t in before} == {t: [r for r in v if r != ("d2",)] for t, v in before.items()}
    assert store.info()["changes"] == ["1", "2", "3", "4"]


def test_tags_images_and_columns(spark, store, rows):
    store.set_tags("2", spark.createDataFrame([("d1", "a", "b")], T), spark.createDataFrame([("d2",)], "document_id string"))
    assert rows(store.table("tags")) == [("d1", "a", "b")]
    images = spark.createDataFrame([("i1", "d1", "png")], "image_id string, document_id string, format string")
    store.set_images("3", images, images)
    assert rows(store.image("i1"), "document_id", "format") == [("d1", "png")]
    store.set_images("4", images.limit(0), images)
    assert store.table("images").count() == 0
    store.touch("5", images, content_hash=F.lit("h"), updated_at=F.lit(T1))
    assert rows(store.by_hash("h"), "document_id", "updated_at") == [("d1", T1)] and store.table("blocks").count() == 3
    with pytest.raises(StoreError):
        store.touch("6", images, colour=F.lit("h"))


def test_embedding_is_resumed_and_repaired(spark, store, rows):
    class Fails(embedding.HashProvider):
        def embed(self, texts):
            if any(t.startswith("g") for t in texts):
                raise embedding.ContextTooLong("too long")
            return super().embed(texts)

    assert rows(store.pending(2)) == [("d1",), ("d2",)]
    store.embed("a", Fails(dimension=4, max_batch=1))
    assert rows(store.table("vectors"), "document_id", "block_id") == [("d1", "b1")]
    assert rows(store.waiting(), "document_id") == [("d2",)]
    good = embedding.HashProvider(dimension=4)
    store.embed("b", good, spark.createDataFrame([("d1",)], "document_id string"))
    assert rows(store.waiting(), "document_id") == [("d2",)]
    stray = spark.createDataFrame([("gone", "b", 0, [1.0])], "document_id string, block_id string, chunk_idx int, vector array<float>")
    store.save_vectors("c", stray)
    store.repair("d", good)
    assert rows(store.table("vectors"), "document_id", "block_id", "chunk_idx") == [("d1", "b1", 0), ("d2", "b1", 0)] and store.waiting().count() == 0
    store.save("e", store.document("d1").withColumn("updated_at", F.lit(T1)), spark.createDataFrame([("d1", "b1", "text", "other", 0)], B))
    assert rows(store.waiting(), "document_id") == [("d1",)]


def test_a_change_that_failed_is_not_there(spark, store, rows, monkeypatch):
    gone = spark.createDataFrame([("d1",)], "document_id string")

    def fails(*a):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(store.commits, "add", fails)
        with pytest.raises(OSError, match="lost"):
            store.delete("2", gone)
    assert store.document("d1").count() == 1
    assert store.delete("2", gone) and store.document("d1").count() == 0


def test_empty(spark, tmp_path, rows):
    s = Store(spark, str(tmp_path / "none"))
    assert s.info()["changes"] == [] and all(s.table(t).count() == 0 for t in ("documents", "vectors", "stats"))
    s.save("1", spark.createDataFrame([], D), spark.createDataFrame([], B), spark.createDataFrame([], T))
    s.embed("2", embedding.HashProvider())
    assert s.pending().count() == 0
    assert ordered(spark.createDataFrame([], B), 5).count() == 0
    many = spark.createDataFrame([("d", f"b{i}", "text", "x", i) for i in range(9)], B)
    assert rows(ordered(many, 3, 2), "block_id", "position") == [("b2", 3), ("b3", 4), ("b4", 5)]


def test_a_job_embeds_every_piece_once(store, rows, tmp_path):
    """What ends and what is saved come from the same vectors."""
    at = str(tmp_path / "calls")

    class Counts(embedding.HashProvider):
        def embed(self, texts):
            with open(at, "a") as f:
                f.write("".join(f"{t}\n" for t in texts))
            return super().embed(texts)

    assert store.embed("job", Counts(dimension=4))
    assert sorted(open(at).read().splitlines()) == ["alpha beta alpha", "gamma"]
    assert rows(store.table("vectors"), "document_id", "block_id") == [("d1", "b1"), ("d2", "b1")]
    assert not store.embed("job", Counts(dimension=4))
