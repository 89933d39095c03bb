import numpy as np

from folioquery.operators import vectorindex
from folioquery.operators.vectorindex import VectorIndex

V = "vec_id long, vector array<float>"


def made(spark, x, first=0):
    return spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(x)], V)


def nearest(x, q, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    return [set(np.argsort(-(u @ v), kind="stable")[:k].tolist()) for v in q]


def test_recall_after_adding_and_loading(spark, rows, tmp_path, monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((60, 24))
    x = (base[rng.integers(0, 60, 3000)] + 0.6 * rng.standard_normal((3000, 24))).astype(np.float32)
    index = VectorIndex(spark, str(tmp_path / "v"), 24, cell_size=60)
    index.build(made(spark, x[:2000]))
    index.add(made(spark, x[2000:], 2000))
    loaded = VectorIndex(spark, str(tmp_path / "v"), 24)
    q = x[:100]
    found = loaded.search(made(spark, q).withColumnRenamed("vec_id", "query_id"), 10, probes=12)
    got = {}
    for a, b in rows(found, "query_id", "vec_id"):
        got.setdefault(a, set()).add(b)
    with monkeypatch.context() as m:
        m.setattr(vectorindex, "BLOCK", 40)
        split = loaded.search(made(spark, q).withColumnRenamed("vec_id", "query_id"), 10, probes=12)
        assert rows(split) == rows(found)
    recall = np.mean([len(got[i] & w) / 10 for i, w in enumerate(nearest(x, q, 10))])
    print(recall)
    assert recall >= 0.9
    assert max(int(r[0]) for r in rows(found.groupBy("query_id").count().select("count"))) == 10


def test_delete_replace_rebuild(spark, rows, tmp_path):
    x = np.eye(4, dtype=np.float32)
    index = VectorIndex(spark, str(tmp_path / "v"), 4, cell_size=1)
    ask = spark.createDataFrame([(7, [1.0, 0.1, 0.0, 0.0]), (8, None), (9, [0.0] * 4)], "query_id long, vector array<float>")
    assert rows(index.search(ask, 2)) == []
    bad = spark.createDataFrame([(20, None), (21, [0.0] * 4), (22, [1.0]), (None, [1.0] * 4), (23, [float("nan")] * 4)], V)
    index.add(made(spark, x).unionByName(bad))
    assert rows(index.search(ask, 2), "query_id", "vec_id", "rank") == [(7, 0, 1), (7, 1, 2)]
    index.delete(spark.createDataFrame([(0,)], "vec_id long"))
    assert rows(index.search(ask, 1), "vec_id") == [(1,)]
    index.add(spark.createDataFrame([(0, [0.0, 0.0, 0.0, 2.0]), (2, [1.0, 0.0, 0.0, 0.0])], V))  # both anew
    want = [(0,), (1,), (2,), (3,)]
    assert rows(index.vectors(), "vec_id") == want and rows(index.search(ask, 1), "vec_id") == [(2,)]
    index.rebuild()
    assert rows(index.vectors(), "vec_id") == want and rows(index.search(ask, 1), "vec_id") == [(2,)] and index.commits.last()["gone"] == []


def test_empty(spark, rows, tmp_path):
    index = VectorIndex(spark, str(tmp_path / "v"), 4)
    index.build(spark.createDataFrame([], V))
    assert rows(index.vectors()) == [] and rows(index.search(spark.createDataFrame([(1, [1.0] * 4)], "query_id long, vector array<float>"), 3)) == []
