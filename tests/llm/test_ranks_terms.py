"""Problems 1, 2 and 6."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from folioquery.llm import distinctive, rankfusion, termstats

HIT = "query_id long, branch string, document_id string, block_id string, score double"
QUERY = "query_id long, keyword_weight double, vector_weight double, asked_at int"
NAN, INF = float("nan"), float("inf")


def hits(spark, data):
    return spark.createDataFrame(data, HIT)


@pytest.fixture
def blocks(spark):
    return spark.createDataFrame([(f"d{i}", "b") for i in range(30)], "document_id string, block_id string")


def test_fusion_edges(spark, rows, blocks, crowded):
    data = [
        (1, "keyword", "d1", "b", 900.0), (1, "keyword", "d2", "b", 900.0), (1, "keyword", "d3", "b", 1.0), (1, "keyword", "d3", "b", 950.0),
        (1, "vector", "d3", "b", 0.9), (1, "vector", "d2", "b", 0.1), (1, "vector", "d9", "b", NAN), (1, "vector", "d9", "b", INF), (1, "vector", "d9", "b", None),
        (1, "vector", "gone", "b", 5.0), (1, "vector", None, "b", 5.0), (1, "other", "d4", "b", 5.0), (None, "vector", "d1", "b", 1.0), (2, "vector", "d1", "b", 1.0),
    ]
    q = spark.createDataFrame([(1, 0.75, 0.25, 1), (1, 0.75, 0.25, 1), (3, None, None, 1)], QUERY)
    got = {(r["query_id"], r["document_id"]): r for r in rankfusion.ranking(crowded(hits(spark, data)), crowded(q), crowded(blocks)).collect()}
    assert (got[1, "d3"]["keyword_rank"], got[1, "d3"]["vector_rank"]) == (1, 1)
    assert got[1, "d1"]["keyword_rank"] == got[1, "d2"]["keyword_rank"] == 2  # a tie
    assert got[1, "d1"]["vector_rank"] is None
    assert got[1, "d1"]["rrf"] == pytest.approx(0.75 / 62 + 0.25 / 63)
    assert got[2, "d1"]["rrf"] == pytest.approx(0.5 / 61 + 0.5 / 61)  # no weights, no keyword list
    assert (1, "d9") not in got and (1, "gone") not in got and (1, "d4") not in got
    assert got[1, "d3"]["position"] == 1
    assert rows(rankfusion.found(hits(spark, data), q, blocks)) == [(1, "d2", "b"), (1, "d3", "b")]


def test_weights(spark):
    q = spark.createDataFrame([(1, NAN, 0.3, 1), (2, 2.0, -1.0, 1), (3, 0.0, 0.0, 1), (4, 0.2, 0.2, 1)], QUERY)
    got = {r[0]: (round(r[1], 6), round(r[2], 6)) for r in rankfusion.weights(q).collect()}
    assert got == {1: (0.625, 0.375), 2: (0.5, 0.5), 3: (0.5, 0.5), 4: (0.5, 0.5)}


def test_ranks_of_a_hot_group(spark):
    random.seed(2)
    data = [(0, random.choice([0.1, 0.5, random.random()])) for _ in range(3000)] + [(i % 50, random.random()) for i in range(500)]
    df = spark.createDataFrame(data, "g long, s double").repartition(7)
    by = defaultdict(list)
    for g, s in data:
        by[g].append(s)
    for r in rankfusion.group_ranks(df, ["g"], "s").collect():
        assert r["rank"] == 1 + sum(x > r["s"] for x in by[r["g"]]) and r["size"] == len(by[r["g"]])


def test_fusion_is_symmetric(spark, rows, blocks):
    random.seed(4)
    data = [(q, b, f"d{random.randrange(30)}", "b", random.random() * (1000 if b == "keyword" else 1)) for q in range(5) for b in ("keyword", "vector") for _ in range(20)]
    swap = [(q, "vector" if b == "keyword" else "keyword", d, x, s) for q, b, d, x, s in data]
    q = spark.createDataFrame([(i, 0.3, 0.7, 1) for i in range(5)], QUERY)
    other = q.select("query_id", F.col("vector_weight").alias("keyword_weight"), F.col("keyword_weight").alias("vector_weight"), "asked_at")
    a = rows(rankfusion.fused(hits(spark, data), q, blocks).select("query_id", "document_id", F.round("rrf", 12)))
    assert a == rows(rankfusion.fused(hits(spark, swap), other, blocks).select("query_id", "document_id", F.round("rrf", 12)))
    none = hits(spark, [])
    assert rows(rankfusion.ranking(none, q.limit(0), blocks.limit(0))) == []


POST = "term string, document_id string, block_id string, positions array<int>, term_frequency double"


def test_counts(spark, rows, crowded, tmp_path):
    data = [("a", "d1", "1", [0, 4], 0.5), ("a", "d1", "1", [0, 4], 0.5), ("a", "d1", "2", [1], None), ("a", "d2", "1", None, None), ("b", "d1", "1", [2], 0.1), ("b", None, "1", [2], 0.1), ("b", "d1", None, [3], 0.1), ("", "d9", "1", [0], 1.0), (None, "d9", "1", [0], 1.0)]
    t = termstats.TermCounts(spark, str(tmp_path / "x"))
    assert rows(t.terms()) == [] and t.documents().first()[0] == 0
    t.apply("1", added=crowded(spark.createDataFrame(data, POST)))
    assert rows(termstats.verdicts(t)) == [("a", 3, 2, 3, "common"), ("b", 3, 1, 1, "rare")]


def test_deltas_equal_a_recount(spark, rows, tmp_path):
    """Whole documents come, change and go; every change set is applied twice and
    the log is merged in between."""
    random.seed(7)
    make = lambda d: [(t, d, f"b{b}", list(range(random.randrange(4))), 0.1) for t in "abcdefgh" for b in range(3) if random.random() < 0.3]
    held = {}
    inc = termstats.TermCounts(spark, str(tmp_path / "inc"), buckets=3, log=2)
    flat = lambda docs: spark.createDataFrame([x for d in docs for x in d], POST)
    for turn in range(4):
        before = dict(held)
        for d in random.sample(range(9), 5):
            held[f"d{d}"] = make(f"d{d}")
        for d in random.sample(sorted(held), 2):
            del held[d]
        added, deleted = termstats.changed_documents(flat(before.values()), flat(held.values()))
        touched = {d for d in {*before, *held} if before.get(d) != held.get(d)}
        assert {r[0] for r in added.select("document_id").collect()} == {d for d in touched if held.get(d)}
        assert inc.apply(f"{turn}", added, deleted) and not inc.apply(f"{turn}", added, deleted)
        full = termstats.TermCounts(spark, str(tmp_path / f"full{turn}"))
        full.apply("all", added=flat(held.values()))
        assert rows(termstats.verdicts(inc)) == rows(termstats.verdicts(full))
        assert inc.documents().first()[0] == sum(1 for x in held.values() if x)
    inc.apply("x", deleted=flat(held.values()))
    assert rows(inc.terms()) == []
    inc.apply("y", added=spark.createDataFrame([], POST))
    inc.apply("z")
    assert rows(inc.terms()) == [] and inc.documents().first()[0] == 0


def test_a_change_set_that_failed_counts_once(spark, rows, tmp_path, monkeypatch):
    data = spark.createDataFrame([("a", "d1", "1", [0], 0.5), ("a", "d2", "1", [0], 0.5)], POST)
    t = termstats.TermCounts(spark, str(tmp_path / "x"))
    t.apply("1", added=data)

    def fails(*a):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(t.commits, "add", fails)  # its folder is written, its marker is not
        with pytest.raises(OSError, match="lost"):
            t.apply("2", deleted=data.limit(1))
        with pytest.raises(OSError, match="lost"):
            t.compact()
    assert rows(t.terms()) == [("a", 2, 2, 2)]
    t.apply("2", deleted=data.filter("document_id = 'd1'"))
    t.compact()
    assert rows(t.terms()) == [("a", 1, 1, 1)] and not t.apply("2", deleted=data)


def test_distinctive(spark, rows, crowded):
    random.seed(8)
    data = [(random.choice("abcdefghij") * 2, f"d{random.randrange(6)}", f"b{random.randrange(4)}", list(range(random.randrange(1, 4))), 0.1) for _ in range(80)]
    data = list({(x[0], x[1], x[2]): x for x in data}.values())
    dirty = [*data, data[0], ("", "d1", "b", [1], 1.0), (None, "d1", "b", [1], 1.0), ("zz", None, "b", [1], 1.0), ("yy", "d1", "b", None, None)]
    stats = spark.createDataFrame([("d0", 40), ("d0", 40), ("d1", 0), ("d2", None), (None, 5)], "document_id string, total_terms long")
    got = {(r["document_id"], r["term"]): r["score"] for r in distinctive.scored(crowded(spark.createDataFrame(dirty, POST)), crowded(stats), mu=50.0).collect()}
    tf, df, cf, own = Counter(), defaultdict(set), Counter(), Counter()
    for t, d, _, p, _ in data:
        tf[d, t] += len(p)
        df[t].add(d)
        cf[t] += len(p)
        own[d] += len(p)
    n = sum(cf.values())
    want = {}
    for (d, t), k in tf.items():
        if len(df[t]) >= 2:
            q = cf[t] / n
            p = (k + 50 * q) / ((40 if d == "d0" else own[d]) + 50)
            want[d, t] = p * math.log(p / q)
    assert got == pytest.approx(want)
    assert rows(distinctive.found(spark.createDataFrame([], POST), stats)) == []


def test_distinctive_found(spark, rows):
    data = [("x", f"d{i}", "b", [0, 1, 2], 0.1) for i in range(2)] + [("y", f"d{i}", "b", [0, 1, 2], 0.1) for i in range(6)] + [("z", "d0", "b", [5, 6, 7], 0.1)] + [("w", f"d{i}", "b", [5, 6], 0.1) for i in range(3)]
    stats = spark.createDataFrame([("d0", 150), ("d1", 151)], "document_id string, total_terms long")
    assert rows(distinctive.found(spark.createDataFrame(data, POST), stats)) == [("d0", "x")]
