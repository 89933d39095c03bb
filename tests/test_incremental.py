"""Problem 5."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from folioquery.errors import StoreError
from folioquery.operators import incremental as N

D = "doc_id long, source string, external_id string, text string, imported_at timestamp_ntz, updated_at timestamp_ntz"
R = "source string, cutoff_at timestamp_ntz, status string"
T0 = datetime(2025, 1, 1)


def made(seed):
    r = random.Random(seed)
    when = lambda: r.choice([None, T0 + timedelta(days=r.randrange(30))])
    docs = [(i, r.choice(["a", "b", "c", None]), r.choice([None, "", *"xyz"]), r.choice([None, "", "t1", "t2"]), when(), when()) for i in range(120)]
    runs = [(r.choice(["a", "b"]), when(), r.choice(["success", "failed", "running"])) for _ in range(12)] + [("c", T0 + timedelta(days=99), "failed"), (None, T0, "success")]
    return docs, runs


def brute(docs, runs):
    cut = {}
    for s, c, st in runs:
        if st == "success" and s is not None and c:
            cut[s] = max(cut.get(s, c), c)
    groups = {}
    for i, s, e, t, a, b in docs:
        change = max((x for x in (a, b) if x), default=None)
        opened = change is None or s not in cut or change > cut[s]
        groups.setdefault((s, ("d", i) if not e else ("e", e)), []).append((opened, change is None, change or T0, i, t))
    out = set()
    for g in groups.values():
        due, done = [x for x in g if x[0]], [x for x in g if not x[0]]
        if due:
            last = max(due, key=lambda x: x[1:4])
            if not (done and max(done, key=lambda x: x[1:4])[4] == last[4]):
                out.add(last[3])
    return out


def kept(spark, path):
    return N.ChangedPartitions(spark, str(path), N.RECORDS)


def ran(spark, state, docs, runs):
    return state.run(N.deliveries(spark.createDataFrame(docs, D), spark.createDataFrame(runs, R)), N.last_rows)


def ids(rows, state):
    return {x[0] for x in rows(N.due(state.result()), "doc_id")}


def test_against_brute_force(spark, rows, crowded, tmp_path):
    for seed in (1, 2):
        docs, runs = made(seed)
        got = N.next_run(crowded(spark.createDataFrame(docs, D)), crowded(spark.createDataFrame(runs, R)), str(tmp_path / str(seed)), days=4)
        assert {x[0] for x in rows(got, "doc_id")} == brute(docs, runs)


def test_only_changed_partitions_run(spark, rows, tmp_path):
    docs, runs = made(3)
    state = kept(spark, tmp_path / "s")
    assert ran(spark, state, docs, runs) > 5 and ran(spark, state, docs, runs) == ran(spark, state, docs[::-1], runs) == 0
    more = [*docs, (500, "a", "x", "text", T0 + timedelta(days=200), None)]
    assert ran(spark, state, more, runs) == 1
    assert ids(rows, state) == brute(more, runs)
    later = [*runs, ("a", T0 + timedelta(days=300), "success")]
    assert ran(spark, state, more, later)
    assert ids(rows, state) == brute(more, later)
    fewer = more[:40]
    ran(spark, state, fewer, later)
    assert ids(rows, state) == brute(fewer, later)


def test_a_late_batch_touches_few_partitions(spark, rows, tmp_path):
    """Of 24 sources over two years, a batch of all sources within a week."""
    r = random.Random(5)
    docs = [(i, f"s{r.randrange(24)}", f"e{r.randrange(3000)}", f"t{i % 7}", T0 + timedelta(days=r.randrange(720)), None) for i in range(4000)]
    runs = [(f"s{k}", T0 + timedelta(days=600), "success") for k in range(24)]
    batch = [(10_000 + i, f"s{i % 24}", f"e{r.randrange(3000)}", "new", T0 + timedelta(days=700 + r.randrange(7)), None) for i in range(240)]
    state = kept(spark, tmp_path / "s")
    every = ran(spark, state, docs, runs)
    assert ran(spark, state, docs + batch, runs) <= every / 10
    assert ids(rows, state) == brute(docs + batch, runs)
    moved = runs[:-1] + [("s23", T0 + timedelta(days=720), "success")]
    assert ran(spark, state, docs + batch, moved) <= every / 100  # the periods that one cutoff passes over
    assert ids(rows, state) == brute(docs + batch, moved)


def test_a_failure_at_each_write_skips_nothing(spark, rows, tmp_path, monkeypatch):
    docs, runs = made(4)
    first, more = docs[:80], docs
    for step in ("prints", "changed", "compute", "result", "commit"):
        state = kept(spark, tmp_path / step)
        ran(spark, state, first, runs)

        def fails(*a, **kw):
            raise OSError("lost")

        with monkeypatch.context() as m:
            if step == "prints":
                m.setattr(state, "fingerprints", fails)
            elif step == "changed":
                m.setattr(state, "changed", fails)
            elif step in ("compute", "result"):

                def broken(df, step=step):
                    out = N.last_rows(df)
                    if step == "compute":
                        raise OSError("lost")
                    return out.withColumn("record", F.when(F.col("record") == "e:x", F.raise_error(F.lit("lost"))).otherwise(F.col("record")))

            else:
                m.setattr(state.commits, "add", fails)
            frame = N.deliveries(spark.createDataFrame(more, D), spark.createDataFrame(runs, R))
            compute = broken if step in ("compute", "result") else N.last_rows
            with pytest.raises(Exception, match="lost"):
                state.run(frame, compute)
        assert ran(spark, state, more, runs) > 0
        assert ids(rows, state) == brute(more, runs)


def test_rows_that_arrive_during_a_run(spark, rows, tmp_path):
    """They come between the comparison and the result; the next run repeats
    their partition."""
    docs, runs = made(6)
    state, at = kept(spark, tmp_path / "s"), str(tmp_path / "documents")
    spark.createDataFrame(docs[:60], D).write.parquet(at)
    cut = spark.createDataFrame(runs, R)

    def grows(df):
        spark.createDataFrame(docs[60:], D).write.mode("append").parquet(at)
        wider = N.deliveries(spark.read.parquet(at), cut)
        return N.last_rows(wider.join(df.select("part").distinct(), "part", "left_semi"))

    state.run(N.deliveries(spark.read.parquet(at), cut), grows)
    assert state.run(N.deliveries(spark.read.parquet(at), cut), N.last_rows) > 0
    assert ids(rows, state) == brute(docs, runs)


def test_two_runs_at_once(spark, tmp_path):
    docs, runs = made(7)
    a, b = kept(spark, tmp_path / "s"), kept(spark, tmp_path / "s")
    before = a.commits.last()
    ran(spark, a, docs, runs)
    with pytest.raises(StoreError):
        b.commits.add({"prints": "other"}, before)


def test_empty(spark, tmp_path):
    none = spark.createDataFrame([], D)
    state = kept(spark, tmp_path / "e")
    assert state.run(N.deliveries(none, spark.createDataFrame([], R)), N.last_rows) == 0
    assert N.next_run(none, spark.createDataFrame([], R), str(tmp_path / "n")).count() == 0
