from datetime import datetime

from folioquery.streaming import ingest


def test_streams_go_on(spark, rows, tmp_path):
    s = "k string, t timestamp"
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("a", datetime(2024, 1, 1)), ("b", None)], s).write.parquet(src)
    stream = lambda: ingest.source(spark, src, s)
    assert dict(rows(ingest.last_times(stream(), out, "k", "t"))) == {"a": datetime(2024, 1, 1), "b": None}
    spark.createDataFrame([("a", datetime(2024, 2, 1)), ("c", datetime(2023, 1, 1))], s).write.mode("append").parquet(src)
    assert dict(rows(ingest.last_times(stream(), out, "k", "t"))) == {"a": datetime(2024, 2, 1), "b": None, "c": datetime(2023, 1, 1)}
    assert ingest.append(stream(), str(tmp_path / "copy")).count() == 4
    assert ingest.append(stream(), str(tmp_path / "copy")).count() == 4


def test_windows(spark, rows, tmp_path):
    s = "k string, t timestamp"
    src = str(tmp_path / "in")
    spark.createDataFrame([("a", datetime(2024, 1, 1, 0, m)) for m in (1, 2, 59)] + [("a", datetime(2024, 1, 1, 3))], s).write.parquet(src)
    q = ingest.counted(ingest.source(spark, src, s), "t", "k").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("windows"), "n") == [(1,), (3,)]
