"""Continuous ingest: new files become deltas of the store's tables.

Every stream runs until what is there has been processed (``availableNow``) and
goes on from its checkpoint the next time, so a failed run repeats its batch and
skips none; the sinks replace what a repeated batch had written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def source(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_batch).parquet(folder)


def each_batch(stream: DataFrame, path: str, write: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Start a run over all that is new; the caller may wait for or stop it."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()


def append(stream: DataFrame, path: str) -> DataFrame:
    """Append the stream's rows below ``path``, a folder a batch, so that a batch
    that runs twice is there once. Returns the table."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/data/batch={number}")

    each_batch(stream, path, write).awaitTermination()
    return stream.sparkSession.read.parquet(f"{path}/data").drop("batch")


def last_times(stream: DataFrame, path: str, key: str, time: str) -> DataFrame:
    """(key, last): the newest time per key, from per-batch maxima."""
    part = lambda b: b.groupBy(key).agg(F.max(time).alias("last"))

    def write(batch: DataFrame, number: int) -> None:
        part(batch).write.mode("overwrite").parquet(f"{path}/data/batch={number}")

    each_batch(stream, path, write).awaitTermination()
    return stream.sparkSession.read.parquet(f"{path}/data").groupBy(key).agg(F.max("last").alias("last"))


def counted(stream: DataFrame, time: str, key: str, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Rows per window and key, with late rows up to ``late`` counted."""
    w = F.window(F.col(time), window)
    return stream.withWatermark(time, late).groupBy(w, key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")
