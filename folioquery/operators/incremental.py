"""Problem 5: processing only new or changed records.

``ChangedPartitions`` is the general operator. Rows are split into partitions, and
of each a fingerprint is kept: the count and the sum of its rows' hashes, so that
order and arrival do not matter. A run recomputes the partitions whose fingerprint
changed, and replaces each by dynamic partition overwrite.

What a run compares is written down first, and that very table is committed after
the result. Rows that arrive in between can only be in the result and not in the
fingerprint, so the next run finds their partition changed again; none is skipped,
and as a partition is replaced whole, none counts twice. A run that fails at any
point has committed nothing and is simply repeated.

``next_run`` is the operator for document deliveries. A partition is a source and
a period of import. Of each record a partition keeps the last row that is open
and the last that is not, and a late batch touches the periods that it falls in.
Whether a row is open is part of its hash, not the cutoff itself, so that a cutoff
which moves on only changes the periods it passes over.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquery.session import Commits, delete, path_exists

DAYS = 30
PRINTS = "part long, n long, total string"


class ChangedPartitions:
    """Results under ``path`` in a folder that all executors share, as rows of
    ``schema`` (without the partition column ``part``, a long)."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.commits = Commits(spark, path)

    def fingerprints(self, rows: DataFrame) -> DataFrame:
        """(part, n, total) of rows. All columns but part count. Maps and
        intervals must be left out by the caller."""
        cols = sorted(c for c in rows.columns if c != "part")
        null = F.concat_ws("", *[F.col(c).isNull().cast("string") for c in cols])  # a null is not skipped
        row = F.xxhash64(*cols, null).cast("decimal(20,0)")
        return rows.groupBy("part").agg(F.count("*").alias("n"), F.sum(row).cast("string").alias("total"))

    def changed(self, now: DataFrame, state: dict) -> DataFrame:
        """(part) of those that differ from the last run, vanished ones included."""
        if not state:
            return now.select("part")
        old = self.spark.read.schema(PRINTS).parquet(f"{self.path}/{state['prints']}").withColumnsRenamed({"n": "n0", "total": "t0"})
        both = now.join(old, "part", "full_outer")
        return both.filter(~(F.col("n").eqNullSafe(F.col("n0")) & F.col("total").eqNullSafe(F.col("t0")))).select("part")

    def run(self, rows: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> int:
        """Recompute what changed. ``compute`` keeps the column part and may only
        combine rows of one partition. Returns how many were recomputed."""
        state = self.commits.last()
        prints = f"prints-{uuid.uuid4().hex}"
        self.fingerprints(rows).write.parquet(f"{self.path}/{prints}")
        now = self.spark.read.schema(PRINTS).parquet(f"{self.path}/{prints}")
        at = f"{self.path}/changed-{uuid.uuid4().hex}"
        self.changed(now, state).write.parquet(at)
        changed = self.spark.read.schema("part long").parquet(at)
        n = changed.count()
        if n:
            done = compute(rows.join(changed, "part", "left_semi"))
            # A partition without results must still be replaced: it holds one row of nulls.
            blank = changed.withColumn("blank", F.lit(True))
            out = done.withColumn("blank", F.lit(False)).unionByName(blank, allowMissingColumns=True)
            out = out.repartition("part")  # one file a partition
            out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{self.path}/result")
        self.commits.add({"prints": prints, "rows": now.agg(F.sum("n")).first()[0] or 0}, state)
        delete(self.spark, at)
        if state:
            delete(self.spark, f"{self.path}/{state['prints']}")
        return n

    def result(self) -> DataFrame:
        """What the last run left; without any result yet, no rows."""
        schema = f"{self.schema}, blank boolean, part long"
        if not path_exists(self.spark, f"{self.path}/result"):
            return self.spark.createDataFrame([], schema).drop("blank", "part")
        found = self.spark.read.schema(schema).parquet(f"{self.path}/result")
        # small files are read together, by as many tasks as there are cores or quarter millions of rows
        tasks = max(self.spark.sparkContext.defaultParallelism, self.commits.last().get("rows", 0) // 250_000)
        return found.coalesce(tasks).filter(~F.col("blank")).drop("blank", "part")


ROW = "struct<none: boolean, changed: timestamp_ntz, doc_id: long, digest: string>"
RECORDS = f"source string, record string, due {ROW}, done {ROW}"


def cutoffs(runs: DataFrame) -> DataFrame:
    """(source, cutoff): the greatest cutoff of a source's successful runs."""
    return runs.filter("status = 'success' and cutoff_at is not null").groupBy("source").agg(F.max("cutoff_at").alias("cutoff"))


def deliveries(documents: DataFrame, runs: DataFrame, days: int = DAYS) -> DataFrame:
    """(part, source, record, doc_id, changed, open, text). A row is open when its
    change time is after the cutoff of its source, or it has none, or the source
    has no cutoff. Null sources form one source without a cutoff."""
    own = F.col("external_id").isNull() | (F.col("external_id") == "")
    record = F.when(own, F.concat(F.lit("d:"), F.col("doc_id"))).otherwise(F.concat(F.lit("e:"), F.col("external_id")))
    time = lambda c: F.col(c).cast("timestamp_ntz")
    period = F.floor(F.datediff(F.coalesce("imported_at", "updated_at"), F.lit("1970-01-01")) / days)
    d = documents.select("source", record.alias("record"), "doc_id", F.greatest(time("imported_at"), time("updated_at")).alias("changed"), period.alias("period"), "text")
    cut = cutoffs(runs).select(F.col("source").alias("run_source"), F.col("cutoff").cast("timestamp_ntz").alias("cutoff"))
    d = d.join(cut, F.col("source") == F.col("run_source"), "left")
    is_open = F.col("changed").isNull() | F.col("cutoff").isNull() | (F.col("changed") > F.col("cutoff"))
    null = F.concat_ws("", F.col("source").isNull().cast("string"), F.col("period").isNull().cast("string"))
    return d.select(F.xxhash64("source", "period", null).alias("part"), "source", "record", "doc_id", "changed", is_open.alias("open"), "text")


def last_rows(rows: DataFrame) -> DataFrame:
    """(part, source, record, due, done): of the record's rows in the partition
    the last open one and the last other one (a missing time is last, then the
    larger time, then the larger doc_id), with a digest of the text. A record of
    any size is reduced by two partial maxima, never gathered."""
    row = F.struct(F.col("changed").isNull().alias("none"), "changed", "doc_id", F.sha2("text", 256).alias("digest"))
    return rows.groupBy("part", "source", "record").agg(F.max(F.when(F.col("open"), row)).alias("due"), F.max(F.when(~F.col("open"), row)).alias("done"))


def due(records: DataFrame) -> DataFrame:
    """(source, record, doc_id): of each record the last open row, unless the last
    row that is not open has exactly the same text (two null texts are the same).
    Records without an open row do not meet the others' rows."""
    null = lambda c: F.struct(F.col(c).isNull(), F.coalesce(c, F.lit("")))  # noqa: E731 a null source joins
    best: Callable[[str], Column] = lambda c: F.max(c).alias(c)
    wait = records.filter("due is not null").groupBy("source", "record").agg(best("due"))
    seen = records.filter("done is not null").select(null("source").alias("s"), F.col("record").alias("r"), "done")
    met = seen.join(wait.select(null("source").alias("s"), F.col("record").alias("r")), ["s", "r"], "left_semi").groupBy("s", "r").agg(best("done"))
    both = wait.withColumns({"s": null("source"), "r": F.col("record")}).join(met, ["s", "r"], "left")
    same = F.col("done").isNotNull() & F.col("due.digest").eqNullSafe(F.col("done.digest"))
    return both.filter(~same).select("source", "record", F.col("due.doc_id").alias("doc_id"))


def next_run(documents: DataFrame, runs: DataFrame, path: str, days: int = DAYS) -> DataFrame:
    """(source, record, doc_id) due, kept under ``path`` between calls."""
    state = ChangedPartitions(documents.sparkSession, path, RECORDS)
    state.run(deliveries(documents, runs, days), last_rows)
    return due(state.result())
