"""Problem 2: how often every distinct term occurs, and in how many records.

Method: incremental signed deltas. The records are documents. A change set holds
whole documents: ``added``, the postings of new and changed ones as they are now,
and ``deleted``, the postings of changed and vanished ones as they were. It alone
is aggregated, into signed changes of every term's occurrences, documents and
blocks and of the number of documents, and appended to a log that is split into
buckets by the term's hash. The counts are the base's plus the log's; when the
log is long it is merged into a new base.

A change set has an id. One that was applied is not applied again, so a run may
be repeated after any failure: the change set's folder counts only once a marker
names it, and it has all numbers in one table. ``changed_documents`` makes the
change set of two states of the postings.

Terms are counted as stored. Null and empty terms count nowhere. Repeated rows
of one (term, document_id, block_id) count once, with the largest number of
positions; null positions are no occurrence. A null document_id or block_id is
no record and counts in neither number. The same posting added and deleted
cancels out. Empty change sets change nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquery.session import Commits, delete

BUCKETS = 16
LOG = 8  # change sets in the log before they are merged
NUMBERS = ("occurrences", "documents", "blocks", "postings")
SCHEMA = "term string, occurrences long, documents long, blocks long, postings long, bucket int, delta string"


def usable(terms: DataFrame, *more: str) -> DataFrame:
    """(term, document_id, block_id, more, occ) of the rows that count, spread by
    term and document: that one shuffle serves all counting within a document."""
    occ = F.when(F.col("positions").isNull(), F.lit(0)).otherwise(F.size("positions"))
    t = terms.filter("term is not null and term <> ''").select("term", "document_id", "block_id", *more, occ.alias("occ"))
    return t.repartition("term", "document_id").groupBy("term", "document_id", "block_id", *more).agg(F.max("occ").alias("occ"))


def _signed(added: DataFrame | None, deleted: DataFrame | None) -> DataFrame:
    """The postings of both sides with their ``sign``."""
    cols = ["term", "document_id", "block_id", "positions"]
    sides = [df.select(*cols, F.lit(s).alias("sign")) for df, s in ((added, 1), (deleted, -1)) if df is not None]
    return sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])


def _summed(rows: DataFrame, *keys: str) -> DataFrame:
    """Changes added up; what cancels out is dropped."""
    g = rows.groupBy(*keys, "term").agg(*[F.sum(c).alias(c) for c in NUMBERS])
    return g.filter(" or ".join(f"{c} <> 0" for c in NUMBERS))


def deltas(added: DataFrame | None, deleted: DataFrame | None) -> DataFrame:
    """(term, occurrences, documents, blocks, postings), signed. The row without
    a term has the change of the number of documents."""
    rows = _signed(added, deleted)
    block = F.when(F.col("document_id").isNotNull() & F.col("block_id").isNotNull(), F.col("sign")).otherwise(0)
    pairs = usable(rows, "sign").groupBy("term", "document_id", "sign").agg(F.sum(F.col("sign") * F.col("occ")).alias("occ"), F.sum(block).alias("blocks"), F.sum("sign").alias("postings"))
    doc = F.when(F.col("document_id").isNotNull(), F.col("sign")).otherwise(0)
    per = pairs.groupBy("term").agg(F.sum("occ").alias("occurrences"), F.sum(doc).alias("documents"), F.sum("blocks").alias("blocks"), F.sum("postings").alias("postings"))
    docs = rows.filter("term is not null and term <> '' and document_id is not null").select("document_id", "sign").distinct().agg(F.coalesce(F.sum("sign"), F.lit(0)).alias("documents"))
    none = [F.lit(0).cast("long").alias(c) for c in NUMBERS if c != "documents"]
    every = per.unionByName(docs.select(F.lit(None).cast("string").alias("term"), "documents", *none))
    return every.filter(" or ".join(f"{c} <> 0" for c in NUMBERS))


def changed_documents(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(added, deleted) of two states of the postings: all rows of the documents
    whose number of rows or sum of row hashes differs. Postings without a document
    belong to one nameless record."""

    def prints(df: DataFrame, n: str, total: str) -> DataFrame:
        row = F.xxhash64(F.coalesce("term", F.lit("")), F.coalesce("block_id", F.lit("")), F.coalesce(F.size("positions"), F.lit(-1)))
        return df.groupBy("document_id").agg(F.count("*").alias(n), F.sum(row.cast("decimal(20,0)")).alias(total))

    a, b = prints(old, "n0", "t0"), prints(new, "n1", "t1").withColumnRenamed("document_id", "d1")
    both = a.join(b, F.col("document_id").eqNullSafe(F.col("d1")), "full_outer")
    differ = both.filter(~(F.col("n0").eqNullSafe(F.col("n1")) & F.col("t0").eqNullSafe(F.col("t1")))).select(F.coalesce("document_id", "d1").alias("d"))
    rows = lambda df: df.join(differ, df["document_id"].eqNullSafe(differ["d"]), "left_semi")
    return rows(new), rows(old)


class TermCounts:
    """The persistent counts under a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, log: int = LOG):
        self.spark, self.path, self.buckets, self.log = spark, path.rstrip("/"), buckets, log
        self.commits = Commits(spark, path)

    def _write(self, rows: DataFrame) -> str:
        name = f"deltas/delta={uuid.uuid4().hex}"
        bucket = F.pmod(F.hash("term"), F.lit(self.buckets)).cast("int")
        rows.select("term", *NUMBERS, bucket.alias("bucket")).write.partitionBy("bucket").parquet(f"{self.path}/{name}")
        return name

    def _rows(self, state: dict) -> DataFrame:
        names = ([state["base"]] if state.get("base") else []) + state.get("log", [])
        if not names:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).option("basePath", f"{self.path}/deltas").parquet(*[f"{self.path}/{n}" for n in names])

    def apply(self, change: str, added: DataFrame | None = None, deleted: DataFrame | None = None) -> bool:
        """Merge one change set under its id. False: it was there already."""
        state = self.commits.last()
        if change in state.get("applied", []):
            return False
        names = [] if added is None and deleted is None else [self._write(deltas(added, deleted))]
        state = self.commits.add({"base": state.get("base"), "log": state.get("log", []) + names, "applied": [*state.get("applied", []), change]}, state)
        if len(state["log"]) > self.log:
            self.compact()
        return True

    def compact(self) -> None:
        """Merge the log into a new base. The folders before are deleted after
        the marker."""
        state = self.commits.last()
        if not state.get("log"):
            return
        base = self._write(_summed(self._rows(state)))
        self.commits.add({"base": base, "log": [], "applied": state["applied"]}, state)
        for name in [state.get("base"), *state["log"]]:
            if name:
                delete(self.spark, f"{self.path}/{name}")

    def terms(self) -> DataFrame:
        """(term, occurrences, documents, blocks) of the terms with any posting"""
        return _summed(self._rows(self.commits.last())).filter("term is not null and postings > 0").select("term", "occurrences", "documents", "blocks")

    def documents(self) -> DataFrame:
        """One row: n, the number of documents with a counted term."""
        return self._rows(self.commits.last()).filter("term is null").agg(F.coalesce(F.sum("documents"), F.lit(0)).alias("n"))


def verdicts(counts: TermCounts, common: float = 0.5) -> DataFrame:
    """terms() with ``verdict``: 'rare' in exactly one document, 'common' in more
    than the share ``common`` of the documents, else null. Were both true, as of
    a collection of one document, it is 'common'."""
    n = F.broadcast(counts.documents())  # one row
    v = F.when(F.col("documents") > F.col("n") * common, "common").when(F.col("documents") == 1, "rare")
    return counts.terms().crossJoin(n).select("term", "occurrences", "documents", "blocks", v.alias("verdict"))
