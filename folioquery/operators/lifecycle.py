"""State of embeddings, duplicates, health, upserts and deletions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioquery.functions import text as T
from folioquery.functions import vectors as V
from folioquery.functions.tokens import estimate
from folioquery.schemas import EMBEDDABLE


def embeddable() -> Column:
    return F.col("type").isin(*EMBEDDABLE) & (F.trim(F.coalesce("content", F.lit(""))) != "")


def keys(vectors: DataFrame) -> DataFrame:
    """Distinct (document_id, block_id) with a vector, whatever its chunks."""
    return vectors.filter("vector is not null and document_id is not null").select("document_id", "block_id").distinct()


def unembedded(blocks: DataFrame, vectors: DataFrame) -> DataFrame:
    return blocks.filter(embeddable()).join(keys(vectors), ["document_id", "block_id"], "left_anti")


def status(blocks: DataFrame, vectors: DataFrame) -> DataFrame:
    """(document_id, embeddable, embedded, complete, progress)"""
    b = blocks.join(keys(vectors).withColumn("has", F.lit(1)), ["document_id", "block_id"], "left")
    g = b.groupBy("document_id").agg(F.count(F.when(embeddable(), 1)).alias("embeddable"), F.count(F.when(embeddable(), F.col("has"))).alias("embedded"))
    done = F.col("embedded") >= F.col("embeddable")
    return g.withColumn("complete", done).withColumn("progress", F.when(F.col("embeddable") == 0, 100.0).otherwise(100.0 * F.col("embedded") / F.col("embeddable")))


def pending(documents: DataFrame, vectors: DataFrame) -> DataFrame:
    return documents.join(keys(vectors).select("document_id"), "document_id", "left_anti")


def incomplete(blocks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Documents with some but not all of their vectors."""
    return status(blocks, vectors).filter("embedded > 0 and not complete").select("document_id", "embeddable", "embedded")


def missing(blocks: DataFrame, vectors: DataFrame) -> DataFrame:
    return status(blocks, vectors).filter("embedded < embeddable").select("document_id", "embeddable", "embedded")


def stale(blocks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Embeddable blocks without a vector of their present text's hash."""
    have = vectors.filter("vector is not null").select("document_id", "block_id", "text_hash").distinct()
    b = blocks.filter(embeddable()).withColumn("text_hash", V.text_hash(F.col("content")))
    return b.join(have, ["document_id", "block_id", "text_hash"], "left_anti").select("document_id", "block_id", "text_hash")


def by_source(documents: DataFrame, blocks: DataFrame, vectors: DataFrame) -> DataFrame:
    """(source, documents, blocks, embedded, missing, with_issues)"""
    s = documents.select("document_id", "source").join(status(blocks, vectors), "document_id", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    g = s.groupBy("source").agg(F.count("*").alias("documents"), F.sum(z("embeddable")).alias("blocks"), F.sum(z("embedded")).alias("embedded"), F.count(F.when(z("embedded") < z("embeddable"), 1)).alias("with_issues"))
    return g.withColumn("missing", F.col("blocks") - F.col("embedded"))


def vector_info(vectors: DataFrame) -> DataFrame:
    return vectors.agg(F.count("*").alias("vectors"), F.coalesce(F.max("model"), F.lit("")).alias("model"), F.coalesce(F.max("dimension"), F.lit(0)).alias("dimension"), F.max("created_at").alias("last_created"))


def store_stats(documents: DataFrame, blocks: DataFrame, terms: DataFrame, vectors: DataFrame) -> DataFrame:
    """(what, n): counts, one scan each."""
    n = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    out = n(documents, "documents").unionByName(n(blocks, "blocks")).unionByName(n(blocks.filter("type = 'image'"), "images"))
    words = terms.filter("term is not null and term <> ''").select("term").distinct()
    return out.unionByName(n(words, "terms")).unionByName(n(keys(vectors), "embedded_blocks"))


def health(documents: DataFrame, blocks: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row. Healthy: no vector without its block and no document half done;
    documents still waiting are allowed."""
    k = keys(vectors)
    orphans = k.join(blocks.select("document_id", "block_id"), ["document_id", "block_id"], "left_anti").agg(F.count("*").alias("orphans"))
    part = incomplete(blocks, vectors).agg(F.count("*").alias("incomplete"))
    wait = pending(documents, vectors).agg(F.count("*").alias("pending"))
    row = k.agg(F.count("*").alias("embedded_blocks")).crossJoin(orphans).crossJoin(part).crossJoin(wait)  # one row each
    return row.withColumn("healthy", (F.col("orphans") == 0) & (F.col("incomplete") == 0))


def last_import(documents: DataFrame) -> DataFrame:
    return documents.groupBy("source").agg(F.max("imported_at").alias("last_imported"))


def content_hashes(blocks: DataFrame) -> DataFrame:
    """(document_id, content_hash): of the sorted normalized contents, so that
    the order of blocks does not matter. A document's blocks meet in one row."""
    b = blocks.filter(F.coalesce("type", F.lit("")) != "image").select("document_id", T.normalized(F.col("content")).alias("x")).filter("x <> ''")
    return b.groupBy("document_id").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("x")), "\n"), 256).alias("content_hash"))


def duplicates(documents: DataFrame, column: str, method: str) -> DataFrame:
    """(document_id, duplicate_of, method, similarity): the first document with
    the same value. A value of any frequency is reduced to its first document."""
    d = documents.filter(F.col(column).isNotNull() & (F.col(column) != ""))
    first = d.groupBy(column).agg(F.min("document_id").alias("duplicate_of"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return d.join(first, column).filter("document_id <> duplicate_of").select("document_id", "duplicate_of", F.lit(method).alias("method"), F.lit(1.0).alias("similarity"))


def alike(documents: DataFrame, wanted: DataFrame, limit: int = 10) -> DataFrame:
    """(wanted_id, document_id, rank): documents of the same name, or the same
    size and pages, or a size within five percent; the first ``limit`` by id.

    Of a name, a pair of size and pages, a size, and a band of sizes (0.1 %) only
    the first limit + 1 ids can be among them, so each is cut to these before it
    meets a wanted document: bands that lie within the five percent as they are,
    the two at the ends by their sizes."""
    size = F.greatest("size_bytes", F.lit(1)).cast("double")
    of = lambda n: F.floor(F.log(n) / F.log(F.lit(1.001))).cast("long")
    d = documents.filter("document_id is not null").select("document_id", "name", "size_bytes", "page_count", of(size).alias("band"))

    def first(*keys: str) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy("document_id")
        return d.dropna(subset=list(keys)).dropDuplicates([*keys, "document_id"]).withColumn("n", F.row_number().over(w)).filter(F.col("n") <= limit + 1).drop("n")

    lo, hi = F.floor(F.col("size_bytes") * 95 / 100), F.floor(F.col("size_bytes") * 105 / 100)
    w = wanted.filter("document_id is not null").select(F.col("document_id").alias("wanted_id"), F.col("name").alias("wn"), F.col("size_bytes").alias("ws"), F.col("page_count").alias("wp"), lo.alias("lo"), hi.alias("hi"))
    w = w.withColumns({"from": of(F.greatest("lo", F.lit(1)).cast("double")), "to": of(F.greatest("hi", F.lit(1)).cast("double"))})
    same = w.join(first("name"), F.col("wn") == F.col("name"))
    pages = w.join(first("size_bytes", "page_count"), (F.col("ws") == F.col("size_bytes")) & (F.col("wp") == F.col("page_count")))
    inner = w.filter("to - from > 1").withColumn("at", F.explode(F.sequence(F.col("from") + 1, F.col("to") - 1))).join(first("band"), F.col("at") == F.col("band"))
    ends = w.withColumn("at", F.explode(F.array_distinct(F.array("from", "to")))).join(first("size_bytes"), F.col("at") == F.col("band")).filter(F.col("size_bytes").between(F.col("lo"), F.col("hi")))
    rows = [x.filter("wanted_id <> document_id").select("wanted_id", "document_id") for x in (same, pages, inner, ends)]
    every = rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3]).distinct()
    each = Window.partitionBy("wanted_id").orderBy("document_id")
    return every.withColumn("rank", F.row_number().over(each)).filter(F.col("rank") <= limit)


def upserted(old: DataFrame, new: DataFrame) -> DataFrame:
    """documents after an upsert on (source, external_id): the last delivery
    replaces, created_at is that of the first. Rows without an external id are
    records of their own. Partial maxima, so a hot record needs no sort."""
    own = F.col("external_id").isNull() | (F.col("external_id") == "")
    rows = old.withColumn("turn", F.lit(0)).unionByName(new.withColumn("turn", F.lit(1)), allowMissingColumns=True)
    rows = rows.withColumn("record", F.when(own, F.concat(F.lit("d:"), F.col("document_id"))).otherwise(F.concat(F.lit("e:"), F.col("external_id"))))
    rest = [c for c in old.columns if c not in ("source", "created_at")]
    g = rows.groupBy("source", "record").agg(F.max_by(F.struct(*rest), F.struct("turn", F.coalesce("imported_at", F.lit("1970-01-01").cast("timestamp_ntz")), "document_id")).alias("r"), F.min("created_at").alias("created_at"))
    return g.select("source", "r.*", "created_at")


def without(table: DataFrame, documents: DataFrame) -> DataFrame:
    """A table after the documents were deleted (every table the same way)."""
    return table.join(documents.select("document_id"), "document_id", "left_anti")


def token_totals(blocks: DataFrame) -> DataFrame:
    """(document_id, tokens): the estimate of all contents."""
    return blocks.groupBy("document_id").agg(F.sum(estimate(F.col("content"))).cast("long").alias("tokens"))
