"""Record sets given by the user: checked, and turned into documents and blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioquery.functions.text import or_default
from folioquery.functions.vectors import file_checksum


def checked(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad); bad has a column ``error``."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    error = F.when(blank("source"), "missing source").when(blank("name"), "missing name").when(F.coalesce(F.size("entries"), F.lit(0)) <= 0, "no entries")
    r = records.withColumn("error", error)
    return r.filter("error is null").drop("error"), r.filter("error is not null")


def ingested(records: DataFrame, default_source: str = "customdata") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, blocks, tags). A document's id follows from its source and
    external id, or from its name and entries where it has none, so the same
    record set always gets the same id. Entries without an id are entry_1, …"""
    text = F.to_json("entries")
    own = F.coalesce(F.nullif("external_id", F.lit("")), F.concat_ws("\x1f", "name", text))
    r = records.withColumn("document_id", F.concat(F.lit("doc_"), F.substring(F.sha2(F.concat_ws("\x1f", "source", own), 256), 1, 24)))
    docs = r.select(
        "document_id", "name", F.lit(None).cast("string").alias("original_path"), F.lit("customdata").alias("format"), F.octet_length(text).cast("long").alias("size_bytes"), F.lit(1).alias("page_count"),
        file_checksum(text).alias("checksum"), "imported_at", or_default(F.col("source"), default_source).alias("source"), "description", "external_id",
    )
    e = r.select("document_id", "source", F.posexplode("entries").alias("sequence", "e"))
    blocks = e.select(
        "document_id", F.coalesce(F.nullif("e.id", F.lit("")), F.concat(F.lit("entry_"), F.col("sequence") + 1)).alias("block_id"), F.lit("custom").alias("type"), F.col("e.content").alias("content"),
        F.lit(1).alias("page"), "sequence", F.col("source").alias("section"), F.col("e.metadata").alias("entry_metadata"),
    )
    tags = r.select("document_id", F.explode("tags").alias("tag_key", "tag_value"))
    return docs, blocks, tags
