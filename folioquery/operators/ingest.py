"""Files and record sets into a store: parsed, checked, saved as one change."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioquery.errors import RecordError
from folioquery.operators import embedding
from folioquery.operators.store import Store
from folioquery.session import written
from folioquery.sources import files, images, records

Progress = Callable[[str, int], None]


@dataclass(frozen=True)
class IndexOptions:
    source: str | None = None  # by default the files' format
    tags: dict[str, str] = field(default_factory=dict)
    force: bool = False  # also files whose checksum the store has
    images: bool = True
    stemming: bool = True
    provider: embedding.Provider | None = None  # none: embedding is left to a later job


def _blocks(parsed: DataFrame) -> DataFrame:
    """Parsed rows as rows of the store's blocks."""
    box = F.struct("x", "y", "width", "height", F.lit(612.0).alias("page_width"), F.lit(792.0).alias("page_height"))
    font = F.struct(F.col("font_name").alias("name"), F.col("font_size").alias("size"), "bold", "italic")
    more = F.map_filter(F.create_map(F.lit("list_type"), F.col("list_type"), F.lit("list_prefix"), F.col("list_prefix")), lambda _, v: v.isNotNull())
    return parsed.filter("error is null and block_id is not null").withColumns({"bbox": box, "font": font, "entry_metadata": more})


def index_files(store: Store, change: str, found: DataFrame, o: IndexOptions = IndexOptions(), progress: Progress = lambda stage, n: None) -> DataFrame:
    """Index files, rows of (path, content). Files with a checksum that the store
    has are left out. Returns (path, error) of those that no parser could read;
    they are not saved. ``progress`` hears of every stage with its count: found,
    known, failed, saved, embedded."""
    docs = files.documents(found, o.source)
    docs = written(docs.withColumn("path", F.col("original_path")), "files")
    progress("found", docs.count())
    if not o.force:
        have = store.table("documents").filter("checksum is not null").select("checksum").distinct()
        known = docs.join(have, "checksum", "left_semi").count()
        docs = docs.join(have, "checksum", "left_anti")
        progress("known", known)
    docs = docs.dropDuplicates(["document_id"])
    wanted = found.join(docs.select("path"), "path", "left_semi")
    parsed = written(files.parsed(wanted), "parsed")
    bad = parsed.filter("error is not null").select("path", "error").distinct()
    progress("failed", bad.count())
    good = docs.join(bad, "path", "left_anti")
    facts = parsed.groupBy("path").agg(F.max("page_count").alias("page_count"), F.max("title").alias("title"), F.max("author").alias("author"))
    good = good.join(facts, "path", "left").withColumns({"created_at": F.current_timestamp(), "updated_at": F.current_timestamp(), "imported_at": F.current_timestamp(), "description": F.col("title")})
    ids = good.select("path", "document_id")
    blocks = _blocks(parsed).join(ids, "path")
    tags = good.select("document_id", F.explode(F.create_map(*[F.lit(x) for kv in o.tags.items() for x in kv])).alias("tag_key", "tag_value")) if o.tags else None
    pictures = images.extracted(wanted).filter("error is null").join(ids, "path") if o.images else None
    if pictures is not None:
        pictures = pictures.withColumn("image_id", F.concat_ws("_", "document_id", "image_id"))
    store.save(change, good, blocks, tags, pictures, o.stemming)
    progress("saved", good.count())
    if o.provider is not None:
        store.embed(f"{change}-vectors", o.provider, ids)
        progress("embedded", store.table("vectors").join(ids, "document_id", "left_semi").count())
    return bad


def index_records(store: Store, change: str, sets: DataFrame, stemming: bool = True, strict: bool = False) -> DataFrame:
    """Save record sets; one of the same source and external id replaces the
    record with its blocks and tags. Returns the refused ones with their
    ``error``; ``strict`` raises instead when there is any."""
    good, bad = records.checked(sets)
    if strict and (first := bad.select("source", "error").first()):
        raise RecordError(first["error"], source=first["source"])
    docs, blocks, tags = records.ingested(good)
    docs = docs.withColumns({"created_at": F.coalesce("imported_at", F.current_timestamp()), "updated_at": F.coalesce("imported_at", F.current_timestamp())})
    store.save(change, docs, blocks, tags, stemming=stemming)
    return bad
