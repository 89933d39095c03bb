"""Filters of documents: predicates, tags, embeddings; applied before ranking."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Filter:
    """A conjunction. Empty parts do not restrict; a part that nothing meets
    gives no rows."""

    sources: list[str] = field(default_factory=list)
    formats: list[str] = field(default_factory=list)
    tags: dict[str, str] = field(default_factory=dict)  # a value of '!x' must not be there
    after: datetime | None = None
    before: datetime | None = None
    min_pages: int = 0
    max_pages: int = 0
    has_embeddings: bool | None = None
    external_ids: list[str] = field(default_factory=list)
    document_ids: list[str] | None = None

    def is_empty(self) -> bool:
        return self == Filter()

    def predicate(self) -> Column:
        """What the documents' own columns decide; reaches the scan."""
        p: list[Column] = []
        if self.sources:
            p.append(F.col("source").isin(self.sources) | F.col("format").isin(self.sources))
        if self.formats:
            p.append(F.col("format").isin(self.formats))
        if self.after:
            p.append(F.col("created_at") >= F.lit(self.after))
        if self.before:
            p.append(F.col("created_at") <= F.lit(self.before))
        if self.min_pages > 0:
            p.append(F.col("page_count") >= self.min_pages)
        if self.max_pages > 0:
            p.append(F.col("page_count") <= self.max_pages)
        if self.external_ids:
            p.append(F.col("external_id").isin(self.external_ids))
        if self.document_ids is not None:
            p.append(F.col("document_id").isin(self.document_ids))
        return reduce(lambda a, b: a & b, p, F.lit(True))

    def apply(self, documents: DataFrame, tags: DataFrame | None = None, vectors: DataFrame | None = None) -> DataFrame:
        out = documents.filter(self.predicate())
        if self.tags:
            out = tagged(out, tags, self.tags)
        if self.has_embeddings is not None:
            have = vectors.filter("document_id is not null").select("document_id")
            out = out.join(have, "document_id", "left_semi" if self.has_embeddings else "left_anti")
        return out


def tagged(documents: DataFrame, tags: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Documents that have all tags; '!x' keeps those without that value, also
    documents without any tag. One join per sign, whatever the number of tags."""
    has = {k: v for k, v in wanted.items() if not v.startswith("!")}
    hasnt = {k: v[1:] for k, v in wanted.items() if v.startswith("!")}
    hit = lambda of: reduce(lambda a, b: a | b, [(F.col("tag_key") == k) & (F.col("tag_value") == v) for k, v in of.items()])
    out = documents
    if has:
        full = tags.filter(hit(has)).select("document_id", "tag_key").distinct().groupBy("document_id").agg(F.count("*").alias("n")).filter(F.col("n") == len(has))
        out = out.join(full.select("document_id"), "document_id", "left_semi")
    if hasnt:
        out = out.join(tags.filter(hit(hasnt)).select("document_id"), "document_id", "left_anti")
    return out


def restricted(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """rows of the documents given."""
    return rows.join(documents.select("document_id"), "document_id", "left_semi")


def block_filter(sections: list[str] | None = None, pages: tuple[int, int] | None = None, types: list[str] | None = None) -> Column:
    p = [F.lit(True)]
    if sections:
        p.append(F.col("section").isin(sections))
    if pages and pages[1] > 0:
        p.append(F.col("page").between(*pages))
    if types:
        p.append(F.col("type").isin(types))
    return reduce(lambda a, b: a & b, p)
