"""The inverted index: blocks, tokens, postings and corpus statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioquery.functions import text as T


def unique_blocks(blocks: DataFrame) -> DataFrame:
    """One row per (document_id, block_id): of repeated rows that with the
    largest block_key. A partial maximum, so hot keys are reduced before the
    shuffle."""
    rest = [c for c in blocks.columns if c not in ("document_id", "block_id", "block_key")]
    row = F.struct("block_key", *rest)
    best = blocks.filter("document_id is not null and block_id is not null").groupBy("document_id", "block_id").agg(F.max_by(row, "block_key").alias("r"))
    return best.select("document_id", "block_id", "r.*")


def unique_postings(terms: DataFrame) -> DataFrame:
    """One row per (term, document_id, block_id), without null and empty terms."""
    t = terms.filter("term is not null and term <> '' and document_id is not null and block_id is not null")
    return t.groupBy("term", "document_id", "block_id").agg(F.max("positions").alias("positions"), F.max("term_frequency").alias("tf"))


def unique_stats(stats: DataFrame) -> DataFrame:
    s = stats.filter("document_id is not null").groupBy("document_id")
    return s.agg(F.max("total_terms").alias("total_terms"), F.max("unique_terms").alias("unique_terms"), F.max("avg_block_length").alias("avg_block_length"))


def split_lines(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, sequence, block_id, content): the lines with ink of each text."""
    lines = F.filter(F.split(F.col("text"), "\r?\n"), lambda x: x.rlike(r"[^\s\p{Z}]"))
    d = documents.select(key, F.posexplode(lines).alias("sequence", "content"))
    return d.select(key, "sequence", F.format_string("blk_%05d", F.col("sequence") + 1).alias("block_id"), F.regexp_replace("content", r"^[\s\p{Z}]+|[\s\p{Z}]+$", "").alias("content"))


def tokenized(blocks: DataFrame, stop_words: bool = True) -> DataFrame:
    """(document_id, block_id, position, token); images are not indexed. The
    position counts kept tokens."""
    b = blocks.filter(F.coalesce("type", F.lit("text")) != "image")
    return b.select("document_id", "block_id", F.posexplode(T.tokens(F.col("content"), stop_words)).alias("position", "token"))


def postings(blocks: DataFrame, stop_words: bool = True, stemming: bool = True) -> DataFrame:
    """(term, document_id, block_id, positions, tf, block_len). A block's tokens
    are grouped within its own row by one sort, so only finished postings leave
    the scan and a long block costs little more than its length."""
    b = blocks.filter(F.coalesce("type", F.lit("text")) != "image")
    toks = T.tokens(F.col("content"), stop_words)
    if stemming:
        toks = F.transform(toks, T.stem)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            lists = x.column(2)
            size = np.diff(lists.offsets.to_numpy())
            words = lists.flatten().dictionary_encode()
            row = np.repeat(np.arange(len(size)), size)
            place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            key = row * max(1, len(words.dictionary)) + words.indices.to_numpy()
            order = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.diff(key[order], prepend=-1))
            off = np.append(first, len(key)).astype(np.int32)
            at = pa.array(row[order][first])
            n = size[row[order][first]]
            cols = [words.dictionary.take(words.indices.take(pa.array(order[first]))), x.column(0).take(at), x.column(1).take(at), pa.ListArray.from_arrays(pa.array(off), pa.array(place[order].astype(np.int32))), pa.array(np.diff(off) / np.maximum(n, 1)), pa.array(n.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=["term", "document_id", "block_id", "positions", "tf", "block_len"])

    schema = "term string, document_id string, block_id string, positions array<int>, tf double, block_len int"
    return b.select("document_id", "block_id", toks.alias("toks")).mapInArrow(run, schema)


def document_stats(blocks: DataFrame, posts: DataFrame) -> DataFrame:
    """(document_id, total_terms, unique_terms, avg_block_length); the average is
    over all blocks, also those without terms."""
    n = blocks.groupBy("document_id").agg(F.count("*").alias("blocks"))
    per_term = posts.groupBy("document_id", "term").agg(F.sum(F.size("positions")).alias("n"))
    t = per_term.groupBy("document_id").agg(F.sum("n").alias("total"), F.count("*").alias("distinct"))
    j = n.join(t, "document_id", "left")
    total = F.coalesce("total", F.lit(0)).cast("long")
    return j.select("document_id", total.alias("total_terms"), F.coalesce("distinct", F.lit(0)).cast("long").alias("unique_terms"), (total / F.col("blocks")).alias("avg_block_length"))


def corpus_stats(stats: DataFrame) -> DataFrame:
    """One row: total_documents, avg_doc_length, avg_block_length (100 without any)."""
    return stats.agg(F.count("*").alias("total_documents"), F.avg("total_terms").alias("avg_doc_length"), F.coalesce(F.avg(F.when(F.col("avg_block_length") > 0, F.col("avg_block_length"))), F.lit(100.0)).alias("avg_block_length"))


def document_frequency(posts: DataFrame) -> DataFrame:
    return posts.select("term", "document_id").distinct().groupBy("term").agg(F.count("*").alias("df"))


def keywords(blocks: DataFrame, n: int = 10, key: str = "document_id") -> DataFrame:
    """(key, keyword, n, rank): most frequent words of three bytes or more that
    are no stop words; ties by the word."""
    words = F.filter(T.tokens(F.col("content")), lambda w: F.octet_length(w) >= 3)
    c = blocks.select(key, F.explode(words).alias("keyword")).groupBy(key, "keyword").agg(F.count("*").alias("n"))
    w = Window.partitionBy(key).orderBy(F.desc("n"), "keyword")
    return c.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def sections(blocks: DataFrame, heading: Column | None = None) -> DataFrame:
    """blocks with ``section_now``: the content of the last heading before."""
    h = F.col("is_heading") if heading is None else heading
    w = Window.partitionBy("document_id").orderBy("sequence", "block_id").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("section_now", F.when(h, None).otherwise(F.last(F.when(h, F.col("content")), ignorenulls=True).over(w)))


def keyword_scope(blocks: DataFrame, reach: int = 5) -> DataFrame:
    """blocks with ``scope``: 'document' for headings, which get the document's
    keywords, 'own' for blocks within ``reach`` after a heading, else null."""
    h = F.coalesce("is_heading", F.lit(False))
    w = Window.partitionBy("document_id").orderBy("sequence", "block_id").rowsBetween(-reach, -1)
    after = F.max(h.cast("int")).over(w) == 1
    return blocks.withColumn("scope", F.when(h, "document").when(after, "own"))


def placed(paragraphs: DataFrame, total: str, pages: str, at: str = "sequence") -> DataFrame:
    """Estimated page and height on a Letter page for texts without layout."""
    per = F.greatest(F.floor(F.col(total) / F.col(pages)), F.lit(1))
    page = F.when((F.col(total) == 0) | (F.col(pages) == 0), 1).otherwise(F.least(F.floor(F.col(at) / per) + 1, F.col(pages))).cast("int")
    y = F.lit(720.0) - (F.col(at) % 46) * 14.0
    return paragraphs.withColumn("page_now", page).withColumn("y_now", y)


def relative_position(blocks: DataFrame) -> DataFrame:
    """blocks with ``percent``: how far down its document a block begins."""
    at, n = Window.partitionBy("document_id").orderBy("sequence", "block_id"), Window.partitionBy("document_id")
    return blocks.withColumn("percent", 100.0 * (F.row_number().over(at) - 1) / F.count(F.lit(1)).over(n))
