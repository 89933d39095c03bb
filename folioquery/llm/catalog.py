"""The queries of the subpackage, by name, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioquery.llm import batchdedup, bpe, distinctive, lookalike, neighbours, packing, rankfusion, termstats, truncation
from folioquery.llm.oracle import SQL
from folioquery.session import new_path, table


def p1_found(spark, d):
    return rankfusion.found(table(spark, d, "search_hits"), table(spark, d, "search_queries"), table(spark, d, "content_blocks"))


def p1_ranking(spark, d):
    r = rankfusion.ranking(table(spark, d, "search_hits"), table(spark, d, "search_queries"), table(spark, d, "content_blocks"))
    return r.select("query_id", "document_id", "block_id", "keyword_rank", "vector_rank", F.round("rrf", 10).alias("rrf"), "position")


def _counts(spark, d):
    """Two deliveries: of an eighth of the documents the first brings half of the
    blocks only; the second takes those back and brings these documents whole."""
    t = table(spark, d, "search_terms")
    late = F.pmod(F.xxhash64("document_id"), F.lit(8)) == 0
    half = F.pmod(F.xxhash64("block_id"), F.lit(2)) == 0
    counts = termstats.TermCounts(spark, new_path(spark, "p2"))
    counts.apply("first", added=t.filter(~late | half))
    counts.apply("second", added=t.filter(late), deleted=t.filter(late & half))
    return counts


def p2_found(spark, d):
    return termstats.verdicts(_counts(spark, d)).filter("verdict is not null").select("term", "verdict")


def p2_terms(spark, d):
    return termstats.verdicts(_counts(spark, d))


SIZES = {"quill-embed-96": 96, "quill-embed-64": 64}  # what the problem states of the two models


def p3_found(spark, d):
    return neighbours.similar_pairs(table(spark, d, "vectors"), models=SIZES)


def p4_found(spark, d):
    return lookalike.found(table(spark, d, "content_blocks"), table(spark, d, "search_terms"))


def p4_contents(spark, d):
    """Every content in its one form."""
    c = table(spark, d, "content_blocks").select("block_key", "content")
    return lookalike.canonical(c, "content", "form", lookalike.corpus_forms(c.select("content"))).select("block_key", "form")


def p6_found(spark, d):
    return distinctive.found(table(spark, d, "search_terms"), table(spark, d, "document_stats"))


def p6_scores(spark, d):
    s = distinctive.scored(table(spark, d, "search_terms"), table(spark, d, "document_stats"))
    return s.select("document_id", "term", "tf", "total", "df", F.round("score", 9).alias("score"))


def p7_found(spark, d):
    return batchdedup.found(table(spark, d, "documents"))


def p7_methods(spark, d):
    """Every copy with how it was recognised."""
    return batchdedup.methods(table(spark, d, "documents"))


def p8_ids(spark, d):
    return bpe.encoded(table(spark, d, "documents"))


def p9_containers(spark, d):
    return packing.containers(table(spark, d, "documents"))


def p9_check(spark, d):
    """What must hold of the containers: none over its capacity, every document
    in pieces without a gap or overlap, none missing, and little room left."""
    c = packing.containers(table(spark, d, "documents"))
    full = c.groupBy("container_id").agg(F.sum("n_tokens").alias("n")).agg(F.count(F.when(F.col("n") > packing.CAPACITY, 1)).alias("over"), (F.sum("n") >= 0.97 * packing.CAPACITY * (F.count("*") - 1)).alias("filled"))
    pieces = c.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.max(F.col("start") + F.col("n_tokens")).alias("end"), F.countDistinct("start").alias("starts"), F.count("*").alias("pieces"), F.min("start").alias("first"))
    bad = (F.col("n") != F.col("end")) | (F.col("starts") != F.col("pieces")) | (F.col("first") != 0)
    return full.crossJoin(pieces.agg(F.count(F.when(bad, 1)).alias("torn"), F.count("*").alias("documents")))  # one row each


def p10_found(spark, d):
    return truncation.found(table(spark, d, "documents"))


def p10_why(spark, d):
    return truncation.reasons(table(spark, d, "documents"))


def p10_rates(spark, d):
    return truncation.rates(table(spark, d, "documents"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k[:1] == "p" and k[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
