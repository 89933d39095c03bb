"""Problem 1: one ranking per query from two differently scaled score lists.

Method: reciprocal rank fusion. Items are ranked separately in each list, each
rank adds ``weight / (60 + rank)``, and the sum orders the items. Only ranks
enter, so the list with the larger numbers has no more say than its weight.

A score that is null, NaN or infinite does not count; a block listed twice in a
list counts with its highest score; a block that is not in content_blocks, or
whose keys are null, is left out. Equal scores have equal rank (one more than
the number of strictly higher ones). An item missing from a list has there the
rank after the last. A weight that is null, NaN, infinite, negative or above 1
becomes one half; the two are then scaled to sum to 1 (two zeros to one half
each). Hits of a query without a row in search_queries count with halves. Items
with equal sums share a position. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioquery.session import partitions, written

K = 60


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def group_ranks(rows: DataFrame, group: list[str], score: str) -> DataFrame:
    """(group, score, rank, size): for each distinct score of a group one more
    than the number of its rows with a higher score, and the group's rows.

    A group may be of any size: equal scores are counted before the shuffle, the
    distinct ones are range-partitioned in order, and each range only needs the
    number of rows in the ranges before it.
    """
    spark = rows.sparkSession
    counts = rows.groupBy(*group, score).agg(F.count("*").alias("n"))
    ranged = counts.repartitionByRange(partitions(spark), *group, F.desc(score)).withColumn("range", F.spark_partition_id())
    ranged = written(ranged, "p1-ranges")
    before = Window.partitionBy(*group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(*group, "range").agg(F.sum("n").alias("n"))
    sums = sums.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("size", F.sum("n").over(Window.partitionBy(*group))).drop("n")
    inside = Window.partitionBy(*group, "range").orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("within", F.coalesce(F.sum("n").over(inside), F.lit(0))).drop("n")
    return placed.join(sums, [*group, "range"]).select(*group, score, (F.col("before") + F.col("within") + 1).alias("rank"), "size")


def usable_hits(hits: DataFrame, blocks: DataFrame) -> DataFrame:
    """(query_id, branch, document_id, block_id, score): the best finite score of
    each block that exists."""
    h = hits.select("query_id", "branch", "document_id", "block_id", F.col("score").cast("double").alias("score")).filter(finite(F.col("score")) & F.col("branch").isin("keyword", "vector"))
    best = h.groupBy("query_id", "branch", "document_id", "block_id").agg(F.max("score").alias("score"))
    return best.join(blocks.select("document_id", "block_id"), ["document_id", "block_id"], "left_semi")


def weights(queries: DataFrame) -> DataFrame:
    """(query_id, wk, wv), summing to 1; of repeated queries one row."""
    ok = lambda c: F.when(finite(F.col(c)) & F.col(c).between(0, 1), F.col(c)).otherwise(F.lit(0.5))
    one = queries.filter(F.col("query_id").isNotNull()).groupBy("query_id").agg(F.min_by("keyword_weight", "asked_at").alias("keyword_weight"), F.min_by("vector_weight", "asked_at").alias("vector_weight"))
    w = one.select("query_id", ok("keyword_weight").alias("wk"), ok("vector_weight").alias("wv"))
    total = F.col("wk") + F.col("wv")
    return w.select("query_id", F.when(total > 0, F.col("wk") / total).otherwise(0.5).alias("wk"), F.when(total > 0, F.col("wv") / total).otherwise(0.5).alias("wv"))


def fused(hits: DataFrame, queries: DataFrame, blocks: DataFrame, k: int = K) -> DataFrame:
    """(query_id, document_id, block_id, keyword_rank, vector_rank, rrf): ranks
    are null where a list does not have the block."""
    best = written(usable_hits(hits, blocks), "p1-hits")
    ranks = group_ranks(best, ["query_id", "branch"], "score")
    ranked = best.join(ranks, ["query_id", "branch", "score"])
    of = lambda b, c: F.max(F.when(F.col("branch") == b, F.col(c)))
    items = ranked.groupBy("query_id", "document_id", "block_id").agg(of("keyword", "rank").alias("keyword_rank"), of("vector", "rank").alias("vector_rank"))
    sizes = best.groupBy("query_id").agg(F.count(F.when(F.col("branch") == "keyword", 1)).alias("nk"), F.count(F.when(F.col("branch") == "vector", 1)).alias("nv"))
    info = sizes.join(weights(queries), "query_id", "left")
    rk = F.coalesce("keyword_rank", F.col("nk") + 1)
    rv = F.coalesce("vector_rank", F.col("nv") + 1)
    rrf = F.coalesce("wk", F.lit(0.5)) / (k + rk) + F.coalesce("wv", F.lit(0.5)) / (k + rv)
    return items.join(info, "query_id").select("query_id", "document_id", "block_id", "keyword_rank", "vector_rank", rrf.alias("rrf"))


def ranking(hits: DataFrame, queries: DataFrame, blocks: DataFrame, k: int = K) -> DataFrame:
    """fused() with ``position``: 1 for the best block of its query, in order of
    the sums to 12 places. Equal sums have equal positions."""
    f = written(fused(hits, queries, blocks, k).withColumn("rrf", F.round("rrf", 12)), "p1-fused")
    at = group_ranks(f.select("query_id", "rrf"), ["query_id"], "rrf").select("query_id", "rrf", F.col("rank").alias("position"))
    return f.join(at, ["query_id", "rrf"])


def found(hits: DataFrame, queries: DataFrame, blocks: DataFrame, best: int = 2) -> DataFrame:
    """(query_id, document_id, block_id) among the ``best`` of both lists: the
    weights sum to 1, so the fused sum of such a block is at least that of rank
    ``best`` in a single list. What has that sum is then checked by its ranks."""
    near = fused(hits, queries, blocks).filter(F.col("rrf") >= 1 / (K + best) - 1e-12)
    return near.filter((F.col("keyword_rank") <= best) & (F.col("vector_rank") <= best)).select("query_id", "document_id", "block_id")
