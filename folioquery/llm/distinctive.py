"""Problem 6: how distinctive a term is of a record.

Method: smoothed language-model divergence. With the collection distribution
``q(t)`` and the record distribution smoothed by a Dirichlet prior,
``p(t|d) = (tf + mu q(t)) / (len + mu)``, a term's score is its part of the
relative entropy, ``p log(p / q)``, in nats. Terms below the minimum document
frequency are cut off: a term that one record alone has cannot link records.

Occurrences are entries of ``positions`` over all blocks of the document; null
positions are none. Repeated rows of one (term, document_id, block_id) count
once, with the most positions. Null and empty terms, and null documents, count
not at all. Where a document's total is missing, null or 0, the occurrences of
all its terms replace it; of repeated statistics rows the largest total counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioquery.llm.termstats import usable
from folioquery.session import written


def term_documents(terms: DataFrame) -> DataFrame:
    """(term, document_id, tf), in one shuffle"""
    once = usable(terms.filter("document_id is not null"))
    return once.groupBy("term", "document_id").agg(F.sum("occ").alias("tf"))


def scored(terms: DataFrame, stats: DataFrame, mu: float = 100.0, min_df: int = 2, max_df: int | None = None, min_tf: int = 0) -> DataFrame:
    """(document_id, term, tf, total, df, q, score) of terms in at least ``min_df``
    and at most ``max_df`` documents, where they have at least ``min_tf``
    occurrences. The three only choose rows; the distributions are of all
    postings. An empty table gives no rows."""
    td = written(term_documents(terms), "p6-terms")
    per_term = td.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).filter(F.col("df") >= min_df)
    if max_df is not None:
        per_term = per_term.filter(F.col("df") <= max_df)
    size = td.agg(F.sum("tf").alias("all"))
    given = stats.filter("document_id is not null").groupBy("document_id").agg(F.max("total_terms").alias("given"))
    totals = td.groupBy("document_id").agg(F.sum("tf").alias("own")).join(given, "document_id", "left")
    totals = totals.select("document_id", F.when(F.col("given") > 0, F.col("given")).otherwise(F.col("own")).alias("total"))
    rows = td.filter(F.col("tf") >= min_tf).join(per_term, "term").join(totals, "document_id").crossJoin(F.broadcast(size))  # one row
    rows = rows.withColumn("q", F.col("cf") / F.col("all"))
    return rows.select("document_id", "term", "tf", "total", "df", "q", divergence(F.col("tf"), F.col("total"), F.col("q"), mu).alias("score"))


def divergence(tf: Column, total: Column, q: Column, mu: float) -> Column:
    """A term's part of the relative entropy; 0 for a term without occurrences."""
    p = (tf + mu * q) / (total + mu)
    return F.when(q > 0, p * F.log(p / q)).otherwise(0.0)


def found(terms: DataFrame, stats: DataFrame, share: float = 0.02, mu: float = 100.0) -> DataFrame:
    """(document_id, term): in 2 to 5 documents, at least 3 occurrences that make
    up at least 2 % of the document's total. The score rises with a term's share,
    so such a term scores at least what a share of just 2 % would; where that
    share is so far below the collection's that the score falls there, the check
    by share decides alone."""
    s = scored(terms, stats, mu, min_df=2, max_df=5, min_tf=3)
    least = F.col("total") * share
    rises = (least + mu * F.col("q")) / (F.col("total") + mu) * math.e >= F.col("q")
    s = s.filter(~rises | (F.col("score") >= divergence(least, F.col("total"), F.col("q"), mu) - 1e-9))
    return s.filter(F.col("tf") * 50 >= F.col("total")).select("document_id", "term")
