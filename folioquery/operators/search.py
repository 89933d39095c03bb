"""Batch search: BM25, nearest vectors, fusion. All queries run in one plan."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioquery.errors import InvalidQuery
from folioquery.functions import text as T
from folioquery.operators import index as I
from folioquery.operators.filters import restricted
from folioquery.session import written

K1, B, RRF_K = 1.2, 0.75, 60
BOOST = 1.5


def query_terms(queries: DataFrame, stop_words: bool = True, stemming: bool = False) -> DataFrame:
    """(query_id, term, times): a term that occurs twice counts twice."""
    toks = T.tokens(F.col("query_text"), stop_words)
    if stemming:
        toks = F.transform(toks, T.stem)
    return queries.select("query_id", F.explode(toks).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))


def weighted(posts: DataFrame, stats: DataFrame) -> DataFrame:
    """(term, document_id, block_id, weight): a posting's part of any query that
    has its term. tf is relative to the block; lengths compare to the document's
    average block, else the corpus average."""
    corpus = I.corpus_stats(stats)
    df = I.document_frequency(posts)
    p = posts.join(stats.select("document_id", F.col("avg_block_length").alias("own")), "document_id").join(df, "term").crossJoin(F.broadcast(corpus))  # one row
    tf, n = F.coalesce("tf", F.lit(0.0)), F.coalesce(F.size("positions"), F.lit(0))
    size = F.when(tf > 0, n / tf).otherwise(n)
    avg = F.when(F.col("own") > 0, F.col("own")).when(F.col("avg_block_length") > 0, F.col("avg_block_length")).otherwise(F.col("avg_doc_length") / 10)
    idf = F.log((F.col("total_documents") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    return p.select("term", "document_id", "block_id", (idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * (size / avg)))).alias("weight"))


def bm25(queries: DataFrame, posts: DataFrame, stats: DataFrame, stop_words: bool = True, stemming: bool = False) -> DataFrame:
    """(query_id, document_id, block_id, score), to nine places, so that the order
    of summation decides no tie. Postings of terms that no query has are dropped
    before anything is weighted; document frequencies are of the terms left."""
    terms = query_terms(queries, stop_words, stemming)
    used = posts.join(terms.select("term").distinct(), "term", "left_semi")
    hits = terms.join(weighted(used, stats), "term")
    return hits.groupBy("query_id", "document_id", "block_id").agg(F.round(F.sum(F.col("times") * F.col("weight")), 9).alias("score"))


def best(queries: DataFrame, posts: DataFrame, stats: DataFrame, n: int, stop_words: bool = True, stemming: bool = False, kept: DataFrame | None = None, blocks: DataFrame | None = None, min_score: float | None = None, factor: float = BOOST, part: int = 524_288) -> DataFrame:
    """(query_id, document_id, block_id, score, rank): ``top(bm25(..), n)`` for many
    queries, without a row for every pair of a query and a block that it finds,
    which grow as the queries times the postings. ``kept``: only blocks of these
    documents count. ``blocks``: scores are boosted as by ``boosted``.

    Queries with the same terms are one. Blocks are split into parts of about
    ``part`` postings. Each part adds up the scores of one set of terms after
    another in an array with a place for every block, so only the best n of a
    part meet in a shuffle.
    """
    terms = query_terms(queries, stop_words, stemming)
    word = F.array_join(F.transform("words", lambda x: F.concat_ws(" ", x["term"], x["times"].cast("string"))), " ")  # terms have no blanks
    asked = terms.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("term", "times"))).alias("words")).withColumn("key", word)
    asked = written(asked, "asked")
    sets = asked.groupBy("key").agg(F.first("words").alias("words")).withColumn("lead", F.monotonically_increasing_id())
    sets = written(sets, "sets")
    w = weighted(posts.join(terms.select("term").distinct(), "term", "left_semi"), stats)
    w = w if kept is None else restricted(w, kept)
    gain = F.lit(1.0)
    if blocks is not None:
        w = w.join(blocks.select("document_id", "block_id", "is_heading"), ["document_id", "block_id"])
        gain = F.when(F.coalesce("is_heading", F.lit(False)), F.lit(factor)).otherwise(1.0)
    w = written(w.select("term", "document_id", "block_id", "weight", gain.alias("gain")), "weights")
    parts = max(1, -(-w.count() // part))
    p = w.withColumn("part", F.pmod(F.xxhash64("document_id", "block_id"), F.lit(parts)))
    s = sets.select("lead", F.col("words.term").alias("term"), F.col("words.times").alias("times"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"))
    schema = "lead long, document_id string, block_id string, score double"
    found = p.groupBy("part").cogroup(s.groupBy("part")).applyInArrow(_scored(n, min_score, max(1.0, factor) if blocks is not None else 1.0), schema)
    found = top(found, n, "lead")
    return asked.select("query_id", "key").join(sets.select("key", "lead"), "key").join(found, "lead").select("query_id", "document_id", "block_id", "score", "rank")


def _first(at: np.ndarray, s: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n largest of s with their places, which ascend; equal ones by place.
    NaN is the largest, as it is in a sort of Spark."""
    k = np.where(np.isnan(s), np.inf, s)
    if len(k) > n:
        kth = np.partition(k, len(k) - n)[len(k) - n]
        more = np.flatnonzero(k > kth)
        i = np.sort(np.concatenate([more, np.flatnonzero(k == kth)[: n - len(more)]]))
        at, s, k = at[i], s[i], k[i]
    order = np.argsort(-k, kind="stable")
    return at[order], s[order]


def _scored(n: int, min_score: float | None, most: float):
    """What ``best`` does with a part: (postings, sets of terms) -> the best n of
    each set. ``most``: no gain is above."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.combine_chunks()
        out: list[tuple[int, np.ndarray, np.ndarray]] = []
        order = pc.sort_indices(left, sort_keys=[("document_id", "ascending"), ("block_id", "ascending")])
        t = left.take(order).combine_chunks()
        doc, blk = (pc.fill_null(t[c].combine_chunks() if isinstance(t[c], pa.ChunkedArray) else t[c], "") for c in ("document_id", "block_id"))
        rows = len(doc)
        if rows:
            fresh = np.append(True, pc.or_(pc.not_equal(doc[1:], doc[:-1]), pc.not_equal(blk[1:], blk[:-1])).to_numpy(zero_copy_only=False))
            place = np.cumsum(fresh) - 1
            start = np.flatnonzero(fresh)
            weight = t["weight"].to_numpy()
            gain = t["gain"].to_numpy()[start]
            code = pc.dictionary_encode(t["term"].combine_chunks())
            code = code.combine_chunks() if isinstance(code, pa.ChunkedArray) else code
            known = {x: i for i, x in enumerate(code.dictionary.to_pylist())}
            by = np.argsort(code.indices.to_numpy(), kind="stable")
            cut = np.searchsorted(code.indices.to_numpy()[by], np.arange(len(known) + 1))
            plain = bool((weight >= 0).all())  # else one term may take from another
            acc = np.zeros(len(start))
            lists: dict[int, tuple] = {}

            def of(i: int) -> tuple:
                """Places, weights, the same for every place where it is frequent, and
                what the n-th of its blocks has at least."""
                if i not in lists:
                    at, x = place[by[cut[i] : cut[i + 1]]], weight[by[cut[i] : cut[i + 1]]]
                    full = None
                    if len(at) * 8 > len(start):
                        full = np.zeros(len(start))
                        full[at] = x
                    own = x if min_score is None else x[x >= min_score]
                    own = own * gain[at if min_score is None else at[x >= min_score]]
                    lists[i] = at, x, full, np.partition(own, len(own) - n)[len(own) - n] if plain and len(own) >= n else -np.inf
                return lists[i]

            def finished(at: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                s = np.round(s, 9)
                if min_score is not None:
                    ok = ~(s < min_score)
                    at, s = at[ok], s[ok]
                return _first(at, np.round(s * gain[at], 9), n)

            for lead, words, times in zip(right["lead"].to_pylist(), right["term"].to_pylist(), right["times"].to_pylist()):
                mine = [(of(known[x]), m) for x, m in zip(words, times) if x in known]
                if not mine:
                    continue
                if len(mine) == 1:
                    (at, x, _, _), m = mine[0]
                    out.append((lead, *finished(at, x * m)))
                    continue
                mine.sort(key=lambda z: -len(z[0][0]))
                (at, x, full, _), m = mine[0]
                if full is not None:
                    np.multiply(full, m, out=acc)
                else:
                    acc.fill(0)
                    acc[at] = x * m
                for (at, x, full, _), m in mine[1:]:
                    if full is not None:
                        np.add(acc, full if m == 1 else full * m, out=acc)
                    else:
                        acc[at] += x if m == 1 else x * m
                least = max(z[3] * m for z, m in mine) / most
                if plain and min_score is not None:
                    least = max(least, min_score)
                least -= 1e-8  # scores are rounded
                at = np.flatnonzero(acc >= least) if least > 0 else np.unique(np.concatenate([z[0] for z, _ in mine]))
                out.append((lead, *finished(at, acc[at])))
        if not out:
            return pa.table({"lead": pa.array([], pa.int64()), "document_id": pa.array([], pa.string()), "block_id": pa.array([], pa.string()), "score": pa.array([], pa.float64())})
        at = pa.array(start[np.concatenate([a for _, a, _ in out])])
        lead = np.repeat(np.array([x for x, _, _ in out], dtype=np.int64), [len(a) for _, a, _ in out])
        return pa.table({"lead": lead, "document_id": doc.take(at), "block_id": blk.take(at), "score": np.concatenate([s for _, _, s in out])})

    return run


def boosted(scores: DataFrame, blocks: DataFrame, min_score: float | None = None, factor: float = BOOST) -> DataFrame:
    """Scores of existing blocks; the least score holds before headings gain."""
    s = scores if min_score is None else scores.filter(F.col("score") >= min_score)
    b = blocks.select("document_id", "block_id", "is_heading")
    gain = F.when(F.coalesce("is_heading", F.lit(False)), F.lit(factor)).otherwise(1.0)
    return s.join(b, ["document_id", "block_id"]).withColumn("score", F.round(F.col("score") * gain, 9)).drop("is_heading")


def top(scores: DataFrame, n: int | None = None, group: str = "query_id", by: str = "score") -> DataFrame:
    """The best n of each group, or all, with ``rank``; ties by document and
    block. Spark limits each task's rows per group before the shuffle."""
    w = Window.partitionBy(group).orderBy(F.desc(by), "document_id", "block_id")
    s = scores.withColumn("rank", F.row_number().over(w))
    return s if n is None else s.filter(F.col("rank") <= n)


def parsed_query(text: str) -> dict:
    """Words that must, may and must not occur, and phrases. ``AND`` binds its
    two neighbours, ``NOT`` and ``-`` exclude, quotes make a phrase."""
    if not text or not text.strip():
        raise InvalidQuery("empty query")
    phrases = [p.lower().split() for p in re.findall(r'"([^"]+)"', text)]
    rest = re.sub(r'"[^"]*"', " ", text)
    must, may, without = [], [], []
    words = re.findall(r"-?[^\W_]+", rest)
    for i, w in enumerate(words):
        if w in ("AND", "OR", "NOT"):
            continue
        before, after = words[i - 1] if i else "", words[i + 1] if i + 1 < len(words) else ""
        to = without if w[0] == "-" or before == "NOT" else must if "AND" in (before, after) else may
        to.append(w.lstrip("-").lower())
    return {"must": must, "may": may, "without": without, "phrases": phrases}


def boolean_matches(posts: DataFrame, text: str) -> DataFrame:
    """(document_id, block_id) of the blocks that meet a boolean query. Phrases
    are found by the positions of their words."""
    q = parsed_query(text)
    words = sorted({*q["must"], *q["may"], *q["without"], *(w for p in q["phrases"] for w in p)})
    p = posts.filter(F.col("term").isin(words))
    held = p.groupBy("document_id", "block_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at"))  # as many as the query's words
    has = lambda w: F.map_contains_key("at", F.lit(w))
    cond = F.lit(True)
    for w in q["must"]:
        cond = cond & has(w)
    for w in q["without"]:
        cond = cond & ~has(w)
    if q["may"] and not q["must"] and not q["phrases"]:
        cond = cond & F.array(*[has(w) for w in q["may"]]).cast("string").contains("true")
    back = lambda positions, k: F.transform(positions, lambda x: x - k)
    for ph in q["phrases"]:
        starts = F.element_at("at", ph[0])
        for k, w in enumerate(ph[1:], 1):
            starts = F.array_intersect(starts, back(F.element_at("at", w), k))
        cond = cond & F.coalesce(F.size(starts) > 0, F.lit(False))
    return held.filter(cond).select("document_id", "block_id")


def nearest(queries: DataFrame, vectors: DataFrame, k: int, least: float = -1.0, block: int = 16_384, part: int = 65_536, skip_own: bool = True) -> DataFrame:
    """(query_id, vec_id, similarity, rank): exact k nearest by cosine.

    queries: query_id, model, vector; vectors: vec_id, model, vector, usable
    ones. Queries are split into blocks of about ``block`` and vectors into parts
    of about ``part`` rows; each pair of these gives at most k per query, equal
    similarities by vec_id, so nothing is broadcast and no pair of rows is made.
    Products in single precision tell which pairs can be among the k; these are
    compared in double. With ``skip_own`` queries are vectors of the table: one
    is not its own neighbour.
    """
    parts = max(1, -(-vectors.count() // part))
    blocks = max(1, -(-queries.count() // block))
    q = queries.select(F.col("query_id").alias("id"), "model", "vector", F.lit(True).alias("asks"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("vb"))
    v = vectors.select(F.col("vec_id").alias("id"), "model", "vector", F.lit(False).alias("asks"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("qb"), F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("vb"))
    near_by = 1e-5  # more than single precision is off

    def cut(a: np.ndarray, b: np.ndarray, s: np.ndarray, ids: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best k of each query a; floor: what its k-th has."""
        order = np.lexsort((ids[b], -s, a))
        a, b, s = a[order], b[order], s[order]
        n = np.bincount(a, minlength=len(floor))
        nth = np.arange(len(a)) - (np.cumsum(n) - n)[a]
        last = nth == k - 1
        floor[a[last]] = np.maximum(floor[a[last]], s[last])
        return a[nth < k], b[nth < k], s[nth < k]

    def run(f: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "similarity": np.zeros(0)})]
        x = np.stack(f["vector"].to_numpy()).astype(np.float64)
        x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
        asks, ids = f["asks"].to_numpy(), f["id"].to_numpy()
        vi, vx, qi, qx = ids[~asks], x[~asks], ids[asks], x[asks]
        if not len(vi) or not len(qi):
            return out[0]
        small = vx.astype(np.float32)
        for i in range(0, len(qi), 512):
            own, mine = qx[i : i + 512], qi[i : i + 512]
            single, floor = own.astype(np.float32), np.full(len(mine), least)
            a, b, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            for j in range(0, len(vi), 8192):
                near = single @ small[j : j + 8192].T
                if skip_own:
                    r = np.flatnonzero(np.isin(mine, vi[j : j + 8192]))
                    r, c = r[(e := np.nonzero(mine[r][:, None] == vi[None, j : j + 8192]))[0]], e[1]
                    near[r, c] = -3
                low = floor - near_by
                if not j and near.shape[1] >= k:
                    low = np.maximum(low, np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k] - near_by)
                na, nb = np.nonzero(near >= np.maximum(low, -2).astype(np.float32)[:, None])
                for m in range(0, len(na), 65_536):
                    ma, mb = na[m : m + 65_536], nb[m : m + 65_536] + j
                    ms = np.round(np.einsum("ij,ij->i", own[ma], vx[mb]), 9)
                    ok = ms >= floor[ma]
                    a, b, s = cut(np.concatenate([a, ma[ok]]), np.concatenate([b, mb[ok]]), np.concatenate([s, ms[ok]]), vi, floor)
            out.append(pd.DataFrame({"query_id": mine[a], "vec_id": vi[b], "similarity": s}))
        return pd.concat(out, ignore_index=True)

    near = q.unionByName(v).groupBy("model", "qb", "vb").applyInPandas(run, "query_id long, vec_id long, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def fuse(keyword: DataFrame, vector: DataFrame, wk: float = 0.5, wv: float = 0.5, k: int = RRF_K, use_rrf: bool = True) -> DataFrame:
    """Full outer join of two ranked lists (query_id, document_id, block_id,
    score, rank). Missing ranks are one after the last. Weights outside 0..1
    are ignored. ``use_rrf`` false adds the weighted scores instead."""
    wk = wk if 0 <= wk <= 1 else 0.5
    wv = wv if 0 <= wv <= 1 else 0.5
    on = ["query_id", "document_id", "block_id"]
    a = keyword.select(*on, F.col("score").alias("keyword_score"), F.col("rank").alias("kr"))
    b = vector.select(*on, F.col("score").alias("vector_score"), F.col("rank").alias("vr"))
    per = Window.partitionBy("query_id")
    j = a.join(b, on, "full_outer")
    j = j.withColumn("keyword_rank", F.coalesce("kr", F.count("kr").over(per) + 1)).withColumn("vector_rank", F.coalesce("vr", F.count("vr").over(per) + 1))
    zero = F.lit(0.0)
    if use_rrf:
        s = wk / (k + F.col("keyword_rank")) + wv / (k + F.col("vector_rank"))
    else:
        s = wk * F.coalesce("keyword_score", zero) + wv * F.coalesce("vector_score", zero)
    return j.select(*on, F.coalesce("keyword_score", zero).alias("keyword_score"), F.coalesce("vector_score", zero).alias("vector_score"), "keyword_rank", "vector_rank", s.alias("score"))


def normalized(scores: DataFrame, by: str = "score", group: str = "query_id") -> DataFrame:
    """Scores divided by the best of their group, where that is above 0."""
    best = F.max(by).over(Window.partitionBy(group))
    return scores.withColumn(by, F.when(best > 0, F.col(by) / best).otherwise(F.col(by)))


def diversified(hits: DataFrame, per_document: int, by: str = "score") -> DataFrame:
    """At most so many hits of a document per query, the best ones."""
    w = Window.partitionBy("query_id", "document_id").orderBy(F.desc(by), "block_id")
    return hits.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= per_document).drop("nth")


def cited(hits: DataFrame, by: str = "score") -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc(by), "document_id", "block_id")
    return hits.withColumn("citation", F.format_string("[%d]", F.row_number().over(w)))


def hybrid(keyword: DataFrame, vector: DataFrame | None, limit: int = 10, min_score: float = 0.0, mode: str = "hybrid", **weights) -> DataFrame:
    """Each branch gives its best 2 x limit; fused, normalized, cut at the least
    score, then limited. Without vectors it is the keyword search."""
    if mode == "keyword" or vector is None:
        return top(normalized(keyword).filter(F.col("score") >= min_score), limit)
    if mode == "semantic":
        return top(normalized(vector).filter(F.col("score") >= min_score), limit)
    f = fuse(top(keyword, 2 * limit), top(vector, 2 * limit), **weights)
    return top(normalized(f).withColumn("score", F.round("score", 9)).filter(F.col("score") >= min_score), limit)


def context(blocks: DataFrame, window: int = 2) -> DataFrame:
    """blocks with ``before`` and ``after``: the ids of so many neighbours."""
    w = Window.partitionBy("document_id").orderBy("sequence", "block_id")
    take = lambda a, b: F.collect_list("block_id").over(w.rowsBetween(a, b))
    return blocks.withColumn("before", take(-window, -1)).withColumn("after", take(1, window))


def numbered(blocks: DataFrame) -> DataFrame:
    """blocks with ``at``, their place in their document from 1."""
    w = Window.partitionBy("document_id").orderBy("sequence", "block_id")
    return blocks.withColumn("at", F.row_number().over(w))


def with_metadata(hits: DataFrame, documents: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """hits with the document's name, source, external id and tags."""
    out = hits.join(documents.select("document_id", F.col("name").alias("document_name"), "source", "external_id"), "document_id", "left")
    if tags is None:
        return out
    t = tags.groupBy("document_id").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("tag_key", "tag_value")))).alias("tags"))  # a document's few tags
    return out.join(t, "document_id", "left")


def with_images(hits: DataFrame, images: DataFrame) -> DataFrame:
    """hits with the references of the images of their block."""
    ref = F.concat(F.lit("images/"), F.col("image_id"), F.lit("."), F.col("format"))
    i = images.groupBy("document_id", "block_id").agg(F.array_sort(F.collect_list(ref)).alias("images"))
    return hits.join(i, ["document_id", "block_id"], "left")


def images_of_section(images: DataFrame, blocks: DataFrame, section: Column) -> DataFrame:
    b = blocks.filter(section).select("document_id", "block_id")
    return images.join(b, ["document_id", "block_id"], "left_semi")


def images_by_section(images: DataFrame) -> DataFrame:
    """(document_id, section, images): references to the images of a section."""
    ref = F.concat(F.lit("images/"), F.col("image_id"), F.lit("."), F.col("format"))
    i = images.filter("section is not null and section <> ''")
    return i.groupBy("document_id", "section").agg(F.array_sort(F.collect_set(ref)).alias("images"))
