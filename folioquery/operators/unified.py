"""End-to-end search: texts of queries against a whole store, in one plan.

Documents are filtered first. Each branch ranks what is left: BM25 over the
postings, and the nearest block vectors of the query's text, which a provider
embeds. The lists are fused, normalized, cut and limited; then hits get their
texts, snippets, context, images of their section, metadata and tags."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioquery.errors import InvalidQuery
from folioquery.functions import text as T
from folioquery.functions import tokens as K
from folioquery.functions import vectors as V
from folioquery.operators import embedding, search
from folioquery.operators.filters import Filter, restricted
from folioquery.schemas import MODES
from folioquery.session import written


@dataclass(frozen=True)
class Tables:
    """What a search reads. blocks: one row per (document_id, block_id).
    vectors: vec_id, document_id, block_id, model, vector. tags: document_id,
    tag_key, tag_value. images: image_id, document_id, section, format."""

    documents: DataFrame
    blocks: DataFrame
    postings: DataFrame
    stats: DataFrame
    vectors: DataFrame | None = None
    tags: DataFrame | None = None
    images: DataFrame | None = None


@dataclass(frozen=True)
class Options:
    mode: str = "hybrid"
    max_results: int = 10
    min_score: float = 0.0
    keyword_weight: float = 0.5
    vector_weight: float = 0.5
    use_rrf: bool = True
    stemming: bool = False
    stop_words: bool = True
    heading_boost: bool = False
    min_similarity: float = 1e-6  # vectors below are no hits
    where: Filter = field(default_factory=Filter)
    max_per_document: int = 0  # 0: any number
    context_window: int = 0
    images: bool = False
    metadata: bool = False
    pre: str = ""
    post: str = ""

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise InvalidQuery(f"no mode {self.mode!r}")


def keyword_hits(queries: DataFrame, tables: Tables, kept: DataFrame | None, o: Options) -> DataFrame:
    """(query_id, document_id, block_id, score) by BM25 in the documents kept, as
    many as enter the fusion. Frequencies are those of the whole store."""
    return search.best(queries, tables.postings, tables.stats, 2 * o.max_results, o.stop_words, o.stemming, kept, tables.blocks if o.heading_boost else None).drop("rank")


def vector_hits(queries: DataFrame, tables: Tables, kept: DataFrame | None, o: Options, provider: embedding.Provider) -> DataFrame:
    """(query_id, document_id, block_id, score): a block counts with its nearest
    chunk. Only vectors of the provider's model are compared."""
    asked = queries.filter(F.trim(F.coalesce("query_text", F.lit(""))) != "").select("query_id", "query_text")
    q = embedding.embedded(asked, provider, "query_text").filter(V.usable(F.col("vector"), provider.dimension))
    v = tables.vectors.filter((F.col("model") == provider.name) & V.usable(F.col("vector"), provider.dimension))
    v = v if kept is None else restricted(v, kept)
    near = search.nearest(q.select("query_id", "model", "vector"), v.select("vec_id", "model", "vector"), 2 * o.max_results, o.min_similarity, skip_own=False)
    of = near.join(v.select("vec_id", "document_id", "block_id"), "vec_id")
    return of.groupBy("query_id", "document_id", "block_id").agg(F.max("similarity").alias("score"))


def ranked(queries: DataFrame, tables: Tables, o: Options = Options(), provider: embedding.Provider | None = None) -> DataFrame:
    """(query_id, document_id, block_id, score, rank). Without vectors or a
    provider it is the keyword search. Null and blank queries have no hits."""
    kept = _kept(tables, o)
    k = v = None
    if o.mode != "semantic" or provider is None or tables.vectors is None:
        k = keyword_hits(queries, tables, kept, o)
    if o.mode != "keyword" and provider is not None and tables.vectors is not None:
        v = vector_hits(queries, tables, kept, o, provider)
    return _fused(k, v, o)


def _kept(tables: Tables, o: Options) -> DataFrame | None:
    return None if o.where.is_empty() else o.where.apply(tables.documents, tables.tags, tables.vectors).select("document_id").distinct()


def _fused(k: DataFrame | None, v: DataFrame | None, o: Options) -> DataFrame:
    mode = "keyword" if v is None else "semantic" if k is None else "hybrid"
    return search.hybrid(v if k is None else k, v, o.max_results, o.min_score, mode, wk=o.keyword_weight, wv=o.vector_weight, use_rrf=o.use_rrf).select("query_id", "document_id", "block_id", "score", "rank")


def _around(hits: DataFrame, blocks: DataFrame, window: int) -> DataFrame:
    """hits with ``context``: the blocks (block_id, content) around and including
    theirs, in order. Only documents with hits are sorted."""
    b = blocks.join(hits.select("document_id").distinct(), "document_id", "left_semi")
    at = search.numbered(b)
    found = hits.select("query_id", "document_id", "block_id").join(at.select("document_id", "block_id", "at"), ["document_id", "block_id"])
    found = found.withColumn("at", F.explode(F.sequence(F.col("at") - window, F.col("at") + window))).alias("h")
    near = found.join(at.alias("b"), (F.col("h.document_id") == F.col("b.document_id")) & (F.col("h.at") == F.col("b.at")))
    rows = near.groupBy("h.query_id", "h.document_id", "h.block_id").agg(F.array_sort(F.collect_list(F.struct("b.at", "b.block_id", "b.content"))).alias("context"))
    return hits.join(rows, ["query_id", "document_id", "block_id"], "left")


def enriched(hits: DataFrame, queries: DataFrame, tables: Tables, o: Options = Options()) -> DataFrame:
    """hits with content, page, section and snippet, and by the options context,
    images and metadata; at most ``max_per_document`` of a document."""
    b = tables.blocks.select("document_id", "block_id", "content", "page", "section")
    out = hits.join(b, ["document_id", "block_id"]).join(queries.groupBy("query_id").agg(F.min("query_text").alias("query_text")), "query_id")
    out = out.withColumn("snippet", T.snippet(F.col("content"), F.col("query_text"), o.pre, o.post))
    if o.max_per_document > 0:
        out = search.diversified(out, o.max_per_document)
    if o.context_window > 0:
        out = _around(out, tables.blocks, o.context_window)
    if o.images and tables.images is not None:
        out = out.join(search.images_by_section(tables.images), ["document_id", "section"], "left")
    if o.metadata:
        out = search.with_metadata(out, tables.documents, tables.tags)
    return out


def search_store(queries: DataFrame, tables: Tables, o: Options = Options(), provider: embedding.Provider | None = None) -> DataFrame:
    """Hits of every query (query_id, query_text), complete."""
    return enriched(ranked(queries, tables, o, provider), queries, tables, o)


def search_in_document(document_id: str, queries: DataFrame, tables: Tables, o: Options = Options(), provider: embedding.Provider | None = None) -> DataFrame:
    """search_store within one document."""
    return search_store(queries, tables, replace(o, where=replace(o.where, document_ids=[document_id])), provider)


def for_agents(queries: DataFrame, tables: Tables, o: Options = Options(), provider: embedding.Provider | None = None) -> DataFrame:
    """search_store with the query's ``kind`` and suggested ``mode``, a
    ``citation``, ``tokens`` of the content and its context, and ``total_tokens``
    of the whole answer."""
    s = search.cited(search_store(queries, tables, o, provider))
    n = K.estimate(F.col("content"))
    if o.context_window > 0:
        n = n + F.aggregate(F.transform(F.coalesce("context", F.array().cast("array<struct<at:int,block_id:string,content:string>>")), lambda x: K.estimate(x["content"])), F.lit(0), lambda a, x: a + x)
    kind = T.query_kind(F.col("query_text"))
    s = s.withColumns({"tokens": n.cast("int"), "kind": kind, "mode": T.suggested_mode(kind)})
    return s.withColumn("total_tokens", F.sum("tokens").over(Window.partitionBy("query_id")))


def diagnosed(queries: DataFrame, tables: Tables, o: Options = Options(), provider: embedding.Provider | None = None) -> DataFrame:
    """(query_id, keyword_results, vector_results, returned, filtered_by_score):
    how the answer to every query came about. Results of a branch are those that
    entered the fusion."""
    kept = _kept(tables, o)
    n = lambda df, name: df.groupBy("query_id").agg(F.count("*").alias(name))
    k, v = written(keyword_hits(queries, tables, kept, o), "keyword"), None
    out = queries.select("query_id").distinct().join(n(search.top(k, 2 * o.max_results), "keyword_results"), "query_id", "left")
    if provider is not None and tables.vectors is not None:
        v = written(vector_hits(queries, tables, kept, o, provider), "near")
        out = out.join(n(search.top(v, 2 * o.max_results), "vector_results"), "query_id", "left")
    else:
        out = out.withColumn("vector_results", F.lit(0).cast("long"))
    lists = (None if v is not None and o.mode == "semantic" else k), (None if o.mode == "keyword" else v)
    every = n(_fused(*lists, replace(o, min_score=0.0)), "all")
    out = out.join(n(_fused(*lists, o), "returned"), "query_id", "left").join(every, "query_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select("query_id", zero("keyword_results"), zero("vector_results"), zero("returned"), (F.coalesce("all", F.lit(0)) - F.coalesce("returned", F.lit(0))).cast("long").alias("filtered_by_score"))
