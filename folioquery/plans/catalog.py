"""Every query of the core, by name. The SQL that must give the same rows is in
plans.oracle; queries without one are tested by round trip or brute force."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioquery.functions import text as T
from folioquery.functions import tokens as K
from folioquery.functions import vectors as V
from folioquery.operators import chunking, embedding, incremental, lifecycle, search, store, unified, vectorindex
from folioquery.operators import filters as flt
from folioquery.operators import index as ix
from folioquery.plans.oracle import SQL
from folioquery.session import new_path, table, written

MODEL_SIZES = {"quill-embed-96": 96, "quill-embed-64": 64}
QUERY = "the annual report and the legal contract"


# --- the store's tables, from the driver's -------------------------------------
def docs(spark, d):
    return table(spark, d, "documents")


def blocks(spark, d):
    return ix.unique_blocks(table(spark, d, "content_blocks"))


def posts(spark, d):
    return ix.unique_postings(table(spark, d, "search_terms"))


def stats(spark, d):
    return ix.unique_stats(table(spark, d, "document_stats"))


def tags(spark, d):
    t = docs(spark, d).select("document_id", F.explode(F.create_map(F.lit("lang"), F.col("lang"), F.lit("format"), F.col("format"), F.lit("batch"), F.col("batch_no").cast("string"))).alias("tag_key", "tag_value"))
    return t.filter("tag_value is not null")


def vecs(spark, d):
    v = table(spark, d, "vectors").filter("vec_id is not null")
    size = F.when(F.col("model") == "quill-embed-96", 96).when(F.col("model") == "quill-embed-64", 64)
    return v.filter(V.usable(F.col("vector"), size)).dropDuplicates(["vec_id"])


def headings(spark, d):
    """blocks with what a boost needs, so that no content is shuffled."""
    return ix.unique_blocks(table(spark, d, "content_blocks").select("document_id", "block_id", "block_key", "is_heading"))


def one_query(spark, text=QUERY):
    return spark.createDataFrame([(0, text)], "query_id long, query_text string")


def bm25(spark, d, queries):
    return search.bm25(queries, posts(spark, d), stats(spark, d))


def best(spark, d, n, **opts):
    """The best n hits of each stored query."""
    return search.best(table(spark, d, "search_queries"), posts(spark, d), stats(spark, d), n, **opts)


# --- index ----------------------------------------------------------------------
def block_split(spark, d):
    return ix.split_lines(docs(spark, d)).select("doc_id", "sequence", "block_id", "content")


def tokenize(spark, d):
    return ix.tokenized(blocks(spark, d))


def stem_vocab(spark, d):
    return T.stemmed_vocabulary(ix.tokenized(blocks(spark, d), stop_words=False), "token")


def _postings(p):
    return p.select("term", "document_id", "block_id", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"), F.round("tf", 6).alias("tf"))


def postings(spark, d):
    return _postings(ix.postings(blocks(spark, d), stemming=False))


def postings_stemmed(spark, d):
    return _postings(ix.postings(blocks(spark, d)))


def relative_position(spark, d):
    return ix.relative_position(blocks(spark, d)).select("document_id", "block_id", F.round("percent", 6).alias("percent"))


def doc_stats(spark, d):
    b = blocks(spark, d)
    s = ix.document_stats(b, ix.postings(b, stemming=False))
    return s.select("document_id", "total_terms", "unique_terms", F.round("avg_block_length", 6).alias("avg_block_length"))


def corpus_stats(spark, d):
    s = ix.corpus_stats(stats(spark, d))
    return s.select("total_documents", F.round("avg_doc_length", 6).alias("avg_doc_length"), F.round("avg_block_length", 6).alias("avg_block_length"))


def doc_frequency(spark, d):
    return ix.document_frequency(posts(spark, d))


def keywords_topn(spark, d):
    return ix.keywords(blocks(spark, d), 5).select("document_id", "keyword", "n", "rank")


def section_propagation(spark, d):
    return ix.sections(blocks(spark, d), F.coalesce("is_heading", F.lit(False))).select("document_id", "block_id", F.col("section_now").alias("section"))


def keyword_scope(spark, d):
    return ix.keyword_scope(blocks(spark, d)).select("document_id", "block_id", "scope")


def page_estimate(spark, d):
    lines = ix.split_lines(docs(spark, d))
    n = lines.groupBy("doc_id").agg(F.count("*").alias("total"))
    p = docs(spark, d).select("doc_id", F.greatest(F.coalesce("page_count", F.lit(1)), F.lit(1)).alias("pages"))
    return ix.placed(lines.join(n, "doc_id").join(p, "doc_id"), "total", "pages").select("doc_id", "sequence", F.col("page_now").alias("page"), F.col("y_now").alias("y"))


# --- text -----------------------------------------------------------------------
def heading_detect(spark, d):
    b = blocks(spark, d)
    return b.select("document_id", "block_id", T.is_heading(F.col("content"), F.col("font.size"), F.col("font.bold")).alias("heading"), T.is_page_heading(F.col("content"), F.col("font.size"), F.col("font.name")).alias("page_heading"))


def heading_level(spark, d):
    b = blocks(spark, d)
    return b.select("document_id", "block_id", T.heading_level(F.col("font.size"), T.is_bold(F.col("font.name"))).alias("level"), T.is_italic(F.col("font.name")).alias("italic"))


def list_detect(spark, d):
    return blocks(spark, d).select("document_id", "block_id", T.is_list_item(F.col("content")).alias("item"))


def query_type(spark, d):
    q = table(spark, d, "search_queries")
    kind = T.query_kind(F.col("query_text"))
    return q.select("query_id", kind.alias("kind"), T.suggested_mode(kind).alias("mode"), T.described(kind).alias("description"))


def snippets(spark, d):
    return blocks(spark, d).select("document_id", "block_id", T.snippet(F.col("content"), F.lit("the"), "<b>", "</b>").alias("snippet"))


def highlights(spark, d):
    return docs(spark, d).select("doc_id", T.highlighted(F.col("text"), ["report", "contract", "annual"], "<b>", "</b>").alias("snippet"))


def normalize_text(spark, d):
    return blocks(spark, d).select("document_id", "block_id", T.normalized(F.col("content")).alias("text"))


def token_estimate(spark, d):
    return docs(spark, d).select("doc_id", K.estimate(F.col("text")).alias("tokens"))


def token_truncate(spark, d):
    return docs(spark, d).select("doc_id", K.truncated(F.col("text"), 40).alias("text"))


def token_budget(spark, d):
    b = blocks(spark, d).select("document_id", "block_id", "sequence", K.estimate_block(F.col("content"), F.col("section")).alias("tokens"))
    return K.within_budget(b, "tokens", 60, ["document_id"], ["sequence", "block_id"]).select("document_id", "block_id", "used", "kept")


def text_hash(spark, d):
    return blocks(spark, d).select("document_id", "block_id", V.text_hash(F.col("content")).alias("text_hash"))


def word_excerpt(spark, d):
    return blocks(spark, d).select("document_id", "block_id", T.excerpt(F.col("content"), F.lit(3), 2).alias("excerpt"))


def file_formats(spark, d):
    return docs(spark, d).select("doc_id", T.file_format(F.coalesce("original_path", "name")).alias("kind"), T.or_default(F.col("external_id"), "none").alias("external"), T.image_format(F.col("format")).alias("image"))


# --- filters ----------------------------------------------------------------------
def filter_sources(spark, d):
    return flt.Filter(sources=["crm_notes", "pdf"]).apply(docs(spark, d)).select("doc_id")


def filter_tags_and(spark, d):
    return flt.Filter(tags={"lang": "en", "format": "pdf"}).apply(docs(spark, d), tags(spark, d)).select("doc_id")


def filter_tags_negated(spark, d):
    return flt.Filter(tags={"lang": "!en", "format": "pdf"}).apply(docs(spark, d), tags(spark, d)).select("doc_id")


def filter_dsl(spark, d):
    f = flt.Filter(formats=["pdf", "docx"], after=datetime(2025, 6, 1), before=datetime(2026, 3, 1), min_pages=2, max_pages=40)
    return f.apply(docs(spark, d)).select("doc_id")


def filter_has_embeddings(spark, d):
    return flt.Filter(has_embeddings=True).apply(docs(spark, d), vectors=table(spark, d, "vectors")).select("doc_id")


def block_filters(spark, d):
    return blocks(spark, d).filter(flt.block_filter(pages=(1, 2), types=["text", "list"])).select("document_id", "block_id")


def search_filtered(spark, d):
    """Documents are filtered before ranking, so the best of what is left come out."""
    kept = flt.Filter(sources=["crm_notes", "wiki_export"]).apply(docs(spark, d))
    return best(spark, d, 5, kept=kept).select("query_id", "document_id", "block_id", F.round("score", 6).alias("score"), "rank")


# --- search -----------------------------------------------------------------------
def _scores(df):
    return df.select("query_id", "document_id", "block_id", F.round("score", 6).alias("score"), "rank")


def bm25_topk(spark, d):
    return _scores(search.top(bm25(spark, d, one_query(spark)), 20))


def bm25_batch(spark, d):
    return _scores(best(spark, d, 10))


def bm25_heading_boost(spark, d):
    return _scores(best(spark, d, 10, blocks=headings(spark, d)))


def bm25_min_score(spark, d):
    return _scores(best(spark, d, 10, blocks=headings(spark, d), min_score=1.0))


def boolean_search(spark, d):
    return search.boolean_matches(posts(spark, d), "sheet AND copy NOT manual")


def phrase_search(spark, d):
    return search.boolean_matches(posts(spark, d), '"belongs to"')


def _asking(spark, d):
    v = vecs(spark, d)
    return v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "model", "vector"), v.select("vec_id", "model", "vector")


def knn_batch(spark, d):
    q, v = _asking(spark, d)
    return search.nearest(q, v, 5).select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


def knn_min_similarity(spark, d):
    q, v = _asking(spark, d)
    return search.nearest(q, v, 10, least=0.8).select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


def knn_filtered(spark, d):
    q, _ = _asking(spark, d)
    kept = flt.Filter(sources=["crm_notes", "wiki_export"]).apply(docs(spark, d))
    return search.nearest(q, flt.restricted(vecs(spark, d), kept).select("vec_id", "model", "vector"), 5).select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


def _branches(spark, d):
    """The two stored lists of each query."""
    h = table(spark, d, "search_hits").filter("score is not null and not isnan(score) and score < double('Infinity') and score > double('-Infinity')")
    best = h.groupBy("query_id", "branch", "document_id", "block_id").agg(F.max("score").alias("score"))
    best = written(best, "branches")
    of = lambda b: best.filter(F.col("branch") == b).drop("branch")
    return of("keyword"), of("vector")


def _each(spark, d, f):
    """f of both lists, with the list's name."""
    k, v = _branches(spark, d)
    return f(k).withColumn("branch", F.lit("keyword")).unionByName(f(v).withColumn("branch", F.lit("vector")))


def rrf_fusion(spark, d):
    k, v = _branches(spark, d)
    f = search.fuse(search.top(k), search.top(v))
    return f.select("query_id", "document_id", "block_id", "keyword_rank", "vector_rank", F.round("score", 9).alias("score"))


def weighted_fusion(spark, d):
    k, v = _branches(spark, d)
    f = search.fuse(search.top(k), search.top(v), 0.3, 0.7, use_rrf=False)
    return f.select("query_id", "document_id", "block_id", F.round("score", 6).alias("score"))


def fused_lists(spark, d):
    """The stored lists, each cut at twice the limit, as a hybrid search takes them."""
    k, v = _branches(spark, d)
    return search.hybrid(k, v, 10, min_score=0.2).select("query_id", "document_id", "block_id", F.round("score", 6).alias("score"), "rank")


def score_normalize(spark, d):
    return _each(spark, d, search.normalized).select("branch", "query_id", "document_id", "block_id", F.round("score", 6).alias("score"))


def diversify(spark, d):
    return _each(spark, d, lambda x: search.diversified(search.top(x), 2)).select("branch", "query_id", "document_id", "block_id", "rank")


def citations(spark, d):
    return _each(spark, d, search.cited).select("branch", "query_id", "document_id", "block_id", "citation")


# --- end to end
WHOLE = embedding.HashProvider(unit=False)  # whole numbers, so that any engine gets the same


def _store(spark, d):
    b = written(blocks(spark, d), "blocks")
    e = b.filter(lifecycle.embeddable()).select(F.col("block_key").alias("vec_id"), "document_id", "block_id", "content")
    v = embedding.embedded(e, WHOLE).drop("content")
    i = b.filter("type = 'image'").select(F.concat_ws("_", "document_id", "block_id").alias("image_id"), "document_id", "section", F.lit("png").alias("format"))
    return unified.Tables(docs(spark, d), b, posts(spark, d), stats(spark, d), written(v, "vectors"), tags(spark, d), i)


def _asked(spark, d):
    return table(spark, d, "search_queries").select("query_id", "query_text")


def hybrid_search(spark, d):
    """Queries as texts against the whole store: both branches, fused, with
    snippets, context, images and metadata."""
    o = unified.Options(min_score=0.2, context_window=1, images=True, metadata=True, max_per_document=2)
    r = unified.search_store(_asked(spark, d), _store(spark, d), o, WHOLE)
    ids = F.array_join(F.transform("context", lambda x: x["block_id"]), ",")
    return r.select("query_id", "document_id", "block_id", F.round("score", 6).alias("score"), "rank", "snippet", "page", "section", "source", F.col("tags")["lang"].alias("lang"), ids.alias("context"), F.coalesce(F.array_join("images", ","), F.lit("")).alias("images"))


def agent_search(spark, d):
    """The answer for an agent: intent, citations, tokens with context, totals."""
    r = unified.for_agents(_asked(spark, d), _store(spark, d), unified.Options(max_results=5, context_window=1), WHOLE)
    return r.select("query_id", "kind", "mode", "citation", "document_id", "block_id", "tokens", "total_tokens")


def search_in_document(spark, d):
    t = _store(spark, d)
    first = t.blocks.agg(F.min("document_id")).first()[0]
    r = unified.search_in_document(first or "", _asked(spark, d), t, unified.Options(max_results=3), WHOLE)
    return r.select("query_id", "document_id", "block_id", F.round("score", 6).alias("score"), "rank")


def semantic_search(spark, d):
    r = unified.ranked(_asked(spark, d), _store(spark, d), unified.Options(mode="semantic", max_results=5), WHOLE)
    return r.select("query_id", "document_id", "block_id", F.round("score", 6).alias("score"), "rank")


def search_diagnostics(spark, d):
    return unified.diagnosed(_asked(spark, d), _store(spark, d), unified.Options(min_score=0.6), WHOLE)


def context_window(spark, d):
    c = search.context(blocks(spark, d), 2)
    return c.select("document_id", "block_id", F.array_join("before", ",").alias("before"), F.array_join("after", ",").alias("after"))


def metadata_join(spark, d):
    m = _each(spark, d, lambda x: search.with_metadata(search.top(x), docs(spark, d), tags(spark, d)))
    return m.select("branch", "query_id", "document_id", "block_id", "document_name", "source", "external_id", F.col("tags")["lang"].alias("lang"))


def image_blocks(spark, d):
    """Images of the blocks in a section, joined by document and block."""
    b = blocks(spark, d)
    images = b.filter("type = 'image'").select(F.concat_ws("_", "document_id", "block_id").alias("image_id"), "document_id", "block_id", F.lit("png").alias("format"))
    kept = search.images_of_section(images, b, F.col("section").isNotNull())
    return search.with_images(kept, images).select("document_id", "block_id", F.array_join("images", ",").alias("images"))


# --- chunks -----------------------------------------------------------------------
def _chunks(spark, d, **opts):
    return chunking.chunked(docs(spark, d), "doc_id", "text", chunking.ChunkOptions(**opts))


def chunk_paragraph(spark, d):
    return _chunks(spark, d, max_tokens=128)


def chunk_sentence(spark, d):
    return _chunks(spark, d, max_tokens=128, overlap_tokens=16, chunk_by="sentence")


def chunk_tokens(spark, d):
    return _chunks(spark, d, max_tokens=128, overlap_tokens=16, chunk_by="tokens")


def chunk_text(spark, d):
    return chunking.embedding_pieces(docs(spark, d), "doc_id", "text", 1000, 100)


def chunk_blocks(spark, d):
    b = blocks(spark, d).select("document_id", "sequence", "block_id", K.estimate_block(F.col("content"), F.col("section")).alias("tokens"))
    return chunking.grouped_rows(b, "document_id", ["sequence", "block_id"], "tokens", 64, alone=True)


def chunk_hits(spark, d):
    b = blocks(spark, d).select("document_id", "block_id", K.estimate(F.col("content")).alias("tokens"))
    return _each(spark, d, lambda x: chunking.grouped_rows(search.top(x).join(b, ["document_id", "block_id"]), "query_id", ["rank"], "tokens", 64))


def combine_blocks(spark, d):
    b = blocks(spark, d).select("document_id", "sequence", "content", F.floor(F.col("sequence") / 5).alias("part"))
    return chunking.combined(b, ["document_id", "part"], "sequence", "content")


def vector_index(spark, d):
    """Whether the persistent index finds nine tenths of the five nearest."""
    q, v = _asking(spark, d)
    one = F.col("model") == "quill-embed-96"
    index = vectorindex.VectorIndex(spark, new_path(spark, "vectors"), 96, cell_size=200)
    late = F.pmod(F.col("vec_id"), F.lit(10)) == 0
    index.build(v.filter(one & ~late))
    index.add(v.filter(one & late))
    got = index.search(q.filter(one).select("query_id", "vector"), 6, probes=24).filter("query_id <> vec_id").select("query_id", "vec_id")
    want = search.nearest(q.filter(one), v.filter(one), 5, least=0.5).select("query_id", "vec_id")
    return want.join(got.withColumn("hit", F.lit(1)), ["query_id", "vec_id"], "left").agg((F.coalesce(F.sum("hit"), F.lit(0)) >= 0.9 * F.count("*")).alias("enough"))


# --- lifecycle --------------------------------------------------------------------
def content_hash(spark, d):
    return lifecycle.content_hashes(blocks(spark, d))


def dedup_checksum(spark, d):
    return lifecycle.duplicates(docs(spark, d), "checksum", "checksum")


def dedup_content(spark, d):
    """Contents of documents by their whole texts, a block a line."""
    lines = ix.split_lines(docs(spark, d), "document_id").withColumn("type", F.lit("text"))
    return lifecycle.duplicates(lifecycle.content_hashes(lines), "content_hash", "content_hash")


def similar_documents(spark, d):
    x = docs(spark, d)
    return lifecycle.alike(x, x.filter("doc_id % 20 = 0"))


def pending_documents(spark, d):
    return lifecycle.pending(docs(spark, d), table(spark, d, "vectors")).select("document_id")


def incomplete_embeddings(spark, d):
    return lifecycle.incomplete(blocks(spark, d), table(spark, d, "vectors"))


def unembedded_blocks(spark, d):
    return lifecycle.unembedded(blocks(spark, d), table(spark, d, "vectors")).select("document_id", "block_id")


def embedding_status(spark, d):
    return lifecycle.status(blocks(spark, d), table(spark, d, "vectors")).withColumn("progress", F.round("progress", 6))


def missing_block_embeddings(spark, d):
    return lifecycle.missing(blocks(spark, d), table(spark, d, "vectors"))


def needs_reembedding(spark, d):
    return lifecycle.stale(blocks(spark, d), table(spark, d, "vectors"))


def source_stats(spark, d):
    return lifecycle.by_source(docs(spark, d), blocks(spark, d), table(spark, d, "vectors"))


def vector_info(spark, d):
    return lifecycle.vector_info(table(spark, d, "vectors"))


def last_import(spark, d):
    return lifecycle.last_import(docs(spark, d))


def store_stats(spark, d):
    return lifecycle.store_stats(docs(spark, d), blocks(spark, d), table(spark, d, "search_terms"), table(spark, d, "vectors"))


def health(spark, d):
    return lifecycle.health(docs(spark, d), blocks(spark, d), table(spark, d, "vectors"))


def upsert_latest(spark, d):
    x = docs(spark, d).select("document_id", "source", "external_id", "name", "created_at", "imported_at", "batch_no")
    return lifecycle.upserted(x.filter("batch_no = 0").drop("batch_no"), x.filter("batch_no > 0").drop("batch_no")).select("document_id", "source", "external_id", "created_at")


def token_totals(spark, d):
    return lifecycle.token_totals(blocks(spark, d))


# --- the store: every table as saved, replaced, deleted, read again
def _saved(spark, d):
    """Batch 0, then the other batches with new names for a tenth of batch 0."""
    at = store.Store(spark, new_path(spark, "store"))
    x, b, t = docs(spark, d), table(spark, d, "content_blocks"), tags(spark, d)
    old = F.coalesce("batch_no", F.lit(0)) == 0
    again = x.filter(old & (F.pmod(F.col("doc_id"), F.lit(10)) == 0)).withColumn("name", F.concat(F.lit("renamed "), F.col("doc_id")))
    at.save("first", x.filter(old), b, t, stemming=False)
    at.save("second", x.filter(~old).unionByName(again), b, t, stemming=False)
    return at


def store_documents(spark, d):
    return _saved(spark, d).table("documents").select("document_id", "name", "source", "external_id", "page_count", "created_at")


def store_deleted(spark, d):
    """Rows of every table after the documents of a source were deleted."""
    at = _saved(spark, d)
    at.save_vectors("vectors", table(spark, d, "vectors"))
    at.delete("gone", docs(spark, d).filter("source = 'wiki_export'"))
    count = lambda n: at.table(n).agg(F.count("*").alias("n")).select(F.lit(n).alias("what"), "n")
    out = count("documents")
    for n in ("blocks", "tags", "postings", "stats", "vectors"):
        out = out.unionByName(count(n))
    return out


def store_tags(spark, d):
    """Tags of the pdf files replaced by one."""
    at = store.Store(spark, new_path(spark, "store"))
    x = docs(spark, d)
    at.save("first", x, tags=tags(spark, d))
    at.set_tags("new", x.filter("format = 'pdf'").select("document_id", F.lit("kind").alias("tag_key"), F.lit("file").alias("tag_value")))
    return at.table("tags")


def store_touched(spark, d):
    at = store.Store(spark, new_path(spark, "store"))
    x = docs(spark, d)
    at.save("first", x)
    at.touch("hash", x.filter("content_hash is null"), content_hash=F.concat(F.lit("new:"), F.col("document_id")))
    return at.table("documents").select("document_id", "content_hash", "source")


def embed_pending(spark, d):
    """A job embeds what has no vector of its present text; its keys and hashes."""
    at = store.Store(spark, new_path(spark, "store"))
    at.save("first", docs(spark, d), table(spark, d, "content_blocks"), stemming=False)
    at.save_vectors("vectors", table(spark, d, "vectors"))
    at.embed("job", embedding.HashProvider())
    return at.table("vectors").filter("model = 'hash-embed'").select("document_id", "block_id", "chunk_idx", "text_hash", "dimension")


def embed_repaired(spark, d):
    """After a repair no block waits, and no vector lacks its block."""
    at = store.Store(spark, new_path(spark, "store"))
    at.save("first", docs(spark, d), table(spark, d, "content_blocks"), stemming=False)
    at.save_vectors("vectors", table(spark, d, "vectors"))
    at.repair("mend", embedding.HashProvider())
    return at.waiting().agg(F.count("*").alias("waiting")).crossJoin(lifecycle.health(at.table("documents"), at.table("blocks"), at.table("vectors")).select("orphans", "incomplete"))  # one row each


def pending_first(spark, d):
    at = store.Store(spark, new_path(spark, "store"))
    at.save("first", docs(spark, d))
    at.save_vectors("vectors", table(spark, d, "vectors"))
    return at.pending(25)


def paged_blocks(spark, d):
    return store.ordered(blocks(spark, d), 50, 100).select("document_id", "block_id", "position")


def lookups(spark, d):
    """By id, by external id, by hash: what each finds for one document."""
    at = store.Store(spark, new_path(spark, "store"))
    x = docs(spark, d)
    at.save("first", x)
    one = x.filter("external_id <> '' and content_hash <> '' and source is not null").orderBy("doc_id").select("document_id", "source", "external_id", "content_hash").first()
    if one is None:
        return spark.createDataFrame([], "how string, document_id string")
    found = {"id": at.document(one[0]), "external": at.by_external_id(one[1], one[2]), "hash": at.by_hash(one[3])}
    out = None
    for how, df in found.items():
        rows = df.select(F.lit(how).alias("how"), "document_id")
        out = rows if out is None else out.unionByName(rows)
    return out


def ordered_documents(spark, d):
    """Documents by time of change, the newest first, with their place."""
    x = docs(spark, d).filter("updated_at is not null").orderBy(F.desc("updated_at"), "document_id").limit(100)
    return x.select("document_id", F.row_number().over(Window.orderBy(F.desc("updated_at"), "document_id")).alias("position"))


def delete_cascade(spark, d):
    gone = docs(spark, d).filter("source = 'wiki_export'")
    count = lambda name, df: lifecycle.without(df, gone).agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
    return count("documents", docs(spark, d)).unionByName(count("blocks", blocks(spark, d))).unionByName(count("postings", posts(spark, d)))


def embed_hash(spark, d):
    """Every embeddable block through the offline provider."""
    b = blocks(spark, d).filter(lifecycle.embeddable()).select("document_id", "block_id", "content")
    return embedding.embedded(b, embedding.HashProvider()).select("document_id", "block_id", "vector", "model", "dimension", "error")


def parsed_files(spark, d):
    """Every document written as a file and parsed again (a round trip)."""
    from folioquery.sources import files, maker

    return files.parsed(maker.made(docs(spark, d).filter("text is not null").select("doc_id", "text"))).select("path", "sequence", "type", "content", "error")


def parsed_texts(spark, d):
    """The contents of parsed_files."""
    return parsed_files(spark, d).select("path", "sequence", "content", "error")


def stream_last_event(spark, d):
    from folioquery.streaming import ingest

    schema = table(spark, d, "events").schema
    s = ingest.source(spark, d, schema, "events.parquet")
    return ingest.last_times(s, new_path(spark, "stream"), "event_type", "ts")


def p5_found(spark, d):
    """The deliveries of all batches but the last, then all of them: the second
    run recomputes what the last batch changed."""
    x, runs, at = docs(spark, d), table(spark, d, "import_runs"), new_path(spark, "p5")
    last = F.coalesce("batch_no", F.lit(0)) == 8
    incremental.next_run(x.filter(~last), runs, at)
    return incremental.next_run(x, runs, at).select("doc_id")


HELPERS = {"Window", "docs", "blocks", "headings", "posts", "stats", "tags", "vecs", "one_query", "bm25", "best", "table", "new_path", "written", "queries", "oracle_sql"}


def queries() -> dict:
    return {k: f for k, f in globals().items() if callable(f) and k[0] != "_" and k not in HELPERS and getattr(f, "__module__", "") == __name__}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
