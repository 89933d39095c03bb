"""A store of documents: tables that are saved, replaced and deleted by document.

Every change appends folders of rows with the number of the change, and a list of
the documents (for vectors also blocks) whose older rows it ends. A reader joins
this list, which is as long as what changed since the last ``compact`` and not as
the store, so nothing is rewritten by a change. A marker makes a change visible
with all its tables at once; one that failed has left nothing. Changes have names,
and one of a name that is there is not applied again.

documents are keyed by document_id. created_at survives a replacement. Deleting a
document deletes its rows in all tables. Rows without a document_id are not kept;
of repeated documents in one change the last by updated_at, then name counts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioquery import schemas as S
from folioquery.errors import StoreError
from folioquery.functions import vectors as V
from folioquery.operators import chunking, embedding, lifecycle
from folioquery.operators import index as ix
from folioquery.session import Commits, delete, written

TABLES = {"documents": S.DOCUMENTS, "blocks": S.BLOCKS, "tags": S.TAGS, "images": S.IMAGES, "vectors": S.VECTORS, "postings": S.POSTINGS, "stats": S.DOC_STATS}
ENDED = "what string, document_id string, block_id string"
BY_BLOCK = ("vectors",)


def _names(schema: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(schema + ","):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(schema[start:i].split()[0])
            start = i + 1
    return out


class Store:
    """Tables under ``path`` in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, after: int = 16):
        self.spark, self.path, self.after = spark, path.rstrip("/"), after
        self.commits = Commits(spark, path)

    # --- reading
    def info(self) -> dict:
        """Schema version, the changes applied, and what is kept of them."""
        s = self.commits.last()
        return {"version": s.get("version", S.VERSION), "changes": s.get("applied", []), "folders": {t: len(s.get(t, [])) for t in (*TABLES, "ended")}}

    def _rows(self, state: dict, table: str, schema: str) -> DataFrame:
        parts = [self.spark.read.schema(schema).parquet(f"{self.path}/{table}/{name}").withColumn("change", F.lit(n)) for n, name in state.get(table, [])]
        out = parts[0] if parts else self.spark.createDataFrame([], f"{schema}, change int")
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def table(self, name: str) -> DataFrame:
        """The rows of a table as of the last change."""
        state = self.commits.last()
        rows = self._rows(state, name, TABLES[name])
        ended = self._rows(state, "ended", ENDED).filter(F.col("what") == name)
        whole = ended.filter("block_id is null").groupBy("document_id").agg(F.max("change").alias("ended"))
        live = rows.join(whole, "document_id", "left").filter(F.col("ended").isNull() | (F.col("change") >= F.col("ended"))).drop("ended")
        if name in BY_BLOCK:
            part = ended.filter("block_id is not null").groupBy("document_id", "block_id").agg(F.max("change").alias("ended"))
            live = live.join(part, ["document_id", "block_id"], "left").filter(F.col("ended").isNull() | (F.col("change") >= F.col("ended"))).drop("ended")
        return live.select(*_names(TABLES[name]))

    def document(self, document_id: str) -> DataFrame:
        return self.table("documents").filter(F.col("document_id") == document_id)

    def by_external_id(self, source: str, external_id: str) -> DataFrame:
        return self.table("documents").filter((F.col("source") == source) & (F.col("external_id") == external_id))

    def by_hash(self, value: str, column: str = "content_hash") -> DataFrame:
        return self.table("documents").filter(F.col(column) == value)

    def image(self, image_id: str) -> DataFrame:
        return self.table("images").filter(F.col("image_id") == image_id)

    # --- changing
    def _change(self, name: str, rows: dict[str, DataFrame], ended: DataFrame | Callable[[dict[str, DataFrame]], DataFrame] | None) -> bool:
        """``ended`` may be a function of the rows as they are written, so that
        they are not made a second time, perhaps otherwise."""
        state = self.commits.last()
        if name in state.get("applied", []):
            return False
        n = state.get("change", 0) + 1
        new = dict(state) | {"change": n, "version": S.VERSION, "applied": [*state.get("applied", []), name]}

        def put(table: str, df: DataFrame) -> DataFrame:
            at = uuid.uuid4().hex
            df.write.parquet(f"{self.path}/{table}/{at}")
            new[table] = [*state.get(table, []), [n, at]]
            return self.spark.read.schema(df.schema).parquet(f"{self.path}/{table}/{at}")

        saved = {table: put(table, df) for table, df in rows.items()}
        if ended is not None:
            put("ended", (ended(saved) if callable(ended) else ended).select(*_names(ENDED)))
        self.commits.add(new, state)
        if len(new.get("ended", [])) > self.after:
            self.compact()
        return True

    @staticmethod
    def _fitted(df: DataFrame, schema: str, spark: SparkSession) -> DataFrame:
        """The columns of a schema, in their types; missing ones are null."""
        types = {f.name: f.dataType for f in spark.createDataFrame([], schema).schema}
        return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(types[c]).alias(c) for c in _names(schema)]).filter("document_id is not null")

    def _ends(self, documents: DataFrame, tables: list[str]) -> DataFrame:
        return documents.select("document_id").distinct().select(F.explode(F.array(*map(F.lit, tables))).alias("what"), "document_id", F.lit(None).cast("string").alias("block_id"))

    def save(self, change: str, documents: DataFrame, blocks: DataFrame | None = None, tags: DataFrame | None = None, images: DataFrame | None = None, stemming: bool = True) -> bool:
        """Save documents, replacing those of the same id with their rows in every
        table. With blocks, postings and statistics are made of them. Blocks, tags
        and images of other documents are not taken."""
        d = self._fitted(documents, S.DOCUMENTS, self.spark)
        rest = [c for c in d.columns if c != "document_id"]
        d = d.groupBy("document_id").agg(F.max_by(F.struct(*rest), F.struct("updated_at", "name")).alias("r")).select("document_id", "r.*")
        old = self.table("documents").select("document_id", F.col("created_at").alias("first"))
        d = d.join(old, "document_id", "left").withColumn("created_at", F.least(F.coalesce("first", "created_at"), F.coalesce("created_at", "first"))).drop("first")
        mine = documents.select("document_id").distinct()
        own: Callable[[DataFrame, str], DataFrame] = lambda df, schema: self._fitted(df.join(mine, "document_id", "left_semi"), schema, self.spark)
        rows = {"documents": d}
        if blocks is not None:
            keyed = blocks if "block_key" in blocks.columns else blocks.withColumn("block_key", F.col("sequence").cast("long"))
            b = self._fitted(ix.unique_blocks(keyed.join(mine, "document_id", "left_semi")), S.BLOCKS, self.spark)
            p = ix.postings(b, stemming=stemming)
            rows |= {"blocks": b, "postings": self._fitted(p, S.POSTINGS, self.spark), "stats": self._fitted(ix.document_stats(b, p), S.DOC_STATS, self.spark)}
        if tags is not None:
            rows["tags"] = own(tags, S.TAGS).dropDuplicates(["document_id", "tag_key"])
        if images is not None:
            rows["images"] = own(images, S.IMAGES)
        return self._change(change, rows, self._ends(mine.filter("document_id is not null"), list(TABLES)))

    def delete(self, change: str, documents: DataFrame) -> bool:
        """Delete documents with their rows in every table."""
        return self._change(change, {}, self._ends(documents.filter("document_id is not null"), list(TABLES)))

    def set_tags(self, change: str, tags: DataFrame, documents: DataFrame | None = None) -> bool:
        """Replace the tags of the documents that have any in ``tags``, and delete
        those of ``documents`` that have none there."""
        t = self._fitted(tags, S.TAGS, self.spark).dropDuplicates(["document_id", "tag_key"])
        ids = t.select("document_id") if documents is None else t.select("document_id").unionByName(documents.filter("document_id is not null").select("document_id"))
        return self._change(change, {"tags": t}, self._ends(ids, ["tags"]))

    def set_images(self, change: str, images: DataFrame, documents: DataFrame) -> bool:
        """Replace the images of the documents."""
        return self._change(change, {"images": self._fitted(images, S.IMAGES, self.spark)}, self._ends(documents.filter("document_id is not null"), ["images"]))

    def save_vectors(self, change: str, vectors: DataFrame) -> bool:
        """Replace the vectors of the blocks given."""
        v = self._fitted(vectors, S.VECTORS, self.spark)
        return self._change(change, {"vectors": v}, lambda saved: saved["vectors"].select(F.lit("vectors").alias("what"), "document_id", "block_id").filter("block_id is not null").distinct())

    def touch(self, change: str, documents: DataFrame, **columns: Column) -> bool:
        """Set columns of documents, such as updated_at or content_hash; their
        other rows stay."""
        unknown = set(columns) - set(_names(S.DOCUMENTS))
        if unknown:
            raise StoreError(f"no columns {sorted(unknown)}")
        d = self.table("documents").join(documents.select("document_id").distinct(), "document_id", "left_semi").withColumns(columns)
        return self._change(change, {"documents": self._fitted(d, S.DOCUMENTS, self.spark)}, self._ends(d, ["documents"]))

    def compact(self) -> None:
        """Write every table without ended rows. The folders before are deleted
        after the marker."""
        state = self.commits.last()
        new = {k: v for k, v in state.items() if k not in TABLES and k != "ended"}
        for name in TABLES:
            if state.get(name):
                at = uuid.uuid4().hex
                self.table(name).write.parquet(f"{self.path}/{name}/{at}")
                new[name] = [[state["change"], at]]
        self.commits.add(new, state)
        for name in (*TABLES, "ended"):
            for _, at in state.get(name, []):
                delete(self.spark, f"{self.path}/{name}/{at}")

    # --- embedding jobs
    def waiting(self, documents: DataFrame | None = None) -> DataFrame:
        """The embeddable blocks without a vector of their present text."""
        b = self.table("blocks")
        b = b if documents is None else b.join(documents.select("document_id").distinct(), "document_id", "left_semi")
        return b.join(lifecycle.stale(b, self.table("vectors")), ["document_id", "block_id"], "left_semi")

    def pending(self, limit: int | None = None) -> DataFrame:
        """(document_id) of documents without any vector, in order."""
        p = lifecycle.pending(self.table("documents"), self.table("vectors")).select("document_id").orderBy("document_id")
        return p if limit is None else p.limit(limit)

    def embed(self, change: str, provider: embedding.Provider, documents: DataFrame | None = None, size: int = 24_000, overlap: int = 200) -> bool:
        """Embed what waits, of all documents or those given: blocks are cut into
        pieces, pieces embedded in batches. A piece that failed has no vector, and
        its whole block waits for the next job; so a job is resumed, and gaps are
        repaired, by running another."""
        if change in self.commits.last().get("applied", []):
            return False
        b = written(self.waiting(documents).select("document_id", "block_id", "content"), "waiting").withColumn("key", F.concat_ws("\x1f", "document_id", "block_id"))
        cut = chunking.embedding_pieces(b, "key", "content", size, overlap).select("key", "chunk_idx", F.col("content").alias("piece"))
        v = embedding.embedded(cut, provider, "piece")
        whole = F.count(F.when(F.col("vector").isNull(), 1)).over(Window.partitionBy("key")) == 0  # a block's few pieces
        ok = v.drop("piece").withColumn("whole", whole).filter("whole").drop("whole").join(b.select("key", "document_id", "block_id", V.text_hash(F.col("content")).alias("text_hash")), "key")
        return self.save_vectors(change, ok.withColumn("created_at", F.current_timestamp()))

    def repair(self, change: str, provider: embedding.Provider) -> bool:
        """Drop the vectors of blocks that are gone, then embed what waits."""
        k = lifecycle.keys(self.table("vectors"))
        lost = k.join(self.table("blocks").select("document_id", "block_id"), ["document_id", "block_id"], "left_anti")
        done = self._change(f"{change}-lost", {}, lost.select(F.lit("vectors").alias("what"), "document_id", "block_id"))
        return self.embed(change, provider) or done


def ordered(blocks: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page of blocks by document and place, with ``position`` from 1. Spark
    keeps limit + offset rows a task."""
    order = [F.asc("document_id"), F.asc("sequence"), F.asc("block_id")]
    page = blocks.orderBy(*order).limit(limit + offset)
    at = page.withColumn("position", F.row_number().over(Window.orderBy(*order)))  # limit + offset rows
    return at.filter(F.col("position") > offset)
