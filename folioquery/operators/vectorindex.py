"""A persistent index of vectors for approximate searches: cells around centres.

Vectors are kept by cell, the nearest of centres that were fitted once on a bounded
sample; a search compares a query with the vectors of the cells whose centres are
nearest to it. More probes find more. Adding appends, deleting lists ids, and a
later ``rebuild`` fits new centres and drops what was deleted; a marker makes each
visible. Vectors are scaled to length one; unusable ones (null, not finite, all
zero, another length) are not kept, and of an id added again the last counts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioquery.functions.vectors import usable
from folioquery.session import Commits, delete

BLOCK = 8192  # rows of a cell, or queries, that a task has at once
ROWS = "cell int, vec_id long, vector array<float>, change int"


def _unit(col) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in col])
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def centres_of(sample: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """k-means on the sphere; an empty cell keeps its centre."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)]
    for _ in range(rounds):
        near = np.argmax(sample @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        size = np.sqrt(np.einsum("ij,ij->i", total, total))
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1e-12)[:, None], c)
    return c


class VectorIndex:
    """Under ``path`` in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, dimension: int, cell_size: int = 1000, sample: int = 50_000):
        self.spark, self.path, self.dimension, self.cell_size, self.sample = spark, path.rstrip("/"), dimension, cell_size, sample
        self.commits = Commits(spark, path)

    def _centres(self, state: dict) -> np.ndarray:
        return np.array(self.commits.get(state["centres"])["centres"])

    def _put(self, vectors: DataFrame, centres: np.ndarray, change: int) -> list:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                if len(f):
                    x = _unit(f["vector"])
                    yield pd.DataFrame({"cell": np.argmax(x @ centres.T, axis=1).astype(np.int32), "vec_id": f["vec_id"], "vector": list(x.astype(np.float32)), "change": np.full(len(f), change, np.int32)})

        name = uuid.uuid4().hex
        good = vectors.filter(F.col("vec_id").isNotNull() & usable(F.col("vector"), self.dimension)).select("vec_id", "vector").dropDuplicates(["vec_id"])
        good.mapInPandas(run, ROWS).repartition("cell").write.partitionBy("cell").parquet(f"{self.path}/vectors/folder={name}")
        return [change, name]

    def build(self, vectors: DataFrame) -> None:
        """Start anew with these vectors."""
        state = self.commits.last()
        good = vectors.filter(usable(F.col("vector"), self.dimension)).select("vector")
        n = good.count()
        some = good.sample(min(1.0, self.sample / max(1, n)), seed=5).toPandas()
        k = max(1, min(4096, round(n / self.cell_size), len(some)))
        c = centres_of(_unit(some["vector"]), k) if len(some) else np.zeros((1, self.dimension))
        name, change = f"centres/{uuid.uuid4().hex}.json", state.get("change", 0) + 1
        self.commits.put(name, {"centres": c.tolist()})
        self.commits.add({"centres": name, "change": change, "vectors": [self._put(vectors, c, change)], "gone": []}, state)
        for _, at in state.get("vectors", []):
            delete(self.spark, f"{self.path}/vectors/folder={at}")

    def add(self, vectors: DataFrame) -> None:
        state = self.commits.last()
        if not state:
            return self.build(vectors)
        change = state["change"] + 1
        ids = vectors.select("vec_id").filter("vec_id is not null").distinct()
        self.commits.add(state | {"change": change, "vectors": [*state["vectors"], self._put(vectors, self._centres(state), change)], "gone": [*state["gone"], self._ends(ids, change)]}, state)
        return None

    def delete(self, ids: DataFrame) -> None:
        """ids: vec_id"""
        state = self.commits.last()
        change = state.get("change", 0) + 1
        self.commits.add(state | {"change": change, "gone": [*state.get("gone", []), self._ends(ids.select("vec_id").distinct(), change)]}, state)

    def _ends(self, ids: DataFrame, change: int) -> list:
        name = uuid.uuid4().hex
        ids.write.parquet(f"{self.path}/gone/{name}")
        return [change, name]

    def vectors(self, cells: list[int] | None = None) -> DataFrame:
        """(cell, vec_id, vector) of what is there, or of some cells."""
        state = self.commits.last()
        if not state.get("vectors"):
            return self.spark.createDataFrame([], ROWS).drop("change")
        at = [f"{self.path}/vectors/folder={n}" for _, n in state["vectors"]]
        rows = self.spark.read.schema(f"{ROWS}, folder string").option("basePath", f"{self.path}/vectors").parquet(*at)
        rows = rows if cells is None else rows.filter(F.col("cell").isin(cells))
        for change, name in state["gone"]:
            gone = self.spark.read.schema("vec_id long").parquet(f"{self.path}/gone/{name}").withColumn("until", F.lit(change))
            rows = rows.join(gone, (rows["vec_id"] == gone["vec_id"]) & (rows["change"] < gone["until"]), "left_anti")
        return rows.select("cell", "vec_id", "vector")

    def rebuild(self) -> None:
        """Fit new centres to what is there; deleted rows and lists go."""
        self.build(self.vectors())

    def search(self, queries: DataFrame, k: int, probes: int = 8) -> DataFrame:
        """(query_id, vec_id, similarity, rank): about the k nearest of each
        (query_id, vector). Only cells that a query probes are read."""
        state = self.commits.last()
        out = "query_id long, vec_id long, similarity double"
        if not state.get("vectors"):
            return self.spark.createDataFrame([], f"{out}, rank int")
        centres = self._centres(state)

        def near(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                if len(f):
                    x = _unit(f["vector"])
                    m = min(probes, len(centres))
                    best = np.argpartition(-(x @ centres.T), m - 1, axis=1)[:, :m]
                    yield pd.DataFrame({"cell": best.ravel().astype(np.int32), "query_id": np.repeat(f["query_id"].to_numpy(), m), "q": [v for v in x.astype(np.float32) for _ in range(m)]})

        asks = queries.filter(usable(F.col("vector"), self.dimension)).select("query_id", "vector").mapInPandas(near, "cell int, query_id long, q array<float>")
        asked = {r["cell"]: r["n"] for r in asks.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # at most as many as there are centres
        rows = self.vectors(list(asked))
        held = {r["cell"]: r["n"] for r in rows.groupBy("cell").agg(F.count("*").alias("n")).collect()}
        # crowded cells are split on both sides
        grid = lambda: self.spark.createDataFrame([(c, -(-n // BLOCK), -(-asked[c] // BLOCK)) for c, n in held.items()], "cell int, rn int, qn int")
        part = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        asks = asks.join(grid(), "cell").withColumn("qb", part("query_id", "qn")).withColumn("rb", every("rn")).drop("rn", "qn")
        rows = rows.join(grid(), "cell").withColumn("rb", part("vec_id", "rn")).withColumn("qb", every("qn")).drop("rn", "qn")

        def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(a) or not len(b):
                return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "similarity": np.zeros(0)})
            ids = b["vec_id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            s = np.round(_unit(a["q"]) @ _unit(b["vector"])[order].T, 9)
            top = np.argsort(-s, axis=1, kind="stable")[:, :k]
            return pd.DataFrame({"query_id": np.repeat(a["query_id"].to_numpy(), top.shape[1]), "vec_id": ids[order][top.ravel()], "similarity": np.take_along_axis(s, top, axis=1).ravel()})

        found = asks.groupBy("cell", "rb", "qb").cogroup(rows.groupBy("cell", "rb", "qb")).applyInPandas(run, out)
        w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
        return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
