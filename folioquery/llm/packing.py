"""Problem 9: filling fixed-capacity containers with whole items.

Method: lexical retrieval packing. Documents are spread over shards of about
4 096 by the hash of their id. Each shard has a BM25 inverted index over token
ids. The longest unused document seeds a container; its unused neighbours by
BM25 fill it in order as long as any fits; what room is left then takes the longest
unused documents that still fit. Shards hold equally many documents whatever
their content, so none is hot.

A document longer than the capacity is cut into full containers and one rest,
which is packed like a document; no other document is split. Null and empty
texts are left out. Ties are broken by position in doc_id order. Each row is an
item. An empty table gives no rows.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioquery.llm import bpe

CAPACITY = 2048
SHARD = 4096
ITEMS = "doc_id long, start int, n int, ids binary"
OUT = "container_id string, position int, doc_id long, start int, n_tokens int"


def items(documents: DataFrame, capacity: int, folder: str) -> DataFrame:
    """Full pieces of long documents (without ids), and the rests with ids."""
    enc = bpe.encoded(documents.filter("text is not null and text <> ''"), folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            off, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            rows: list[list] = [[], [], [], []]
            for i, doc in enumerate(b.column(0).to_pylist()):
                size = int(off[i + 1] - off[i])
                for s in range(0, size, capacity):
                    n = min(capacity, size - s)
                    ids = b"" if n == capacity else flat[off[i] + s : off[i] + s + n].astype(np.int32).tobytes()
                    for r, x in zip(rows, (doc, s, n, ids)):
                        r.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, (pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=["doc_id", "start", "n", "ids"])

    return enc.mapInArrow(run, ITEMS)


class Index:
    """BM25 postings of a shard: for each term the items and their weights."""

    def __init__(self, texts: list[np.ndarray], k1: float = 1.2, b: float = 0.75):
        n = len(texts)
        size = np.array([len(t) for t in texts], np.float64)
        norm = k1 * (1 - b + b * size / max(1.0, size.mean()))
        self.terms = [np.unique(t) for t in texts]
        term = np.concatenate(texts)
        doc = np.repeat(np.arange(n), size.astype(np.int64))
        key, tf = np.unique(term.astype(np.int64) * n + doc, return_counts=True)
        term, self.doc = key // n, key % n
        vocab, self.first, df = np.unique(term, return_index=True, return_counts=True)
        self.last = self.first + df
        idf = np.log((n - df + 0.5) / (df + 0.5) + 1)
        self.weight = (np.repeat(idf, df) * tf * (k1 + 1) / (tf + norm[self.doc])).astype(np.float32)
        self.place = [np.searchsorted(vocab, t) for t in self.terms]
        self.n = n

    def scores(self, i: int) -> np.ndarray:
        a, b = self.first[self.place[i]], self.last[self.place[i]]
        at = np.repeat(b - np.cumsum(b - a), b - a) + np.arange(int((b - a).sum()))
        return np.bincount(self.doc[at], self.weight[at], self.n)


def pack(sizes: np.ndarray, texts: list[np.ndarray], capacity: int) -> list[list[int]]:
    """Containers as lists of item numbers."""
    n = len(sizes)
    if not n:
        return []
    index = Index(texts)
    by_size = sorted(range(n), key=lambda i: (sizes[i], -i))
    order = [int(sizes[i]) for i in by_size]
    free = np.ones(n, bool)
    out = []

    def take(i: int) -> None:
        free[i] = False
        at = bisect.bisect_left(order, int(sizes[i]))
        while by_size[at] != i:
            at += 1
        del by_size[at], order[at]

    while by_size:
        seed = by_size[-1]
        take(seed)
        box, room = [seed], capacity - int(sizes[seed])
        if order and order[0] <= room:
            s = index.scores(seed)
            near = np.flatnonzero(free & (sizes <= room) & (s > 0))
            near = near[np.argsort(-s[near], kind="stable")]
            while len(near):
                i = int(near[0])
                take(i)
                box.append(i)
                room -= int(sizes[i])
                near = near[1:][sizes[near[1:]] <= room]
            while order and order[0] <= room:
                i = by_size[bisect.bisect_right(order, room) - 1]
                take(i)
                box.append(i)
                room -= int(sizes[i])
        out.append(box)
    return out


def containers(documents: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, folder: str = bpe.FOLDER) -> DataFrame:
    """(container_id, position, doc_id, start, n_tokens): every token of every
    text in exactly one container."""
    shards = max(1, math.ceil(documents.count() / shard))

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["doc_id", "start"], kind="stable").reset_index(drop=True)
        full = f["n"].to_numpy() == capacity
        rest = np.flatnonzero(~full)
        boxes = [[int(i)] for i in np.flatnonzero(full)]
        ids = f["ids"].to_numpy()
        found = pack(f["n"].to_numpy()[rest].astype(np.int64), [np.frombuffer(ids[i], np.int32) for i in rest], capacity)
        boxes += [[int(rest[i]) for i in b] for b in found]
        flat = np.array([i for b in boxes for i in b], np.int64)
        name = [f"{f['shard'].iloc[0]}-{k}" for k, b in enumerate(boxes) for _ in b]
        at = [p for b in boxes for p in range(len(b))]
        return pd.DataFrame({"container_id": name, "position": at, "doc_id": f["doc_id"].to_numpy()[flat], "start": f["start"].to_numpy()[flat], "n_tokens": f["n"].to_numpy()[flat]})

    spread = items(documents, capacity, folder).withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)))
    return spread.groupBy("shard").applyInPandas(run, OUT)
