"""Problem 8: encoding of the whole corpus with a public tokenizer.

Method: the texts' pieces (by the tokenizer's own pattern) are encoded in padded
numpy matrices, one per length bucket. In each round every row merges its
leftmost pair of minimum rank; pair ranks come from a hash table of all
mergeable pairs, and rows that have no pair left are compacted away. A piece too
long for a matrix is merged with a heap, by the same order. Pieces met before
are looked up.

Null and empty texts both get an empty list. Strings that name special tokens
are ordinary text. Every row gives one row, repeated ones too; texts are encoded
whole, whatever their length. Code points that UTF-8 cannot hold become U+FFFD.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

FOLDER = os.environ.get("FOLIOQUERY_TOKENIZERS", "/opt/tokenizers")
NONE = np.int32(2**31 - 1)
WIDTHS = (4, 8, 16, 32, 64, 128, 256)
KEPT = 300_000  # pieces a worker remembers
# Fixed value: the pattern of the tokenizer, which cuts a text into pieces.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class PairRanks:
    """Hash table from a pair of ids to the id (= rank) of their merge."""

    def __init__(self, keys: np.ndarray, ranks: np.ndarray):
        self.bits = max(4, int(len(keys) * 2.5).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.ranks = np.full(size, NONE, np.int32)
        left, at, self.probes = np.arange(len(keys)), self.slot(keys), 0
        while len(left):
            self.probes += 1
            free = self.keys[at[left]] == -1
            slots, first = np.unique(at[left[free]], return_index=True)
            placed = left[free][first]
            self.keys[slots], self.ranks[slots] = keys[placed], ranks[placed]
            left = np.setdiff1d(left, placed, assume_unique=True)
            at[left] = (at[left] + 1) & (size - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pairs; NONE where there is no merge or an id is negative."""
        keys = (a.astype(np.int64) << 20) | b
        keys[(a < 0) | (b < 0)] = -2
        shape, keys = keys.shape, keys.ravel()
        out, left, at = np.full(len(keys), NONE, np.int32), np.flatnonzero(keys >= 0), None
        at = self.slot(keys[left])
        for _ in range(self.probes):
            there = self.keys[at]
            hit = there == keys[left]
            out[left[hit]] = self.ranks[at[hit]]
            go = ~hit & (there != -1)
            left, at = left[go], (at[go] + 1) & (len(self.keys) - 1)
            if not len(left):
                break
        return out.reshape(shape)


class Encoder:
    def __init__(self, lines: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines()) if a}
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = {}
        for token, r in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[(a << 20) | b] = r
        self.pairs = pairs
        self.table = PairRanks(np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs)))
        self.pattern = regex.compile(PATTERN)
        self.known: dict[str, list[int]] = {}

    def matrix(self, pieces: list[bytes], width: int) -> list[list[int]]:
        """Ids of pieces of at most ``width`` bytes."""
        n = len(pieces)
        x = np.full((n, width), -1, np.int32)
        size = np.fromiter(map(len, pieces), np.int64, n)
        x[np.arange(width) < size[:, None]] = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        out: list = [None] * n
        rows, r = np.arange(n), self.table.find(x[:, :-1], x[:, 1:])
        cols = np.arange(width)
        while True:
            j = r.argmin(axis=1)
            low = r[np.arange(len(r)), j]
            go = low != NONE
            if not go.all():
                done = ~go
                for i, ids, k in zip(rows[done], x[done].tolist(), (x[done] >= 0).sum(axis=1)):
                    out[i] = ids[:k]
                x, r, rows, j, low = x[go], r[go], rows[go], j[go], low[go]
            if not len(x):
                return out
            k = np.arange(len(x))
            x[k, j] = low
            step = cols + (cols > j[:, None])
            x = np.take_along_axis(np.concatenate([x, np.full((len(x), 1), -1, np.int32)], axis=1), step, axis=1)
            r = np.take_along_axis(np.concatenate([r, np.full((len(r), 1), NONE, np.int32)], axis=1), step[:, :-1], axis=1)
            at = np.minimum(j, width - 2)
            r[k, at] = self.table.find(x[k, at], x[k, at + 1])
            at = np.maximum(j - 1, 0)
            r[k, at] = self.table.find(x[k, at], x[k, at + 1])

    def long(self, piece: bytes) -> list[int]:
        """The same order of merges for one long piece, by a heap of pairs."""
        ids = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.pairs.get((ids[i] << 20) | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            k = after[i]
            if k >= n or ids[i] != a or ids[k] != b:
                continue
            ids[i], ids[k] = r, -1
            after[i] = after[k]
            if after[i] < n:
                before[after[i]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q < n and (s := self.pairs.get((ids[p] << 20) | ids[q])) is not None:
                    heapq.heappush(heap, (s, p, ids[p], ids[q]))
        return [v for v in ids if v >= 0]

    def learn(self, pieces: set[str]) -> None:
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for p in pieces:
            b = p.encode("utf-8", "replace") if not p.isascii() else p.encode()
            width = next((w for w in WIDTHS if len(b) <= w), None)
            if width:
                buckets.setdefault(width, []).append((p, b))
            else:
                self.known[p] = self.long(b)
        for width, found in buckets.items():
            most = max(64, 2**20 // width)
            for i in range(0, len(found), most):
                part = found[i : i + most]
                self.known |= zip((p for p, _ in part), self.matrix([b for _, b in part], width))

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        cut = [self.pattern.findall(t) if t else [] for t in texts]
        if len(self.known) > KEPT:
            self.known.clear()
        self.learn(set(chain.from_iterable(cut)) - self.known.keys())
        known = self.known.__getitem__
        return [list(chain.from_iterable(map(known, c))) for c in cut]


@cache
def encoder(lines: bytes) -> Encoder:
    return Encoder(lines)


def vocabulary(folder: str = FOLDER, name: str = "byte_bpe_50k.tiktoken") -> bytes:
    with open(f"{folder}/{name}", "rb") as f:
        return f.read()


def encoded(documents: DataFrame, folder: str = FOLDER, name: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """(doc_id, ids) of every row of documents (doc_id, text). The vocabulary is
    read by the driver and broadcast; its size is fixed, whatever the data's."""
    lines = documents.sparkSession.sparkContext.broadcast(vocabulary(folder, name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(lines.value)
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                ids = e.encode(part.column(1).to_pylist())
                size = np.fromiter(map(len, ids), np.int64, len(ids))
                flat = np.fromiter(chain.from_iterable(ids), np.int32, int(size.sum()))
                offsets = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, pa.array(flat))], names=["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")
