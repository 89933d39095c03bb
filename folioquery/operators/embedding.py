"""Embedding texts through providers, in batches inside Arrow functions."""

from __future__ import annotations

import hashlib
import json
import random
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from folioquery.errors import ContextTooLong, EmptyInput, ProviderError


class Provider(Protocol):
    name: str
    dimension: int
    max_batch: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


@dataclass
class HashProvider:
    """A deterministic provider without a network: signed feature hashing of
    words, scaled to length one. Texts without words give zeros."""

    dimension: int = 64
    name: str = "hash-embed"
    max_batch: int = 256
    unit: bool = True  # false leaves the whole numbers

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dimension))
        known: dict[str, int] = {}
        for i, t in enumerate(texts):
            for w in t.lower().split():
                if w not in known:
                    known[w] = int.from_bytes(hashlib.md5(w.encode("utf-8", "replace"), usedforsecurity=False).digest()[:8], "little")
                h = known[w]
                out[i, h % self.dimension] += 1 if h >> 63 else -1
        if not self.unit:
            return out.tolist()
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, n, out=np.zeros_like(out), where=n > 0).tolist()


@dataclass
class HttpProvider:
    """A provider behind HTTP. ``style``: 'openai' (a list under ``data``) or
    'ollama' (a list under ``embeddings``, or one under ``embedding``)."""

    url: str
    name: str
    dimension: int
    key: str = ""
    key_header: str = "Authorization"
    style: str = "openai"
    max_batch: int = 100
    timeout: float = 30.0

    def embed(self, texts: list[str]) -> list[list[float]]:
        body = {"model": self.name, "input": texts}
        head = {"Content-Type": "application/json"}
        if self.key:
            head[self.key_header] = f"Bearer {self.key}" if self.key_header == "Authorization" else self.key
        try:
            with urllib.request.urlopen(urllib.request.Request(self.url, json.dumps(body).encode(), head), timeout=self.timeout) as r:
                found = json.load(r)
        except urllib.error.HTTPError as e:
            said = e.read().decode(errors="replace")
            raise (ContextTooLong if "maximum context length" in said else ProviderError)(said[:500]) from e
        except (OSError, ValueError) as e:
            raise ProviderError(str(e)) from e
        return self.read(found)

    def read(self, found: dict) -> list[list[float]]:
        if self.style == "openai":
            return [d["embedding"] for d in sorted(found["data"], key=lambda d: d.get("index", 0))]
        return found["embeddings"] if "embeddings" in found else [found["embedding"]]


def batches(texts: list[str], size: int) -> list[list[str]]:
    size = size if size > 0 else 100
    return [texts[i : i + size] for i in range(0, len(texts), size)]


def retried(provider: Provider, texts: list[str], retries: int = 3, delay: float = 1.0) -> list[list[float]]:
    """Exponential waits up to 30 s; empty input and too long texts are not
    tried again as they are. Too long texts are halved, then quartered."""
    if not texts or any(not t for t in texts):
        raise EmptyInput("empty text")
    for turn in range(retries + 1):
        try:
            return provider.embed(texts)
        except ContextTooLong:
            break
        except ProviderError:
            if turn == retries:
                raise
            time.sleep(min(30.0, delay * 2**turn) * random.uniform(0.8, 1.2))
    for part in (2, 4):
        try:
            return provider.embed([t[: max(1, len(t) // part)] for t in texts])
        except ContextTooLong:
            if part == 4:
                raise
    raise AssertionError


def embedded(chunks: DataFrame, provider: Provider, column: str = "content") -> DataFrame:
    """chunks with ``vector``, ``model``, ``dimension`` and ``error``. A batch
    that fails gives null vectors and its error, and the job goes on; blank
    texts get neither. Columns of these names are replaced."""
    chunks = chunks.drop("vector", "model", "dimension", "error")
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in chunks.schema]) + ", vector array<float>, model string, dimension int, error string"
    at = chunks.columns.index(column)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            texts = b.column(at).to_pylist()
            full = [i for i, t in enumerate(texts) if t and t.strip()]
            vec: list = [None] * len(texts)
            err: list = [None] * len(texts)
            for k in range(0, len(full), provider.max_batch):
                part = full[k : k + provider.max_batch]
                try:
                    for i, v in zip(part, retried(provider, [texts[i] for i in part])):
                        vec[i] = v
                except ProviderError as e:
                    for i in part:
                        err[i] = str(e)
            ok = [v is not None for v in vec]
            new = [pa.array(vec, pa.list_(pa.float32())), pa.array([provider.name if x else None for x in ok], pa.string()), pa.array([provider.dimension if x else None for x in ok], pa.int32()), pa.array(err, pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, "vector", "model", "dimension", "error"])

    return chunks.mapInArrow(run, schema)


def provider(kind: str, key: str = "", **given) -> Provider:
    """A provider by name, with the defaults of its kind: 'hash', 'openai',
    'azure' (needs ``endpoint`` and ``deployment``), 'ollama'."""
    if kind == "hash":
        return HashProvider(**given)
    if kind == "openai":
        base = given.pop("endpoint", "https://api.openai.com/v1").rstrip("/")
        return HttpProvider(**{"url": f"{base}/embeddings", "name": "text-embedding-3-small", "dimension": 1536, "key": key} | given)
    if kind == "azure":
        base, at, version = given.pop("endpoint").rstrip("/"), given.pop("deployment"), given.pop("version", "2024-02-01")
        return HttpProvider(**{"url": f"{base}/openai/deployments/{at}/embeddings?api-version={version}", "name": at, "dimension": 1536, "key": key, "key_header": "api-key"} | given)
    if kind == "ollama":
        base = given.pop("endpoint", "http://localhost:11434").rstrip("/")
        return HttpProvider(**{"url": f"{base}/api/embed", "name": "nomic-embed-text", "dimension": 768, "style": "ollama"} | given)
    raise ProviderError(f"no provider {kind!r}")
