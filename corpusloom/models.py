"""Model interfaces, with deterministic defaults that need no model.

An embedder turns texts into unit vectors, a reranker scores (query, text) pairs in 0..1. Real models
implement the same two methods; they are pickled to the workers, so load lazily.
"""

from __future__ import annotations

import hashlib
import re
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"[a-z0-9]+(?:[._+-][a-z0-9]+)*|[\u4e00-\u9fff]")


class Embedder(Protocol):
    dim: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class Reranker(Protocol):
    def score(self, query: str, texts: list[str]) -> list[float]: ...


class Extractor(Protocol):
    """pages: the text of each page of a file, or None. May raise Deferred. An extractor may also have
    ``sidecar(name, content)``, which returns its blocks as JSON (type and text, see strip_sidecar_noise),
    and ``signature``, the name of what it can do now."""

    def pages(self, name: str, content: bytes) -> list[str] | None: ...


class Deferred(Exception):
    """Raised by an extractor whose service will read the file later: the file is left as it is until the
    next run, and isn't a failure."""


class HashedTokens:
    """Tokens hashed to signed dimensions, summed and normalised."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for row, text in zip(out, texts, strict=True):
            for token in _TOKEN.findall(text.lower()):
                h = int.from_bytes(hashlib.sha1(token.encode()).digest()[:8], "big")
                row[h % self.dim] += 1 if h >> 63 else -1
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms > 0, norms, 1)


class TokenOverlap:
    """The share of the query's tokens that the text has."""

    def score(self, query: str, texts: list[str]) -> list[float]:
        wanted = set(_TOKEN.findall(query.lower()))
        return [len(wanted & set(_TOKEN.findall((t or "").lower()))) / len(wanted) if wanted else 0.0 for t in texts]


def embed(text: Column, model: Embedder) -> Column:
    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(list(model.encode([t or "" for t in texts])))

    return run(text)


def rerank(text: Column, query: str, model: Reranker) -> Column:
    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(query, texts.tolist()), dtype="float64")

    return run(text)


def truncate_vector(vector: Column, dim: int) -> Column:
    """The first dim numbers, made a unit vector again."""
    head = F.slice(vector.cast("array<double>"), 1, dim)
    norm = F.sqrt(F.aggregate(head, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(head, lambda x: x / norm)).otherwise(head)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in doubles; 0 if either vector has no length."""
    x, y = a.cast("array<double>"), b.cast("array<double>")
    dot = F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    length = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, p: s + p * p))
    product = length(x) * length(y)
    return F.when(product > 0, dot / product).otherwise(F.lit(0.0))
