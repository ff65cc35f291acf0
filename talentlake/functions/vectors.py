"""Vectors as arrays: cosine, Jaccard and the hashing embedding."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, not below 0; 0 where either is null, empty or zero."""
    scale = F.sqrt(dot(a, a) * dot(b, b))
    return F.coalesce(F.when(scale > 0, F.greatest(F.lit(0.0), dot(a, b) / scale)), F.lit(0.0))


def cosine_to(query: Sequence[float], vector: Column) -> Column:
    """As ``cosine`` with one fixed vector, in Arrow batches: its norm is taken once and a batch is one matrix product."""
    q = np.asarray(list(query), np.float64)
    norm = float(np.sqrt(q @ q))

    @F.pandas_udf("double")
    def near(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            out = np.zeros(len(s))
            rows = [k for k, v in enumerate(s) if v is not None and len(v) == len(q)]
            if rows and norm:
                m = np.asarray([s.iloc[k] for k in rows], np.float64)
                scale = np.sqrt(np.einsum("ij,ij->i", m, m)) * norm
                got = np.divide(m @ q, scale, out=np.zeros(len(rows)), where=scale > 0)
                out[rows] = np.maximum(np.nan_to_num(got), 0)
            yield pd.Series(out)

    return near(vector)


def text_cosine(text: Column, query: Sequence[float], dimensions: int = 384) -> Column:
    """``cosine_to`` of a text's hashing embedding, in one function, so that no vector leaves the worker."""
    q = np.asarray(list(query), np.float64)
    norm = float(np.sqrt(q @ q))

    @F.pandas_udf("double")
    def near(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hasher = Hasher(dimensions)
        for s in parts:
            m = hasher.encode(s.tolist()).astype(np.float64)
            scale = np.sqrt(np.einsum("ij,ij->i", m, m)) * norm
            yield pd.Series(np.maximum(np.divide(m @ q, scale, out=np.zeros(len(m)), where=scale > 0), 0) if len(q) == dimensions else np.zeros(len(m)))

    return near(text)


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets; 0 where either is empty."""
    return F.coalesce(F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))), F.lit(0.0))


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


_TOKEN = re.compile(r"[a-z0-9+#.]+")


class Hasher(dict):
    """Signed feature hashing of tokens into a unit vector.

    Remembers each token's place, doubled and with its sign in the last bit, and forgets all beyond ``bound`` tokens.
    """

    def __init__(self, dimensions: int = 384, bound: int = 500_000):
        super().__init__()
        self.dimensions, self.bound = dimensions, bound

    def __missing__(self, token: str) -> int:
        digest = hashlib.blake2b(token.encode("utf-8", "surrogatepass"), digest_size=8).digest()
        if len(self) >= self.bound:
            self.clear()
        self[token] = code = int.from_bytes(digest[:4], "big") % self.dimensions * 2 + (digest[4] & 1)
        return code

    def encode(self, texts: list[str | None], chars: int = 1_000_000) -> np.ndarray:
        """One row per text; a text without tokens is the zero vector.  The tokens of about ``chars`` characters are held at a time, as a batch may be of long texts."""
        out = np.zeros((len(texts), self.dimensions), np.float32)
        start, size = 0, 0
        for k, text in enumerate(texts):
            size += len(text or "")
            if size >= chars or k == len(texts) - 1:
                out[start : k + 1] = self._encode(texts[start : k + 1])
                start, size = k + 1, 0
        return out

    def _encode(self, texts: list[str | None]) -> np.ndarray:
        tokens = [_TOKEN.findall((text or "").lower()) for text in texts]
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        codes = np.fromiter(map(self.__getitem__, chain.from_iterable(tokens)), np.int64, int(sizes.sum()))
        at = np.repeat(np.arange(len(texts)) * self.dimensions, sizes) + (codes >> 1)
        flat = np.bincount(at, (codes & 1) * 2.0 - 1.0, len(texts) * self.dimensions)
        out = flat.reshape(len(texts), self.dimensions).astype(np.float32)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > 0)


def hash_embedding(text: Column, dimensions: int = 384) -> Column:
    """array<float>: the hashing embedding of a text, in Arrow batches."""

    @F.pandas_udf("array<float>")
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hasher = Hasher(dimensions)
        for s in parts:
            yield pd.Series(list(hasher.encode(s.tolist())), dtype=object)

    return embed(text)
