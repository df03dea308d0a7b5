"""Vector columns: cosine similarity and the deterministic hash embedding."""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products in array order, in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors, different lengths or a vector of length 0."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == 0) | (F.size(a) != F.size(b)) | (norm == 0), 0.0).otherwise(dot(a, b) / norm)


_WORD = re.compile(r"[^\W_]+")


class _Buckets(dict):
    """Word -> its bucket, kept from batch to batch and emptied when large."""

    def __init__(self, dims: int) -> None:
        super().__init__()
        self.dims = dims

    def __missing__(self, word: str) -> int:
        found = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % self.dims
        if len(word) <= 64:
            if len(self) > 1 << 16:
                self.clear()
            self[word] = found
        return found


_KNOWN: dict[int, _Buckets] = {}


def counted(texts, dims: int) -> np.ndarray:
    """For each text how many of its words fall in each bucket; null as empty."""
    out, bucket = np.zeros((len(texts), dims), np.int32), _KNOWN.setdefault(dims, _Buckets(dims)).__getitem__
    for a in range(0, len(texts), 1024):
        found = [list(map(bucket, _WORD.findall(t.lower()))) if t else () for t in texts[a : a + 1024]]
        n = [len(x) for x in found]
        places = np.repeat(np.arange(len(found)) * dims, n) + np.fromiter(chain.from_iterable(found), np.int64, sum(n))
        out[a : a + 1024] = np.bincount(places, minlength=len(found) * dims).reshape(-1, dims)
    return out


def hash_counts(c: Column, dims: int = 32) -> Column:
    """How many words of a text fall in each of ``dims`` buckets by the first 32 bits of their MD5; null for null."""

    @F.pandas_udf("array<int>")
    def counts(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else n for t, n in zip(texts, counted(texts, dims), strict=True)], dtype=object)

    return counts(c)


def hash_embedding(c: Column, dims: int = 32) -> Column:
    """The counts at length 1; zeros for a text without words, null for null."""

    @F.pandas_udf("array<double>")
    def embedding(texts: pd.Series) -> pd.Series:
        n = counted(texts, dims).astype(float)
        n /= np.maximum(1e-300, np.sqrt((n * n).sum(1, keepdims=True)))
        return pd.Series([None if t is None else x for t, x in zip(texts, n, strict=True)], dtype=object)

    return embedding(c)
