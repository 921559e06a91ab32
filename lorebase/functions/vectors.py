"""Vector functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: An embedding model: texts in, vectors out.
Embedder = Callable[[list[str]], list[np.ndarray]]


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity over the shorter length; 0 for a zero vector."""
    n = F.least(F.size(a), F.size(b))
    a, b = F.slice(a, 1, n), F.slice(b, 1, n)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / norm)))


def l2(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x))


def mean(a: Column, b: Column) -> Column:
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: ((x + y) / 2).cast("float"))


def from_bytes(blob: Column, dimension: int) -> Column:
    """Little-endian float32 bytes to an array of ``dimension``; null for null or another length."""

    @F.pandas_udf("array<float>")
    def floats(blobs: pd.Series) -> pd.Series:
        return blobs.map(lambda b: np.frombuffer(b, "<f4") if b is not None and len(b) == 4 * dimension else None)

    return floats(blob)


def to_bytes(vector: Column) -> Column:
    """An array of float as little-endian float32 bytes, any value; null for null."""

    @F.pandas_udf("binary")
    def blobs(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())

    return blobs(vector)
