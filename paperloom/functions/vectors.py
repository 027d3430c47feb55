"""Expressions over vectors, boxes and places."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products; the longer vector is cut."""
    n = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, bad: float = 0.0, same_length: bool = False) -> Column:
    """Cosine similarity; `bad` for a zero norm, and for differing lengths where they must be the same."""
    size = norm(a) * norm(b)
    fine = (size > 0) & (F.size(a) == F.size(b)) if same_length else size > 0
    return F.when(fine, dot(a, b) / size).otherwise(F.lit(bad))


def unit(a: Column) -> Column:
    """A vector at length one; a zero vector stays."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of two boxes (x, y, width, height)."""
    w = F.greatest(F.lit(0.0), F.least(a[0] + a[2], b[0] + b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[1] + a[3], b[1] + b[3]) - F.greatest(a[1], b[1]))
    union = a[2] * a[3] + b[2] * b[3] - w * h
    return F.when(union > 0, w * h / union).otherwise(F.lit(0.0))


def clamp(value: Column) -> Column:
    """Into [0, 1]; NaN becomes 0."""
    return F.when(F.isnan(value), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * 6371.0088) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def to_bytes(a: Column, double: bool = False) -> Column:
    """A vector as little-endian floats, or doubles."""

    @F.pandas_udf("binary")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda v: None if v is None else np.asarray(v, dtype="<f8" if double else "<f4").tobytes())

    return run(a)


def from_bytes(a: Column, double: bool = False) -> Column:
    """The vector of little-endian floats, or doubles; bytes beyond the last whole one are left out."""

    @F.pandas_udf("array<double>" if double else "array<float>")
    def run(batch: pd.Series) -> pd.Series:
        size = 8 if double else 4
        return batch.map(lambda b: None if b is None else np.frombuffer(bytes(b)[: len(b) // size * size], dtype="<f8" if double else "<f4"))

    return run(a)
