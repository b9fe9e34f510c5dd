"""Vector arithmetic on ``ARRAY<FLOAT>`` / ``ARRAY<DOUBLE>`` columns, computed in DOUBLE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(vec: Column) -> Column:
    return vec.cast("array<double>")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y))


def norm(vec: Column) -> Column:
    return F.sqrt(_sum(F.transform(as_double(vec), lambda v: v * v)))


def cosine(a: Column, b: Column, eps: float = 0.0) -> Column:
    """Cosine similarity; null when a vector has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b) + F.lit(eps))


def sqdist(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y)))


def l2_normalize(vec: Column, eps: float | None = None) -> Column:
    """Unit vector. ``eps=None`` leaves a zero vector as it is, otherwise divides by ``norm + eps``."""
    length = norm(vec)
    divisor = F.when(length > 0, length).otherwise(F.lit(1.0)) if eps is None else length + F.lit(eps)
    # The divisor enters the lambda through a one-element array, so it is computed once per row.
    return F.flatten(
        F.transform(F.array(divisor), lambda d: F.transform(as_double(vec), lambda v: v / d))
    )


def max_abs_diff(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(as_double(a), as_double(b), lambda x, y: F.abs(x - y)))
