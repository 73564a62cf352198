"""Vectors in arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fit(vector: Column, size: int) -> Column:
    """Cut, or filled with zeros at the right, to size."""
    return F.slice(F.concat(vector, F.array_repeat(F.lit(0.0).cast("float"), size)), 1, size)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def raw_cosine(a: Column, b: Column) -> Column:
    return _dot(a, b) / F.nullif(F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)), F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine within 0 and 1; 0 for empty vectors, unequal sizes and norms of zero."""
    usable = (F.size(a) > 0) & (F.size(a) == F.size(b))
    return F.when(usable, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(raw_cosine(a, b), F.lit(0.0))))).otherwise(0.0)


def literal(vector: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))
