"""Vector expressions: sums in double, zero vectors stay zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def normalize(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / F.when(norm == 0, 1.0).otherwise(norm))


def weighted_sum(items: Column, vector: str, weight: str) -> Column:
    """Sum of weight * vector over an array of structs with these fields; the array is bounded by the history cap."""
    zero = F.transform(F.get(items, 0)[vector], lambda x: F.lit(0.0))
    return F.aggregate(items, zero, lambda s, e: F.zip_with(s, e[vector], lambda x, y: x + e[weight] * y.cast("double")))
