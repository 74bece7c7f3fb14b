"""Vectors and sets as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def l2_normalize(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))


def jaccard(a: Column, b: Column) -> Column:
    """1 if both are empty."""
    whole = F.size(F.array_union(a, b))
    return F.when(whole == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / whole)


def runtime_multiplier(ratio: Column) -> Column:
    return F.when(ratio <= 0.5, 1.0).when(ratio <= 1.0, 0.9).when(ratio <= 2.0, 0.75).otherwise(0.5)
