"""Vectors as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    """The vector at length one, as doubles; an all-zero vector stays as it is, null stays null."""
    n = l2_norm(v)
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def euclidean_score(a: Column, b: Column) -> Column:
    """1 / (1 + squared distance)."""
    d = F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2))), F.lit(0.0), lambda s, x: s + x)
    return 1 / (1 + d)


def usable(v: Column, dim: int) -> Column:
    """Of the stated dimension, finite in all places and not all zero; false for null."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) == dim) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))
