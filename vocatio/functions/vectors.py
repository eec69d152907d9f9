"""Checks and arithmetic on embedding columns (arrays of floats)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    squares = F.transform(a, lambda x: x.cast("double") * x.cast("double"))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x))


def normalised(a: Column, by: Column) -> Column:
    """The vector divided by ``by``, its norm; zero vectors stay as they are."""
    return F.transform(a, lambda x: F.when(by > 0, x.cast("double") / by).otherwise(x.cast("double")))


def quantised(score: Column) -> Column:
    """Scores to six decimals, so that ties are real ties on every engine."""
    return F.floor(score * 1_000_000 + 0.5).cast("double") / 1_000_000


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def is_finite(vector: Column) -> Column:
    """True for a vector whose components are all there and finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad, F.lit(False))
