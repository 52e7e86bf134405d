"""Vector expressions over array<double> columns. Null arrays give null; arrays of unequal size give null by their missing elements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def scaled(a: Column, by: Column) -> Column:
    return F.transform(a, lambda x: x * by)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def unit(a: Column) -> Column:
    """a over its norm; null where the norm is zero or not finite."""
    n = norm(a)
    return F.when((n > 0) & (n < float("inf")), F.transform(a, lambda x: x / n))


def cosine(a: Column, b: Column) -> Column:
    """NaN where either norm is zero."""
    denominator = norm(a) * norm(b)
    return F.when(denominator > 0, dot(a, b) / denominator).otherwise(F.lit(float("nan")))


def residual(a: Column, n: Column) -> Column:
    """a without its part along the unit vector n (one Gram-Schmidt step)."""
    along = dot(a, n)
    return F.zip_with(a, n, lambda x, y: x - along * y)


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
