"""Vector expressions over ARRAY<FLOAT or DOUBLE>; null vectors give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) ** 2), F.lit(0.0), lambda s, x: s + x))


def blend(a: Column, b: Column, share_a: float) -> Column:
    """share_a * a + (1 - share_a) * b, normalised to length 1."""
    mixed = F.zip_with(a, b, lambda x, y: share_a * x.cast("double") + (1 - share_a) * y.cast("double"))
    return F.transform(mixed, lambda x: F.try_divide(x, norm(mixed)))
