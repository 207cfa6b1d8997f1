"""Vectors: ARRAY<FLOAT or DOUBLE>, computed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column) -> Column:
    """Length 1; a vector of length 1e-12 or less stays."""
    n = norm(a)
    return F.when(n <= 1e-12, a.cast("array<double>")).otherwise(F.transform(a, lambda x: x.cast("double") / n))
