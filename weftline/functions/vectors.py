"""Vector expressions in the JVM, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(c: Column) -> Column:
    return c.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_d(a), _d(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(_d(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Null where either vector is null or zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def normalized(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(_d(a), lambda x: (x / n).cast("float"))).otherwise(a.cast("array<float>"))
