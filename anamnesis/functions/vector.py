"""Vector expressions: JVM-side column functions over arrays, in double."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalize(v: Column) -> Column:
    """v over its length; a zero vector stays."""
    n = norm(v)
    return F.when(n == 0, _double(v)).otherwise(F.transform(_double(v), lambda x: x / n))


def sq_dist(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a side is null, empty or of length zero; unequal dimensions raise."""
    n = norm(a) * norm(b)
    mismatch = F.raise_error(F.lit("vector dimensions differ")).cast("double")
    none = F.coalesce(F.size(a), F.lit(0)) * F.coalesce(F.size(b), F.lit(0)) <= 0
    return F.when(none, 0.0).when(F.size(a) != F.size(b), mismatch).when(n == 0, 0.0).otherwise(dot(a, b) / n)


def f16(w: Column) -> Column:
    """Round to half precision (normal range), ties to even."""
    step = F.pow(F.lit(2.0), F.floor(F.log2(F.abs(w))) - 10)
    return F.when(w == 0, w).otherwise(F.rint(w / step) * step)
