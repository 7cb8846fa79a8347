"""Vector expressions over ``array<double>`` columns, in whole-stage JVM code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_double(c: Column) -> Column:
    """float storage to double arithmetic."""
    return F.transform(c, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def scale(a: Column, by: Column) -> Column:
    return F.transform(a, lambda x: x * by)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def normalize(a: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a)


def chord2(cos: Column) -> Column:
    """Squared chord distance of unit vectors."""
    return 2 - 2 * cos


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two sets; 0 where both are empty."""
    return F.size(F.array_intersect(a, b)) / (F.size(F.array_union(a, b)) + 1e-9)


def linear_grid(lo: float, hi: float, n: int) -> list[float]:
    """n evenly spaced values from lo to hi, rounded to 10 digits."""
    return [round(lo + (hi - lo) * i / (n - 1), 10) for i in range(n)]
