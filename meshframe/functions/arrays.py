"""Small algebra on array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_doubles(col: Column | str) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return col.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays of equal length; 0 for empty arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def sum_squares(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x)


def sum_squared_gap(a: Column, target: Column) -> Column:
    """Sum of (a - target)^2, element by element."""
    return F.aggregate(
        F.zip_with(a, target, lambda x, t: (x - t) * (x - t)), F.lit(0.0), lambda acc, x: acc + x
    )


def sum_abs_gap(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda acc, x: acc + x
    )
