"""Column arithmetic in named steps.

Longer formulas are written as SQL text, one column per intermediate value and one projection per
step, so that a value used several times is computed once.

A filter on a late step is pushed below the earlier ones and repeats their formulas; unroll such
columns with the outer form of explode, which infers no filter.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from itertools import zip_longest

from pyspark.sql import DataFrame

Steps = list[Mapping[str, str]]


def run_steps(df: DataFrame, *plans: Steps) -> DataFrame:
    """Add the columns of several independent step lists, level by level."""
    for level in zip_longest(*plans, fillvalue={}):
        columns = {name: text for step in level for name, text in step.items()}
        df = df.selectExpr("*", *[f"{text} AS {name}" for name, text in columns.items()])
    return df


def array_sql(items: Iterable[str]) -> str:
    return f"array({', '.join(items)})"


def number_sql(value: float) -> str:
    return f"{float(value)!r}D"


def numbers_sql(values: Iterable[float]) -> str:
    """Literal array<double>, also for no values."""
    items = [number_sql(v) for v in values]
    return array_sql(items) if items else "CAST(array() AS array<double>)"


def dot_sql(a: str, b: str) -> str:
    """Inner product of two arrays of equal length; 0 for empty arrays."""
    return f"aggregate(zip_with({a}, {b}, (x, y) -> x * y), 0D, (t, x) -> t + x)"


def product_sql(left: Iterable[str], right: Iterable[str]) -> str:
    """Sum of pairwise products, written out."""
    return " + ".join(f"{a} * {b}" for a, b in zip(left, right))
