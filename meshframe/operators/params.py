"""Coefficient vectors: layout, slicing, width contract, linear head, neutral groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshframe.functions.arrays import as_doubles, dot
from meshframe.operators.blocks import BLOCK_BYTES, map_blocks, pack
from meshframe.session import BROADCAST_BYTES, broadcast_if_small, doubles

# The 6D encoding of "no rotation".
NEUTRAL_6D = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)


@dataclass(frozen=True)
class Layout:
    """Ordered group widths of a coefficient vector."""

    groups: tuple[tuple[str, int], ...]

    @property
    def names(self) -> tuple[str, ...]:
        return tuple(name for name, _ in self.groups)

    @property
    def total(self) -> int:
        return sum(width for _, width in self.groups)

    def width(self, name: str) -> int:
        return dict(self.groups)[name]

    def offset(self, name: str) -> int:
        return sum(width for _, width in self.groups[: self.names.index(name)])

    def neutral(self, name: str) -> tuple[float, ...]:
        """Zeros, but "no rotation" for a six-wide global pose."""
        width = self.width(name)
        return NEUTRAL_6D if name == "global_pose" and width == 6 else (0.0,) * width


# Group order and widths of the full coefficient vector.
FULL_LAYOUT = Layout((
    ("shape", 100), ("expression", 0), ("global_pose", 6), ("jaw_pose", 3),
    ("eye_pose", 6), ("neck_pose", 3), ("transl", 3), ("detail", 106),
))

# The same groups on a 64-wide vector.
COMPACT_LAYOUT = Layout((
    ("shape", 40), ("expression", 0), ("global_pose", 6), ("jaw_pose", 3),
    ("eye_pose", 6), ("neck_pose", 3), ("transl", 3), ("detail", 3),
))


def check_layout(layout: Layout, width: int) -> None:
    if layout.total != width:
        raise ValueError(f"layout covers {layout.total} coefficients, the vector has {width}")


def has_width(col: str | Column, layout: Layout) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.size(col) == layout.total, F.lit(False))


def check_width(df: DataFrame, col: str, layout: Layout, mode: str = "raise"):
    """Enforce the vector width.

    ``raise`` fails the job on the first wrong row, ``quarantine`` returns (good, bad) DataFrames.
    """
    fits = has_width(col, layout)
    if mode == "raise":
        message = F.concat(F.lit(f"expected {layout.total} coefficients, got "), F.size(col).cast("string"))
        guarded = F.when(fits, F.col(col)).otherwise(
            F.raise_error(F.coalesce(message, F.lit("coefficients are null"))).cast(df.schema[col].dataType)
        )
        return df.withColumn(col, guarded)
    if mode == "quarantine":
        return df.filter(fits), df.filter(~fits)
    raise ValueError(f"unknown mode {mode!r}")


def group_slice(col: str | Column, layout: Layout, name: str) -> Column:
    if layout.width(name) == 0:
        return doubles()
    return F.slice(as_doubles(col), layout.offset(name) + 1, layout.width(name))


def split_vector(df: DataFrame, col: str, layout: Layout) -> DataFrame:
    """Replace the vector by one array column per group."""
    return df.select(
        *[c for c in df.columns if c != col],
        *[group_slice(col, layout, name).alias(name) for name in layout.names],
    )


def join_groups(df: DataFrame, layout: Layout, out: str) -> DataFrame:
    """Inverse of :func:`split_vector`."""
    rest = [c for c in df.columns if c not in layout.names]
    return df.select(*rest, F.concat(*[F.col(n) for n in layout.names]).alias(out))


def neutralize(df: DataFrame, groups: Sequence[str], layout: Layout) -> DataFrame:
    """Set the chosen groups of every row to neutral values."""
    return df.withColumns({name: doubles(*layout.neutral(name)) for name in groups})


def neutral_bias(layout: Layout, width: int) -> list[float]:
    """Bias of a fresh head: zeros, with "no rotation" only where the vector reaches that far."""
    bias = [0.0] * width
    start = layout.offset("global_pose")
    if width >= start + len(NEUTRAL_6D):
        bias[start : start + len(NEUTRAL_6D)] = NEUTRAL_6D
    return bias


def score_head(df: DataFrame, feat: str, head: DataFrame, n_out: int, n_in: int, key: str = "sid") -> DataFrame:
    """Linear head y = W f + b in long form (key, o, y).

    ``head`` has one row per output: ``o``, ``w`` (n_in weights) and ``b``.
    """
    outputs = F.explode(F.sequence(F.lit(0), F.lit(n_out - 1))).alias("o")
    rows = df.select(key, as_doubles(feat).alias("_f"), outputs)
    weights = broadcast_if_small(head.select("o", "w", "b"), n_out, 8 * (n_in + 2))
    return rows.join(weights, "o").select(key, "o", (dot(F.col("_f"), F.col("w")) + F.col("b")).alias("y"))


def score_head_dense(df: DataFrame, feat: str, weights: np.ndarray, bias: np.ndarray,
                     key: str = "sid", out: str = "coeffs", budget: int | None = None) -> DataFrame:
    """The same product, one matrix multiplication per Arrow batch, result as one array per row.

    A head within the budget is broadcast. A larger one, given as arrays on the driver, is cut into blocks of outputs, of which a
    worker holds one; the outputs of a row are then put together by a shuffle.
    """
    weights, bias = np.asarray(weights, dtype=np.float64), np.asarray(bias, dtype=np.float64)
    size = 8 * (weights.shape[1] + 1)
    step = len(weights) if budget is None and size * len(weights) <= BROADCAST_BYTES else max(1, (budget or BLOCK_BYTES) // size)
    spark = df.sparkSession
    rows = df.select(key, as_doubles(feat).alias("_f"))
    fields = T.StructType([rows.schema[key], T.StructField("first", T.IntegerType()), T.StructField(out, T.ArrayType(T.DoubleType()))])

    def product(m: dict[str, np.ndarray], record: pa.RecordBatch, first: int) -> pa.RecordBatch:
        x = matrix_of(record.column(record.schema.get_field_index("_f")), m["w"].shape[1])
        return pa.RecordBatch.from_arrays([
            record.column(record.schema.get_field_index(key)), pa.array(np.full(len(x), first, np.int32)), list_of(x @ m["w"].T + m["b"])],
            names=[key, "first", out])

    if step >= len(weights):
        shared = spark.sparkContext.broadcast({"w": weights, "b": bias})

        def run(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for record in records:
                yield product(shared.value, record, 0)

        return rows.mapInArrow(run, fields).drop("first")

    def one(held: tuple[int, dict[str, np.ndarray]], record: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield product(held[1], record, held[0])

    starts = range(0, len(weights), step)
    blocks = spark.createDataFrame(pa.table({
        "block": pa.array(range(len(starts)), pa.int32()),
        "payload": pa.array([pack({"w": weights[i:i + step], "b": bias[i:i + step]}) for i in starts], pa.binary())}))
    # Equal keys stay rows of their own.
    named = rows.withColumn("_row", F.monotonically_increasing_id())
    fields = T.StructType([named.schema[key], T.StructField("_row", T.LongType()), *fields.fields[1:]])

    def numbered(held: tuple[int, dict[str, np.ndarray]], record: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for found in one(held, record):
            columns = [found.column(0), record.column(record.schema.get_field_index("_row")), *found.columns[1:]]
            yield pa.RecordBatch.from_arrays(columns, names=fields.names)

    parts = map_blocks(named, blocks, len(starts), numbered, fields, lambda block, m: (block * step, m))
    joined = F.array_sort(F.collect_list(F.struct("first", out)))
    return parts.groupBy(key, "_row").agg(F.flatten(F.transform(joined, lambda p: p[out])).alias(out)).drop("_row")


def matrix_of(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as a matrix; every list must have ``width`` elements."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if column.null_count or len(flat) != len(column) * width:
        raise ValueError(f"expected lists of {width} numbers")
    return flat.reshape(len(column), width)


def list_of(matrix: np.ndarray, wrap: Callable[[np.ndarray], pa.Array] = pa.array) -> pa.ListArray:
    """Matrix rows as a list column."""
    rows, width = matrix.shape
    offsets = np.arange(0, rows * width + 1, width, dtype=np.int32) if width else np.zeros(rows + 1, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), wrap(matrix.reshape(-1)))
