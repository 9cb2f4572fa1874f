"""Distributed row numbers without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshframe.session import ensure_checkpoint_dir

# monotonically_increasing_id() keeps the partition above this bit and the row within it below.
_ROW_BITS = 33


def number_rows(df: DataFrame, order: Sequence[str | Column], out: str = "n") -> DataFrame:
    """Zero-based ordinal of each row under ``order``.

    Rows are range-partitioned by the order, then by a hash of the whole row and its place in the input, so
    that a sort key shared by many rows, and rows equal in all columns, spread over several partitions. The sorted layout is checkpointed together
    with each row's partition and position; the only data brought together afterwards is one count
    per partition, from which the partition offsets follow.
    """
    ensure_checkpoint_dir(df.sparkSession)
    columns = df.columns
    hashable = [f.name for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    df = df.withColumn("_salt", F.monotonically_increasing_id())
    keys = [*order, F.xxhash64(*hashable), "_salt"]
    place = F.monotonically_increasing_id()
    laid_out = (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_place", place)
        .checkpoint()
        .withColumn("_part", F.shiftright("_place", _ROW_BITS))
    )
    # One row per partition, so this unpartitioned window stays at the partition count.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        laid_out.groupBy("_part")
        .agg(F.count("*").alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    row = F.col("_place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return laid_out.join(F.broadcast(offsets), "_part").select(
        *columns, (F.col("_offset") + row).cast("bigint").alias(out)
    )
