"""Staged settings, epoch metrics, statistics, grids and profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshframe.functions.arrays import as_doubles
from meshframe.operators.params import Layout
from meshframe.session import broadcast_if_small

DEFAULT_RATE = 1e-4


@dataclass(frozen=True)
class Stage:
    name: str
    epochs: int
    lr: float | None = None
    weights: Mapping[str, float] = field(default_factory=dict)


# The three training stages.
TRAINING_STAGES = (
    Stage("Stage1_LockDownPose", 10, 1e-4, {
        "pixel": 0.0, "landmark": 0.5, "reg_shape": 1.0, "reg_transl": 100.0, "reg_global_pose": 10.0,
        "reg_jaw_pose": 1.0, "reg_neck_pose": 1.0, "reg_eye_pose": 1.0, "reg_detail": 1e-4,
    }),
    Stage("Stage2_CoarseAlignment", 10, 1e-5, {
        "pixel": 0.0, "landmark": 0.3, "reg_shape": 0.5, "reg_transl": 10.0, "reg_global_pose": 5.0,
        "reg_jaw_pose": 1.0, "reg_neck_pose": 1.0, "reg_eye_pose": 1.0, "reg_detail": 1e-3,
    }),
    Stage("Stage3_FinetuneShape", 10, 1e-5, {
        "pixel": 0.0, "landmark": 0.2, "reg_shape": 0.2, "reg_transl": 1.0, "reg_global_pose": 1.0,
        "reg_jaw_pose": 0.5, "reg_neck_pose": 0.5, "reg_eye_pose": 0.5, "reg_detail": 1e-4,
    }),
)


def epoch_settings(spark: SparkSession, stages: Sequence[Stage] = TRAINING_STAGES,
                   default_rate: float = DEFAULT_RATE) -> DataFrame:
    """One row per global epoch: stage, its settings and the report marks."""
    starts = [0, *accumulate(s.epochs for s in stages)]
    total = starts[-1]
    schema = T.StructType([
        T.StructField("stage", T.IntegerType()), T.StructField("name", T.StringType()),
        T.StructField("start", T.IntegerType()), T.StructField("epochs", T.IntegerType()),
        T.StructField("lr", T.DoubleType()), T.StructField("weights", T.MapType(T.StringType(), T.DoubleType())),
    ])
    rows = [
        (i + 1, s.name, starts[i], s.epochs, default_rate if s.lr is None else float(s.lr), dict(s.weights))
        for i, s in enumerate(stages) if s.epochs > 0
    ]
    marked = [0, total // 2, total - 1] if total > 0 else [0]
    within = F.col("epoch") - F.col("start")
    progress = (within == 0) | ((within + 1) % 5 == 0) | (within == F.col("epochs") - 1)
    return (
        spark.createDataFrame(rows, schema)
        .withColumn("epoch", F.explode(F.sequence("start", F.col("start") + F.col("epochs") - 1)))
        .select("epoch", "stage", "name", within.alias("stage_epoch"), "lr", "weights",
                F.col("epoch").isin(marked).alias("verbose"), progress.alias("progress"))
    )


def with_settings(df: DataFrame, stages: Sequence[Stage] = TRAINING_STAGES, epoch: str = "epoch") -> DataFrame:
    """Attach stage, learning rate, weights and marks by global epoch; other epochs keep nulls."""
    settings = epoch_settings(df.sparkSession, stages).withColumnRenamed("epoch", "_epoch")
    small = broadcast_if_small(settings, sum(s.epochs for s in stages), 1024)
    return df.join(small, F.col(epoch) == F.col("_epoch"), "left").drop("_epoch")


def last_batch(df: DataFrame, by: Sequence[str], order: str, value: str = "value") -> DataFrame:
    """Value at the highest batch of each group, and the mean over its batches beside it."""
    return df.groupBy(*by).agg(
        F.max(order).alias("last_batch"),
        F.max_by(value, order).alias("last_value"),
        F.avg(value).alias("mean_value"),
    )


def metric_rows(terms: DataFrame, epoch: str = "epoch", term: str = "term", value: str = "last_value") -> DataFrame:
    """Scalar log rows (tag, step, value) of last-batch term values."""
    tag = F.concat(F.lit("Loss/train_"), F.col(term), F.lit("_epoch_last_batch"))
    return terms.select(tag.alias("tag"), (F.col(epoch) + 1).cast("bigint").alias("step"), F.col(value).alias("value"))


def rate_rows(settings: DataFrame, epoch: str = "epoch") -> DataFrame:
    """Scalar log rows of the learning rate, one per epoch."""
    return settings.select(
        F.lit("Hyperparameters/learning_rate_epoch").alias("tag"),
        (F.col(epoch) + 1).cast("bigint").alias("step"),
        F.col("lr").alias("value"),
    ).distinct()


def axis_stats(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean, sample deviation, min, max and count per column: (by, axis, ...), in one aggregate.

    The deviation of a single row is null.
    """
    stats = [F.struct(
        F.lit(c).alias("axis"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
        F.min(c).alias("min"), F.max(c).alias("max"), F.count(c).alias("n"),
    ) for c in cols]
    return df.groupBy(*by).agg(F.array(*stats).alias("_stats")).select(*by, F.inline("_stats"))


def moment_states(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """What :func:`axis_stats` needs of a batch, in a form that adds up: (by, axis, n, mean, m2, min, max).

    ``m2`` is the sum of squared deviations from the batch's mean. States of several batches go into one table, are merged by
    :func:`merge_states` at any time and in any order, and give the statistics of all rows without reading these again.
    """
    stats = [F.struct(
        F.lit(c).alias("axis"), F.count(c).alias("n"), F.avg(c).alias("mean"),
        (F.var_pop(c) * F.count(c)).alias("m2"), F.min(c).alias("min"), F.max(c).alias("max"),
    ) for c in cols]
    return df.groupBy(*by).agg(F.array(*stats).alias("_stats")).select(*by, F.inline("_stats"))


def merge_states(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One state per group from any number of them. Deviations are taken from the joint mean, so large offsets cost no digits."""
    keys = [*by, "axis"]
    whole = states.groupBy(*keys).agg(F.sum("n").alias("_n"), F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum("n")).alias("_mean"))
    whole = whole.select("_n", "_mean", *[F.col(k).alias(f"_{k}") for k in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    gap = F.col("mean") - F.col("_mean")
    joined = states.join(whole, same).select(*keys, "n", "mean", "m2", "min", "max", "_n", "_mean")
    return joined.groupBy(*keys, "_n", "_mean").agg(
        F.sum(F.col("m2") + F.col("n") * gap * gap).alias("m2"), F.min("min").alias("min"), F.max("max").alias("max")
    ).select(*keys, F.col("_n").alias("n"), F.col("_mean").alias("mean"), "m2", "min", "max")


def stats_of_states(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The columns of :func:`axis_stats` from merged states."""
    return states.select(
        *by, "axis", "mean", F.when(F.col("n") > 1, F.sqrt(F.greatest("m2", F.lit(0.0)) / (F.col("n") - 1))).alias("std"), "min", "max", "n")


def group_stats(df: DataFrame, col: str, layout: Layout, groups: Sequence[str] | None = None) -> DataFrame:
    """Statistics over all elements of each parameter group.

    Elements find their group by position, so a vector is unrolled once. Groups of width zero and
    names the layout does not have are reported as ``empty`` and ``absent``.
    """
    names = list(groups or layout.names)
    known = [n for n in names if n in layout.names and layout.width(n) > 0]
    group = F.lit(None).cast("string")
    for name in known:
        start = layout.offset(name)
        group = F.when(F.col("i").between(start, start + layout.width(name) - 1), name).otherwise(group)
    stats = (
        df.select(F.posexplode(as_doubles(col)).alias("i", "x"))
        .select(group.alias("group"), "x")
        .filter(F.col("group").isNotNull())
        .groupBy("group")
        .agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"),
             F.max("x").alias("max"), F.count("x").alias("n"))
    )
    listed = df.sparkSession.createDataFrame(
        [(n, "absent" if n not in layout.names else "empty" if n not in known else "present") for n in names],
        "group string, kind string",
    )
    state = F.when((F.col("kind") == "present") & F.col("n").isNull(), "empty").otherwise(F.col("kind"))
    return listed.join(stats, "group", "left").select(
        "group", state.alias("state"), "mean", "std", "min", "max", F.coalesce("n", F.lit(0)).alias("n")
    )


def grid(df: DataFrame, width: float, height: float, gw: int = 40, gh: int = 20, x: str = "x", y: str = "y",
         by: Sequence[str] = ()) -> DataFrame:
    """Points per grid cell: (by, gx, gy, points). Points without a position (NaN or null) have no cell."""
    def bin_of(col: str, size: float, cells: int) -> Column:
        share = F.greatest(F.least(F.col(col) / F.lit(float(size)), F.lit(1.0)), F.lit(0.0))
        return F.floor(share * (cells - 1)).cast("int")

    placed = df.filter(~F.isnan(x) & ~F.isnan(y) & F.col(x).isNotNull() & F.col(y).isNotNull())
    return (
        placed.select(*by, bin_of(x, width, gw).alias("gx"), bin_of(y, height, gh).alias("gy"))
        .groupBy(*by, "gx", "gy")
        .agg(F.count("*").alias("points"))
    )


def preview(df: DataFrame, col: str, k: int = 5) -> DataFrame:
    """Keep the first k elements of an array column."""
    return df.withColumn(col, F.slice(col, 1, k))


def preview_rows(df: DataFrame, index: str = "lmk", k: int = 5) -> DataFrame:
    """Keep the first k points of each sample of a long table."""
    return df.filter(F.col(index) < k)


def profile(df: DataFrame, col: str, by: Sequence[str], order: str, k: int = 5) -> DataFrame:
    """Profile of the matrix whose rows are the arrays of one group.

    Shape, element type, min, mean and max over all elements, and the first k elements of the first
    row. Rows are reduced on their own before grouping.
    """
    dtype = df.schema[col].dataType.elementType.simpleString()
    x = as_doubles(col)
    rows = df.select(
        *by, F.col(order).alias("_order"), F.size(col).cast("bigint").alias("_w"),
        F.array_min(x).alias("_lo"), F.array_max(x).alias("_hi"),
        F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v).alias("_sum"), F.slice(x, 1, k).alias("_head"),
    )
    return rows.groupBy(*by).agg(
        F.count("*").alias("rows"),
        F.max("_w").alias("width"),
        F.lit(dtype).alias("dtype"),
        F.min("_lo").alias("min"),
        F.try_divide(F.sum("_sum"), F.sum("_w")).alias("mean"),
        F.max("_hi").alias("max"),
        F.min_by("_head", "_order").alias("head"),
    )
