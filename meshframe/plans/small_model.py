"""A 25-vertex model from integer formulas, for the queries, the tests and the bench."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshframe.sources.assets import FaceModel, load_assets

VERTICES, JOINTS, LANDMARKS = 25, 5, 68
TREE = (-1, 0, 1, 1, 1)
AXES = ("x", "y", "z")


def template_value(v, c):
    return ((v * 7 + c * 3) % 11 - 5) / 50.0


def shape_value(v, c, s):
    return ((v * 5 + c * 2 + s * 3) % 13 - 6) / 100.0


def expression_value(v, c, s):
    return ((v * 3 + c * 5 + s * 2) % 13 - 6) / 100.0


def pose_value(v, c, p):
    return ((v + p * 2 + c) % 7 - 3) / 200.0


def tables(spark: SparkSession, n_shape: int = 40, n_expr: int = 0, vertices: int = VERTICES) -> dict[str, DataFrame]:
    """Model tables under the names and schemas that load_assets reads."""
    v = np.arange(vertices)
    f = np.arange(vertices - 2)
    lmk = np.arange(LANDMARKS)
    bary = np.stack([lmk % m + 1 for m in (3, 4, 5)])

    def table(**columns) -> DataFrame:
        return spark.createDataFrame(pa.table({
            name: pa.array(values.tolist() if values.ndim > 1 else values) for name, values in columns.items()
        }))

    def ids(values: np.ndarray) -> np.ndarray:
        return values.astype(np.int32)

    def basis(value, n: int, prefix: str) -> DataFrame:
        columns = {f"{prefix}{a}": value(v[:, None], c, np.arange(n)[None, :]) for c, a in enumerate(AXES)}
        return table(v=ids(v), **columns)

    out = {
        "template": table(v=ids(v), **{a: template_value(v, c) for c, a in enumerate(AXES)}),
        "shape_basis": basis(shape_value, n_shape, "b"),
        "pose_basis": basis(pose_value, 36, "p"),
        "joint_reg": table(j=ids(v % JOINTS), v=ids(v), w=np.full(vertices, JOINTS / vertices)),
        "skin": table(v=ids(v), w=((v[:, None] + np.arange(JOINTS)[None, :]) % JOINTS + 1) / 15.0),
        "joints": table(j=ids(np.arange(JOINTS)), parent=ids(np.array(TREE))),
        "faces": table(f=ids(f), a=ids(f), b=ids(f + 1), c=ids(f + 2)),
        "lmk_embed": table(lmk=ids(lmk), f=ids(lmk * 5 % len(f)), **{
            f"b{k}": bary[k] / bary.sum(axis=0) for k in range(3)
        }),
    }
    if n_expr:
        out["expr_basis"] = basis(expression_value, n_expr, "b")
    return out


@lru_cache(maxsize=8)
def small_model(spark: SparkSession, n_shape: int = 40, n_expr: int = 0, parents: tuple[int, ...] = TREE,
                vertices: int = VERTICES) -> FaceModel:
    """The model as load_assets makes it from these tables."""
    t = tables(spark, n_shape, n_expr, vertices)
    tree = pa.table({"j": pa.array(range(len(parents)), pa.int32()), "parent": pa.array(parents, pa.int32())})
    return load_assets(spark, "", n_shape, n_expr, {**t, "joints": spark.createDataFrame(tree)})


def truth_points(sid: Column) -> Column:
    """True landmark positions of a sample, on a 224x224 image."""
    return F.transform(F.sequence(F.lit(0), F.lit(LANDMARKS - 1)), lambda l: F.struct(
        (F.lit(112) + (sid * 3 + l * 7) % 41 - 20).cast("double").alias("x"),
        (F.lit(112) + (sid * 5 + l * 11) % 37 - 18).cast("double").alias("y"),
    ))
