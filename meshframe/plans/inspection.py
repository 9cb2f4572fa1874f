"""Inspection of a model: decode the neutral row, report, and recompute its landmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshframe.operators.geometry import AXES, decode, landmarks3d
from meshframe.operators.params import Layout, neutralize
from meshframe.operators.quality import dangling, reconcile
from meshframe.operators.reporting import axis_stats
from meshframe.session import doubles
from meshframe.sources.assets import FaceModel
from meshframe.sources.sinks import obj_lines


def neutral_row(spark: SparkSession, layout: Layout, key: str = "sid") -> DataFrame:
    """One parameter row with every group neutral."""
    empty = spark.range(1).select(F.col("id").alias(key), *[doubles().alias(n) for n in layout.names])
    return neutralize(empty, layout.names, layout)


def inspect_model(spark: SparkSession, model: FaceModel, layout: Layout, tol: float = 1e-9) -> dict[str, DataFrame]:
    """Reports on the neutral mesh: statistics, mesh text, recomputed landmarks, dangling references."""
    verts, landmarks = decode(neutral_row(spark, layout), model, layout)
    points = landmarks.select("sid", F.col("lmk").alias("v"), *AXES)
    corners = model.faces.select("f", F.explode(F.array("a", "b", "c")).alias("v"))
    return {
        "vertex_stats": axis_stats(verts, AXES),
        "landmark_stats": axis_stats(landmarks, AXES),
        "mesh": obj_lines(verts, model.faces),
        "landmark_mesh": obj_lines(points),
        "recomputed": reconcile(landmarks, landmarks3d(verts, model), ["sid", "lmk"], AXES, tol),
        "landmarks_without_face": dangling(model.lmk_embed, "f", model.faces, "f"),
        "faces_without_vertex": dangling(corners, "v", model.template, "v"),
    }
