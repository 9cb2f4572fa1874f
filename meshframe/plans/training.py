"""From coefficient vectors to weighted losses and epoch metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshframe.functions.camera import Camera
from meshframe.operators.geometry import decode_dense, decode_landmarks, project
from meshframe.operators.losses import (
    active_terms, fused_terms, sample_sum_columns, unpivot_terms, with_sample_sums,
)
from meshframe.operators.params import Layout, check_width, split_vector
from meshframe.operators.reporting import Stage, last_batch, with_settings
from meshframe.sources.assets import FaceModel


def landmark_rows(params: DataFrame, model: FaceModel, layout: Layout, keep: Sequence[str], truth: str = "truth",
                  key: str = "sid", camera: Camera = Camera(), dense: bool = True) -> DataFrame:
    """Screen landmarks beside their truth: (keep, key, lmk, sx, sy, tx, ty).

    The truth travels as one array in the sample's row and is unrolled together with the prediction,
    so no landmark-level join is needed.
    """
    if dense:
        rows = decode_dense(params, model, layout, key, keep=[*keep, truth]).select(
            *keep, key, F.posexplode_outer(F.arrays_zip("points", F.col(truth).alias("truth"))).alias("lmk", "_p")
        ).select(*keep, key, "lmk", "_p.points.x", "_p.points.y", "_p.points.z",
                 F.col("_p.truth.x").cast("double").alias("tx"), F.col("_p.truth.y").cast("double").alias("ty"))
    else:
        rows = decode_landmarks(params, model, layout, key, keep=keep, truth=truth, dense=False)
    return project(rows, camera).select(*keep, key, "lmk", "sx", "sy", "tx", "ty")


def _fused(samples: DataFrame, model: FaceModel, layout: Layout, active: Sequence[str], coeffs: str, truth: str,
           by: Sequence[str], key: str, dense: bool, images: tuple[str, str] | None) -> DataFrame:
    """One pass over the samples and one shuffle of partial sums."""
    params = split_vector(check_width(samples, coeffs, layout), coeffs, layout)
    summed = with_sample_sums(params, active, images)
    rows = landmark_rows(summed, model, layout, [*by, *sample_sum_columns(active)], truth, key, dense=dense)
    return fused_terms(rows, active, by)


def batch_losses(samples: DataFrame, model: FaceModel, layout: Layout, weights: Mapping[str, float],
                 coeffs: str = "coeffs", truth: str = "truth", by: Sequence[str] = ("batch",), key: str = "sid",
                 dense: bool = True, images: tuple[str, str] | None = None) -> DataFrame:
    """Term table with the total of every batch, from samples with coefficients and true landmarks.

    A positive pixel weight needs ``images``, the names of the predicted and the true image column.
    """
    wide = _fused(samples, model, layout, active_terms(weights), coeffs, truth, by, key, dense, images)
    return unpivot_terms(wide, weights, by)


def staged_losses(samples: DataFrame, model: FaceModel, layout: Layout, stages: Sequence[Stage],
                  coeffs: str = "coeffs", truth: str = "truth", key: str = "sid", dense: bool = True,
                  images: tuple[str, str] | None = None) -> DataFrame:
    """Term table per (epoch, batch), weighted by each epoch's stage."""
    by = ("epoch", "batch")
    active = active_terms(*[s.weights for s in stages])
    wide = _fused(samples, model, layout, active, coeffs, truth, by, key, dense, images)
    return unpivot_terms(with_settings(wide, stages), "weights", by)


def epoch_metrics(terms: DataFrame, stages: Sequence[Stage]) -> DataFrame:
    """Scalar log (tag, step, value): last-batch terms and the learning rate of every logged epoch.

    The rate of an epoch comes from its row of the total, so the losses are computed once.
    """
    last = with_settings(last_batch(terms, ["epoch", "term"], "batch"), stages)
    rate = F.struct(
        F.lit("Hyperparameters/learning_rate_epoch").alias("tag"),
        (F.col("epoch") + 1).cast("bigint").alias("step"), F.col("lr").alias("value"),
    )
    tag = F.concat(F.lit("Loss/train_"), F.col("term"), F.lit("_epoch_last_batch"))
    loss = F.struct(tag.alias("tag"), (F.col("epoch") + 1).cast("bigint").alias("step"), F.col("last_value").alias("value"))
    logged = (F.col("term") == "total") & F.col("lr").isNotNull()
    return last.select(F.inline(F.when(logged, F.array(loss, rate)).otherwise(F.array(loss))))
