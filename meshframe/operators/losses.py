"""Weighted multi-term loss as grouped sums and counts.

Every term is a mean over all elements of a group, kept as a sum and a count until the end, so the
aggregation combines within tasks and only one row per group and task is shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshframe.functions.arrays import sum_abs_gap, sum_squared_gap, sum_squares
from meshframe.operators.params import NEUTRAL_6D
from meshframe.session import doubles

# Regularized parameter group of each term.
REGULARIZERS = {
    "reg_shape": "shape",
    "reg_expression": "expression",
    "reg_transl": "transl",
    "reg_global_pose": "global_pose",
    "reg_jaw_pose": "jaw_pose",
    "reg_neck_pose": "neck_pose",
    "reg_eye_pose": "eye_pose",
    "reg_detail": "detail",
}


def mean_of(total: Column, count: Column) -> Column:
    """Mean over elements; 0 without any."""
    return F.coalesce(F.try_divide(total, count), F.lit(0.0))


def group_error(group: str) -> Column:
    """Sum of squares of a group, for the global pose as deviation from "no rotation"."""
    if group == "global_pose":
        return sum_squared_gap(F.col(group), doubles(*NEUTRAL_6D))
    return sum_squares(F.col(group))


def is_active(term: str, weights: Mapping[str, float]) -> bool:
    """A regularizer without a positive weight is never computed."""
    return weights.get(term, 0.0) > 0


def regularizer(params: DataFrame, term: str, by: Sequence[str]) -> DataFrame:
    """One regularizer per group of rows: (by, value)."""
    group = REGULARIZERS[term]
    value = mean_of(F.sum(group_error(group)), F.sum(F.size(group)))
    return params.groupBy(*by).agg(value.alias("value"))


def pixel_l1(df: DataFrame, pred: str, truth: str, by: Sequence[str]) -> DataFrame:
    """Mean absolute difference of two image arrays: (by, value).

    Images of unequal lengths fail the job; a row without one of them does not count.
    """
    gap, count = image_gap(pred, truth)
    return df.groupBy(*by).agg(mean_of(F.sum(gap), F.sum(count)).alias("value"))


def image_gap(pred: str, truth: str) -> tuple[Column, Column]:
    """Sum of absolute differences of a row's images and their number of elements; null without both."""
    a, b = F.col(pred), F.col(truth)
    both = a.isNotNull() & b.isNotNull()
    message = F.concat(F.lit("images of "), F.size(a).cast("string"), F.lit(" and "), F.size(b).cast("string"), F.lit(" elements"))
    fits = F.when(F.size(a) == F.size(b), sum_abs_gap(a, b)).otherwise(F.raise_error(message).cast("double"))
    return F.when(both, fits), F.when(both, F.size(a))


def landmark_mse(df: DataFrame, by: Sequence[str], pred: Sequence[str] = ("sx", "sy"),
                 truth: Sequence[str] = ("tx", "ty")) -> DataFrame:
    """Mean squared coordinate difference of aligned landmark rows: (by, value).

    Rows without a coordinate do not count.
    """
    gaps = [F.col(p) - F.col(t) for p, t in zip(pred, truth)]
    squares = sum((g * g for g in gaps[1:]), gaps[0] * gaps[0])
    return df.groupBy(*by).agg(mean_of(F.sum(squares), F.count(squares) * len(gaps)).alias("value"))


def align_landmarks(pred: DataFrame, truth: DataFrame, key: str = "sid") -> DataFrame:
    """Predicted landmark rows with the truth (key, lmk, x, y) joined as tx, ty; null for a prediction without truth, so its
    group still has a row in :func:`landmark_mse`."""
    given = truth.select(key, "lmk", F.col("x").alias("tx"), F.col("y").alias("ty"))
    return pred.join(given, [key, "lmk"], "left")


def loss_terms(params: DataFrame, weights: Mapping[str, float], by: Sequence[str] = ("batch",),
               landmarks: DataFrame | None = None, images: tuple[str, str] | None = None) -> DataFrame:
    """Long term table (by, term, value).

    ``params`` has one column per parameter group. ``landmarks`` are aligned rows as
    :func:`landmark_mse` takes them; ``images`` names a predicted and a true image column of
    ``params``, left out at weight zero. Regularizers without a positive weight are 0 and leave
    their columns out of the plan.
    """
    sums: dict[str, Column] = {}
    for term, group in REGULARIZERS.items():
        if is_active(term, weights) and group in params.columns:
            sums[term] = mean_of(F.sum(group_error(group)), F.sum(F.size(group)))
        else:
            sums[term] = F.lit(0.0)
    if images and weights.get("pixel", 1.0) > 0:
        gap, count = image_gap(*images)
        sums["pixel"] = mean_of(F.sum(gap), F.sum(count))
    if weights.get("perceptual", 0.0) > 0:
        sums["perceptual"] = F.lit(0.0)
    wide = params.groupBy(*by).agg(F.count("*").alias("_rows"), *[c.alias(t) for t, c in sums.items()])
    pairs = F.array(*[F.struct(F.lit(t).alias("term"), F.col(t).alias("value")) for t in sums])
    terms = wide.select(*by, F.inline(pairs))
    if landmarks is not None:
        # A group none of whose samples has landmarks or truth counts 0, as in the fused form.
        points = landmark_mse(landmarks, by).select(*[F.col(c).alias(f"_{c}") for c in by], F.col("value").alias("_value"))
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
        given = wide.select(*by).join(points, same, "left")
        terms = terms.unionByName(given.select(*by, F.lit("landmark").alias("term"), F.coalesce("_value", F.lit(0.0)).alias("value")))
    return terms


def weight_of(term: Column, weights: Mapping[str, float] | Column) -> Column:
    """Weight of a term in the total; a missing one counts 1."""
    if isinstance(weights, Column):
        return F.coalesce(F.try_element_at(weights, term), F.lit(1.0))
    if not weights:
        return F.lit(1.0)
    pairs = [c for t, w in weights.items() for c in (F.lit(t), F.lit(float(w)))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), term), F.lit(1.0))


def total_loss(terms: DataFrame, weights: Mapping[str, float] | str, by: Sequence[str] = ("batch",)) -> DataFrame:
    """Weighted sum per group: (by, value).

    ``weights`` is a fixed map, or the name of a map column of ``terms`` when stages differ by row.
    """
    chosen = F.col(weights) if isinstance(weights, str) else weights
    # The perceptual term is listed but never enters the total.
    counted = F.when(F.col("term") == "perceptual", 0.0).otherwise(weight_of(F.col("term"), chosen) * F.col("value"))
    return terms.groupBy(*by).agg(F.sum(counted).alias("value"))


def with_total(terms: DataFrame, weights: Mapping[str, float] | str, by: Sequence[str] = ("batch",)) -> DataFrame:
    """Term table with the total as one more term."""
    total = total_loss(terms, weights, by).select(*by, F.lit("total").alias("term"), "value")
    return total.unionByName(terms.select(*by, "term", "value"))


def active_terms(*weights: Mapping[str, float]) -> list[str]:
    """Pixel term and regularizers that at least one weight map computes."""
    return [t for t in ("pixel", *REGULARIZERS) if any(is_active(t, w) for w in weights)]


def with_sample_sums(params: DataFrame, active: Sequence[str], images: tuple[str, str] | None = None) -> DataFrame:
    """Add each active term's sum and element count of the row, two numbers per term.

    The pixel term needs ``images``, the names of the predicted and the true image column.
    """
    def parts(term: str) -> tuple[Column, Column]:
        if term != "pixel":
            return group_error(REGULARIZERS[term]), F.size(REGULARIZERS[term])
        if images is None:
            raise ValueError("a pixel weight needs the image columns")
        return image_gap(*images)

    return params.select("*", *[
        column.alias(f"{t}_{part}") for t in active for part, column in zip(("sq", "n"), parts(t))
    ])


def sample_sum_columns(active: Sequence[str]) -> list[str]:
    return [f"{t}_{part}" for t in active for part in ("sq", "n")]


def fused_terms(rows: DataFrame, active: Sequence[str], by: Sequence[str], index: str = "lmk") -> DataFrame:
    """All terms of a group in one aggregate over landmark rows, one column per term.

    Rows carry sx, sy, tx, ty and the sample's regularizer sums, which count at the first landmark
    only; a sample without landmarks comes as one row with a null index.
    """
    first = F.coalesce(F.col(index), F.lit(0)) == 0
    gaps = [F.col("sx") - F.col("tx"), F.col("sy") - F.col("ty")]
    squares = gaps[0] * gaps[0] + gaps[1] * gaps[1]
    terms = [mean_of(F.sum(squares), F.count(squares) * 2).alias("landmark")]
    for t in (*(["pixel"] if "pixel" in active else []), *REGULARIZERS):
        if t in active:
            total, count = (F.sum(F.when(first, F.col(f"{t}_{part}"))) for part in ("sq", "n"))
            terms.append(mean_of(total, count).alias(t))
        else:
            terms.append(F.lit(0.0).alias(t))
    return rows.groupBy(*by).agg(*terms)


def unpivot_terms(wide: DataFrame, weights: Mapping[str, float] | str, by: Sequence[str]) -> DataFrame:
    """Long term table (by, term, value) with the weighted total, from one column per term.

    With a weight map column, a regularizer that the row's map does not weigh counts as 0.
    """
    names = [*(["pixel"] if "pixel" in wide.columns else []), "landmark", *REGULARIZERS]
    chosen = F.col(weights) if isinstance(weights, str) else weights
    values = {t: F.col(t) for t in names}
    if isinstance(weights, str):
        for t in names:
            if t == "landmark":
                continue
            weighed = F.coalesce(F.try_element_at(chosen, F.lit(t)), F.lit(0.0)) > 0
            values[t] = F.when(weighed, F.col(t)).otherwise(0.0)
    if isinstance(weights, str):
        weighted = [weight_of(F.lit(t), chosen) * values[t] for t in names]
    else:
        weighted = [F.lit(float(weights.get(t, 1.0))) * values[t] for t in names]
    values = {"total": sum(weighted[1:], weighted[0]), **values}
    if not isinstance(weights, str) and weights.get("perceptual", 0.0) > 0:
        # Listed, but never part of the total.
        values["perceptual"] = F.lit(0.0)
    pairs = F.array(*[F.struct(F.lit(t).alias("term"), v.alias("value")) for t, v in values.items()])
    return wide.select(*by, F.inline(pairs))
