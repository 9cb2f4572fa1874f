"""From images and detections to a landed, paired corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshframe.operators.curation import classify, first_detection, pending


def detection_outcomes(images: DataFrame, detections: DataFrame, done: tuple[DataFrame, DataFrame], key: str = "stem",
                       pos: str = "face_pos") -> DataFrame:
    """Every image with the outcome of its first detection.

    ``detections`` has (key, pos, shape, error, ...); ``done`` holds the keys already landed with an
    image and with landmarks. Images already done are kept and marked, so the tally covers them.
    """
    todo = pending(images.select(key), *done, key).withColumn("_todo", F.lit(True))
    marked = images.join(todo, key, "left").withColumn("exists", F.col("_todo").isNull()).drop("_todo")
    return classify(first_detection(detections, key, pos, marked))
