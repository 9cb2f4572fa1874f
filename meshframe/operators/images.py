"""Image preparation and landmark rescaling."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshframe.functions.pixels import CHANNEL_MEAN, CHANNEL_STD

ENCODER_SIZE = (224, 224)
STORED_SIZE = (128, 128)
# A prepared image is about 150,000 floats, so only a few share a batch.
_IMAGES_PER_BATCH = 16


@lru_cache(maxsize=256)
def resize_weights(src: int, dst: int) -> np.ndarray:
    """(dst, src) bilinear weights with half-pixel centers; the filter widens when shrinking."""
    scale = src / dst
    support = max(scale, 1.0)
    centers = (np.arange(dst)[:, None] + 0.5) * scale
    gaps = np.abs(np.arange(src)[None, :] + 0.5 - centers) / support
    weights = np.clip(1.0 - gaps, 0.0, None)
    return weights / weights.sum(axis=1, keepdims=True)


def _prepared(pixels: np.ndarray, size: tuple[int, int], mean: np.ndarray, std: np.ndarray) -> np.ndarray:
    """Images of one size (n, h, w, 3) resized, rounded to whole levels, scaled, normalized, channel-first."""
    down, across = resize_weights(pixels.shape[1], size[0]), resize_weights(pixels.shape[2], size[1])
    planes = down @ pixels.transpose(0, 3, 1, 2) @ across.T
    levels = np.floor(planes + 0.5).clip(0, 255) / 255.0
    return ((levels - mean[:, None, None]) / std[:, None, None]).astype(np.float32)


def prepare_images(df: DataFrame, size: tuple[int, int] = ENCODER_SIZE, mean: Sequence[float] = CHANNEL_MEAN,
                   std: Sequence[float] = CHANNEL_STD, key: str = "stem",
                   transform: Callable[[np.ndarray], np.ndarray] | None = None,
                   batch_transform: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """RGB byte images to encoder inputs: (key, channels, height, width, pixels array<float>).

    Input columns are key, height, width and data. One of the hooks may replace the standard preparation: ``batch_transform`` gets
    all images of one size in a batch, (n, h, w, 3), and returns (n, c, h', w'), ``transform`` one (h, w, 3) image and returns
    (c, h', w'). For a hook in columns see :func:`transform_pixels`.
    """
    if transform and batch_transform:
        raise ValueError("one hook at a time")
    together = batch_transform or (lambda images: _prepared(images.astype(np.float64), size, means, stds))
    means, stds = np.asarray(mean, dtype=np.float64), np.asarray(std, dtype=np.float64)

    def prepare(images: list[np.ndarray]) -> list[np.ndarray]:
        """The images prepared, those of one size together."""
        if transform:
            return [np.asarray(transform(im), dtype=np.float32) for im in images]
        out: list[np.ndarray] = [None] * len(images)
        for shape in {im.shape for im in images}:
            places = [i for i, im in enumerate(images) if im.shape == shape]
            ready = np.asarray(together(np.stack([images[i] for i in places])), dtype=np.float32)
            if ready.ndim != 4 or len(ready) != len(places):
                raise ValueError(f"the hook gave shape {ready.shape} for {len(places)} images")
            for i, image in zip(places, ready):
                out[i] = image
        return out

    key_type = df.schema[key].dataType.simpleString()

    def run(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in records:
            for start in range(0, record.num_rows, _IMAGES_PER_BATCH):
                part = record.slice(start, _IMAGES_PER_BATCH)
                images = prepare([
                    np.frombuffer(data, np.uint8).reshape(h, w, 3)
                    for data, h, w in zip(*(part.column(c).to_pylist() for c in ("data", "height", "width")))
                ])
                shapes = np.array([im.shape for im in images], dtype=np.int32).reshape(-1, 3)
                ends = np.concatenate([[0], np.cumsum([im.size for im in images])]).astype(np.int32)
                flat = np.concatenate([im.reshape(-1) for im in images]) if images else np.zeros(0, np.float32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(key), *[pa.array(shapes[:, i]) for i in range(3)],
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                    names=[key, "channels", "height", "width", "pixels"],
                )

    schema = f"`{key}` {key_type}, channels int, height int, width int, pixels array<float>"
    return df.select(key, "height", "width", "data").mapInArrow(run, schema)


def transform_pixels(df: DataFrame, transform: Callable[[Column], Column], pixels: str = "pixels") -> DataFrame:
    """Prepared images with ``transform``, a function of columns, over their pixels; it must keep their number."""
    changed = transform(F.col(pixels))
    message = F.concat(F.lit("the hook gave "), F.size("_changed").cast("string"), F.lit(" pixels"))
    kept = F.when(F.size("_changed") == F.size(pixels), F.col("_changed")).otherwise(F.raise_error(message).cast(df.schema[pixels].dataType))
    return df.withColumn("_changed", changed.cast(df.schema[pixels].dataType)).withColumn(pixels, kept).drop("_changed")


def rescale(df: DataFrame, src: tuple[float, float] = STORED_SIZE, dst: tuple[float, float] = ENCODER_SIZE,
            points: str = "points") -> DataFrame:
    """Map an array of points from one image size (width, height) to another.

    The stored landmarks live in the stored size; equal sizes leave them as they are.
    """
    fx, fy = dst[0] / src[0], dst[1] / src[1]
    return df.withColumn(points, F.transform(points, lambda p: F.struct(
        (p["x"].cast("double") * fx).alias("x"), (p["y"].cast("double") * fy).alias("y")
    )))


def rescale_rows(df: DataFrame, src: tuple[float, float] = STORED_SIZE, dst: tuple[float, float] = ENCODER_SIZE,
                 x: str = "x", y: str = "y") -> DataFrame:
    """The same for points in columns."""
    return df.withColumns({x: F.col(x) * (dst[0] / src[0]), y: F.col(y) * (dst[1] / src[1])})
