"""Channel-wise arithmetic on pixel arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from meshframe.session import doubles

# Per-channel mean and deviation of the image encoder's input, red, green, blue.
CHANNEL_MEAN = (0.485, 0.456, 0.406)
CHANNEL_STD = (0.229, 0.224, 0.225)


def _channel(i: Column, channels: int, plane: int | None) -> Column:
    """Channel of element i: interleaved without ``plane``, else channel-first planes of that size."""
    index = i if plane is None else F.floor(i / F.lit(plane))
    return F.pmod(index, F.lit(channels)).cast("int")


def normalize(pixels: Column, mean: Sequence[float] = CHANNEL_MEAN, std: Sequence[float] = CHANNEL_STD,
              plane: int | None = None) -> Column:
    means, stds = doubles(*mean), doubles(*std)
    return F.transform(
        pixels,
        lambda x, i: (x - F.get(means, _channel(i, len(mean), plane))) / F.get(stds, _channel(i, len(std), plane)),
    )


def denormalize(pixels: Column, mean: Sequence[float] = CHANNEL_MEAN, std: Sequence[float] = CHANNEL_STD,
                clamp: bool = False, plane: int | None = None) -> Column:
    means, stds = doubles(*mean), doubles(*std)

    def restore(x: Column, i: Column) -> Column:
        value = x * F.get(stds, _channel(i, len(std), plane)) + F.get(means, _channel(i, len(mean), plane))
        if not clamp:
            return value
        return F.when(F.isnan(value), value).otherwise(F.greatest(F.least(value, F.lit(1.0)), F.lit(0.0)))

    return F.transform(pixels, restore)
