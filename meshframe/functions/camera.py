"""Perspective camera looking at the origin."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Camera:
    """Pose by distance, elevation and azimuth (degrees); vertical up axis.

    Screen x grows to the right, y downwards, the optical axis hits (width/2, height/2) and there
    is no half-pixel shift.
    """

    distance: float = 2.7
    elevation: float = 0.0
    azimuth: float = 0.0
    fov: float = 30.0
    width: int = 224
    height: int = 224

    def axes(self) -> tuple[tuple[float, ...], tuple[float, ...], tuple[float, ...], tuple[float, ...]]:
        """Right, up and forward unit vectors, and the camera position."""
        e, a = math.radians(self.elevation), math.radians(self.azimuth)
        eye = (
            self.distance * math.cos(e) * math.sin(a),
            self.distance * math.sin(e),
            self.distance * math.cos(e) * math.cos(a),
        )
        forward = tuple(-c / self.distance for c in eye)
        flat = math.hypot(forward[0], forward[2])
        right = (-forward[2] / flat, 0.0, forward[0] / flat)
        up = (
            right[1] * forward[2] - right[2] * forward[1],
            right[2] * forward[0] - right[0] * forward[2],
            right[0] * forward[1] - right[1] * forward[0],
        )
        return right, up, forward, eye

    def screen(self, x: Column, y: Column, z: Column) -> tuple[Column, Column]:
        right, up, forward, eye = self.axes()

        def along(axis: tuple[float, ...]) -> Column:
            shift = -sum(a * c for a, c in zip(axis, eye))
            terms = [F.lit(a) * c for a, c in zip(axis, (x, y, z)) if a != 0.0]
            total = terms[0]
            for term in terms[1:]:
                total = total + term
            return total + F.lit(shift) if shift else total

        scale = min(self.width, self.height) / 2.0 / math.tan(math.radians(self.fov) / 2.0)
        depth = along(forward)
        sx = F.lit(self.width / 2.0) + F.try_divide(F.lit(scale) * along(right), depth)
        sy = F.lit(self.height / 2.0) - F.try_divide(F.lit(scale) * along(up), depth)
        return sx, sy
