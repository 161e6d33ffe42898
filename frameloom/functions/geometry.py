"""Boxes, points and affine transforms as column expressions; a box is (x_min, y_min, x_max, y_max)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@dataclass
class Box:
    x0: Column
    y0: Column
    x1: Column
    y1: Column

    @classmethod
    def of(cls, *sides: str) -> Box:
        return cls(*map(F.col, sides or ("x_min", "y_min", "x_max", "y_max")))

    @property
    def width(self) -> Column:
        return self.x1 - self.x0

    @property
    def height(self) -> Column:
        return self.y1 - self.y0

    @property
    def area(self) -> Column:
        return self.width * self.height

    @property
    def center(self) -> tuple[Column, Column]:
        return (self.x0 + self.x1) * 0.5, (self.y0 + self.y1) * 0.5

    def intersection(self, other: Box) -> Column:
        w = F.least(self.x1, other.x1) - F.greatest(self.x0, other.x0)
        h = F.least(self.y1, other.y1) - F.greatest(self.y0, other.y0)
        return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))

    def iou(self, other: Box, clamp_areas: bool = False) -> Column:
        """Intersection over union, 0 for a union that is not positive; trackers clamp areas at 0."""
        both = self.intersection(other)
        areas = [F.greatest(b.area, F.lit(0.0)) if clamp_areas else b.area for b in (self, other)]
        union = areas[0] + areas[1] - both
        return F.when(union > 0, both / union).otherwise(F.lit(0.0))

    def transformed(self, m: list[Column]) -> Box:
        """The upright box around the four transformed corners."""
        corners = [affine_point(m, x, y) for x in (self.x0, self.x1) for y in (self.y0, self.y1)]
        xs, ys = zip(*corners, strict=True)
        return Box(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))

    def measurement(self) -> tuple[Column, Column, Column, Column]:
        """Centre, area and aspect as a tracker measures a box."""
        ratio = F.when(F.abs(self.height) > 1e-8, self.width / self.height).otherwise(F.lit(1.0))
        return self.x0 + self.width / 2, self.y0 + self.height / 2, self.area, ratio

    @classmethod
    def from_measurement(cls, cx: Column, cy: Column, area: Column, ratio: Column) -> Box:
        area, ratio = F.greatest(area, F.lit(1e-8)), F.greatest(ratio, F.lit(1e-4))
        w = F.sqrt(area * ratio)
        h = area / F.greatest(w, F.lit(1e-8))
        return cls(cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2)


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((bx - ax) * (bx - ax) + (by - ay) * (by - ay))


def affine_point(m: list[Column], x: Column, y: Column) -> tuple[Column, Column]:
    """``m`` is a, b, tx, c, d, ty."""
    return m[0] * x + m[1] * y + m[2], m[3] * x + m[4] * y + m[5]


def affine_then(first: list[Column], second: list[Column]) -> list[Column]:
    """The transform that applies ``first`` and then ``second``."""
    a, b = first, second
    return [
        b[0] * a[0] + b[1] * a[3], b[0] * a[1] + b[1] * a[4], b[0] * a[2] + b[1] * a[5] + b[2],
        b[3] * a[0] + b[4] * a[3], b[3] * a[1] + b[4] * a[4], b[3] * a[2] + b[4] * a[5] + b[5],
    ]


def angular_delta(a: Column, b: Column) -> Column:
    """Shortest way between two angles within one turn; negative beyond."""
    raw = F.abs(a - b)
    return F.least(raw, 360.0 - raw)


def clamp_unit(x: Column) -> Column:
    """Into [0, 1]; what is not finite becomes 0."""
    odd = F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(odd, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def direction_penalty(vx: Column, vy: Column, dx: Column, dy: Column) -> Column:
    """Half of one minus the cosine between a unit velocity and a displacement; 0 without either."""
    norm = F.sqrt(dx * dx + dy * dy)
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (vx * dx + vy * dy) / norm))
    return F.when(vx.isNull() | (norm < 1e-8), F.lit(0.0)).otherwise((1 - cosine) / 2)
