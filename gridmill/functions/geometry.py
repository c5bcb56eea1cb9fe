"""Geometry as flat columns, so that Catalyst prunes, pushes down and compiles every predicate.

A box is four BIGINT columns (x, y, width, height), a point two, a circle three DOUBLE columns, a polygon two arrays.
Boxes are half-open; boxes that only touch do not overlap. Nulls give null.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType


def _c(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v) if isinstance(v, (int, float)) else F.col(v)


def div(a, b) -> Column:
    """Whole division, towards zero."""
    return F.call_function("div", _c(a), F.lit(b) if isinstance(b, int) else b)


class Box:
    """An axis-parallel rectangle of columns, numbers or column names."""

    def __init__(self, x="x", y="y", width="width", height="height"):
        self._parts = (x, y, width, height)

    x = property(lambda self: _c(self._parts[0]))
    y = property(lambda self: _c(self._parts[1]))
    width = property(lambda self: _c(self._parts[2]))
    height = property(lambda self: _c(self._parts[3]))

    @property
    def x2(self) -> Column:
        return self.x + self.width

    @property
    def y2(self) -> Column:
        return self.y + self.height

    def center(self) -> tuple[Column, Column]:
        """Integer halves, towards zero."""
        return self.x + div(self.width, 2), self.y + div(self.height, 2)

    def contains_point(self, px, py) -> Column:
        px, py = _c(px), _c(py)
        return (px >= self.x) & (px < self.x2) & (py >= self.y) & (py < self.y2)

    def contains(self, o: Box) -> Column:
        return (o.x >= self.x) & (o.x2 <= self.x2) & (o.y >= self.y) & (o.y2 <= self.y2)

    def overlaps(self, o: Box) -> Column:
        return (self.x2 > o.x) & (o.x2 > self.x) & (self.y2 > o.y) & (o.y2 > self.y)

    def intersection(self, o: Box) -> Box:
        """The common box; its width or height is not positive where the boxes do not overlap."""
        x, y = F.greatest(self.x, o.x), F.greatest(self.y, o.y)
        return Box(x, y, F.least(self.x2, o.x2) - x, F.least(self.y2, o.y2) - y)

    def union(self, o: Box) -> Box:
        """The bounding box of both."""
        x, y = F.least(self.x, o.x), F.least(self.y, o.y)
        return Box(x, y, F.greatest(self.x2, o.x2) - x, F.greatest(self.y2, o.y2) - y)

    def max_distance(self, px, py) -> Column:
        """To the farthest corner; the measure that nearest-neighbour queries rank boxes by."""
        px, py = _c(px), _c(py)
        dx, dy = F.greatest(px - self.x, self.x2 - px), F.greatest(py - self.y, self.y2 - py)
        return F.sqrt((dx * dx + dy * dy).cast("double"))

    def min_distance(self, px, py) -> Column:
        """To the nearest point; zero inside."""
        px, py = _c(px), _c(py)
        zero = F.lit(0)
        dx, dy = F.greatest(self.x - px, zero, px - self.x2), F.greatest(self.y - py, zero, py - self.y2)
        return F.sqrt((dx * dx + dy * dy).cast("double"))

    def columns(self, prefix: str = "") -> list[Column]:
        return [c.alias(prefix + n) for c, n in ((self.x, "x"), (self.y, "y"), (self.width, "width"), (self.height, "height"))]


def point_box(x="x", y="y") -> Box:
    """A point's bounding box is one by one."""
    return Box(x, y, F.lit(1).cast("bigint"), F.lit(1).cast("bigint"))


def point_distance(x, y, px, py) -> Column:
    dx, dy = _c(x) - _c(px), _c(y) - _c(py)
    return F.sqrt((dx * dx + dy * dy).cast("double"))


def _spread_bits(v: Column) -> Column:
    """The low 32 bits of v, each moved to twice its place."""
    v = v.bitwiseAND(F.lit(0xFFFFFFFF))
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def morton(x="x", y="y") -> Column:
    """Z-order of the low 32 bits: x in the even places, y in the odd ones."""
    return _spread_bits(_c(x).cast("bigint")).bitwiseOR(F.shiftleft(_spread_bits(_c(y).cast("bigint")), 1))


def circle_box(cx="cx", cy="cy", r="r") -> Box:
    """The circle's bounds, cut to whole numbers towards zero."""
    cx, cy, r = _c(cx), _c(cy), _c(r)
    x, y = (cx - r).cast("bigint"), (cy - r).cast("bigint")
    return Box(x, y, (cx + r).cast("bigint") - x, (cy + r).cast("bigint") - y)


def circle_distance(cx, cy, px, py) -> Column:
    dx, dy = _c(cx) - _c(px), _c(cy) - _c(py)
    return F.sqrt(dx * dx + dy * dy)


def circle_overlaps(cx, cy, r, box: Box) -> Column:
    """Whether the open disc and the box share a point."""
    cx, cy, r = _c(cx), _c(cy), _c(r)
    dx = cx - F.greatest(box.x, F.least(cx, box.x2))
    dy = cy - F.greatest(box.y, F.least(cy, box.y2))
    return dx * dx + dy * dy < r * r


def polygon_box(xs="xs", ys="ys") -> Box:
    xs, ys = _c(xs), _c(ys)
    x, y = F.array_min(xs).cast("bigint"), F.array_min(ys).cast("bigint")
    return Box(x, y, F.array_max(xs) - x, F.array_max(ys) - y)


def polygon_distance(xs, ys, px, py) -> Column:
    """To the centre of the bounding box."""
    return point_distance(*polygon_box(xs, ys).center(), px, py)


def polygon_area_in(xs, ys, x1, y1, x2, y2) -> float:
    """Twice the signed area of the polygon's part inside a box, by clipping at its four sides."""
    points = list(zip(map(float, xs), map(float, ys), strict=True))
    for axis, bound, sign in ((0, x1, 1), (0, x2, -1), (1, y1, 1), (1, y2, -1)):
        out = []
        for (p, q) in zip(points, points[1:] + points[:1], strict=True):
            a, b = sign * (p[axis] - bound), sign * (q[axis] - bound)
            if a >= 0:
                out.append(p)
            if a * b < 0:
                t = a / (a - b)
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        points = out
        if not points:
            return 0.0
    return sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(points, points[1:] + points[:1], strict=True))


@F.pandas_udf(BooleanType())
def _polygon_meets(xs: pd.Series, ys: pd.Series, x: pd.Series, y: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else abs(polygon_area_in(a, b, x1, y1, x1 + dw, y1 + dh)) > 0 for a, b, x1, y1, dw, dh in zip(xs, ys, x, y, w, h, strict=True)])


def polygon_overlaps(xs, ys, box: Box) -> Column:
    """Whether polygon and box share an area; only polygons whose bounds overlap the box reach the exact test."""
    xs, ys = _c(xs), _c(ys)
    return F.when(polygon_box(xs, ys).overlaps(box), _polygon_meets(xs, ys, box.x, box.y, box.width, box.height)).otherwise(F.lit(False))
