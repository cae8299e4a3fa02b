"""Rectangles as tuples of four Columns (left, top, right, bottom), in any units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def intersect(a: Box, b: Box) -> Box:
    return F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3])


def union(a: Box, b: Box) -> Box:
    return F.least(a[0], b[0]), F.least(a[1], b[1]), F.greatest(a[2], b[2]), F.greatest(a[3], b[3])


def inflate(a: Box, by) -> Box:
    return a[0] - by, a[1] - by, a[2] + by, a[3] + by


def is_empty(a: Box) -> Column:
    return (a[2] <= a[0]) | (a[3] <= a[1])


def overlaps(a: Box, b: Box) -> Column:
    """Sides that touch do not overlap."""
    return (a[0] < b[2]) & (b[0] < a[2]) & (a[1] < b[3]) & (b[1] < a[3])


def holds(a: Box, x: Column, y: Column) -> Column:
    return x.between(a[0], a[2]) & y.between(a[1], a[3])


def outward(a: Box) -> Box:
    """Whole units that cover the box."""
    return F.floor(a[0]), F.floor(a[1]), F.ceil(a[2]), F.ceil(a[3])


def area(a: Box) -> Column:
    return F.greatest(F.lit(0.0), a[2] - a[0]) * F.greatest(F.lit(0.0), a[3] - a[1])


def turned(width: Column, height: Column, x: Column, y: Column, angle: Column) -> Box:
    """The upright box around a width x height box centred on x, y and turned by an angle (radians)."""
    c, s = F.abs(F.cos(angle)), F.abs(F.sin(angle))
    w, h = (width * c + height * s) / 2, (width * s + height * c) / 2
    return x - w, y - h, x + w, y + h


def covered(a: Box, b: Box) -> Column:
    """The share of the smaller box that the two have in common."""
    smaller = F.least(area(a), area(b))
    return F.when(smaller > 0, area(intersect(a, b)) / smaller).otherwise(0.0)


def zoom_union(a: tuple[Column, Column], b: tuple[Column, Column]) -> tuple[Column, Column]:
    """The least zoom range over two; a range whose least is over its most is empty and adds nothing."""
    none_a, none_b = a[0] > a[1], b[0] > b[1]
    return F.when(none_a, b[0]).when(none_b, a[0]).otherwise(F.least(a[0], b[0])), F.when(none_a, b[1]).when(none_b, a[1]).otherwise(F.greatest(a[1], b[1]))


def edge_fade(u: Column, v: Column, width: Column, height: Column, ramp: float) -> Column:
    """1 inside, falling to 0 at the edges of a width x height surface over `ramp`."""
    near = F.least(u, v, width - u, height - v)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), near / ramp))
