"""Hilbert tile ids: tiles of all zooms on one line, neighbours mostly near each other.  Range-partitioning by the id keeps
a region's tiles together, and Parquet's min/max then prunes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tile_id(z: Column, x: Column, y: Column) -> Column:
    """z, x, y to the id: the curve's quadrant is read from the highest bit down, the frame turned at each step."""
    start = F.struct(F.lit(0).cast("long").alias("d"), x.cast("long").alias("x"), y.cast("long").alias("y"))

    def step(s: Column, k: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("long"), k)
        rx, ry = (F.when(s[c].bitwiseAND(size) > 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")) for c in ("x", "y"))
        d = s["d"] + size * size * (3 * rx).bitwiseXOR(ry)
        flip = (ry == 0) & (rx == 1)
        fx, fy = (F.when(flip, size - 1 - s[c].bitwiseAND(size - 1)).otherwise(s[c].bitwiseAND(size - 1)) for c in ("x", "y"))
        return F.struct(d.alias("d"), F.when(ry == 0, fy).otherwise(fx).alias("x"), F.when(ry == 0, fx).otherwise(fy).alias("y"))

    down = F.when(z > 0, F.sequence(z.cast("int") - 1, F.lit(0), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(down, start, step)["d"] + base(z)


def base(z: Column) -> Column:
    """(4^z - 1) / 3 without leaving whole numbers."""
    ones = F.when(z > 0, F.sequence(F.lit(1), z.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(ones, F.lit(0).cast("long"), lambda s, _: s * 4 + 1)


def zoom_of(tid: Column) -> Column:
    """The zoom of an id: how many zooms begin at or before it, less one."""
    bases = F.array(*(F.lit((4**z - 1) // 3).cast("long") for z in range(32)))
    return (F.size(F.filter(bases, lambda b: b <= tid)) - 1).cast("int")


def tile_of(tid: Column) -> Column:
    """id to struct<z, x, y>."""
    z = zoom_of(tid)
    rest = tid - F.element_at(F.array(*(F.lit((4**k - 1) // 3).cast("long") for k in range(32))), z + 1)
    start = F.struct(rest.alias("t"), F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"))

    def step(s: Column, k: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("long"), k)
        quarter = s["t"].bitwiseAND(F.lit(3).cast("long"))
        rx = F.shiftright(quarter, 1)
        ry = quarter.bitwiseXOR(rx).bitwiseAND(F.lit(1).cast("long"))
        flip = (ry == 0) & (rx == 1)
        fx, fy = (F.when(flip, size - 1 - s[c]).otherwise(s[c]) for c in ("x", "y"))
        nx, ny = F.when(ry == 0, fy).otherwise(fx), F.when(ry == 0, fx).otherwise(fy)
        return F.struct(F.shiftright(s["t"], 2).alias("t"), (nx + size * rx).alias("x"), (ny + size * ry).alias("y"))

    up = F.when(z > 0, F.sequence(F.lit(0), z - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(F.array(F.aggregate(up, start, step)), lambda s: F.struct(z.alias("z"), s["x"].alias("x"), s["y"].alias("y")))[0]


def zigzag(v: Column) -> Column:
    return F.shiftleft(v.cast("long"), 1).bitwiseXOR(F.shiftright(v.cast("long"), 63))


def unzigzag(v: Column) -> Column:
    return F.shiftrightunsigned(v.cast("long"), 1).bitwiseXOR(-(v.cast("long").bitwiseAND(F.lit(1).cast("long"))))
