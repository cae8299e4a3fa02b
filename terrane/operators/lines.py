"""Lines and rings in the plane: clipping, dashes, cuts, anchors.  Python over Arrow batches: each row is a walk."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import mercator as M

Point = tuple[float, float]
XY = "array<struct<x:double,y:double>>"


def clip_segment(a: Point, b: Point, box: tuple) -> tuple[float, float] | None:
    """The part of a segment inside (left, top, right, bottom), as two fractions of it; None if it stays outside."""
    lo, hi = 0.0, 1.0
    for k in (0, 1):
        d = b[k] - a[k]
        near, far = box[k] - a[k], box[k + 2] - a[k]
        if d == 0:
            if near > 0 or far < 0:
                return None
            continue
        t, u = sorted((near / d, far / d))
        lo, hi = max(lo, t), min(hi, u)
        if lo > hi:
            return None
    return lo, hi


def clip_line(points: list[Point], box: tuple) -> list[tuple[float, list[Point]]]:
    """Runs of a line inside a box, each with the length walked before it."""
    out: list[tuple[float, list[Point]]] = []
    walked, open_ = 0.0, False
    for a, b in zip(points, points[1:], strict=False):
        size, part = math.dist(a, b), clip_segment(a, b, box)
        if part is None or part[0] == part[1] and size:
            open_ = False
        else:
            at = [(a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])) if 0 < t < 1 else (a, b)[int(t)] for t in part]
            if open_ and part[0] == 0:
                out[-1][1].append(at[1])
            else:
                out.append((walked + part[0] * size, at))
            open_ = part[1] == 1
        walked += size
    return out


def clip_ring(points: list[Point], box: tuple) -> list[Point]:
    """A ring cut by a box's four sides, one after the other."""
    for axis, sign, edge in ((0, 1, box[0]), (1, 1, box[1]), (0, -1, box[2]), (1, -1, box[3])):
        inside = [sign * (p[axis] - edge) >= 0 for p in points]
        out: list[Point] = []
        for k, p in enumerate(points):
            q, was = points[k - 1], inside[k - 1]
            if was != inside[k]:
                t = (edge - q[axis]) / (p[axis] - q[axis])
                cut = [q[0] + t * (p[0] - q[0]), q[1] + t * (p[1] - q[1])]
                cut[axis] = edge
                out.append((cut[0], cut[1]))
            if inside[k]:
                out.append(p)
        points = out
    return points


def dash(points: list[Point], pattern: list[float], phase: float = 0.0) -> tuple[list[list[Point]], float]:
    """The drawn runs of a line under a pattern of on and off lengths, and the phase at its end."""
    total = sum(pattern)
    if total <= 0 or len(pattern) % 2:
        return [points], phase
    at = phase % total
    k = 0
    while at >= pattern[k]:
        at -= pattern[k]
        k = (k + 1) % len(pattern)
    left, runs, current = pattern[k] - at, [], [points[0]] if k % 2 == 0 else []
    for a, b in zip(points, points[1:], strict=False):
        size, done = math.dist(a, b), 0.0
        while size - done > left:
            done += left
            p = (a[0] + (b[0] - a[0]) * done / size, a[1] + (b[1] - a[1]) * done / size)
            if k % 2 == 0:
                runs.append([*current, p])
            k = (k + 1) % len(pattern)
            left, current = pattern[k], [p]
        left -= size - done
        if k % 2 == 0:
            current.append(b)
    if k % 2 == 0 and len(current) > 1:
        runs.append(current)
    return runs, sum(pattern[:k]) + pattern[k] - left


def cut_antimeridian(points: list[Point]) -> list[list[Point]]:
    """A line of (lon, lat) cut where it steps over 180 degrees, ending and beginning on the meridian."""
    out: list[list[Point]] = [points[:1]]
    for a, b in zip(points, points[1:], strict=False):
        if abs(b[0] - a[0]) > 180:
            side = 180.0 if a[0] > 0 else -180.0
            over = b[0] + 2 * side
            lat = a[1] + (b[1] - a[1]) * (side - a[0]) / (over - a[0]) if over != a[0] else a[1]
            out[-1].append((side, lat))
            out.append([(-side, lat)])
        out[-1].append(b)
    return out


def anchor(lines: list[list[Point]]) -> Point | None:
    """Half way along the longest line."""
    length = lambda ps: sum(map(math.dist, ps, ps[1:]))
    best = max((ps for ps in lines if ps), key=length, default=None)
    if best is None:
        return None
    rest = length(best) / 2
    for a, b in zip(best, best[1:], strict=False):
        size = math.dist(a, b)
        if size and rest <= size:
            return a[0] + (b[0] - a[0]) * rest / size, a[1] + (b[1] - a[1]) * rest / size
        rest -= size
    return best[0]


def quads_overlap(a: list[Point], b: list[Point]) -> bool:
    """Do two convex quadrilaterals overlap: no side of either has the other wholly beyond it."""
    for shape in (a, b):
        for p, q in zip(shape, shape[1:] + shape[:1], strict=True):
            nx, ny = q[1] - p[1], p[0] - q[0]
            one, two = ([nx * x + ny * y for x, y in s] for s in (a, b))
            if max(one) <= min(two) or max(two) <= min(one):
                return False
    return True


def _each(df: DataFrame, f: Callable[[pd.Series], list[tuple]], added: str) -> DataFrame:
    """A row of df to any number of rows: its columns but `points`, and what f adds."""
    kept = [c for c in df.columns if c != "points"]
    names = [x.split(" ")[0] for x in added.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(*(r[c] for c in kept), *x) for _, r in pdf.iterrows() for x in f(r)]
            yield pd.DataFrame(rows, columns=[*kept, *names])

    ddl = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept)
    return df.mapInPandas(run, f"{ddl}, {added}" if ddl else added)


def _in(points) -> list[Point]:
    return [(p["x"], p["y"]) for p in points]


def _out(points: list[Point]) -> list[dict]:
    return [{"x": float(x), "y": float(y)} for x, y in points]


def clipped(lines: DataFrame, box: tuple) -> DataFrame:
    """Lines (points, ...) as their runs inside a box: start, run."""
    return _each(lines, lambda r: [(float(s), _out(p)) for s, p in clip_line(_in(r["points"]), box)], f"start double, run {XY}")


def dashed(lines: DataFrame, pattern: list[float], phase: float = 0.0) -> DataFrame:
    return _each(lines, lambda r: [(_out(p),) for p in dash(_in(r["points"]), pattern, phase)[0]], f"run {XY}")


def middle(line_parts: Column, z, x: Column, y: Column, extent: Column) -> tuple[Column, Column]:
    """lon, lat of the middle vertex of a tile feature's first line; of the tile's middle where it has no line."""
    first = F.get(line_parts, 0)
    p = F.get(first, F.floor(F.size(first) / 2).cast("int"))
    half = F.floor(extent / 2)
    return M.lonlat_in_tile(z, x, y, F.coalesce(p["x"], half), F.coalesce(p["y"], half), extent)


def bounds(points: Column) -> Column:
    """The box of a path's points, curves' control points among them; null for none.  NaN stays out."""
    side = lambda k: F.filter(F.transform(points, lambda p: p[k]), lambda v: ~F.isnan(v))
    x, y = side("x"), side("y")
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.struct(F.array_min(x).alias("x0"), F.array_min(y).alias("y0"), F.array_max(x).alias("x1"), F.array_max(y).alias("y1")))
