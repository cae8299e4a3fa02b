"""Distances, rectangles and rings as Column expressions.  Rings are arrays of struct<lat, lon>, not closed."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .mercator import CIRCUMFERENCE, clamp

#: Mean earth radius in metres for great circles; kilometres to a degree in planning; ring of depth bands (fixed values).
RADIUS = 6371008.8
KM_DEGREE = 111.32
METRES_DEGREE = CIRCUMFERENCE / 360.0
DEPTHS = [(25.0, 15), (80.0, 14), (250.0, 13)]
WORLD_DEPTH = 5


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * RADIUS * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def to_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of (px, py) to a segment in a plane; a segment of no length is its point."""
    dx, dy = bx - ax, by - ay
    long = dx * dx + dy * dy
    t = F.when(long > 0, clamp(((px - ax) * dx + (py - ay) * dy) / long, 0.0, 1.0)).otherwise(0.0)
    return F.sqrt(F.pow(px - (ax + t * dx), 2) + F.pow(py - (ay + t * dy), 2))


def plane(lat0: Column, lat: Column, lon0: Column, lon: Column) -> tuple[Column, Column]:
    """Metres east and north of (lat0, lon0) on its tangent plane."""
    return (lon - lon0) * F.cos(F.radians(lat0)) * METRES_DEGREE, (lat - lat0) * METRES_DEGREE


def to_line(line: Column, lat: Column, lon: Column) -> Column:
    """Metres from a point to a polyline (array of struct<lat, lon>); one vertex is a point on the sphere."""

    def part(i: Column) -> Column:
        ax, ay = plane(lat, line[i]["lat"], lon, line[i]["lon"])
        bx, by = plane(lat, line[i + 1]["lat"], lon, line[i + 1]["lon"])
        return to_segment(F.lit(0.0), F.lit(0.0), ax, ay, bx, by)

    return F.when(F.size(line) > 1, F.array_min(F.transform(F.sequence(F.lit(0), F.size(line) - 2), part))).when(F.size(line) == 1, haversine(lat, lon, line[0]["lat"], line[0]["lon"]))


def in_box(lat: Column, lon: Column, w: Column, s: Column, e: Column, n: Column) -> Column:
    return lat.between(s, n) & lon.between(w, e)


def in_ring(ring: Column, lat: Column, lon: Column) -> Column:
    """Even-odd rule; an edge counts where one end is above the point's latitude and the other is not."""
    n = F.size(ring)

    def crosses(i: Column) -> Column:
        a, b = ring[i], ring[F.pmod(i + 1, n)]
        above = (a["lat"] > lat) != (b["lat"] > lat)
        at = a["lon"] + (lat - a["lat"]) / F.nullif(b["lat"] - a["lat"], F.lit(0.0)) * (b["lon"] - a["lon"])
        return above & (lon < at)

    edges = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(crosses(i), F.lit(False)))
    return F.when(n >= 3, F.size(edges) % 2 == 1).otherwise(F.lit(False))


def in_polygon(outline: Column, holes: Column, lat: Column, lon: Column) -> Column:
    return in_ring(outline, lat, lon) & ~F.exists(holes, lambda h: in_ring(h, lat, lon))


def shoelace(ring: Column, x: str = "x", y: str = "y") -> Column:
    """Twice the signed area of a ring of struct<x, y>."""
    n = F.size(ring)
    part = lambda i: ring[i][x] * ring[F.pmod(i + 1, n)][y] - ring[F.pmod(i + 1, n)][x] * ring[i][y]
    return F.when(n >= 3, F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), part), F.lit(0.0), lambda s, v: s + v)).otherwise(0.0)


def winding(ring: Column, x: str = "x", y: str = "y") -> Column:
    """1, -1, or 0 for a ring of no area; in exact decimals, as tile coordinates are whole numbers."""
    n, d = F.size(ring), "decimal(19,0)"
    part = lambda i: (ring[i][x].cast(d) * ring[F.pmod(i + 1, n)][y].cast(d) - ring[F.pmod(i + 1, n)][x].cast(d) * ring[i][y].cast(d)).cast("decimal(38,0)")
    total = F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), part), F.lit(0).cast("decimal(38,0)"), lambda s, v: (s + v).cast("decimal(38,0)"))
    return F.when(n >= 3, F.signum(total).cast("int")).otherwise(0)


def wraps(ring: Column) -> Column:
    """Does any edge, the closing one included, span more than half the globe."""
    n = F.size(ring)
    return F.exists(F.sequence(F.lit(0), n - 1), lambda i: F.abs(ring[F.pmod(i + 1, n)]["lon"] - ring[i]["lon"]) > 180)


def extent_km(w: Column, s: Column, e: Column, n: Column) -> tuple[Column, Column]:
    """Width (at the latitude nearest the equator) and height."""
    nearest = F.when((s <= 0) & (n >= 0), 0.0).otherwise(F.least(F.abs(s), F.abs(n)))
    return (e - w) * KM_DEGREE * F.cos(F.radians(nearest)), (n - s) * KM_DEGREE


def depth_for(w: Column, s: Column, e: Column, n: Column, source_max: int) -> Column:
    """The deepest zoom that an area of this size is fetched to; bands are inclusive."""
    wide = F.greatest(*extent_km(w, s, e, n))
    out = F.when(wide <= DEPTHS[0][0], DEPTHS[0][1])
    for km, z in DEPTHS[1:]:
        out = out.when(wide <= km, z)
    return F.least(out.otherwise(WORLD_DEPTH), F.lit(source_max)).cast("int")


def bounds_around(lat: Column, lon: Column, km: Column) -> tuple[Column, Column, Column, Column]:
    """west, south, east, north of a square of km around a point, kept on the globe's map."""
    dlat = km / KM_DEGREE
    dlon = km / (KM_DEGREE * F.cos(F.radians(lat)))
    return clamp(lon - dlon, -180.0, 180.0), clamp(lat - dlat, -85.0, 85.0), clamp(lon + dlon, -180.0, 180.0), clamp(lat + dlat, -85.0, 85.0)


def gap_km(a: tuple, b: tuple) -> Column:
    """Distance between two boxes (w, s, e, n) in kilometres."""
    dlon = F.greatest(F.lit(0.0), b[0] - a[2], a[0] - b[2])
    dlat = F.greatest(F.lit(0.0), b[1] - a[3], a[1] - b[3])
    low, high = F.greatest(a[1], b[1]), F.least(a[3], b[3])
    lo, hi = F.least(low, high), F.greatest(low, high)
    at = F.when((lo <= 0) & (hi >= 0), 0.0).otherwise(F.least(F.abs(lo), F.abs(hi)))
    return F.sqrt(F.pow(dlon * KM_DEGREE * F.cos(F.radians(at)), 2) + F.pow(dlat * KM_DEGREE, 2))


def compass(degrees: Column) -> Column:
    names = F.array(*map(F.lit, "N NE E SE S SW W NW".split()))
    return F.element_at(names, (F.pmod(F.round(F.pmod(degrees, F.lit(360.0)) / 45.0).cast("int"), F.lit(8)) + 1).cast("int"))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    d = F.radians(lon2 - lon1)
    y = F.sin(d) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))
