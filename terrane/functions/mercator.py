"""Web-mercator projection and tile arithmetic as Column expressions.

World units run 0..1 with y south; a tile at zoom z is a square of 2^-z.  Everything here folds into whole-stage codegen."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latitude of the square's edge, and the earth's circumference in metres at the equator (fixed values).
MAX_LAT = 85.0511287798
CIRCUMFERENCE = 40075016.686
#: Slack for rectangles that end on a tile's edge.
SLACK = 1e-9


def clamp(v: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), v))


def world_x(lon: Column) -> Column:
    return (lon + 180.0) / 360.0


def world_y(lat: Column) -> Column:
    s = F.sin(F.radians(clamp(lat, -MAX_LAT, MAX_LAT)))
    return clamp(0.5 - F.log((1.0 + s) / (1.0 - s)) / (4 * math.pi), 0.0, 1.0)


def longitude(x: Column) -> Column:
    return x * 360.0 - 180.0


def latitude(y: Column) -> Column:
    return F.degrees(F.atan(F.sinh(F.lit(math.pi) * (1.0 - 2.0 * y))))


def side(z) -> Column:
    """Tiles to a side at zoom z."""
    return F.pow(F.lit(2.0), z if isinstance(z, Column) else F.lit(z))


def cell(v: Column, z) -> Column:
    """The tile index of a world coordinate: floored and kept on the grid."""
    return clamp(F.floor(v * side(z)), 0, side(z).cast("long") - 1).cast("long")


def tile_at(z, lon: Column, lat: Column) -> tuple[Column, Column]:
    """Tile x, y of a coordinate; null where it is NaN, null or off the globe."""
    good = ~F.isnan(lon) & ~F.isnan(lat) & lon.between(-180.0, 180.0) & lat.between(-90.0, 90.0)
    return F.when(good, cell(world_x(lon), z)), F.when(good, cell(world_y(lat), z))


def tile_bounds(z, x: Column, y: Column) -> tuple[Column, Column, Column, Column]:
    """west, south, east, north."""
    n = side(z)
    return longitude(x / n), latitude((y + 1) / n), longitude((x + 1) / n), latitude(y / n)


def span(low: Column, high: Column, z) -> tuple[Column, Column]:
    """First and last tile index that a world interval touches, rounded outward with slack."""
    n = side(z)
    first = clamp(F.floor(low * n + SLACK), 0, n.cast("long") - 1)
    last = clamp(F.ceil(high * n - SLACK) - 1, 0, n.cast("long") - 1)
    return first.cast("long"), F.greatest(first, last).cast("long")


def key(z, x: Column, y: Column) -> Column:
    """One number for tiles of one zoom, row by row: an equi-join key."""
    return (y * side(z).cast("long") + x).cast("long")


def lonlat_in_tile(z, x: Column, y: Column, px: Column, py: Column, extent) -> tuple[Column, Column]:
    """A tile-local integer position as degrees."""
    n = side(z)
    e = extent if isinstance(extent, Column) else F.lit(float(extent))
    return longitude((x + px / e) / n), latitude((y + py / e) / n)


def metres_per_pixel(zoom, lat: Column, tile_pixels: int = 256) -> Column:
    return CIRCUMFERENCE * F.cos(F.radians(lat)) / (side(zoom) * tile_pixels)
