"""A camera over the ground, as Column expressions.

Camera columns: lat, lon (what it looks at), distance (metres to that), heading and pitch (degrees; 90 looks straight down),
fov (vertical, degrees).  Points are metres east, north and up of the target."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import mercator as M

FOV, NEAR = 40.0, 1.0


def metres_per_unit(lat: Column) -> Column:
    """Metres to a world unit at a latitude."""
    return M.CIRCUMFERENCE * F.cos(F.radians(lat))


def ground(lat: Column, lon: Column, at_lat: Column, at_lon: Column) -> tuple[Column, Column]:
    """Metres east and north of the target, on the map's plane."""
    k = metres_per_unit(at_lat)
    return (M.world_x(lon) - M.world_x(at_lon)) * k, (M.world_y(at_lat) - M.world_y(lat)) * k


def to_camera(east: Column, north: Column, up: Column, heading: Column, pitch: Column, distance: Column) -> tuple[Column, Column, Column]:
    """Right, above and in front of the camera, in metres."""
    h, p = F.radians(heading), F.radians(pitch)
    along, across = east * F.sin(h) + north * F.cos(h), east * F.cos(h) - north * F.sin(h)
    return across, along * F.sin(p) + up * F.cos(p), distance + along * F.cos(p) - up * F.sin(p)


def to_pixel(right: Column, above: Column, ahead: Column, fov: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """Image position; null for what is behind the camera or too near."""
    f = height / 2 / F.tan(F.radians(fov) / 2)
    seen = ahead >= NEAR
    return F.when(seen, width / 2 + right / ahead * f), F.when(seen, height / 2 - above / ahead * f)


def haze_metres(distance: Column) -> Column:
    """Where ground is about two thirds haze: three times the target's distance."""
    return 3 * distance


def visible_range(distance: Column) -> Column:
    return 1.75 * haze_metres(distance)
