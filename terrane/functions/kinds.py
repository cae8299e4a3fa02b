"""What a kind, a level, a file name, a header or a rectangle says: small rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Levels from wide to narrow, those that derived areas answer, and the file that answers the others.
LEVELS = ["country", "region", "city", "water", "locality", "macrohood", "neighbourhood", "area", "street"]
DERIVED = ["locality", "macrohood", "neighbourhood"]
LAYERS = {"country": "countries", "region": "regions", "water": "waters"}
#: Kilometres that a place marked by a point is shown with.
POINT_KM = {"city": 10.0, "town": 4.0, "village": 2.0, "hamlet": 1.0, "isolated_dwelling": 1.0, "farm": 1.0}
OTHER_KM = 3.0
#: Raster tile types that name their files.
RASTERS = ["webp", "png", "jpeg", "avif"]
#: Fixed values of contours: the zoom below which there are none, metres under each zoom, the steps, pixels between lines.
CONTOURS_FROM = 11
INTERVALS = [(12, 100.0), (13, 50.0), (14, 20.0), (16, 10.0)]
FINEST = 5.0
STEPS = [5.0, 10.0, 20.0, 50.0, 100.0, 200.0, 500.0, 1000.0]
LINE_GAP = 4.0
#: The widest blur of a shaded view, in pixels, and the world's last latitude (fixed values).
MOST_BLUR = 16.0
LAST_LATITUDE = 85.0511287798


def number(kind: Column) -> Column:
    """A kind that is a whole number, else null."""
    return F.when(kind.rlike(r"^[+-]?[0-9]{1,9}$"), kind.cast("int"))


def is_city(kind: Column) -> Column:
    return F.coalesce(kind.isin("city", "town"), F.lit(False))


def is_country(kind: Column) -> Column:
    return F.coalesce(number(kind) == 2, F.lit(False))


def listed_level(kind: Column) -> Column:
    """The level that an area of a kind is listed at."""
    n = number(kind)
    return F.when(is_city(kind), "city").when(n <= 2, "country").when(n <= 4, "region").otherwise("locality")


def is_derived(level: Column) -> Column:
    return F.coalesce(level.isin(*DERIVED), F.lit(False))


def layer_of(level: Column) -> Column:
    return F.coalesce(*(F.when(level == k, v) for k, v in LAYERS.items()))


def point_km(kind: Column) -> Column:
    return F.coalesce(*(F.when(kind == k, v) for k, v in POINT_KM.items()), F.lit(OTHER_KM))


def valid_region(name: Column) -> Column:
    """A name that may be part of a file's: letters, digits, -, _ and ., none of these first a dot, at most 64."""
    return F.coalesce(name.rlike(r"^[A-Za-z0-9_-][A-Za-z0-9._-]{0,63}$"), F.lit(False))


def region_of(file: Column, prefix: str, suffix: str) -> Column:
    """The region that a derived file is named for, or null."""
    size = F.length(file) - len(prefix) - len(suffix)
    region = F.substr(file, F.lit(len(prefix) + 1), F.greatest(size, F.lit(0)))
    return F.when(file.startswith(prefix) & file.endswith(suffix) & (size > 0) & valid_region(region), region)


def tile_ext(tile_type: Column) -> Column:
    return F.when(tile_type.isin(*RASTERS), F.concat(F.lit("."), tile_type)).otherwise(".mvt")


def bounds_fault(w: Column, s: Column, e: Column, n: Column) -> Column:
    """Why a rectangle names no area, or null: the edge that is no coordinate, or the pair that is the wrong way round."""
    bad = [F.when(c.isNull() | F.isnan(c) | (F.abs(c) > limit), name) for name, c, limit in (("west", w, 180), ("east", e, 180), ("south", s, 90), ("north", n, 90))]
    return F.coalesce(*bad, F.when(e <= w, "east of west"), F.when(n <= s, "north of south"))


def zoom_interval(z: Column) -> Column:
    """The contour interval that a view starts from; null where it has none."""
    ladder = F.when(z < CONTOURS_FROM, F.lit(None).cast("double"))
    for below, metres in INTERVALS:
        ladder = ladder.when(z < below, metres)
    return ladder.otherwise(FINEST)


def contour_interval(z: Column, rise: Column) -> Column:
    """The first step that is no finer than the zoom's and keeps lines apart where ground rises `rise` metres a pixel."""
    steps = F.array(*map(F.lit, STEPS))
    need = F.greatest(zoom_interval(z), rise * LINE_GAP)
    return F.when(zoom_interval(z).isNotNull() & rise.isNotNull(), F.coalesce(F.get(F.filter(steps, lambda s: s >= need), 0), F.lit(STEPS[-1])))


def blur_radius(r: Column) -> Column:
    """No blur up to a quarter pixel, eased in to half of one, then as it is, 16 at most."""
    c = F.least(r, F.lit(MOST_BLUR))
    return F.when(c <= 0.25, 0.0).when(c < 0.5, 2 * c - 0.5).otherwise(c)


def drawn_zoom(zoom: Column, deepest: Column) -> Column:
    """The zoom that a store is asked at: no deeper than its archive; an unknown one asks as it is."""
    return F.least(zoom, deepest)


def aliases(name: Column, named: list[Column], context: list[Column]) -> Column:
    """A name and the other names of an area, each once whatever its case; those that name what it is in, and "-99", are none."""
    clean = lambda cs: F.filter(F.array(*(F.trim(c) for c in cs)), lambda v: v.isNotNull() & (v != "") & (v != "-99"))
    around = F.transform(clean(context), F.lower)
    every = F.concat(F.array(name), F.filter(clean(named), lambda v: ~F.array_contains(around, F.lower(v))))
    return F.filter(every, lambda v, i: F.array_position(F.transform(every, F.lower), F.lower(v)) == i + 1)


def content_range(header: Column) -> Column:
    """first, last and total (null if `*`) of `bytes a-b/total`; null if it is no such range."""
    form = r"^\s*(?i:bytes)\s+([0-9]{1,18})\s*-\s*([0-9]{1,18})\s*/\s*([0-9]{1,18}|\*)\s*$"
    part = lambda k: F.regexp_extract(header, form, k)
    first, last, total = part(1).try_cast("long"), part(2).try_cast("long"), part(3).try_cast("long")
    return F.when(header.rlike(form) & (first <= last), F.struct(first.alias("first"), last.alias("last"), total.alias("total")))


def near_enough(lat: Column, lon: Column, lat2: Column, lon2: Column, z: Column) -> Column:
    """Within six 256ths of a tile of the zoom, in degrees."""
    d = 6 * 360 / F.pow(F.lit(2.0), z) / 256
    return (F.abs(lat - lat2) < d) & (F.abs(lon - lon2) < d)


def join_credits(a: Column, b: Column) -> Column:
    """Two credits in one line; an empty one is left out."""
    return F.concat_ws(" | ", F.nullif(a, F.lit("")), F.nullif(b, F.lit("")))


def on_earth(lat: Column, lon: Column, step: Column, base_lat: Column, base_lon: Column) -> Column:
    """Whether coordinates in units of `step` nanodegrees are the earth's, before and after a block's origin is added.  Limits are
    divided and not coordinates multiplied, so that no product can overflow."""

    def fits(v: Column, base: Column, degrees: int) -> Column:
        most = degrees * 10**9
        return F.when(F.abs(v) > F.floor(F.lit(most) / step), F.lit(False)).otherwise(F.abs(base + step * v) <= most)

    return fits(lat, base_lat, 90) & fits(lon, base_lon, 180)


def short_credit(ids: Column, by: str, page: str, lead: str = "Elevation") -> Column:
    """The line for a picture that any sources lie under: who compiled them and where they are listed; no ids, no credit."""
    return F.when(F.coalesce(F.size(ids), F.lit(0)) > 0, f"{lead}: © {by}, {page}").otherwise("")
