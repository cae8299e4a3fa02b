"""Views: a rectangle of the map on so many pixels, as Column expressions.

A view is struct-like columns w, s, e, n, width, height.  Its scale is the same on both axes; the shorter axis is extended
about the centre, so all that was asked for is on the picture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import mercator as M

TILE = 256
#: The share of a fitted view that is left free on each side.
MARGIN = 0.04


def resolve(views: DataFrame) -> DataFrame:
    """views plus scale (pixels to a world unit), ox, oy (world position of the top left corner), zoom, tile_zoom and
    tile_scale; null where a view has no pixels or no height on the map."""
    x0, x1, y0, y1 = M.world_x(F.col("w")), M.world_x(F.col("e")), M.world_y(F.col("n")), M.world_y(F.col("s"))
    good = (F.col("width") > 0) & (F.col("height") > 0) & (x1 > x0) & (y1 > y0)
    scale = F.when(good, F.least(F.col("width") / (x1 - x0), F.col("height") / (y1 - y0)))
    out = views.withColumn("scale", scale)
    zoom = F.log2(F.col("scale") / TILE)
    tile_zoom = M.clamp(F.round(zoom), 0, 31).cast("int")
    return out.withColumns({
        "ox": (x0 + x1) / 2 - F.col("width") / (2 * F.col("scale")), "oy": (y0 + y1) / 2 - F.col("height") / (2 * F.col("scale")),
        "zoom": zoom, "tile_zoom": tile_zoom, "tile_scale": F.pow(F.lit(2.0), zoom - tile_zoom),
    })


def pixel(lon: Column, lat: Column) -> tuple[Column, Column]:
    """A coordinate on a resolved view."""
    return (M.world_x(lon) - F.col("ox")) * F.col("scale"), (M.world_y(lat) - F.col("oy")) * F.col("scale")


def coordinate(x: Column, y: Column) -> tuple[Column, Column]:
    """A pixel of a resolved view as lon, lat."""
    return M.longitude(F.col("ox") + x / F.col("scale")), M.latitude(F.col("oy") + y / F.col("scale"))


def tile_box(z: Column, x: Column, y: Column) -> tuple[Column, Column, Column, Column]:
    """A tile's rectangle on a resolved view: left, top, right, bottom."""
    n = M.side(z)
    return tuple((v / n - o) * F.col("scale") for v, o in ((x, F.col("ox")), (y, F.col("oy")), (x + 1, F.col("ox")), (y + 1, F.col("oy"))))


def tiles_under(resolved: DataFrame) -> DataFrame:
    """Resolved views by the tiles of their tile zoom that they show: tx, ty."""
    z = F.col("tile_zoom")
    x0, x1 = M.span(F.col("ox"), F.col("ox") + F.col("width") / F.col("scale"), z)
    y0, y1 = M.span(F.col("oy"), F.col("oy") + F.col("height") / F.col("scale"), z)
    return resolved.withColumn("tx", F.explode(F.sequence(x0, x1))).withColumn("ty", F.explode(F.sequence(y0, y1)))


def fit(boxes: DataFrame, width: int, height: int, most_zoom: float) -> DataFrame:
    """Views (w, s, e, n, width, height, cropped) that hold boxes with a margin, not past a zoom nor off the world."""
    x0, x1, y0, y1 = M.world_x(F.col("w")), M.world_x(F.col("e")), M.world_y(F.col("n")), M.world_y(F.col("s"))
    dx, dy = (x1 - x0) * (1 + 2 * MARGIN), (y1 - y0) * (1 + 2 * MARGIN)
    whole = float(max(width, height))
    scale = F.least(F.lit(TILE * 2.0**most_zoom), F.when(dx > 0, width / dx), F.when(dy > 0, height / dy))
    out = boxes.withColumns({"__x": (x0 + x1) / 2, "__y": (y0 + y1) / 2, "cropped": scale < whole, "__k": F.greatest(scale, F.lit(whole))})
    half_w, half_h = width / (2 * F.col("__k")), height / (2 * F.col("__k"))
    cx, cy = (F.greatest(h, F.least(1 - h, F.col(c))) for c, h in (("__x", half_w), ("__y", half_h)))
    box = {"w": M.longitude(cx - half_w), "n": M.latitude(cy - half_h), "e": M.longitude(cx + half_w), "s": M.latitude(cy + half_h)}
    return out.withColumns(box | {"width": F.lit(width), "height": F.lit(height)}).drop("__x", "__y", "__k")


def covered(tiles: DataFrame, by: str) -> DataFrame:
    """tiles (view, left, top, right, bottom, width, height, held_zoom, tile_zoom): the shares of each view that held tiles
    cover and that shallower ones fill in."""
    area = F.greatest(F.lit(0.0), F.least(F.col("right"), F.col("width")) - F.greatest(F.col("left"), F.lit(0.0))) * F.greatest(F.lit(0.0), F.least(F.col("bottom"), F.col("height")) - F.greatest(F.col("top"), F.lit(0.0)))
    t = tiles.withColumn("__a", area)
    part = lambda c: F.sum(F.when(c, F.col("__a")).otherwise(0.0)) / F.sum("__a")
    return t.groupBy(by).agg(F.count("*").alias("tiles"), F.count("held_zoom").alias("resolved"), part(F.col("held_zoom").isNotNull()).alias("covered"), part(F.col("held_zoom") < F.col("tile_zoom")).alias("overzoomed"))


#: Pixels of the sides of a map that is draped over ground (fixed values).
LEAST_DRAPE, MOST_DRAPE = 512, 8192


def drape_size(wide_km: Column, high_km: Column, distance: Column, fov: Column, image_height: Column, side: Column) -> tuple[Column, Column]:
    """Width and height of the map to drape for a camera: its longer side as asked for, or, asked for 0, one pixel to a pixel of the
    picture at the point looked at, within limits."""
    a_pixel = 2 * distance * F.tan(F.radians(fov) / 2) / F.greatest(image_height, F.lit(1))
    fitting = F.least(F.lit(float(MOST_DRAPE)), F.greatest(F.lit(float(LEAST_DRAPE)), F.greatest(wide_km, high_km) * 1000 / a_pixel))
    longer = F.when(side > 0, side.cast("double")).otherwise(F.floor(fitting))
    shorter = F.greatest(F.lit(1), F.floor(longer * F.least(wide_km, high_km) / F.greatest(wide_km, high_km))).cast("int")
    longer = longer.cast("int")
    return F.when(wide_km > high_km, longer).otherwise(shorter), F.when(wide_km > high_km, shorter).otherwise(longer)


def on_lattice(cell: float, step: int) -> dict[str, Column]:
    """Columns w, s, e, n grown to whole cells of a lattice fixed to the ground, its vertices in the cells' middles, but never past the
    world's edge; with width and height in pixels, `step` to a cell.  Null where fewer than two cells are left."""

    def ends(low: Column, high: Column) -> tuple[Column, Column]:
        a, b = (F.floor(low / cell + 0.5) - 0.5) * cell, (F.ceil(high / cell - 0.5) + 0.5) * cell
        return F.when(a < 0, a + F.ceil(-a / cell) * cell).otherwise(a), F.when(b > 1, b - F.ceil((b - 1) / cell) * cell).otherwise(b)

    (x0, x1), (y0, y1) = ends(M.world_x(F.col("w")), M.world_x(F.col("e"))), ends(M.world_y(F.col("n")), M.world_y(F.col("s")))
    columns, rows = F.round((x1 - x0) / cell), F.round((y1 - y0) / cell)
    good = (columns >= 2) & (rows >= 2)
    out = {"w": M.longitude(x0), "s": M.latitude(y1), "e": M.longitude(x1), "n": M.latitude(y0), "width": (columns * step).cast("int"), "height": (rows * step).cast("int")}
    return {k: F.when(good, v) for k, v in out.items()}
