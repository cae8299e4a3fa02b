"""Spatial joins.

A range predicate alone is a nested loop over all pairs.  Here both sides get the tile keys that they touch, so the join is an
equi-join that Spark can hash, sort, split when skewed and spill; the exact test is the residual, box before ring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo
from ..functions import mercator as M

#: Boxes that touch more bins than this go to a coarser zoom, never to a broadcast of unknown size.
MOST_BINS = 64
ZOOMS = (12, 8, 5, 2, 0)


def with_box(areas: DataFrame, parts_col: str = "parts") -> DataFrame:
    """areas plus w, s, e, n over all parts' outlines (parts: array of struct<outline, holes>)."""
    points = F.flatten(F.transform(parts_col, lambda p: p["outline"]))
    lat, lon = F.transform(points, lambda p: p["lat"]), F.transform(points, lambda p: p["lon"])
    return areas.withColumns({"w": F.array_min(lon), "s": F.array_min(lat), "e": F.array_max(lon), "n": F.array_max(lat)})


def _bins(boxes: DataFrame) -> DataFrame:
    """Each box at the finest zoom of ZOOMS where it touches at most MOST_BINS tiles, exploded to (bin_zoom, bin_key)."""
    ranges = {z: (*M.span(M.world_x(F.col("w")), M.world_x(F.col("e")), z), *M.span(M.world_y(F.col("n")), M.world_y(F.col("s")), z)) for z in ZOOMS}
    count = {z: (r[1] - r[0] + 1) * (r[3] - r[2] + 1) for z, r in ranges.items()}
    zoom = F.coalesce(*(F.when(count[z] <= MOST_BINS, F.lit(z)) for z in ZOOMS), F.lit(0))
    pick = lambda k: F.coalesce(*(F.when(F.col("bin_zoom") == z, ranges[z][k]) for z in ZOOMS))
    out = boxes.withColumn("bin_zoom", zoom)
    out = out.withColumn("__x", F.explode(F.sequence(pick(0), pick(1)))).withColumn("__y", F.explode(F.sequence(pick(2), pick(3))))
    return out.withColumn("bin_key", M.key(F.col("bin_zoom"), F.col("__x"), F.col("__y"))).drop("__x", "__y")


def box_join(points: DataFrame, boxes: DataFrame, exact: Column | None = None) -> DataFrame:
    """points (lat, lon, ...) with boxes (w, s, e, n, ...) that hold them; exact: a further test on both sides' columns.
    A point has one key a zoom, so no pair is found twice."""
    keys = F.explode(F.array(*(F.struct(F.lit(z).alias("bin_zoom"), M.key(z, M.cell(M.world_x(F.col("lon")), z), M.cell(M.world_y(F.col("lat")), z)).alias("bin_key")) for z in ZOOMS)))
    left = points.withColumn("__k", keys).select(*points.columns, "__k.bin_zoom", "__k.bin_key")
    inside = geo.in_box(F.col("lat"), F.col("lon"), F.col("w"), F.col("s"), F.col("e"), F.col("n"))
    # the box is tested first: Catalyst would not keep that order between the terms of an AND
    test = inside if exact is None else F.when(inside, exact).otherwise(F.lit(False))
    return left.join(_bins(boxes), ["bin_zoom", "bin_key"]).where(test).drop("bin_zoom", "bin_key")


def containing(points: DataFrame, areas: DataFrame) -> DataFrame:
    """Every (point, area) where a part's outline holds the point and none of its holes does."""
    held = F.exists("parts", lambda p: geo.in_polygon(p["outline"], p["holes"], F.col("lat"), F.col("lon")))
    return box_join(points, with_box(areas) if "w" not in areas.columns else areas, held)


def box_area() -> Column:
    return (F.col("e") - F.col("w")) * (F.col("n") - F.col("s"))


def smallest(pairs: DataFrame, by: str, columns: list[str], order: str = "file_pos") -> DataFrame:
    """The area of least box among each point's; the first of equals."""
    best = F.min_by(F.struct(*columns), F.struct(box_area(), F.col(order))).alias("__b")
    return pairs.groupBy(by).agg(best).select(by, "__b.*")


def stack(pairs: DataFrame, by: str, order: str = "file_pos") -> DataFrame:
    """Pairs with `depth` (1 is outermost) and `height` (how many hold the point): wider boxes first, then lower kinds, then
    file order.  Copies of an area (name, kind, box) from later files are dropped."""
    once = W.partitionBy(by, "name", "kind", "w", "s", "e", "n").orderBy(order)
    kept = pairs.withColumn("__r", F.row_number().over(once)).where("__r = 1").drop("__r")
    outer = [box_area().desc(), F.expr("try_cast(kind AS int)").asc_nulls_last(), F.col(order)]
    mine = W.partitionBy(by)
    return kept.withColumns({"depth": F.row_number().over(mine.orderBy(*outer)), "height": F.count("*").over(mine)})


def rank_level(depth: Column, height: Column) -> Column:
    """The level that an area of a stack answers: the innermost three are neighbourhood, macrohood and locality; of two,
    neighbourhood and locality; one alone is the locality."""
    inward = height - depth  # 0 is innermost
    return F.when(height == 1, F.when(inward == 0, "locality")).when(height == 2, F.when(inward == 0, "neighbourhood").when(inward == 1, "locality")).otherwise(
        F.when(inward == 0, "neighbourhood").when(inward == 1, "macrohood").when(inward == 2, "locality")
    )


def levels(points: DataFrame, areas: DataFrame, by: str, wanted: list[str]) -> DataFrame:
    """(point, level, name, containment): Inside with a name, Outside where other areas hold the point, NoData where none
    does.  Every point gets a row for each level; none of the three is null."""
    ranked = stack(containing(points, areas), by).withColumn("level", rank_level(F.col("depth"), F.col("height")))
    spine = points.select(by).withColumn("level", F.explode(F.array(*map(F.lit, wanted))))
    any_ = ranked.groupBy(by).agg(F.count("*").alias("__n"))
    found = ranked.where(F.col("level").isNotNull()).select(by, "level", "name")
    out = spine.join(found, [by, "level"], "left").join(any_, by, "left")
    return out.select(by, "level", "name", F.when(F.col("name").isNotNull(), "Inside").when(F.col("__n") > 0, "Outside").otherwise("NoData").alias("containment"))


def within(points: DataFrame, features: DataFrame, by: str, cap: float, grid: float = 2.0) -> DataFrame:
    """Points by the features (lat, lon) within cap metres, with raw_m and distance_m (to 0.1 m).  Points look up every grid square
    that the cap's circle can touch, around the antimeridian and the poles too."""
    deg = cap / geo.METRES_DEGREE * 1.01
    lat = F.col("lat")
    row = lambda v: F.floor((v + 90.0) / grid).cast("int")
    columns = int(-(-360 // grid))
    widest = F.least(F.lit(89.9), F.abs(lat) + deg)
    reach = F.least(F.lit(180.0), F.lit(deg) / F.cos(F.radians(widest)))
    squares = points.withColumn("__r", F.explode(F.sequence(row(M.clamp(lat - deg, -90.0, 90.0)), row(M.clamp(lat + deg, -90.0, 90.0)))))
    first, last = F.floor((F.col("lon") + 180.0 - reach) / grid), F.floor((F.col("lon") + 180.0 + reach) / grid)
    squares = squares.withColumn("__c", F.explode(F.array_distinct(F.transform(F.sequence(first, F.least(last, first + columns - 1)), lambda c: F.pmod(c, F.lit(columns)).cast("int")))))
    there = features.withColumnsRenamed({"lat": "f_lat", "lon": "f_lon"})
    there = there.withColumns({"__r": row(F.col("f_lat")), "__c": F.pmod(F.floor((F.col("f_lon") + 180.0) / grid), F.lit(columns)).cast("int")})
    pairs = squares.join(there, ["__r", "__c"]).withColumn("raw_m", geo.haversine(lat, F.col("lon"), F.col("f_lat"), F.col("f_lon"))).where(F.col("raw_m") <= cap)
    return pairs.withColumn("distance_m", F.round("raw_m", 1)).drop("__r", "__c")


def nearest(points: DataFrame, features: DataFrame, by: str, cap: float, k: int = 1, rank: Column | None = None, grid: float = 2.0, tie: str = "feature_id") -> DataFrame:
    """The k best features within cap metres of each point: lower rank, then nearer (to 0.1 m), then `tie`."""
    pairs = within(points, features, by, cap, grid).withColumn("rank", rank if rank is not None else F.lit(0))
    order = [F.col("rank"), F.col("distance_m"), F.col("raw_m"), F.col(tie)]
    return pairs.withColumn("nth", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("nth") <= k)


#: How much farther a named way may be than the nearest of any kind, and kinds that never name a street.
ON_WAY_SLACK, NOT_STREETS = 12.0, ("rail", "aeroway")


def on_way(distances: DataFrame, by: str, cap: float) -> DataFrame:
    """distances: (point, kind, name, distance).  The nearest named way of street kind, if within cap and at most 12 m
    farther than the nearest such way, named or not."""
    street = distances.where(~F.col("kind").isin(*NOT_STREETS))
    named = F.col("name").isNotNull() & (F.col("name") != "")
    best = street.groupBy(by).agg(F.min("distance").alias("any"), F.min(F.when(named, F.struct("distance", "name"))).alias("b"))
    return best.where((F.col("b.distance") <= cap) & (F.col("b.distance") <= F.col("any") + ON_WAY_SLACK)).select(by, F.col("b.name").alias("name"), F.col("b.distance").alias("distance"))


def labels_for(areas: DataFrame, labels: DataFrame) -> DataFrame:
    """Polygons (fid, x, y of their tile) with the label of the same id: own tile first, then west, east, north, south and
    the corners; x wraps."""
    offsets = [(0, 0), (-1, 0), (1, 0), (0, -1), (0, 1), (-1, -1), (1, -1), (-1, 1), (1, 1)]
    near = F.explode(F.array(*(F.struct(F.lit(i).alias("o"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for i, (dx, dy) in enumerate(offsets))))
    wide = areas.withColumn("__o", near).withColumns({"lx": F.pmod(F.col("x") + F.col("__o.dx"), F.pow(F.lit(2), F.col("z")).cast("long")), "ly": F.col("y") + F.col("__o.dy")})
    found = wide.join(labels.select(F.col("fid").alias("lfid"), F.col("x").alias("lx"), F.col("y").alias("ly"), F.col("name").alias("label"), F.col("pos").alias("lpos")), ["lx", "ly"]).where("fid = lfid and label <> ''")
    best = found.groupBy("fid", "z", "x", "y").agg(F.min_by("label", F.struct("__o.o", "lpos")).alias("label"))
    return areas.join(best, ["fid", "z", "x", "y"], "left")


def walk_up(wanted: DataFrame, held: DataFrame) -> DataFrame:
    """wanted (z, x, y) with the deepest held tile that covers it (hz, hx, hy), or null: an equi-join on exploded ancestors."""
    up = wanted.withColumn("hz", F.explode(F.sequence(F.lit(0), F.col("z").cast("int"))))
    up = up.withColumns({"hx": F.expr("shiftright(x, cast(z as int) - hz)"), "hy": F.expr("shiftright(y, cast(z as int) - hz)")})
    found = up.join(held.select(F.col("z").cast("int").alias("hz"), F.col("x").alias("hx"), F.col("y").alias("hy")).distinct(), ["hz", "hx", "hy"])
    best = found.groupBy("z", "x", "y").agg(F.max(F.struct("hz", "hx", "hy")).alias("b")).select("z", "x", "y", "b.*")
    return wanted.join(best, ["z", "x", "y"], "left")
