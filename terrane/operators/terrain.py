"""Elevation archives and credits: which archive holds a cell, which sources lie under a view, and what they are owed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import mercator as M
from ..functions import text
from . import lines

#: File names of a hosted layout (fixed values).
GLOBAL, COVERAGE, SOURCES = "planet.pmtiles", "coverage.pmtiles", "attribution.json"
REGION = r"^(\d+)-(\d+)-(\d+)\.pmtiles$"


def read_index(spark: SparkSession, path: str, base: str) -> DataFrame:
    """A hosted layout's list of archives: kind (global, coverage, sources, region), url, and a region's z, x, y.  Names of
    other forms, and tiles off their zoom's grid, are left out; the coverage archive and the sources lie beside the list."""
    schema = "items array<struct<name:string,url:string>>"
    items = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("items").alias("i")).select("i.name", F.coalesce(text.some(F.col("i.url")), F.concat(F.lit(base.rstrip("/") + "/"), F.col("i.name"))).alias("url"))
    part = lambda k: F.try_to_number(F.regexp_extract("name", REGION, k), F.lit("9999999999")).cast("long")
    tiles = items.withColumns({k: F.when(F.col("name").rlike(REGION), part(i)) for i, k in enumerate("zxy", 1)})
    kind = F.when(F.col("name") == GLOBAL, "global").when((F.col("z") <= 31) & (F.col("x") < F.pow(F.lit(2), "z")) & (F.col("y") < F.pow(F.lit(2), "z")), "region")
    listed = tiles.select(kind.alias("kind"), "url", *(F.when(kind == "region", F.col(k)).alias(k) for k in "zxy")).where("kind is not null")
    beside = spark.createDataFrame([("coverage", f"{base.rstrip('/')}/{COVERAGE}"), ("sources", f"{base.rstrip('/')}/{SOURCES}")], "kind string, url string")
    return listed.unionByName(beside, allowMissingColumns=True)


def region_for(cells: DataFrame, regions: DataFrame, cell_zoom: int) -> DataFrame:
    """cells (x, y) with the url of the region that holds each, the first by z, x, y, or null: a join on exploded ancestors."""
    up = cells.withColumn("rz", F.explode(F.sequence(F.lit(0), F.lit(cell_zoom))))
    up = up.withColumns({"rx": F.expr(f"shiftright(x, {cell_zoom} - rz)"), "ry": F.expr(f"shiftright(y, {cell_zoom} - rz)")})
    found = up.join(regions.where("kind = 'region'").select(F.col("z").alias("rz"), F.col("x").alias("rx"), F.col("y").alias("ry"), "url"), ["rz", "rx", "ry"])
    return cells.join(found.groupBy("x", "y").agg(F.min_by("url", F.struct("rz", "rx", "ry")).alias("url")), ["x", "y"], "left")


def meets(box: tuple, exterior: list, holes: list) -> bool:
    """Does a rectangle reach a polygon: an edge crosses it, or it lies inside, out of all holes."""
    for ring in (exterior, *holes):
        if any(lines.clip_segment(a, b, box) for a, b in zip(ring, ring[1:] + ring[:1], strict=True)):
            return True

    def inside(ring) -> bool:
        x, y, odd = box[0], box[1], False
        for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
            if (a[1] > y) != (b[1] > y) and x < a[0] + (y - a[1]) / (b[1] - a[1]) * (b[0] - a[0]):
                odd = not odd
        return odd

    return inside(exterior) and not any(map(inside, holes))


def sources_in(views: DataFrame, coverage: DataFrame) -> DataFrame:
    """views (view_id, w, s, e, n) by the sources whose coverage polygons reach them.  coverage: features (z, x, y, extent,
    source, polygons) of the tiles to look at, one zoom or several."""
    world = views.select("view_id", M.world_x(F.col("w")).alias("vx0"), M.world_y(F.col("n")).alias("vy0"), M.world_x(F.col("e")).alias("vx1"), M.world_y(F.col("s")).alias("vy1"))
    zooms = coverage.select("z").distinct()  # at most 32
    spans = world.join(F.broadcast(zooms))
    x0, x1 = M.span(F.col("vx0"), F.col("vx1"), F.col("z"))
    y0, y1 = M.span(F.col("vy0"), F.col("vy1"), F.col("z"))
    tiles = spans.withColumn("x", F.explode(F.sequence(x0, x1))).withColumn("y", F.explode(F.sequence(y0, y1)))
    rows = tiles.join(coverage, ["z", "x", "y"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                k = 2.0**r.z * r.extent
                ox, oy = r.x * r.extent, r.y * r.extent
                box = (r.vx0 * k - ox, r.vy0 * k - oy, r.vx1 * k - ox, r.vy1 * k - oy)
                ring = lambda ps: [(p["x"], p["y"]) for p in ps]
                if any(meets(box, ring(p["exterior"]), [ring(h) for h in p["holes"]]) for p in r.polygons):
                    out.append((r.view_id, r.source))
            yield pd.DataFrame(out, columns=["view_id", "source"])

    kind = views.schema["view_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"view_id {kind}, source string").distinct()


def credit(ids: DataFrame, attributions: DataFrame, by: str, notices: dict[str, str] | None = None, lead: str = "Elevation") -> DataFrame:
    """ids (by, pos, source) to a credit line each: the producer (else the name) and licence of each source in order, the same
    words once; a source with a notice of its own is credited by that, an unknown one by its id."""
    said = F.coalesce(*(F.when(F.col("source") == k, F.lit(v)) for k, v in (notices or {}).items()), F.lit(None).cast("string"))
    who = F.coalesce(text.some(text.collapse_space(F.col("producer"))), text.some(text.collapse_space(F.col("name"))))
    licence = text.some(text.collapse_space(F.col("license")))
    words = F.coalesce(said, F.concat(who, F.coalesce(F.concat(F.lit(" ("), licence, F.lit(")")), F.lit(""))), F.col("source"))
    named = ids.join(attributions.select("source", "name", "producer", "license").dropDuplicates(["source"]), "source", "left").withColumn("__t", words)
    first = named.withColumn("__r", F.row_number().over(W.partitionBy(by, "__t").orderBy("pos"))).where("__r = 1")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "__t"))), lambda s: s["__t"])
    return first.groupBy(by).agg(F.concat(F.lit(f"{lead}: "), F.array_join(parts, "; ")).alias("credit"))


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """A folder of archives as read_index gives it: its global archive, without which it is no layout, regions, coverage and sources."""
    names = spark.read.format("binaryFile").load(path).select("path").withColumn("name", F.element_at(F.split("path", "/"), -1))  # no content is read
    part = lambda k: F.regexp_extract("name", REGION, k).try_cast("long")
    tiles = names.withColumns({k: part(i) for i, k in enumerate("zxy", 1)})
    on_grid = (F.col("z") <= 31) & (F.col("x") < F.pow(F.lit(2), "z")) & (F.col("y") < F.pow(F.lit(2), "z"))
    kind = F.when(F.col("name") == GLOBAL, "global").when(F.col("name") == COVERAGE, "coverage").when(F.col("name") == SOURCES, "sources").when(on_grid, "region")
    found = tiles.select(kind.alias("kind"), F.col("path").alias("url"), *(F.when(kind == "region", F.col(k)).alias(k) for k in "zxy")).where("kind is not null")
    if found.where("kind = 'global'").isEmpty():
        raise FileNotFoundError(f"{path} holds no {GLOBAL}")
    return found


def locate(spark: SparkSession, source: str, index: str = "") -> DataFrame:
    """The archives at a source: a folder's, or those of a list (its path) that a host at this address has published."""
    return read_index(spark, index, source) if index else read_folder(spark, source)
