"""python -m terrane.cli COMMAND ...: inspect, tile, geojson, locate, boundaries, render, plan.

Each command is a thin shell over the library: it builds DataFrames, runs one plan and prints or writes the result."""

from __future__ import annotations

import argparse
import json
import re
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text, tileid
from .functions import mercator as M
from .functions import view as V
from .operators import draw, inspect, osm, planning, spatial
from .sources import areas, mvt, osmpbf, pmtiles

LEVELS = ["locality", "macrohood", "neighbourhood"]


def session() -> SparkSession:
    s = SparkSession.builder.appName("terrane").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    s.dataSource.register(pmtiles.PmtilesSource)
    s.dataSource.register(osmpbf.OsmSource)
    return s


def archive(spark: SparkSession, path: str, view: str = "tiles") -> DataFrame:
    return spark.read.format("pmtiles").option("view", view).load(path)


def one_tile(spark: SparkSession, path: str, z: int, x: int, y: int) -> DataFrame:
    """The features of a tile, or no rows."""
    held = spark.read.format("pmtiles").option("tile", f"{z}/{x}/{y}").load(path)
    return mvt.features(held.select("z", "x", "y", "data"))


def inspect_command(spark, a) -> dict:
    head = archive(spark, a.archive, "header").first().asDict()
    return {"header": head, "directory": inspect.directory_summary(archive(spark, a.archive, "directory")).first().asDict(), "credit": text_of(archive(spark, a.archive, "metadata").select(text.plain_credit(F.col("attribution"))).first())}


def text_of(row):
    return row[0] if row else None


def tile_command(spark, a) -> list[dict]:
    f = one_tile(spark, a.archive, a.z, a.x, a.y)
    out = [r.asDict() for r in inspect.layer_counts(f).orderBy(F.col("layer").isNull(), "layer").collect()]
    if a.tags:
        value = lambda v: F.coalesce(v["s"], *(v[k].cast("string") for k in ("f", "d", "i", "u", "si", "b")))
        t = f.select("layer", "pos", F.explode("tags").alias("key", "v")).select("layer", "pos", "key", F.col("v.kind").alias("kind"), value(F.col("v")).alias("value"))
        out += [r.asDict() for r in inspect.tag_samples(t, "layer").orderBy("layer", "key").collect()]
    return out


def geojson(features: DataFrame) -> DataFrame:
    """A GeoJSON feature a row (json), for features with a geometry; polygons of under three vertices are left out."""
    at = lambda p: F.struct(*(c.alias(k) for k, c in zip(("lon", "lat"), M.lonlat_in_tile(F.col("z"), F.col("x"), F.col("y"), p["x"], p["y"], F.col("extent").cast("double")), strict=True)))
    pair = lambda p: F.array(at(p)["lon"], at(p)["lat"])
    line = lambda ps: F.transform(ps, pair)
    ring = lambda ps: F.concat(F.reverse(line(ps)), F.slice(F.reverse(line(ps)), 1, 1))
    shape = F.filter(F.transform("polygons", lambda p: F.transform(F.concat(F.array(p["exterior"]), F.filter(p["holes"], lambda h: F.size(h) > 2)), ring)), lambda p: F.size(p[0]) > 3)
    of = lambda kind, c: F.to_json(F.struct(F.lit(kind).alias("type"), c.alias("coordinates")))
    many = lambda c, kind: F.when(F.size(c) == 1, of(kind, c[0])).when(F.size(c) > 1, of(f"Multi{kind}", c))
    body = F.when(F.col("geom_type") == 1, many(line(F.col("points")), "Point")).when(F.col("geom_type") == 2, many(F.transform("lines", line), "LineString")).when(F.col("geom_type") == 3, many(shape, "Polygon"))
    value = lambda v: F.coalesce(v["s"], *(v[k].cast("string") for k in ("f", "d", "i", "u", "si", "b")))
    props = inspect.properties_json(F.col("layer"), F.col("fid"), F.transform_values("tags", lambda k, v: value(v)))
    return features.withColumn("g", body).where("g is not null").select("layer", "pos", F.concat(F.lit('{"type":"Feature","geometry":'), F.col("g"), F.lit(',"properties":'), props, F.lit("}")).alias("json"))


def geojson_command(spark, a) -> str:
    f = one_tile(spark, a.archive, a.z, a.x, a.y)
    if a.layer:
        f = f.where(F.col("layer") == a.layer)
    rows = [r["json"] for r in geojson(f).orderBy("layer", "pos").collect()]  # one tile
    return '{"type":"FeatureCollection","features":[' + ",".join(rows) + "]}"


def read_areas(spark: SparkSession, path: str) -> DataFrame:
    return areas.read_geojson(spark, path) if path.endswith("json") else areas.read_binary(spark, path).select("file_pos", "name", "kind", "parts")


def locate_command(spark, a) -> list[dict]:
    points = spark.createDataFrame([(i, *map(float, p.split(","))) for i, p in enumerate(a.points)], "point_id long, lat double, lon double")
    got = spatial.levels(points, read_areas(spark, a.areas), "point_id", LEVELS)
    wide = got.groupBy("point_id").agg(F.collect_list(F.struct("level", "name", "containment")).alias("levels"))
    return [json.loads(r[0]) for r in points.join(wide, "point_id").orderBy("point_id").select(F.to_json(F.struct("*"))).collect()]


def boundaries_command(spark, a) -> dict:
    """An extract's boundaries as a binary file, or as Parquet where the output ends so."""
    table = lambda t: spark.read.format("osmpbf").option("table", t).load(a.extract)
    found = osm.boundaries(table("relations"), a.language, a.level)
    made = osm.assemble(osm.resolve(found, table("ways"), table("nodes"))).join(found.select("id", "name", "kind"), "id").where("size(parts) > 0").cache()
    if a.out.endswith(".parquet"):
        made.write.parquet(a.out)
    else:  # the format is one small file
        rows = [{"name": r["name"], "kind": r["kind"], "parts": [[[(p["lat"], p["lon"]) for p in ring] for ring in [q["outline"], *q["holes"]]] for q in r["parts"]]} for r in made.orderBy("id").toLocalIterator()]
        with open(a.out, "wb") as f:
            f.write(areas.encode(rows, a.extract, "© OpenStreetMap contributors"))
    return osm.report(made).first().asDict()


def plan_command(spark, a) -> dict:
    box = spark.createDataFrame([tuple(map(float, a.box.split(",")))], "w double, s double, e double, n double")
    cells = planning.plan_areas(box)
    deepest = cells.agg(F.max("depth")).first()[0]
    tiles = planning.pyramid(cells, planning.CELL_ZOOM, max(deepest, planning.CELL_ZOOM)).where("z <= depth")
    wanted = tiles.select(tileid.tile_id(F.col("z"), F.col("tx"), F.col("ty")).alias("tile_id"), F.lit(1).alias("grp"))
    plan = planning.split_plan(wanted, wanted.limit(0), archive(spark, a.archive, "directory"))
    got = planning.totals(plan, ["grp"]).first().asDict()
    return {k: v for k, v in got.items() if k != "grp"} | {"cells": cells.count(), "depth": deepest}


def render_command(spark, a) -> dict:
    """Polygons and lines of the tiles under a view, a flat colour a layer."""
    box = spark.createDataFrame([tuple(map(float, a.box.split(",")))], "w double, s double, e double, n double").withColumns({"width": F.lit(a.width), "height": F.lit(a.height)})
    view = V.resolve(box)
    under = V.tiles_under(view)
    wanted = under.select("*", tileid.tile_id(F.col("tile_zoom"), F.col("tx"), F.col("ty")).alias("tile_id"))
    tiles = archive(spark, a.archive).select("tile_id", "run_length", "data").withColumn("tile_id", F.explode(F.expr("sequence(tile_id, tile_id + run_length - 1)")))
    f = mvt.features(wanted.join(tiles, "tile_id").select("tile_zoom", "tx", "ty", "scale", "ox", "oy", "width", "height", "data"))
    side = M.side(F.col("tile_zoom"))
    to = lambda p: F.struct((((F.col("tx") + p["x"] / F.col("extent")) / side - F.col("ox")) * F.col("scale")).alias("x"), (((F.col("ty") + p["y"] / F.col("extent")) / side - F.col("oy")) * F.col("scale")).alias("y"))
    move = lambda rings: F.transform(rings, lambda r: F.transform(r, to))
    rings = F.when(F.col("geom_type") == 3, move(F.flatten(F.transform("polygons", lambda p: F.concat(F.array(p["exterior"]), p["holes"]))))).otherwise(move(F.col("lines")))
    tint = lambda k: (F.pmod(F.xxhash64("layer", F.lit(k)), F.lit(160)) + 64).cast("int")
    shapes = f.where("geom_type in (2, 3)").select(F.lit(1).cast("bigint").alias("view_id"), "width", "height", F.when(F.col("geom_type") == 3, 0).otherwise(1).alias("ord"), F.when(F.col("geom_type") == 3, "fill").otherwise("stroke").alias("kind"), rings.alias("rings"), tint("r").alias("red"), tint("g").alias("green"), tint("b").alias("blue"), F.lit(1.5).alias("stroke"))
    got = draw.render(shapes).collect()
    png = bytes(got[0]["png"]) if got else draw.Surface(a.width, a.height).png()
    with open(a.out, "wb") as out:
        out.write(png)
    r = view.first()
    return {"zoom": r["zoom"], "tile_zoom": r["tile_zoom"], "bytes": len(png)}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="terrane")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("inspect").add_argument("archive")
    for name in ("tile", "geojson"):
        q = sub.add_parser(name)
        q.add_argument("archive")
        for k in "zxy":
            q.add_argument(k, type=int)
        if name == "tile":
            q.add_argument("--tags", action="store_true")
        else:
            q.add_argument("--layer")
    q = sub.add_parser("locate")
    q.add_argument("areas")
    q.add_argument("points", nargs="+", help="LAT,LON")
    q = sub.add_parser("boundaries")
    q.add_argument("extract")
    q.add_argument("out")
    q.add_argument("--level", type=int, action="append")
    q.add_argument("--language", default="en")
    for name in ("plan", "render"):
        q = sub.add_parser(name)
        q.add_argument("archive")
        q.add_argument("box", help="W,S,E,N")
        if name == "render":
            q.add_argument("out")
            q.add_argument("--width", type=int, default=512)
            q.add_argument("--height", type=int, default=512)
    for q in sub.choices.values():
        q._negative_number_matcher = re.compile(r"^-[0-9.]")  # coordinates are not options
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    got = globals()[f"{a.command}_command"](spark or session(), a)
    sys.stdout.write((got if isinstance(got, str) else json.dumps(got, default=str, indent=1)) + "\n")
    return 0


if __name__ == "__main__":
    sys.exit(main())
