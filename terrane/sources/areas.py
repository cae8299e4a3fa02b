"""Named areas: GeoJSON collections, and a compact binary boundary file."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kinds, text
from . import wire

#: Property names to look for in order, and the binary format's magic, version, scale and limits.
NAMES = ["NAME_EN", "name_en", "NAME", "name", "ADMIN", "admin"]
KINDS = ["featurecla", "FEATURECLA", "type_en", "TYPE_EN"]
MAGIC, VERSION, SCALE = b"osmb", 1, 1e7
AREAS_MOST, POINTS_MOST, STRING_MOST, HEADER_MOST = 1 << 22, 1 << 26, 1 << 12, 1 << 16
POINT = "struct<lat:double,lon:double>"
PARTS = f"array<struct<outline:array<{POINT}>,holes:array<array<{POINT}>>>>"
SCHEMA = f"file_pos bigint, name string, kind string, parts {PARTS}"


def _ring(r: Column) -> Column:
    """[lon, lat] pairs to points, without the closing one."""
    points = F.transform(r, lambda p: F.struct(F.get(p, 1).alias("lat"), F.get(p, 0).alias("lon")))
    closed = (F.size(points) > 1) & (F.element_at(points, 1) == F.element_at(points, -1))
    return F.when(closed, F.slice(points, 1, F.size(points) - 1)).otherwise(points)


def _part(p: Column) -> Column:
    rings = F.transform(p, _ring)
    return F.struct(F.get(rings, 0).alias("outline"), F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0))).alias("holes"))


def read_geojson(spark: SparkSession, path: str, fallback: str = "area") -> DataFrame:
    """Polygons and multipolygons with a name; others are left out; none at all is an error when the rows are read."""
    schema = "features array<struct<properties:string,geometry:struct<type:string,coordinates:string>>>"
    f = spark.read.schema(schema).option("multiLine", True).json(path).select(F.posexplode("features").alias("pos", "f"))
    prop = lambda k: F.get_json_object("f.properties", f"$.{k}")
    poly = F.from_json("f.geometry.coordinates", "array<array<array<double>>>")
    multi = F.from_json("f.geometry.coordinates", "array<array<array<array<double>>>>")
    parts = F.when(F.col("f.geometry.type") == "Polygon", F.array(_part(poly))).when(F.col("f.geometry.type") == "MultiPolygon", F.transform(multi, _part))
    kind = F.coalesce(*(text.some(F.trim(prop(k))) for k in KINDS), F.lit(fallback))
    out = f.select(F.col("pos").cast("bigint").alias("file_pos"), text.first_name([prop(k) for k in NAMES]).alias("name"), kind.alias("kind"), parts.alias("parts"))
    return out.where("name is not null and size(parts) > 0")


def encode(areas: list[dict], source: str = "", credit: str = "", created: int = 0, levels: tuple[int, ...] = ()) -> bytes:
    """The binary file of areas {name, kind, parts: [[ring of (lat, lon)]]}."""

    def string(s: str) -> bytes:
        b = s.encode()
        if len(b) > STRING_MOST:
            raise ValueError("a string past the format's limit")
        return wire.put(len(b)) + b

    head = string(source) + string(credit) + wire.put(max(created, 0)) + wire.put(len(levels)) + b"".join(map(wire.put, levels))
    out = [MAGIC, wire.put(VERSION), wire.put(len(head)), head, wire.put(len(areas))]
    for a in areas:
        if not a["name"] or not a["parts"]:
            raise ValueError("an area needs a name and a polygon")
        out += [string(a["name"]), string(a["kind"]), wire.put(len(a["parts"]))]
        for rings in a["parts"]:
            out.append(wire.put(len(rings)))
            for ring in rings:
                q = [(round(y * SCALE), round(x * SCALE)) for y, x in ring]
                out.append(wire.put(len(q)))
                out += [wire.put(wire.zigzag(b[k] - a_[k])) for a_, b in zip([(0, 0), *q], q, strict=False) for k in (0, 1)]
    return b"".join(out)


def decode(b: bytes) -> tuple[dict, list[dict]]:
    """Provenance and areas of a binary file."""
    if b[:4] != MAGIC:
        raise wire.Malformed("not a boundary file")
    at = 4

    def number(most: int) -> int:
        nonlocal at
        v, at = wire.varint(b, at)
        if v > most:
            raise wire.Malformed(f"a count of {v}")
        return v

    def string() -> str:
        nonlocal at
        n = number(STRING_MOST)
        at += n
        if at > len(b):
            raise wire.Malformed("cut off")
        return b[at - n : at].decode()

    if number(255) != VERSION:
        raise wire.Malformed("another version")
    end = number(HEADER_MOST)
    end += at
    head = {"source": string(), "attribution": string(), "created": number(1 << 62), "levels": [number(1 << 30) for _ in range(number(64))]}
    at = end  # what a later header adds is stepped over
    areas = []
    for pos in range(number(AREAS_MOST)):
        a = {"file_pos": pos, "name": string(), "kind": string(), "parts": []}
        for _ in range(number(1 << 20)):
            rings = []
            for _ in range(number(1 << 20)):
                n = number(POINTS_MOST)
                if 2 * n > len(b) - at:
                    raise wire.Malformed("more points than bytes")
                steps = np.empty(2 * n, np.int64)
                for k in range(2 * n):
                    v, at = wire.varint(b, at)
                    steps[k] = wire.unzigzag(v)
                q = np.cumsum(steps.reshape(-1, 2), axis=0) / SCALE
                rings.append([{"lat": y, "lon": x} for y, x in q.tolist()])
            if rings:
                a["parts"].append({"outline": rings[0], "holes": rings[1:]})
        areas.append(a)
    return head, areas


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """Areas of binary boundary files, with source and attribution; files are ordered by name before areas by place."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                head, areas = decode(bytes(content))
                out = pd.DataFrame(areas, columns=["file_pos", "name", "kind", "parts"])
                yield out.assign(file=name, source=head["source"], attribution=head["attribution"], levels=[head["levels"]] * len(out))

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, f"{SCHEMA}, file string, source string, attribution string, levels array<int>")


def read_regions(spark: SparkSession, folder: str, prefix: str, suffix: str) -> DataFrame:
    """Areas of all the region files of a folder, with their region.  A file that cannot be read is left out, so that one of them takes
    nothing from the others' answers; other files are not opened."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for region, content in zip(pdf["region"], pdf["content"], strict=True):
                try:
                    _, areas = decode(bytes(content))
                except (wire.Malformed, ValueError, IndexError):  # a bad file, or bytes that are no text
                    continue
                yield pd.DataFrame(areas, columns=["file_pos", "name", "kind", "parts"]).assign(region=region)

    files = spark.read.format("binaryFile").load(folder).withColumn("region", kinds.region_of(F.element_at(F.split("path", "/"), -1), prefix, suffix))
    return files.where("region is not null").select("region", "content").mapInPandas(run, f"{SCHEMA}, region string")


def available(spark: SparkSession, folder: str, layers: list[str], prefix: str, suffix: str) -> bool:
    """Does a folder hold any boundaries: all the layers' files, or any region's."""
    try:
        found = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"))
        had = found.where(F.col("name").isin(*layers)).select("name").distinct().count()
        return had == len(set(layers)) or not found.where(kinds.region_of(F.col("name"), prefix, suffix).isNotNull()).isEmpty()
    except AnalysisException:  # no such folder
        return False
