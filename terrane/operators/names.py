"""Name search, label points and name planning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo, text
from . import ordered


def find(queries: DataFrame, places: DataFrame) -> DataFrame:
    """queries (query) by places (place_id, level, name, aliases) that match, exact or near; where a query has an exact
    match its near ones go.  Aliases are matched on their first word, an equi-join; the rest is a residual."""
    word = lambda c: F.lower(F.split_part(c, F.lit(" "), F.lit(1)))
    asked = queries.select("query").distinct().withColumn("__w", word(F.col("query")))
    keys = places.withColumn("__w", F.explode(F.array_distinct(F.transform("aliases", word))))
    found = asked.join(keys, "__w").withColumn("match", text.match_name(F.col("aliases"), F.col("query"))).where("match is not null").drop("__w").dropDuplicates(["query", "place_id"])
    exact = F.max(F.col("match") == "exact").over(W.partitionBy("query"))
    return found.withColumn("__e", exact).where("match = 'exact' or not __e").drop("__e")


def without_repeats(derived: DataFrame, listed: DataFrame) -> DataFrame:
    """Derived candidates (level, name) that the listed ones do not have."""
    known = listed.select("level", F.lower("name").alias("__n")).distinct()
    return derived.withColumn("__n", F.lower("name")).join(known, ["level", "__n"], "left_anti").drop("__n")


def place_points(features: DataFrame, near_m: float = 1000.0) -> DataFrame:
    """Named localities (name, lat, lon, pos), one of those of a name within 1 km of one kept.  Which stay depends on order:
    a name is a group, and groups are small."""
    import math

    import pandas as pd

    band = near_m / geo.METRES_DEGREE * 1.01  # degrees of latitude within which a point can be near

    def far(lat: float, lon: float, others: list[tuple[float, float]]) -> bool:
        for a, b in others:
            h = math.sin(math.radians(lat - a) / 2) ** 2 + math.cos(math.radians(lat)) * math.cos(math.radians(a)) * math.sin(math.radians(lon - b) / 2) ** 2
            if 2 * geo.RADIUS * math.asin(min(1.0, math.sqrt(h))) <= near_m:
                return False
        return True

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        kept: dict[int, list[tuple[float, float]]] = {}  # by band of latitude: only three bands can hold a near one
        stay = []
        for lat, lon in zip(pdf["lat"], pdf["lon"], strict=True):
            k = math.floor(lat / band)
            stay.append(all(far(lat, lon, kept.get(j, ())) for j in (k - 1, k, k + 1)))
            if stay[-1]:
                kept.setdefault(k, []).append((lat, lon))
        return pdf[stay]

    return features.where("name is not null and name <> ''").groupBy("name").applyInPandas(one, features.schema)


def plan(strengths: DataFrame, smooth: int, least_frames: int) -> DataFrame:
    """strengths (name_id, frame, alpha): names seen at half strength for enough consecutive frames, their strengths smoothed."""
    lasting = ordered.longest_run(strengths, "name_id", "frame", F.col("alpha") >= 0.5).where(F.col("longest") >= least_frames).select("name_id")
    return ordered.smoothed(strengths.join(lasting, "name_id", "left_semi"), "name_id", "frame", "alpha", smooth)


def chains(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Shortest chains (root, node, steps) along directed edges (a, b): breadth first, each round's new nodes joined on, until a round
    finds none.  With a checkpoint folder each round is written there, which cuts the lineage."""
    seen = front = roots.select(F.col("node").alias("root"), "node", F.lit(0).alias("steps"))
    context = roots.sparkSession.sparkContext
    keep = (lambda df: df.checkpoint()) if context.getCheckpointDir() else (lambda df: df)
    k = 0
    while not front.isEmpty():
        k += 1
        step = front.join(edges, front["node"] == edges["a"]).select("root", F.col("b").alias("node")).distinct()
        front = keep(step.join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("steps", F.lit(k)))
        seen = keep(seen.union(front))
    return seen


def place_ids(seen: DataFrame) -> DataFrame:
    """Names that frames show (name, pos, lat, lon, z, fine_lat, fine_lon, fine_z) with the number of their place: a name met again near
    where its coarsest or its finest zoom put it is the same place.  What is near depends on what came before, so a name is a group;
    it holds one flight's sights of it, and places of the name, which few are, are looked through for each."""
    import pandas as pd

    def near(lat: float, lon: float, place: list, k: int, z: int) -> bool:
        d = 6 * 360 / 2.0 ** min(place[k + 2], z) / 256
        return abs(lat - place[k]) < d and abs(lon - place[k + 1]) < d

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        places: list[list] = []  # lat, lon, z of the coarsest, then of the finest
        ids = []
        for r in pdf.itertuples():
            coarse, fine = [r.lat, r.lon, r.z], [r.fine_lat, r.fine_lon, r.fine_z]
            k = next((i for i, p in enumerate(places) if near(*coarse[:2], p, 0, r.z) or near(*fine[:2], p, 3, r.fine_z)), len(places))
            if k == len(places):
                places.append([*coarse, *fine])
            elif r.z < places[k][2]:
                places[k][:3] = coarse
            if r.fine_z > places[k][5]:
                places[k][3:] = fine
            ids.append(k)
        return pdf[["name", "pos"]].assign(place=ids)

    return seen.groupBy("name").applyInPandas(one, f"name string, pos {seen.schema['pos'].dataType.simpleString()}, place int")
