"""Where a point is, level by level, and which place a name means.

Levels that areas answer come from a binned containment join, the others from a binned nearest join; ranks, reaches and caps are
columns, so one plan answers all points of a level."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo, kinds, text
from . import spatial

#: Where a level's features are (layer, kinds, zoom, are they lines) and how far its nearest may be, in metres.
AREA_KINDS = ["park", "garden", "nature_reserve", "national_park", "protected_area", "cemetery", "golf_course", "zoo", "theme_park", "recreation_ground", "university", "college", "aerodrome"]
SPECS = [
    ("country", "places", ["country"], 4, False, 1_000_000.0),
    ("region", "places", ["region"], 5, False, 500_000.0),
    ("locality", "places", ["locality"], 10, False, 25_000.0),
    ("macrohood", "places", ["macrohood"], 13, False, 5_000.0),
    ("neighbourhood", "places", ["neighbourhood"], 14, False, 3_000.0),
    ("area", "landuse", AREA_KINDS, 14, False, 0.0),
    ("street", "roads", [], 14, True, 250.0),
]
#: How the neighbourhood level prefers its kinds; the zoom at which a place reaches as far as the cap, and the most times.
HOODS = {"suburb": 0, "quarter": 1, "neighbourhood": 2}
EVEN_ZOOM, LATE_ZOOM, MOST_REACH = 8.0, 12.0, 8.0
#: Parts of an area within so many kilometres of one another are shown together (fixed value).
PART_KM = 300.0


def specs(spark) -> DataFrame:
    """The seven levels that tiles answer."""
    return spark.createDataFrame(SPECS, "level string, layer string, kinds array<string>, zoom int, line boolean, max_m double")


def wanted(names: str) -> list[str]:
    """A comma-separated list of levels; an unknown one is refused; none asks for all."""
    out = [n.strip() for n in names.split(",") if n.strip()]
    if bad := [n for n in out if n not in kinds.LEVELS]:
        raise ValueError(f"unknown level: {', '.join(bad)}")
    return out or list(kinds.LEVELS)


def cap(level: Column, own: dict[str, float] | None = None) -> Column:
    """The farthest that a level's nearest feature may be: the caller's figure, else the level's."""
    table = {s[0]: s[5] for s in SPECS} | (own or {})
    return F.coalesce(*(F.when(level == k, v) for k, v in table.items()))


def reach(min_zoom: Column, base: Column) -> Column:
    """How far a place answers for: doubled for each two zooms that it is shown earlier, eight times at most."""
    return base * F.least(F.pow(F.lit(2.0), (EVEN_ZOOM - F.coalesce(min_zoom, F.lit(LATE_ZOOM))) / 2), F.lit(MOST_REACH))


def town_rank(kind: Column) -> Column:
    return F.when(kind == "city", 0).otherwise(1)


def hood_rank(kind: Column, level: Column) -> Column:
    """Only the neighbourhood level prefers one kind to another."""
    by_kind = F.coalesce(*(F.when(kind == k, v) for k, v in HOODS.items()), F.lit(3))
    return F.when(level == "neighbourhood", by_kind).otherwise(0)


def near_levels(points: DataFrame, features: DataFrame, by: str, levels: Iterable[str], prominent: bool = False, caps: dict[str, float] | None = None) -> DataFrame:
    """points by the best named point feature (level, kind_detail, name, min_zoom, lat, lon, feature_id) of each level within its cap:
    (point, level, name, kind, distance_m, feature_id).  prominent: the locality is the city, else town, whose reach the point is
    most within."""
    found = []
    for level in levels:
        own = features.where((F.col("level") == level) & (F.coalesce("name", F.lit("")) != ""))
        most = (caps or {}).get(level, next(s[5] for s in SPECS if s[0] == level))
        if prominent and level == "locality":
            own = own.where(kinds.is_city(F.col("kind_detail")))
            pairs = spatial.within(points, own, by, most * MOST_REACH, grid=5.0)
            far = reach(F.col("min_zoom").cast("double"), F.lit(most))
            pairs = pairs.where(F.col("raw_m") <= far).withColumns({"rank": town_rank(F.col("kind_detail")).cast("double"), "share": F.col("raw_m") / far})
        else:
            pairs = spatial.within(points, own, by, most, grid=max(0.5, min(10.0, most / 50_000.0)))
            pairs = pairs.withColumns({"rank": hood_rank(F.col("kind_detail"), F.lit(level)).cast("double"), "share": F.lit(0.0)})
        order = [F.col("rank"), F.col("share"), F.col("distance_m"), F.col("raw_m"), F.col("feature_id")]
        best = pairs.withColumn("__n", F.row_number().over(W.partitionBy(by).orderBy(*order))).where("__n = 1")
        found.append(best.select(by, F.lit(level).alias("level"), "name", F.col("kind_detail").alias("kind"), "distance_m", "feature_id"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def deepest(matches: DataFrame, by: str) -> DataFrame:
    """The narrowest answer of each point (level, name)."""
    order = F.array_position(F.array(*map(F.lit, kinds.LEVELS)), F.col("level"))
    return matches.groupBy(by).agg(F.max_by(F.struct("level", "name"), order).alias("m")).select(by, "m.*")


def contained_credits(matches: DataFrame) -> DataFrame:
    """The credits that contained answers owe, each once as plain text, in order."""
    credit = text.terminal_safe(text.plain_credit(F.col("credit")))
    return matches.where((F.col("source") == "contained") & (F.coalesce("credit", F.lit("")) != "")).select(credit.alias("credit")).where("credit <> ''").distinct()


def any_near(matches: DataFrame, by: list[str]) -> DataFrame:
    """Was any answer taken from the tiles."""
    return matches.groupBy(*by).agg(F.bool_or(F.col("source") != "contained").alias("near"))


def city_at(points: DataFrame, areas: DataFrame, by: str) -> DataFrame:
    """(point, name, containment): the innermost city or town extent; Outside where another area holds the point, else NoData."""
    held = spatial.containing(points, areas)
    box = (F.col("e") - F.col("w")) * (F.col("n") - F.col("s"))
    # the innermost is the last from outside: least box, and of equals the last
    own = F.max_by("name", F.when(kinds.is_city(F.col("kind")), F.struct(-box, F.col("file_pos"))))
    known = held.groupBy(by).agg(own.alias("name"), F.count_if(kinds.is_city(F.col("kind"))).alias("__c"))
    out = points.select(by).join(known, by, "left")
    return out.select(by, "name", F.when(F.col("__c") > 0, "Inside").when(F.col("__c") == 0, "Outside").otherwise("NoData").alias("containment"))


def country_at(points: DataFrame, areas: DataFrame, by: str) -> DataFrame:
    """(point, name): the innermost national border that holds the point, for points that one holds."""
    held = spatial.containing(points, areas.where(kinds.is_country(F.col("kind"))))
    box = (F.col("e") - F.col("w")) * (F.col("n") - F.col("s"))
    return held.groupBy(by).agg(F.max_by("name", F.struct(-box, F.col("file_pos"))).alias("name"))


def covers(areas: DataFrame, files: DataFrame) -> DataFrame:
    """Levels by whether anything can answer them: files (layer, areas) of countries, regions and waters that hold an area; the levels
    below by any derived area; a city only by a city's extent."""
    level = files.sparkSession.createDataFrame([(x,) for x in kinds.LEVELS], "level string")
    listed = files.groupBy("layer").agg((F.sum("areas") > 0).alias("filled"))
    some = areas.agg((F.count("*") > 0).alias("any"), (F.count_if(kinds.is_city(F.col("kind"))) > 0).alias("city"))
    rows = level.withColumn("layer", kinds.layer_of(F.col("level"))).join(listed, "layer", "left").join(F.broadcast(some))  # one row of flags
    able = F.when(F.col("layer").isNotNull(), F.coalesce("filled", F.lit(False))).when(F.col("level") == "city", F.col("city"))
    return rows.select("level", able.when(kinds.is_derived(F.col("level")), F.col("any")).otherwise(False).alias("covered"))


def context(points: DataFrame, areas: DataFrame, regions: DataFrame, countries: DataFrame, by: str) -> DataFrame:
    """What each point is in.  `within`: the nearest wider local area, then the region, then the country, as text; `context`: the names
    that may qualify a search, in lower case.  areas may have columns own_area and own_id of the point's own area, which is not wider
    than itself.  regions, countries: areas with names (array) and parents (array)."""
    box = (F.col("e") - F.col("w")) * (F.col("n") - F.col("s"))
    wider = spatial.containing(points, areas).where(~kinds.is_country(F.col("kind"))).withColumn("box", box)
    if "own_box" in points.columns:
        wider = wider.where(F.col("own_box").isNull() | (F.col("box") > F.col("own_box")))
    order = F.struct("box", F.coalesce(-kinds.number(F.col("kind")), F.lit(0)), F.col("file_pos"))
    local = wider.groupBy(by).agg(F.array_agg("name").alias("__names"), F.min_by(F.struct("name", kinds.listed_level(F.col("kind")).alias("level")), order).alias("__near"))

    def smallest(layer: DataFrame, tag: str) -> DataFrame:
        held = spatial.containing(points, layer)
        return held.groupBy(by).agg(F.min_by(F.struct("name", "names", "parents"), F.struct(box, F.col("file_pos"))).alias(tag))

    out = points.select(by).distinct().join(local, by, "left").join(smallest(regions, "__r"), by, "left").join(smallest(countries, "__c"), by, "left")
    none = F.array().cast("array<string>")
    shown = F.when(F.col("__near.level") == "locality", F.col("__near.name"))
    country = F.coalesce("__c.name", F.get("__r.parents", 0))
    parts = F.array_compact(F.array(shown, F.col("__r.name"), F.when(~(country.eqNullSafe(shown)) & ~(country.eqNullSafe(F.col("__r.name"))), country)))
    every = F.concat(F.coalesce("__names", none), F.array(F.col("__r.name")), F.coalesce("__r.names", none), F.coalesce("__r.parents", none), F.array(F.col("__c.name")), F.coalesce("__c.names", none))
    return out.select(by, F.array_join(parts, ", ").alias("within"), F.array_sort(F.array_distinct(F.transform(F.array_compact(every), F.lower))).alias("context"))


def find_within(queries: DataFrame, places: DataFrame) -> DataFrame:
    """queries (query: a name, or `name, what it is in`) by places (place_id, aliases, context): exact matches, or where a query has
    none the near ones; a qualifier must be in the place's context.  Aliases meet on their first word, an equi-join."""
    word = lambda c: F.lower(F.split_part(c, F.lit(" "), F.lit(1)))
    comma = F.locate(",", F.col("query"))
    name = F.trim(F.when(comma > 0, F.substr("query", F.lit(1), comma - 1)).otherwise(F.col("query")))
    inside = F.when(comma > 0, F.nullif(F.lower(F.trim(F.substr("query", comma + 1))), F.lit("")))
    asked = queries.select("query").distinct().withColumns({"__name": name, "__in": inside}).where("__name <> ''").withColumn("__w", word(F.col("__name")))
    keys = places.withColumn("__w", F.explode(F.array_distinct(F.transform("aliases", word))))
    found = asked.join(keys, "__w").withColumn("match", text.match_name(F.col("aliases"), F.col("__name"))).where("match is not null")
    found = found.where(F.col("__in").isNull() | F.array_contains("context", F.col("__in"))).dropDuplicates(["query", "place_id"])
    best = found.groupBy("query").agg(F.bool_or(F.col("match") == "exact").alias("__e"))
    return found.join(best, "query").where("match = 'exact' or not __e").select("query", "place_id", "match")


def listing(candidates: DataFrame, by: str, shown: str, order: str, most: int = 12) -> DataFrame:
    """Candidates of each query on lines, at most so many, and how many more there are.  unique: is it one exact match."""
    rows = candidates.withColumn("__n", F.row_number().over(W.partitionBy(by).orderBy(order)))
    held = rows.groupBy(by).agg(F.count("*").alias("found"), F.array_sort(F.collect_list(F.when(F.col("__n") <= most, F.struct("__n", shown)))).alias("__l"), F.count_if(F.col("match") == "exact").alias("__x"))
    lines = F.array_join(F.transform("__l", lambda v: F.concat(F.lit("  "), v[shown])), "\n")
    tail = F.when(F.col("found") > most, F.concat(F.lit("\n  ... and "), (F.col("found") - most).cast("string"), F.lit(" more"))).otherwise("")
    return held.select(by, "found", F.concat(lines, tail).alias("listing"), (F.col("__x") == 1).alias("unique"))


def interior_point(areas: DataFrame) -> DataFrame:
    """areas (parts of outline and holes) with `at` (lat, lon): the first point inside of a lattice of 9 x 9 over the largest part's box,
    from its middle outward; null if none is inside."""
    lats, lons = (lambda p, c=c: F.transform(p["outline"], lambda v: v[c]) for c in ("lat", "lon"))
    boxed = F.transform("parts", lambda p: F.struct(((F.array_max(lons(p)) - F.array_min(lons(p))) * (F.array_max(lats(p)) - F.array_min(lats(p)))).alias("size"), F.array_min(lons(p)).alias("w"), F.array_min(lats(p)).alias("s"), F.array_max(lons(p)).alias("e"), F.array_max(lats(p)).alias("n")))
    largest = F.array_max(F.transform(boxed, lambda b, i: F.struct(b["size"].alias("size"), (-i).alias("first"), b.alias("b"))))["b"]
    steps = [0.5 + (1 if i % 2 else -1) * ((i + 1) // 2) / 8 for i in range(9)]
    lattice = F.array(*(F.struct(F.lit(fy).alias("y"), F.lit(fx).alias("x")) for fy in steps for fx in steps))
    made = areas.withColumn("__b", largest)
    points = F.transform(lattice, lambda f: F.struct((F.col("__b.s") + f["y"] * (F.col("__b.n") - F.col("__b.s"))).alias("lat"), (F.col("__b.w") + f["x"] * (F.col("__b.e") - F.col("__b.w"))).alias("lon")))
    inside = lambda at: F.exists("parts", lambda p: geo.in_polygon(p["outline"], p["holes"], at["lat"], at["lon"]))
    return made.withColumn("at", F.get(F.filter(points, inside), 0)).drop("__b")


def main_extent(parts: DataFrame, by: str) -> DataFrame:
    """parts (area, part, w, s, e, n): the box about each area's largest part and those within PART_KM of it, directly or through
    others, and how many these are.  Which parts belong is a fold over one area's parts, which a file bounds."""
    import numpy as np
    import pandas as pd

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        w, s, e, n = (pdf[c].to_numpy(float) for c in "wsen")
        taken = np.zeros(len(pdf), bool)
        front = [int(np.argmax((e - w) * (n - s)))]
        taken[front] = True
        while front:  # each part looks once at those that are not taken yet
            k = front.pop()
            dx, dy = np.maximum(0, np.maximum(w - e[k], w[k] - e)), np.maximum(0, np.maximum(s - n[k], s[k] - n))
            a, b = np.maximum(s, s[k]), np.minimum(n, n[k])
            lo, hi = np.minimum(a, b), np.maximum(a, b)
            lat = np.where(lo > 0, lo, np.where(hi < 0, hi, 0.0))
            gap = np.hypot(dx * geo.KM_DEGREE * np.cos(np.radians(lat)), dy * geo.KM_DEGREE)
            new = np.flatnonzero((gap <= PART_KM) & ~taken)
            taken[new] = True
            front.extend(new.tolist())
        return pd.DataFrame({by: [pdf[by].iloc[0]], "w": [w[taken].min()], "s": [s[taken].min()], "e": [e[taken].max()], "n": [n[taken].max()], "shown": [int(taken.sum())], "parts": [len(pdf)]})

    kind = parts.schema[by].dataType.simpleString()
    return parts.groupBy(by).applyInPandas(one, f"{by} {kind}, w double, s double, e double, n double, shown int, parts int")
