"""What tiles and archives hold: counts, tag samples, directory summaries, style rules over features, GeoJSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import mercator as M

#: Into how many shares tag_samples deals a key's values.
SALTS = 64


def layer_counts(features: DataFrame) -> DataFrame:
    """Features (layer, geom_type 1 point, 2 line, 3 polygon, vertices) by layer, and a total (layer null): one rollup."""
    kind = lambda t: F.count_if(F.col("geom_type") == t)
    return features.rollup("layer").agg(F.count("*").alias("features"), kind(1).alias("points"), kind(2).alias("lines"), kind(3).alias("polygons"), F.count_if(~F.col("geom_type").isin(1, 2, 3)).alias("unknown"), F.sum("vertices").alias("vertices"))


def tag_samples(tags: DataFrame, by: str, first: int = 6) -> DataFrame:
    """tags (layer, key, kind, value, pos): for each key its kind or 'mixed', features, distinct values, and the first
    distinct values in feature order.  The firsts are found in two steps, the first ones of each of SALTS shares of a key's values and
    of these the first ones, so that a key of very many values is no one task's work."""
    firsts = tags.groupBy(by, "key", "value").agg(F.min("pos").alias("pos"), F.count("*").alias("n"), F.min("kind").alias("a"), F.max("kind").alias("z"))
    counts = firsts.groupBy(by, "key").agg(F.when(F.min("a") == F.max("z"), F.min("a")).otherwise("mixed").alias("kind"), F.sum("n").alias("features"), F.count("*").alias("distinct_values"))
    share = firsts.withColumn("salt", F.pmod(F.xxhash64("value"), F.lit(SALTS)))
    least = lambda df, *keys: df.withColumn("i", F.row_number().over(W.partitionBy(*keys).orderBy("pos", "value"))).where(F.col("i") <= first)
    some = least(least(share, by, "key", "salt"), by, "key").where("value is not null")
    lists = some.groupBy(by, "key").agg(F.array_sort(F.collect_list(F.struct("i", "value"))).alias("s"))
    sample = F.array_join(F.transform("s", lambda s: s["value"]), ",")
    same = counts[by].eqNullSafe(lists[by]) & counts["key"].eqNullSafe(lists["key"])
    return counts.join(lists, same, "left").select(counts[by], counts["key"], "kind", "features", "distinct_values", F.coalesce(sample, F.lit("")).alias("sample"))


def directory_summary(directory: DataFrame) -> DataFrame:
    return directory.agg(F.count_if(F.col("run_length") == 0).alias("leaves"), F.count_if(F.col("run_length") > 0).alias("runs"), F.coalesce(F.sum("run_length"), F.lit(0)).alias("tiles"))


def matching(features: DataFrame, rules: DataFrame, zoom: Column) -> DataFrame:
    """Features (layer, kind, kind_detail) by the rules (layer, ord, kinds, details, min_zoom, max_zoom) that draw them at a
    zoom, in the rules' order; an empty list of kinds or details takes all.  An equi-join on layer."""
    f, r = features.alias("f"), rules.alias("r")
    takes = lambda many, one: (F.size(F.col(f"r.{many}")) == 0) | F.coalesce(F.array_contains(F.col(f"r.{many}"), F.col(f"f.{one}")), F.lit(False))
    on = (F.col("f.layer") == F.col("r.layer")) & takes("kinds", "kind") & takes("details", "kind_detail") & zoom.between(F.col("r.min_zoom"), F.col("r.max_zoom"))
    return f.join(r, on).select("f.*", "r.ord")


def label_rank(min_zoom: Column, population_rank: Column) -> Column:
    return (32 - F.coalesce(min_zoom, F.lit(0)).cast("int")) * 100 + F.coalesce(population_rank, F.lit(0)).cast("int")


def top_labels(candidates: DataFrame, by: str, k: int) -> DataFrame:
    """The first k candidates of each view: priority and rank down, then order and key up."""
    order = [F.col("priority").desc(), F.col("rank").desc(), F.col("nth"), F.col("key")]
    return candidates.withColumn("place", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("place") <= k)


def place_labels(candidates: DataFrame, by: str = "view_id") -> DataFrame:
    """Candidates (view_id, key, priority, rank, nth, x0, y0, x1, y1) that are drawn: greedily in order of priority, none over
    another.  The outcome depends on order, so a view is a group; it holds one picture's labels."""
    import pandas as pd

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["priority", "rank", "nth", "key"], ascending=[False, False, True, True])
        taken: list[tuple] = []
        keep = []
        for r in pdf.itertuples():
            free = all(r.x1 <= a or r.x0 >= c or r.y1 <= b or r.y0 >= d for a, b, c, d in taken)
            keep.append(free)
            if free:
                taken.append((r.x0, r.y0, r.x1, r.y1))
        return pdf[keep][[by, "key"]]

    kind = candidates.schema
    return candidates.groupBy(by).applyInPandas(one, f"{by} {kind[by].dataType.simpleString()}, key {kind['key'].dataType.simpleString()}")


def ring_json(ring: Column) -> Column:
    """A ring of struct<lon, lat> reversed and closed, as GeoJSON winds it."""
    back = F.reverse(ring)
    closed = F.concat(back, F.slice(back, 1, 1))
    return F.concat(F.lit("["), F.array_join(F.transform(closed, lambda p: F.concat(F.lit("["), p["lon"].cast("string"), F.lit(","), p["lat"].cast("string"), F.lit("]"))), ","), F.lit("]"))


def properties_json(layer: Column, fid: Column, tags: Column) -> Column:
    """@layer, @id where there is one, then the tags by key."""
    entries = F.array_sort(F.map_entries(tags))
    quoted = lambda s: F.to_json(F.array(s)).substr(F.lit(2), F.length(F.to_json(F.array(s))) - 2)
    body = F.transform(entries, lambda e: F.concat(quoted(e["key"]), F.lit(":"), quoted(e["value"])))
    head = F.array_compact(F.array(F.concat(F.lit('"@layer":'), quoted(layer)), F.concat(F.lit('"@id":'), fid.cast("string"))))
    return F.concat(F.lit("{"), F.array_join(F.concat(head, body), ","), F.lit("}"))


#: The least distance between two copies of a name along a line: pixels, or so many of the name's own widths (fixed values).
REPEAT_PIXELS, REPEAT_WIDTHS = 600.0, 4.0


def too_near(others: Column, x: Column, y: Column, along: Column, width: Column) -> Column:
    """Whether a name that is to stand once may not go to (x, y): anywhere if it is a point's, near a copy if it runs along a line.
    others: array of struct<x, y> where it stands already."""
    reach = F.greatest(F.lit(REPEAT_PIXELS), width * REPEAT_WIDTHS)
    near = F.exists(others, lambda o: F.hypot(o["x"] - x, o["y"] - y) < reach)
    return F.when(F.coalesce(F.size(others), F.lit(0)) <= 0, F.lit(False)).otherwise(~along | near)


def own_names(names: DataFrame) -> DataFrame:
    """Names (z, x, y, lat, lon, ...) drawn with a tile whose centre lies on that tile's own ground: its neighbour names the others."""
    n = M.side(F.col("z"))
    return names.where((F.floor(M.world_x(F.col("lon")) * n) == F.col("x")) & (F.floor(M.world_y(F.col("lat")) * n) == F.col("y")))
