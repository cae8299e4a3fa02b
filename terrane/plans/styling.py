"""Queries about style rules, labels and drawing order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import style
from . import derive as D
from .registry import query, r


@query("""WITH v AS (SELECT p_partkey, (p_partkey % 33)::INT AS z, (p_size % 9 - 4)::INT AS bias, (p_partkey % 12)::INT AS z0, (p_partkey % 12 + p_size % 10)::INT AS z1, CASE WHEN p_partkey % 5 > 0 THEN p_size % 20 END AS mz, ['point', 'line', 'area'][p_partkey % 3 + 1] AS placement, p_size % 4 AS g FROM part),
e AS (SELECT *, CASE WHEN z + bias BETWEEN 0 AND 31 THEN z + bias END AS e FROM v)
SELECT p_partkey, e AS effective, coalesce(e BETWEEN z0 AND z1, false) AS applies, coalesce(e BETWEEN z0 AND z1, false) AND coalesce(e >= mz, true) AS allowed, (placement = 'point' AND g = 1) OR (placement = 'line' AND g = 2) AS shaped FROM e""")
def label_zooms(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    v = D.read(spark, d, "part").select("p_partkey", (k % 33).cast("int").alias("z"), (s % 9 - 4).cast("int").alias("bias"), (k % 12).cast("int").alias("z0"), (k % 12 + s % 10).cast("int").alias("z1"), F.when(k % 5 > 0, s % 20).alias("mz"), F.get(F.array(*map(F.lit, ("point", "line", "area"))), (k % 3).cast("int")).alias("placement"), (s % 4).alias("g"))
    z, bias, z0, z1, mz = (F.col(c) for c in ("z", "bias", "z0", "z1", "mz"))
    return v.select("p_partkey", style.effective_zoom(z, bias).alias("effective"), style.applies_at(z, bias, z0, z1).alias("applies"), style.allows(z, bias, z0, z1, mz).alias("allowed"), style.labels_shape(F.col("placement"), F.col("g")).alias("shaped"))


@query("SELECT p_brand, bit_or(1::BIGINT << (p_size % 16)::INT) AS mask, bit_or(1::BIGINT << (p_size % 16)::INT) & 8 <> 0 AS third FROM part GROUP BY 1")
def role_sets(spark, d):
    g = D.read(spark, d, "part").groupBy("p_brand").agg(style.roles(F.col("p_size") % 16).alias("mask"))
    return g.select("p_brand", "mask", style.has_role(F.col("mask"), F.lit(3)).alias("third"))


_STOPS = "[{'zoom': 5e0, 'width': 1e0}, {'zoom': 10e0, 'width': 2e0 + p_size % 5}, {'zoom': 14e0 + p_size % 3, 'width': 16e0}]"


def _stops(size):
    pairs = [(F.lit(5.0), F.lit(1.0)), (F.lit(10.0), 2.0 + size % 5), (14.0 + size % 3, F.lit(16.0))]
    return F.array(*(F.struct(z.alias("zoom"), w.alias("width")) for z, w in pairs))


@query(f"""WITH v AS (SELECT p_partkey, (p_partkey % 200) / 1e1 AS z, (p_size % 7) / 2e0 AS width, {_STOPS} AS st FROM part), i AS (SELECT *, len(list_filter(st, lambda x : x.zoom < z)) AS i FROM v)
SELECT p_partkey, round(CASE WHEN p_partkey % 4 = 0 THEN width * 1.5 WHEN i = 0 THEN st[1].width WHEN i = 3 OR z >= st[3].zoom THEN st[3].width ELSE st[i].width * (st[i + 1].width / st[i].width) ** ((z - st[i].zoom) / (st[i + 1].zoom - st[i].zoom)) END, 6) AS width FROM i""")
def stroke_widths(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    stops = F.when(k % 4 > 0, _stops(s))
    return D.read(spark, d, "part").select("p_partkey", r(style.stroke_width(s % 7 / F.lit(2.0), stops, F.lit(1.5), k % 200 / F.lit(10.0)), 6).alias("width"))


@query("""WITH v AS (SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN '' ELSE p_brand END AS layer, p_partkey % 9 AS z0, p_size % 36 AS z1, p_partkey % 2 = 0 AS fill, p_size % 3 AS width, p_partkey % 5 AS k FROM part)
SELECT p_partkey, CASE WHEN layer = '' THEN 'no layer' WHEN z1 < z0 THEN 'no zoom' WHEN z1 > 31 THEN 'too deep' WHEN NOT fill AND width = 0 AND k = 0 THEN 'draws nothing' WHEN k = 1 THEN 'width of nothing' WHEN k = 2 THEN 'widths out of order' END AS fault FROM v""")
def rule_faults(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    stop = lambda z, w: F.struct(F.lit(z).alias("zoom"), F.lit(w).alias("width"))
    none = F.array().cast("array<struct<zoom:double,width:double>>")
    stops = F.when(k % 5 == 0, none).when(k % 5 == 1, F.array(stop(1.0, 2.0), stop(2.0, 0.0))).when(k % 5 == 2, F.array(stop(3.0, 2.0), stop(3.0, 4.0))).when(k % 5 == 3, F.array(stop(4.0, 1.0))).otherwise(F.array(stop(1.0, 1.0), stop(2.0, 2.0), stop(3.0, 3.0)))
    rules = D.read(spark, d, "part").select("p_partkey", F.when(k % 11 == 0, "").otherwise(F.col("p_brand")).alias("layer"), (k % 9).alias("min_zoom"), (s % 36).alias("max_zoom"), (k % 2 == 0).alias("fill"), (s % 3).cast("double").alias("width"), stops.alias("stops"))
    return rules.select("p_partkey", style.fault().alias("fault"))


_LABELS = """lb AS (SELECT p_partkey AS ord, ['places', 'roads', 'water'][p_partkey % 3 + 1] AS layer, p_partkey % 4 = 0 AS minor, p_partkey % 5 = 0 AS political, (p_size % 3)::INT AS bias,
 CASE p_size % 3 WHEN 0 THEN ['country', 'region'] WHEN 1 THEN ['region'] ELSE ['country'] END AS kinds, 1e0 AS scale, (p_size % 10)::INT AS priority FROM part)"""


def _labels(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    words = lambda *w: F.array(*map(F.lit, w))
    kinds = F.when(s % 3 == 0, words("country", "region")).when(s % 3 == 1, words("region")).otherwise(words("country"))
    return D.read(spark, d, "part").select(k.alias("ord"), F.get(words("places", "roads", "water"), (k % 3).cast("int")).alias("layer"), (k % 4 == 0).alias("minor"), (k % 5 == 0).alias("political"), (s % 3).cast("int").alias("bias"), kinds.alias("kinds"), F.lit(1.0).alias("scale"), (s % 10).cast("int").alias("priority"))


@query(f"""WITH {_LABELS} SELECT ord, bias + CASE WHEN minor THEN -2 ELSE 0 END AS lines, bias + CASE WHEN NOT minor AND NOT political AND layer = 'places' THEN 3 ELSE 0 END AS places, NOT minor AS stays FROM lb""")
def shifted_labels(spark, d):
    """The rewrites of label rules: line names later, place names sooner, no line names."""
    v = _labels(spark, d)
    lines = style.label_choice(v, "extra-sparse").select("ord", F.col("bias").alias("lines"))
    moved = style.shift_place_labels(v, 3).select("ord", F.col("bias").alias("places"))
    stays = style.label_choice(v, "places").select("ord", F.lit(True).alias("s"))
    return lines.join(moved, "ord").join(stays, "ord", "left").select("ord", "lines", "places", F.coalesce("s", F.lit(False)).alias("stays"))


@query(f"""WITH {_LABELS}, s AS (SELECT *, political AND list_contains(kinds, 'country') AS parted FROM lb)
SELECT ord, 0 AS sub, CASE WHEN parted THEN 'country' ELSE array_to_string(kinds, ',') END AS kinds, CASE WHEN parted THEN 2e0 ELSE scale END AS scale, CASE WHEN parted THEN priority + 5 ELSE priority END AS priority FROM s
UNION ALL SELECT ord, 1, array_to_string(list_filter(kinds, lambda x : x <> 'country'), ','), 1.25e0, priority FROM s WHERE parted""")
def emphasised_labels(spark, d):
    return style.emphasise_labels(_labels(spark, d)).select("ord", "sub", F.array_join("kinds", ",").alias("kinds"), "scale", "priority")


@query("""WITH v AS (SELECT p_partkey AS ord, CASE WHEN p_partkey % 3 = 0 THEN 'boundaries' ELSE 'roads' END AS layer, CASE WHEN p_size % 2 = 0 THEN 'country' ELSE 'x' END AS kind FROM part), c AS (SELECT *, layer = 'boundaries' AND kind = 'country' AS b FROM v)
SELECT ord, 0 AS sub, kind AS kinds, 'ink' AS role, 7e0 AS width, 0 AS dashes FROM c WHERE NOT b UNION ALL SELECT ord, i, k, r, w, n FROM c, (VALUES (0, 'region', 'boundary_strong', 1.3e0, 2), (1, 'country', 'land', 4.6e0, 0), (2, 'country', 'boundary_strong', 2.2e0, 0)) AS t(i, k, r, w, n) WHERE b""")
def emphasised_rules(spark, d):
    k = F.col("p_partkey")
    stops = F.array(F.struct(F.lit(1.0).alias("zoom"), F.lit(7.0).alias("width")))
    rules = D.read(spark, d, "part").select(k.alias("ord"), F.when(k % 3 == 0, "boundaries").otherwise("roads").alias("layer"), F.array(F.when(F.col("p_size") % 2 == 0, "country").otherwise("x")).alias("kinds"), F.lit(False).alias("major"), F.lit("ink").alias("role"), stops.alias("stops"), F.array().cast("array<double>").alias("dash"))
    return style.emphasise_rules(rules).select("ord", "sub", F.array_join("kinds", ",").alias("kinds"), "role", r(F.get("stops", 0)["width"], 6).alias("width"), F.size("dash").alias("dashes"))


_NAMES = [("Brand#1", 1, ["ECONOMY"], [], "point", 0, 0, 9), ("Brand#2", 2, [], ["ring"], "line", 2, 5, 15), ("Brand#4", 3, ["SMALL", "ECONOMY"], ["bolt", "ring"], "point", -3, 0, 15), ("Brand#17", 4, [], [], "line", 1, 8, 12), ("Brand#17", 5, [], [], "point", 0, 0, 20)]


@query("""WITH f AS (SELECT p_partkey, p_brand AS layer, p_type AS kind, split_part(p_name, ' ', 2) AS kind_detail, p_size % 3 AS g, CASE WHEN p_partkey % 4 > 0 THEN p_size % 12 END AS mz, p_partkey % 16 AS z, CASE WHEN p_partkey % 9 > 0 THEN p_name END AS name FROM part),
r AS (SELECT * FROM (VALUES ('Brand#1', 1, ['ECONOMY'], []::VARCHAR[], 1, 0, 0, 9), ('Brand#2', 2, []::VARCHAR[], ['ring'], 2, 2, 5, 15), ('Brand#4', 3, ['SMALL', 'ECONOMY'], ['bolt', 'ring'], 1, -3, 0, 15), ('Brand#17', 4, []::VARCHAR[], []::VARCHAR[], 2, 1, 8, 12), ('Brand#17', 5, []::VARCHAR[], []::VARCHAR[], 1, 0, 0, 20)) AS t(layer, ord, kinds, details, place, bias, z0, z1))
SELECT p_partkey, ord FROM f JOIN r USING (layer) WHERE (len(kinds) = 0 OR list_contains(kinds, kind)) AND (len(details) = 0 OR list_contains(details, kind_detail)) AND g = place AND z + bias BETWEEN 0 AND 31 AND z + bias BETWEEN z0 AND z1 AND z + bias >= coalesce(mz, 0) AND name IS NOT NULL""")
def label_candidates(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    f = D.read(spark, d, "part").select("p_partkey", F.col("p_brand").alias("layer"), F.col("p_type").alias("kind"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("kind_detail"), (s % 3).alias("geom_type"), F.when(k % 4 > 0, s % 12).alias("min_zoom"), (k % 16).cast("int").alias("z"), F.when(k % 9 > 0, F.col("p_name")).alias("name"))
    rules = spark.createDataFrame(_NAMES, "layer string, ord int, kinds array<string>, details array<string>, placement string, bias int, z0 int, z1 int")
    return style.label_candidates(f, rules, F.col("f.z")).select("p_partkey", "ord")


@query("""WITH g AS (SELECT l_suppkey AS view_id, l_partkey % 40 AS fid, l_linenumber % 3 AS ord, arg_min(CASE WHEN l_partkey % 4 > 0 THEN (l_partkey % 5)::DOUBLE ELSE 0 END, l_orderkey * 10 + l_linenumber) AS rank, sum(l_quantity)::DOUBLE AS area, min(l_orderkey * 10 + l_linenumber) AS pos, count(*) AS tiles FROM lineitem GROUP BY 1, 2, 3)
SELECT view_id, fid, ord, tiles, area, row_number() OVER (PARTITION BY view_id ORDER BY rank, area DESC, ord, pos) AS place FROM g""")
def draw_order(spark, d):
    k = F.col("l_partkey")
    t = D.read(spark, d, "lineitem").select(F.col("l_suppkey").alias("view_id"), (k % 40).alias("fid"), (F.col("l_linenumber") % 3).alias("ord"), F.when(k % 4 > 0, (k % 5).cast("double")).otherwise(0.0).alias("sort_rank"), F.col("l_quantity").cast("double").alias("area"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    return style.draw_order(t).select("view_id", "fid", "ord", "tiles", "area", F.col("place").cast("long").alias("place"))
