"""Queries over the driver's tables, each beside the SQL that means the same.  Results are rounded alike in both."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import colour, geo, text, tileid
from ..functions import mercator as M
from ..functions import view as V
from ..operators import draw, inspect, lines, names, ordered, osm, planning, spatial
from . import derive as D
from . import sql as S
from .registry import ORACLE, QUERIES, query, r

# --- projection and tiles ---------------------------------------------------------------------------------------------


@query(f"WITH {D.POINTS} SELECT point_id, round({S.wx('lon')}, 9) AS x, round({S.wy('lat')}, 9) AS y FROM pts")
def mercator_project(spark, d):
    return D.points(spark, d).select("point_id", r(M.world_x(F.col("lon"))).alias("x"), r(M.world_y(F.col("lat"))).alias("y"))


@query(f"SELECT c_custkey AS point_id, round((c_custkey * 7919 % 100000) / 1e5 * 360 - 180, 9) AS lon, round({S.latitude('(c_custkey * 104729 % 100000) / 1e5')}, 9) AS lat FROM customer")
def mercator_unproject(spark, d):
    k = F.col("c_custkey")
    return D.read(spark, d, "customer").select(k.alias("point_id"), r(M.longitude(k * 7919 % 100000 / F.lit(1e5))).alias("lon"), r(M.latitude(k * 104729 % 100000 / F.lit(1e5))).alias("lat"))


@query(f"WITH {D.POINTS} SELECT point_id, z, {S.cell(S.wx('lon'), 'z')} AS x, {S.cell(S.wy('lat'), 'z')} AS y FROM pts, (VALUES (0), (4), (10), (15)) AS t(z)")
def tile_at_zoom(spark, d):
    p = D.points(spark, d).withColumn("z", F.explode(F.array(*map(F.lit, (0, 4, 10, 15)))))
    x, y = M.tile_at(F.col("z"), F.col("lon"), F.col("lat"))
    return p.select("point_id", "z", x.alias("x"), y.alias("y"))


@query(f"""WITH {D.POINTS}, t AS (SELECT point_id, {S.cell(S.wx('lon'), 8)} AS x, {S.cell(S.wy('lat'), 8)} AS y FROM pts)
SELECT point_id, round(x / 256e0 * 360 - 180, 9) AS w, round({S.latitude('(y + 1) / 256e0')}, 9) AS s, round((x + 1) / 256e0 * 360 - 180, 9) AS e, round({S.latitude('y / 256e0')}, 9) AS n FROM t""")
def tile_bounds(spark, d):
    x, y = M.tile_at(8, F.col("lon"), F.col("lat"))
    return D.points(spark, d).select("point_id", *(r(c).alias(k) for k, c in zip("wsen", M.tile_bounds(8, x, y), strict=True)))


_HILBERT = f"""WITH RECURSIVE {D.POINTS}, t AS (SELECT point_id, {S.cell(S.wx('lon'), 12)} AS tx, {S.cell(S.wy('lat'), 12)} AS ty FROM pts),
h(point_id, k, d, x, y) AS (SELECT point_id, 11, 0::BIGINT, tx, ty FROM t UNION ALL
SELECT point_id, k - 1, d + (1::BIGINT << (2 * k)) * xor(3 * rx, ry), CASE WHEN ry = 0 THEN fy ELSE fx END, CASE WHEN ry = 0 THEN fx ELSE fy END FROM
(SELECT *, CASE WHEN ry = 0 AND rx = 1 THEN s - 1 - (x & (s - 1)) ELSE x & (s - 1) END AS fx, CASE WHEN ry = 0 AND rx = 1 THEN s - 1 - (y & (s - 1)) ELSE y & (s - 1) END AS fy FROM
(SELECT *, 1::BIGINT << k AS s, ((x >> k) & 1)::BIGINT AS rx, ((y >> k) & 1)::BIGINT AS ry FROM h WHERE k >= 0)))
SELECT point_id, tx, ty, d + (4 ** 12 - 1)::BIGINT // 3 AS tile_id FROM h JOIN t USING (point_id) WHERE k = -1"""


@query(_HILBERT)
def tile_hilbert_id(spark, d):
    x, y = M.tile_at(12, F.col("lon"), F.col("lat"))
    t = D.points(spark, d).select("point_id", x.alias("tx"), y.alias("ty"))
    return t.withColumn("tile_id", tileid.tile_id(F.lit(12), F.col("tx"), F.col("ty")))


@query("""WITH RECURSIVE t AS (SELECT s_suppkey AS k, s_suppkey * 97 + 5 AS id FROM supplier), z AS (SELECT t.*, (SELECT max(g) FROM range(0, 32) q(g) WHERE (4::HUGEINT ** g - 1) / 3 <= id)::BIGINT AS z FROM t),
h(k, id, z, i, t, x, y) AS (SELECT k, id, z, 0, id - ((1::BIGINT << (2 * z)) - 1) // 3, 0::BIGINT, 0::BIGINT FROM z UNION ALL
SELECT k, id, z, i + 1, t >> 2, CASE WHEN ry = 0 THEN fy ELSE fx END + s * rx, CASE WHEN ry = 0 THEN fx ELSE fy END + s * ry FROM
(SELECT *, CASE WHEN ry = 0 AND rx = 1 THEN s - 1 - x ELSE x END AS fx, CASE WHEN ry = 0 AND rx = 1 THEN s - 1 - y ELSE y END AS fy FROM
(SELECT *, 1::BIGINT << i AS s, (t & 3) >> 1 AS rx, xor(t & 3, (t & 3) >> 1) & 1 AS ry FROM h WHERE i < z)))
SELECT k AS supplier, id AS tile_id, z::INT AS z, x, y FROM h WHERE i = z""")
def tile_from_id(spark, d):
    t = D.read(spark, d, "supplier").select(F.col("s_suppkey").alias("supplier"), (F.col("s_suppkey") * 97 + 5).alias("tile_id"))
    return t.withColumn("t", tileid.tile_of(F.col("tile_id"))).select("supplier", "tile_id", "t.z", "t.x", "t.y")


@query(f"WITH {D.POINTS}, t AS (SELECT point_id, {S.cell(S.wx('lon'), 10)} AS x, {S.cell(S.wy('lat'), 10)} AS y FROM pts) SELECT point_id, z, x >> (10 - z) AS tx, y >> (10 - z) AS ty FROM t, range(0, 10) q(z)")
def tile_ancestors(spark, d):
    x, y = M.tile_at(10, F.col("lon"), F.col("lat"))
    return planning.ancestors(D.points(spark, d).select("point_id", x.alias("x"), y.alias("y")), 10).select("point_id", F.col("z").cast("long").alias("z"), "tx", "ty")


@query(f"WITH {D.SUPPLIERS}, t AS (SELECT feature_id, {S.cell(S.wx('lon'), 6)} AS x, {S.cell(S.wy('lat'), 6)} AS y FROM sup) SELECT feature_id, z, x * (1 << (z - 6)) + i AS tx, y * (1 << (z - 6)) + j AS ty FROM t, range(6, 9) q(z), range(0, 1 << (z - 6)) a(i), range(0, 1 << (z - 6)) b(j)")
def pyramid_tiles(spark, d):
    x, y = M.tile_at(6, F.col("lon"), F.col("lat"))
    c = D.points(spark, d, "supplier", "s_suppkey").select(F.col("point_id").alias("feature_id"), x.alias("x"), y.alias("y"))
    return planning.pyramid(c, 6, 8).select("feature_id", F.col("z").cast("long").alias("z"), "tx", "ty")


@query(f"WITH {D.BOXES} {S.tiles(4)}")
def cells_for_bounds(spark, d):
    return planning.tiles_over(D.boxes(spark, d), 4).select("file_pos", "x", "y")


@query("SELECT l_orderkey, l_partkey - 10000 AS value, xor((l_partkey - 10000) << 1, (l_partkey - 10000) >> 63) AS zigzag FROM (SELECT l_orderkey, l_partkey FROM lineitem)".replace("(l_partkey - 10000) << 1", "(l_partkey - 10000) * 2"))
def zigzag_codes(spark, d):
    v = F.col("l_partkey") - 10000
    z = tileid.zigzag(v)
    return D.read(spark, d, "lineitem").select("l_orderkey", tileid.unzigzag(z).alias("value"), z.alias("zigzag"))


# --- rectangles, distances --------------------------------------------------------------------------------------------

_AROUND = f"""{D.POINTS}, a AS (SELECT point_id, lat, lon, (1 + point_id % 300) / 1e0 AS km FROM pts),
b AS (SELECT point_id, greatest(-180, least(180, lon - km / (111.32 * cos(radians(lat))))) AS w, greatest(-85, least(85, lat - km / 111.32)) AS s, greatest(-180, least(180, lon + km / (111.32 * cos(radians(lat))))) AS e, greatest(-85, least(85, lat + km / 111.32)) AS n FROM a),
k AS (SELECT *, (e - w) * 111.32 * cos(radians(CASE WHEN s <= 0 AND n >= 0 THEN 0 ELSE least(abs(s), abs(n)) END)) AS width, (n - s) * 111.32 AS height FROM b)"""


@query(f"WITH {_AROUND} SELECT point_id, round(width, 4) AS width, round(height, 4) AS height, least(15, CASE WHEN greatest(width, height) <= 25 THEN 15 WHEN greatest(width, height) <= 80 THEN 14 WHEN greatest(width, height) <= 250 THEN 13 ELSE 5 END)::INT AS depth FROM k")
def depth_bands(spark, d):
    km = (1 + F.col("point_id") % 300) / F.lit(1.0)
    box = geo.bounds_around(F.col("lat"), F.col("lon"), km)
    b = D.points(spark, d).select("point_id", *(c.alias(k) for k, c in zip("wsen", box, strict=True)))
    width, height = geo.extent_km(*(F.col(c) for c in "wsen"))
    return b.select("point_id", r(width, 4).alias("width"), r(height, 4).alias("height"), geo.depth_for(*(F.col(c) for c in "wsen"), 15).alias("depth"))


@query(f"""WITH {D.POINTS}, {D.SUPPLIERS}, p AS (SELECT point_id, feature_id, {S.haversine('pts.lat', 'pts.lon', 'sup.lat', 'sup.lon')} AS m FROM pts, sup), q AS (SELECT *, round(m, 1) AS distance_m FROM p WHERE m <= 400000)
SELECT point_id, feature_id, distance_m, nth FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY distance_m, m, feature_id) AS nth FROM q) WHERE nth <= 2""")
def haversine_nearest(spark, d):
    f = D.points(spark, d, "supplier", "s_suppkey").withColumnRenamed("point_id", "feature_id")
    return spatial.nearest(D.points(spark, d), f, "point_id", 400_000.0, 2, grid=5.0).select("point_id", "feature_id", "distance_m", F.col("nth").cast("long").alias("nth"))


@query(f"""WITH {D.POINTS}, {D.SUPPLIERS}, p AS (SELECT point_id, feature_id, feature_id % 4 AS rank, {S.haversine('pts.lat', 'pts.lon', 'sup.lat', 'sup.lon')} AS m FROM pts, sup), q AS (SELECT *, round(m, 1) AS distance_m FROM p WHERE m <= 600000)
SELECT point_id, feature_id, rank, distance_m FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY rank, distance_m, m, feature_id) AS nth FROM q) WHERE nth = 1""")
def ranked_nearest(spark, d):
    f = D.points(spark, d, "supplier", "s_suppkey").withColumnRenamed("point_id", "feature_id")
    return spatial.nearest(D.points(spark, d), f, "point_id", 600_000.0, 1, F.col("feature_id") % 4, grid=5.0).select("point_id", "feature_id", "rank", "distance_m")


def _distances(spark, d):
    w = D.ways(spark, d)
    return w.select("point_id", "way_id", "kind", "name", r(geo.to_line(F.col("line"), F.col("lat"), F.col("lon")), 3).alias("distance"))


@query(f"WITH {D.WAYS} SELECT point_id, way_id, distance FROM dist")
def way_distances(spark, d):
    return _distances(spark, d).select("point_id", "way_id", "distance")


@query(f"""WITH {D.WAYS}, s AS (SELECT * FROM dist WHERE kind NOT IN ('rail', 'aeroway')), g AS (SELECT point_id, min(distance) AS a, min(distance) FILTER (name IS NOT NULL) AS b FROM s GROUP BY 1)
SELECT g.point_id, min(name) AS name, b AS distance FROM g JOIN s ON s.point_id = g.point_id AND s.distance = b AND s.name IS NOT NULL WHERE b <= 20000 AND b <= a + 12 GROUP BY g.point_id, b""")
def on_way_rule(spark, d):
    return spatial.on_way(_distances(spark, d), "point_id", 20_000.0)


@query(f"""WITH {D.POINTS}, {D.BOXES}, g AS (SELECT point_id, name, greatest(0, w - lon, lon - e) AS dx, greatest(0, s - lat, lat - n) AS dy, greatest(lat, s) AS lo, least(lat, n) AS hi FROM pts, box)
SELECT point_id, name, round(sqrt((dx * 111.32 * cos(radians(CASE WHEN least(lo, hi) <= 0 AND greatest(lo, hi) >= 0 THEN 0 ELSE least(abs(lo), abs(hi)) END))) ** 2 + (dy * 111.32) ** 2), 3) AS km FROM g""")
def box_gaps(spark, d):
    b = D.boxes(spark, d)  # one row a nation: 25 by the table's definition
    p = D.points(spark, d).join(F.broadcast(b.select("name", "w", "s", "e", "n")))
    lat, lon = F.col("lat"), F.col("lon")
    return p.select("point_id", "name", r(geo.gap_km((lon, lat, lon, lat), tuple(F.col(c) for c in "wsen")), 3).alias("km"))


@query(f"""WITH {D.POINTS}, q AS (SELECT point_id, lat, lon, n_nationkey, (n_nationkey * 53 % 130) - 75.0::DOUBLE AS lat2, (n_nationkey * 37 % 300) - 180.0::DOUBLE AS lon2 FROM pts JOIN customer ON point_id = c_custkey JOIN nation ON c_nationkey = n_nationkey),
b AS (SELECT point_id, (degrees(atan2(sin(radians(lon2 - lon)) * cos(radians(lat2)), cos(radians(lat)) * sin(radians(lat2)) - sin(radians(lat)) * cos(radians(lat2)) * cos(radians(lon2 - lon)))) + 360) % 360 AS deg FROM q)
SELECT point_id, round(deg, 6) AS bearing, ['N','NE','E','SE','S','SW','W','NW'][round(deg / 45)::INT % 8 + 1] AS compass FROM b""")
def bearings(spark, d):
    n = D.boxes(spark, d).select("file_pos", F.col("w").alias("lon2"), F.col("s").alias("lat2"))
    c = D.read(spark, d, "customer").select(F.col("c_custkey").alias("point_id"), F.col("c_nationkey").cast("long").alias("file_pos"))
    b = geo.bearing(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    return D.points(spark, d).join(c, "point_id").join(n, "file_pos").select("point_id", r(b, 6).alias("bearing"), geo.compass(b).alias("compass"))


# --- containment ------------------------------------------------------------------------------------------------------


def _pairs(spark, d):
    return spatial.containing(D.points(spark, d), D.boxes(spark, d))


@query(f"WITH {D.POINTS}, {D.BOXES}, {D.HELD} SELECT point_id, arg_min(name, ((e - w) * (n - s)) * 1000 + file_pos) AS name FROM held GROUP BY 1")
def contains_smallest(spark, d):
    return spatial.smallest(_pairs(spark, d), "point_id", ["name"])


_STACK = f"{D.POINTS}, {D.BOXES}, {D.HELD}, st AS (SELECT point_id, name, row_number() OVER (PARTITION BY point_id ORDER BY (e - w) * (n - s) DESC, kind::INT, file_pos) AS depth, count(*) OVER (PARTITION BY point_id) AS height FROM held)"


@query(f"WITH {_STACK} SELECT point_id, name, depth, height FROM st")
def containment_stack(spark, d):
    return spatial.stack(_pairs(spark, d), "point_id").select("point_id", "name", F.col("depth").cast("long").alias("depth"), "height")


@query(f"""WITH {_STACK}, lv AS (SELECT *, CASE WHEN height = 1 THEN 'locality' WHEN height = 2 THEN CASE depth WHEN 2 THEN 'neighbourhood' ELSE 'locality' END
 ELSE CASE height - depth WHEN 0 THEN 'neighbourhood' WHEN 1 THEN 'macrohood' WHEN 2 THEN 'locality' END END AS level FROM st), sp AS (SELECT point_id, level FROM pts, (VALUES ('locality'), ('macrohood'), ('neighbourhood')) AS t(level))
SELECT point_id, level, lv.name AS name, CASE WHEN lv.name IS NOT NULL THEN 'Inside' WHEN point_id IN (SELECT point_id FROM st) THEN 'Outside' ELSE 'NoData' END AS containment FROM sp LEFT JOIN lv USING (point_id, level)""")
def containment_levels(spark, d):
    return spatial.levels(D.points(spark, d), D.boxes(spark, d), "point_id", ["locality", "macrohood", "neighbourhood"])


@query(f"""WITH {D.WAYS}, e AS (SELECT way_id, lat, lon, vlat AS alat, vlon AS alon, coalesce(lead(vlat) OVER q, first_value(vlat) OVER q) AS blat, coalesce(lead(vlon) OVER q, first_value(vlon) OVER q) AS blon, c FROM vx WINDOW q AS (PARTITION BY way_id ORDER BY i))
SELECT way_id, any_value(c) >= 3 AND count(*) FILTER ((alat > lat) <> (blat > lat) AND lon < alon + (lat - alat) / nullif(blat - alat, 0) * (blon - alon)) % 2 = 1 AS inside FROM e GROUP BY 1""")
def point_in_ring(spark, d):
    return D.ways(spark, d).select("way_id", geo.in_ring(F.col("line"), F.col("lat"), F.col("lon")).alias("inside"))


@query("""WITH v AS (SELECT l_orderkey, l_partkey AS x, l_suppkey AS y, row_number() OVER q AS i, count(*) OVER (PARTITION BY l_orderkey) AS c FROM lineitem WINDOW q AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)),
e AS (SELECT *, coalesce(lead(x) OVER q, first_value(x) OVER q) AS x2, coalesce(lead(y) OVER q, first_value(y) OVER q) AS y2 FROM v WINDOW q AS (PARTITION BY l_orderkey ORDER BY i))
SELECT l_orderkey AS ring_id, any_value(c) AS vertices, CASE WHEN any_value(c) >= 3 THEN sum(x * y2 - x2 * y) ELSE 0 END::DOUBLE AS twice_area, CASE WHEN any_value(c) >= 3 THEN sign(sum(x * y2 - x2 * y)) ELSE 0 END::INT AS winding, min(x) AS x0, max(y) AS y1 FROM e GROUP BY 1""")
def ring_measures(spark, d):
    v = F.struct("l_linenumber", F.col("l_partkey").alias("x"), F.col("l_suppkey").alias("y"))
    g = D.read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(v)).alias("v"))
    ring = F.col("v")
    return g.select(F.col("l_orderkey").alias("ring_id"), F.size(ring).cast("long").alias("vertices"), geo.shoelace(ring).alias("twice_area"), geo.winding(ring).alias("winding"), F.array_min(F.transform(ring, lambda p: p["x"])).alias("x0"), F.array_max(F.transform(ring, lambda p: p["y"])).alias("y1"))


# --- inspection -------------------------------------------------------------------------------------------------------


@query("SELECT p_brand AS layer, count(*) AS features, count(*) FILTER (p_size % 4 = 0) AS points, count(*) FILTER (p_size % 4 = 1) AS lines, count(*) FILTER (p_size % 4 = 2) AS polygons, count(*) FILTER (p_size % 4 = 3) AS unknown, sum(p_size)::BIGINT AS vertices FROM part GROUP BY ROLLUP (p_brand)")
def layer_counts(spark, d):
    return inspect.layer_counts(D.read(spark, d, "part").select(F.col("p_brand").alias("layer"), (F.col("p_size") % 4 + 1).alias("geom_type"), F.col("p_size").alias("vertices")))


@query("""WITH t AS (SELECT event_type AS layer, 'k' AS key, json_extract_string(props, '$.k') AS value, event_id AS pos FROM events), f AS (SELECT layer, key, value, min(pos) AS pos, count(*) AS n FROM t GROUP BY ALL),
g AS (SELECT *, row_number() OVER (PARTITION BY layer, key ORDER BY pos, value) AS i FROM f) SELECT layer, key, 'string' AS kind, sum(n)::BIGINT AS features, count(*) AS distinct_values, string_agg(value, ',' ORDER BY i) FILTER (i <= 6) AS sample FROM g GROUP BY 1, 2""")
def tag_samples(spark, d):
    t = D.read(spark, d, "events").select(F.col("event_type").alias("layer"), F.lit("k").alias("key"), F.lit("string").alias("kind"), F.get_json_object("props", "$.k").alias("value"), F.col("event_id").alias("pos"))
    return inspect.tag_samples(t, "layer")


_RULES = [("Brand#1", 1, ["ECONOMY"], [], 0, 9), ("Brand#2", 2, [], ["ring"], 5, 15), ("Brand#4", 3, ["SMALL", "ECONOMY"], ["bolt", "ring"], 0, 15), ("Brand#17", 4, [], [], 8, 12)]


@query("""WITH f AS (SELECT p_partkey, p_brand AS layer, p_type AS kind, split_part(p_name, ' ', 2) AS kind_detail, p_size % 16 AS z FROM part),
r AS (SELECT * FROM (VALUES ('Brand#1', 1, ['ECONOMY'], []::VARCHAR[], 0, 9), ('Brand#2', 2, []::VARCHAR[], ['ring'], 5, 15), ('Brand#4', 3, ['SMALL', 'ECONOMY'], ['bolt', 'ring'], 0, 15), ('Brand#17', 4, []::VARCHAR[], []::VARCHAR[], 8, 12)) AS t(layer, ord, kinds, details, z0, z1))
SELECT p_partkey, ord FROM f JOIN r USING (layer) WHERE (len(kinds) = 0 OR list_contains(kinds, kind)) AND (len(details) = 0 OR list_contains(details, kind_detail)) AND z BETWEEN z0 AND z1""")
def style_matching(spark, d):
    f = D.read(spark, d, "part").select("p_partkey", F.col("p_brand").alias("layer"), F.col("p_type").alias("kind"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("kind_detail"), (F.col("p_size") % 16).alias("z"))
    rules = spark.createDataFrame(_RULES, "layer string, ord int, kinds array<string>, details array<string>, min_zoom int, max_zoom int")
    return inspect.matching(f, rules, F.col("f.z")).select("p_partkey", "ord")


@query("SELECT view_id, key, rank, place FROM (SELECT p_brand AS view_id, p_partkey AS key, (32 - p_size % 16) * 100 + p_size % 18 AS rank, row_number() OVER (PARTITION BY p_brand ORDER BY p_size % 3 DESC, (32 - p_size % 16) * 100 + p_size % 18 DESC, p_size, p_partkey) AS place FROM part) WHERE place <= 3")
def label_priority(spark, d):
    s = F.col("p_size")
    c = D.read(spark, d, "part").select(F.col("p_brand").alias("view_id"), F.col("p_partkey").alias("key"), (s % 3).alias("priority"), inspect.label_rank(s % 16, s % 18).alias("rank"), s.alias("nth"))
    return inspect.top_labels(c, "view_id", 3).select("view_id", "key", "rank", F.col("place").cast("long").alias("place"))


@query(f"""WITH {D.POINTS}, {D.SUPPLIERS}, w AS (SELECT DISTINCT {S.cell(S.wx('lon'), 6)} AS x, {S.cell(S.wy('lat'), 6)} AS y FROM pts),
h AS (SELECT DISTINCT feature_id % 5 AS z, {S.cell(S.wx('lon'), '(feature_id % 5)')} AS x, {S.cell(S.wy('lat'), '(feature_id % 5)')} AS y FROM sup),
m AS (SELECT w.x, w.y, max(h.z) AS hz FROM w LEFT JOIN h ON h.x = w.x >> (6 - h.z)::INT AND h.y = w.y >> (6 - h.z)::INT GROUP BY 1, 2) SELECT x, y, hz::INT AS hz, x >> (6 - hz)::INT AS hx, y >> (6 - hz)::INT AS hy FROM m""")
def overzoom_fallback(spark, d):
    x, y = M.tile_at(6, F.col("lon"), F.col("lat"))
    wanted = D.points(spark, d).select(F.lit(6).alias("z"), x.alias("x"), y.alias("y")).distinct()
    s = D.points(spark, d, "supplier", "s_suppkey").withColumn("z", F.col("point_id") % 5)
    hx, hy = M.tile_at(F.col("z"), F.col("lon"), F.col("lat"))
    return spatial.walk_up(wanted, s.select("z", hx.alias("x"), hy.alias("y"))).select("x", "y", "hz", "hx", "hy")


# --- archives and planning --------------------------------------------------------------------------------------------


def _directory(spark, d):
    k = F.col("o_orderkey")
    return D.read(spark, d, "orders").select((k * 4).alias("tile_id"), (k * 1000).alias("offset"), (F.col("o_custkey") + 1).alias("length"), (k % 4).alias("run_length"))


_DIR = "dir AS (SELECT o_orderkey * 4 AS entry_id, o_orderkey * 1000 AS offset_, o_custkey + 1 AS length, o_orderkey % 4 AS run FROM orders)"


@query(f"WITH {_DIR}, w AS (SELECT p_partkey, p_partkey * 31 % 60000 AS tile_id FROM part), m AS (SELECT * FROM w ASOF LEFT JOIN dir ON w.tile_id >= dir.entry_id) SELECT p_partkey, tile_id, CASE WHEN tile_id < entry_id + run THEN entry_id END AS entry_id, CASE WHEN tile_id < entry_id + run THEN offset_ END AS \"offset\", CASE WHEN tile_id < entry_id + run THEN length END AS length FROM m")
def directory_lookup(spark, d):
    w = D.read(spark, d, "part").select("p_partkey", (F.col("p_partkey") * 31 % 60000).alias("tile_id"))
    return planning.lookup(w, _directory(spark, d)).select("p_partkey", "tile_id", "entry_id", "offset", "length")


@query("SELECT count(*) FILTER (o_orderkey % 4 = 0) AS leaves, count(*) FILTER (o_orderkey % 4 > 0) AS runs, sum(o_orderkey % 4)::BIGINT AS tiles FROM orders")
def directory_summary(spark, d):
    return inspect.directory_summary(_directory(spark, d))


_PLAN = f"""{_DIR}, w AS (SELECT l_suppkey AS grp, l_partkey * 31 % 60000 AS tile_id FROM lineitem), h AS (SELECT DISTINCT p_partkey * 5 AS tile_id FROM part),
m AS (SELECT * FROM w ASOF LEFT JOIN dir ON w.tile_id >= dir.entry_id), p AS (SELECT grp, tile_id, CASE WHEN tile_id IN (SELECT tile_id FROM h) THEN 'held' WHEN entry_id IS NULL OR tile_id >= entry_id + run THEN 'absent' ELSE 'located' END AS status, offset_, length FROM m)"""


def _plan(spark, d):
    w = D.read(spark, d, "lineitem").select(F.col("l_suppkey").alias("grp"), (F.col("l_partkey") * 31 % 60000).alias("tile_id"))
    h = D.read(spark, d, "part").select((F.col("p_partkey") * 5).alias("tile_id"))
    return planning.split_plan(w, h, _directory(spark, d))


@query(f"WITH {_PLAN} SELECT grp, status, count(*) AS tiles, coalesce(sum(CASE WHEN status = 'located' THEN length END), 0)::BIGINT AS bytes FROM p GROUP BY 1, 2")
def plan_split(spark, d):
    return _plan(spark, d).groupBy("grp", "status").agg(F.count("*").alias("tiles"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


_RANGES = """r AS (SELECT grp, o, o + n AS e, row_number() OVER (PARTITION BY grp ORDER BY o, n) AS i FROM (SELECT l_suppkey AS grp, l_partkey * 4096 + l_linenumber * 512 AS o, l_quantity::BIGINT * 40 AS n FROM lineitem)),
f(grp, i, id, o, e) AS (SELECT grp, i, 1, o, e FROM r WHERE i = 1 UNION ALL SELECT r.grp, r.i, CASE WHEN j THEN id ELSE id + 1 END, CASE WHEN j THEN f.o ELSE r.o END, CASE WHEN j THEN greatest(f.e, r.e) ELSE r.e END
 FROM (SELECT f.*, r.o < f.e OR (r.o - f.e <= 4096 AND greatest(f.e, r.e) - f.o <= 100000) AS j FROM f JOIN r ON r.grp = f.grp AND r.i = f.i + 1) f JOIN r ON r.grp = f.grp AND r.i = f.i + 1)"""


@query(f"WITH RECURSIVE {_RANGES} SELECT grp, min(o) AS \"offset\", max(e) - min(o) AS length FROM f GROUP BY grp, id")
def coalesce_ranges(spark, d):
    t = D.read(spark, d, "lineitem").select(F.col("l_suppkey").alias("grp"), (F.col("l_partkey") * 4096 + F.col("l_linenumber") * 512).alias("offset"), (F.col("l_quantity").cast("long") * 40).alias("length"))
    return ordered.coalesce_ranges(t, ["grp"], 4096, 100_000)


@query(f"""WITH RECURSIVE {_PLAN}, r AS (SELECT grp, offset_ AS o, offset_ + length AS e, row_number() OVER (PARTITION BY grp ORDER BY offset_, length) AS i FROM p WHERE status = 'located'),
f(grp, i, id, o, e) AS (SELECT grp, i, 1, o, e FROM r WHERE i = 1 UNION ALL SELECT grp, i + 1, CASE WHEN j THEN id ELSE id + 1 END, CASE WHEN j THEN o ELSE ro END, CASE WHEN j THEN greatest(e, re) ELSE re END
 FROM (SELECT f.*, r.o AS ro, r.e AS re, r.o < f.e OR (r.o - f.e <= 65536 AND greatest(f.e, r.e) - f.o <= 8388608) AS j FROM f JOIN r ON r.grp = f.grp AND r.i = f.i + 1)),
t AS (SELECT grp, sum(n)::BIGINT AS transfer, count(*) AS requests FROM (SELECT grp, id, max(e) - min(o) AS n FROM f GROUP BY 1, 2) GROUP BY 1),
u AS (SELECT grp, sum(length)::BIGINT AS useful FROM (SELECT DISTINCT grp, offset_, length FROM p WHERE status = 'located') GROUP BY 1),
c AS (SELECT grp, count(*) AS tiles, count(*) FILTER (status = 'held') AS held, count(*) FILTER (status = 'absent') AS absent, coalesce(sum(CASE WHEN status = 'located' THEN length END), 0)::BIGINT AS bytes FROM p GROUP BY 1)
SELECT c.*, coalesce(useful, 0) AS useful, coalesce(transfer, 0) AS transfer, coalesce(requests, 0) AS requests, greatest(0, coalesce(transfer, 0) - coalesce(useful, 0)) AS waste FROM c LEFT JOIN t USING (grp) LEFT JOIN u USING (grp)""")
def plan_totals(spark, d):
    return planning.totals(_plan(spark, d), ["grp"])


@query(f"""WITH {_AROUND}, {D.CELLS}, t AS ({S.tiles(6, 'k', 'point_id')}) SELECT point_id, count(*) AS cells, count(*) FILTER (complete) AS complete, count(*) FILTER (NOT complete) AS partial, count(*) FILTER (complete IS NULL) AS missing,
count(*) FILTER (complete) / count(*) AS fraction FROM t LEFT JOIN cells USING (x, y) GROUP BY 1""")
def coverage_fraction(spark, d):
    return planning.coverage(_areas(spark, d), D.cells(spark, d), "point_id", 6)


def _areas(spark, d):
    box = geo.bounds_around(F.col("lat"), F.col("lon"), (1 + F.col("point_id") % 300) / F.lit(1.0))
    return D.points(spark, d).select("point_id", *(c.alias(k) for k, c in zip("wsen", box, strict=True)))


@query(f"WITH {_AROUND}, {D.CELLS}, t AS ({S.tiles(8, 'k', 'point_id', 'tx', 'ty')}) SELECT point_id, count(*) FILTER (complete AND zoom_max >= 8) AS held, count(*) AS wanted FROM t LEFT JOIN cells ON x = tx >> 2 AND y = ty >> 2 GROUP BY 1")
def held_at_zoom(spark, d):
    return planning.held_at(_areas(spark, d), D.cells(spark, d), "point_id", 8, 6)


@query(f"WITH {_AROUND}, z AS (SELECT *, CASE WHEN greatest(width, height) <= 25 THEN 15 WHEN greatest(width, height) <= 80 THEN 14 WHEN greatest(width, height) <= 250 THEN 13 ELSE 5 END AS depth FROM k), t AS ({S.tiles(6, 'z', 'depth')}) SELECT x, y, max(depth)::INT AS depth FROM t GROUP BY 1, 2")
def plan_areas(spark, d):
    return planning.plan_areas(_areas(spark, d), 15, 6)


@query(f"WITH {D.CELLS}, t AS (SELECT sum(bytes) AS total FROM cells), o AS (SELECT *, sum(bytes) OVER (ORDER BY last_used, y, x) AS freed FROM cells WHERE x % 7 <> 0) SELECT x, y, bytes, freed::BIGINT AS freed FROM o, t WHERE freed - bytes < total // 3")
def evict_lru(spark, d):
    c = D.cells(spark, d).withColumns({"source_id": F.lit("a"), "in_use": F.col("x") % 7 == 0})
    total = c.agg(F.sum("bytes").alias("b")).first()["b"] or 0
    return planning.evict(c, total - total // 3, total).select("x", "y", "bytes", "freed")


@query("SELECT l_orderkey, string_agg(p_name, '|' ORDER BY l_linenumber, l_partkey) AS members, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def resolve_members(spark, d):
    j = D.read(spark, d, "lineitem").join(D.read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    g = j.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "p_name"))).alias("m"))
    return g.select("l_orderkey", F.array_join(F.transform("m", lambda m: m["p_name"]), "|").alias("members"), F.size("m").cast("long").alias("n"))


# --- ordered rows -----------------------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT user_id, event_id, value, row_number() OVER q AS i, count(*) OVER (PARTITION BY user_id) AS n, first_value(value) OVER q AS a, last_value(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS z,
sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS s FROM events WINDOW q AS (PARTITION BY user_id ORDER BY event_id)) SELECT user_id, event_id, round((s + greatest(0, 3 - i) * a + greatest(0, i + 2 - n) * z) / 5, 6) AS smooth FROM e""")
def smoothed_strength(spark, d):
    return ordered.smoothed(D.read(spark, d, "events"), "user_id", "event_id", "value", 2).select("user_id", "event_id", r(F.col("smooth"), 6).alias("smooth"))


@query("""WITH e AS (SELECT user_id, value >= 20 AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, row_number() OVER (PARTITION BY user_id, value >= 20 ORDER BY event_id) AS j FROM events),
g AS (SELECT user_id, count(*) AS n FROM e WHERE t GROUP BY user_id, i - j) SELECT user_id, coalesce(max(n), 0) AS longest FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN g USING (user_id) GROUP BY 1""")
def longest_runs(spark, d):
    return ordered.longest_run(D.read(spark, d, "events"), "user_id", "event_id", F.col("value") >= 20)


@query("SELECT user_id, round(coalesce(sum(c), 0), 6) AS change FROM (SELECT user_id, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id)) AS c FROM events) GROUP BY 1")
def total_change(spark, d):
    return ordered.total_change(D.read(spark, d, "events"), "user_id", "event_id", "value").select("user_id", r(F.col("change"), 6).alias("change"))


@query("SELECT event_type, value AS step FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE i = least(n * 95 // 100 + 1, n)")
def percentile_step(spark, d):
    return ordered.percentile_step(D.read(spark, d, "events"), "event_type", "value")


@query("SELECT l_orderkey, l_linenumber, l_partkey, sum(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING)::BIGINT AS absolute FROM lineitem")
def undelta_ids(spark, d):
    t = D.read(spark, d, "lineitem").withColumn("o", F.struct("l_linenumber", "l_partkey", "l_suppkey"))
    return ordered.undelta(t, "l_orderkey", "o", "l_partkey", "absolute").select("l_orderkey", "l_linenumber", "l_partkey", "absolute")


@query("SELECT event_id, sum((value * 100)::BIGINT) OVER (ORDER BY ts, event_id)::BIGINT AS running FROM events")
def running_total(spark, d):
    e = D.read(spark, d, "events").withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    return ordered.running_total(e, F.date_trunc("hour", "ts"), ["ts", "event_id"], "cents").select("event_id", "running")


@query("""WITH v AS (SELECT user_id AS line_id, event_id, value, row_number() OVER q - 1 AS i, count(*) OVER (PARTITION BY user_id) - 1 AS segments, lead(value) OVER q AS next FROM events WINDOW q AS (PARTITION BY user_id ORDER BY event_id)),
g AS (SELECT *, CASE WHEN segments % 4 > 0 AND segments > 4 THEN least(i // 4, segments // 4 - 1) ELSE i // 4 END AS piece FROM v WHERE i < segments)
SELECT line_id, (min(i) + 1)::INT AS first, (max(i) + 2)::INT AS last, round(avg((value + next) / 2), 6) AS value FROM g GROUP BY line_id, piece""")
def gradient_pieces(spark, d):
    """Lines of segments of length 1 in pieces of 4; a shorter tail joins the piece before it."""
    e = D.read(spark, d, "events").select(F.col("user_id").alias("line_id"), F.row_number().over(W.partitionBy("user_id").orderBy("event_id")).alias("pos"), F.lit(1.0).alias("span"), "value")
    return ordered.gradient_pieces(e, "line_id", 4.0).withColumn("value", r(F.col("value"), 6))


# --- names, text, colour ----------------------------------------------------------------------------------------------

_FIND = """q AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS query FROM part UNION SELECT p_brand FROM part UNION SELECT n_name FROM nation UNION SELECT upper(p_name) FROM part),
al AS (SELECT place_id, lower(unnest(aliases)) AS a FROM (SELECT p_partkey AS place_id, [p_name, p_brand] AS aliases FROM part)),
ex AS (SELECT DISTINCT query, place_id FROM q JOIN al ON a = lower(query)), nr AS (SELECT DISTINCT query, place_id FROM q JOIN al ON split_part(a, ' ', 1) = split_part(lower(query), ' ', 1) AND starts_with(a, lower(query) || ' ')),
m AS (SELECT query, place_id, 'exact' AS match FROM ex UNION ALL SELECT query, place_id, 'near' FROM (SELECT * FROM nr EXCEPT SELECT * FROM ex))"""


@query(f"WITH {_FIND} SELECT query, place_id, match FROM m WHERE match = 'exact' OR query NOT IN (SELECT query FROM m WHERE match = 'exact')")
def find_names(spark, d):
    p = D.read(spark, d, "part")
    asked = p.select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("query")).union(p.select("p_brand")).union(D.read(spark, d, "nation").select("n_name")).union(p.select(F.upper("p_name")))
    return names.find(asked, p.select(F.col("p_partkey").alias("place_id"), F.array("p_name", "p_brand").alias("aliases"))).select("query", "place_id", "match")


@query("""WITH v AS (SELECT p_partkey, ['', '+', ' ', '-', '0'][p_partkey % 5 + 1] || p_size || ['', '.0', ''][p_partkey % 3 + 1] AS text FROM part), n AS (SELECT *, CASE WHEN regexp_full_match(text, '[+-]?[0-9]{1,9}') THEN text::INT END AS i FROM v)
SELECT p_partkey, text, CASE WHEN i BETWEEN 1 AND 12 THEN i END AS level FROM n""")
def admin_levels(spark, d):
    k = F.col("p_partkey")
    t = F.concat(F.get(F.array(*map(F.lit, ("", "+", " ", "-", "0"))), (k % 5).cast("int")), F.col("p_size").cast("string"), F.get(F.array(*map(F.lit, ("", ".0", ""))), (k % 3).cast("int")))
    return D.read(spark, d, "part").select("p_partkey", t.alias("text"), text.admin_level(t).alias("level"))


_CREDIT = "regexp_replace(regexp_replace(html, '(?i)</?(?:br|p|div|li|ul|ol|tr|td)(?:[\\s/][^>]*)?>', ' ', 'g'), '<[^>]*>', '', 'g')"
for _ref, _char in text.REFERENCES:
    _CREDIT = "replace({}, '{}', '{}')".format(_CREDIT, _ref, "''" if _char == "'" else _char)


@query(f"SELECT page_id, length(c) AS n_chars, md5(c) AS digest FROM (SELECT page_id, trim(regexp_replace({_CREDIT}, '\\s+', ' ', 'g')) AS c FROM pages)")
def html_credit_text(spark, d):
    c = text.plain_credit(F.col("html"))
    return D.read(spark, d, "pages").select("page_id", F.length(c).cast("long").alias("n_chars"), F.md5(c).alias("digest"))


@query("SELECT page_id, CASE WHEN regexp_matches(u, '\\?') THEN regexp_replace(u, '\\?.*$', '?redacted') ELSE u END AS url, substr(sha256(url || chr(0) || page_id), 1, 16) AS source_id FROM (SELECT page_id, url, regexp_replace(url, '#.*$', '') AS u FROM pages)")
def redacted_urls(spark, d):
    return D.read(spark, d, "pages").select("page_id", text.redact(F.col("url")).alias("url"), text.source_id(F.col("url"), F.col("page_id").cast("string")).alias("source_id"))


@query("""SELECT o_orderkey, CASE WHEN b < 1024 THEN b || ' bytes' WHEN b < 1048576 THEN printf('%.1f KiB', round(b / 1024e0, 1)) WHEN b < 1073741824 THEN printf('%.1f MiB', round(b / 1048576e0, 1)) ELSE printf('%.1f GiB', round(b / 1073741824e0, 1)) END AS size,
CASE WHEN m < 1000 THEN printf('%d m', round(m)::BIGINT) WHEN m < 10000 THEN CASE WHEN round(m / 1000, 1) = floor(round(m / 1000, 1)) THEN printf('%d km', round(m / 1000, 1)::BIGINT) ELSE printf('%.1f km', round(m / 1000, 1)) END ELSE printf('%d km', round(m / 1000)::BIGINT) END AS distance
FROM (SELECT o_orderkey, o_orderkey * o_orderkey * 7 AS b, (o_orderkey % 20000) * 1e0 + 0.25 AS m FROM orders)""")
def human_figures(spark, d):
    k = F.col("o_orderkey")
    return D.read(spark, d, "orders").select("o_orderkey", text.human_bytes(k * k * 7).alias("size"), text.human_distance((k % 20000) * F.lit(1.0) + 0.25).alias("distance"))


@query(f"WITH {D.POINTS}, s AS (SELECT point_id, regexp_replace(printf('%.7f', lat), '\\.?0+$', '') AS a, regexp_replace(printf('%.7f', lon), '\\.?0+$', '') AS b FROM pts) SELECT point_id, CASE WHEN a IN ('-0', '') THEN '0' ELSE a END AS lat, CASE WHEN b IN ('-0', '') THEN '0' ELSE b END AS lon FROM s")
def coordinate_text(spark, d):
    return D.points(spark, d).select("point_id", text.format_coordinate(F.col("lat")).alias("lat"), text.format_coordinate(F.col("lon")).alias("lon"))


@query(f"SELECT p_partkey, round((greatest(a, b) + 0.05) / (least(a, b) + 0.05), 6) AS ratio FROM (SELECT p_partkey, {S.luminance('(p_partkey * 37 % 256)', '(p_partkey * 91 % 256)', '(p_partkey * 13 % 256)')} AS a, {S.luminance('(p_size * 5 % 256)', '(p_size * 29 % 256)', '(p_size * 3 % 256)')} AS b FROM part)")
def contrast_ratios(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    c = colour.contrast_ratio((k * 37 % 256, k * 91 % 256, k * 13 % 256), (s * 5 % 256, s * 29 % 256, s * 3 % 256))
    return D.read(spark, d, "part").select("p_partkey", r(c, 6).alias("ratio"))


_CIEDE = """v AS (SELECT p_partkey, 50e0 AS l1, (p_partkey % 101 - 50)::DOUBLE AS a1, (p_partkey % 89 - 44)::DOUBLE AS b1, (p_size + 20)::DOUBLE AS l2, (p_partkey % 61 - 30)::DOUBLE AS a2, (p_partkey % 71 - 35)::DOUBLE AS b2 FROM part),
c AS (SELECT *, ((sqrt(a1 ** 2 + b1 ** 2) + sqrt(a2 ** 2 + b2 ** 2)) / 2) ** 7 AS c7 FROM v), p AS (SELECT *, (1 + 0.5 * (1 - sqrt(c7 / (c7 + 25e0 ** 7)))) * a1 AS p1, (1 + 0.5 * (1 - sqrt(c7 / (c7 + 25e0 ** 7)))) * a2 AS p2 FROM c),
h AS (SELECT *, sqrt(p1 ** 2 + b1 ** 2) AS c1, sqrt(p2 ** 2 + b2 ** 2) AS c2, CASE WHEN p1 = 0 AND b1 = 0 THEN 0 ELSE (degrees(atan2(b1, p1)) + 360) % 360 END AS h1, CASE WHEN p2 = 0 AND b2 = 0 THEN 0 ELSE (degrees(atan2(b2, p2)) + 360) % 360 END AS h2 FROM p),
d AS (SELECT *, CASE WHEN c1 * c2 = 0 THEN 0 WHEN abs(h2 - h1) <= 180 THEN h2 - h1 WHEN h2 - h1 > 180 THEN h2 - h1 - 360 ELSE h2 - h1 + 360 END AS dh, CASE WHEN c1 * c2 = 0 THEN h1 + h2 WHEN abs(h2 - h1) <= 180 THEN (h1 + h2) / 2 WHEN h1 + h2 < 360 THEN (h1 + h2 + 360) / 2 ELSE (h1 + h2 - 360) / 2 END AS hm, (l1 + l2) / 2 AS lm, (c1 + c2) / 2 AS cm FROM h),
t AS (SELECT *, 1 - 0.17 * cos(radians(hm - 30)) + 0.24 * cos(radians(2 * hm)) + 0.32 * cos(radians(3 * hm + 6)) - 0.20 * cos(radians(4 * hm - 63)) AS t, 2 * sqrt(c1 * c2) * sin(radians(dh / 2)) AS dhh FROM d),
u AS (SELECT p_partkey, (l2 - l1) / (1 + 0.015 * (lm - 50) ** 2 / sqrt(20 + (lm - 50) ** 2)) AS x, (c2 - c1) / (1 + 0.045 * cm) AS y, dhh / (1 + 0.015 * cm * t) AS z, -2 * sqrt(cm ** 7 / (cm ** 7 + 25e0 ** 7)) * sin(radians(60 * exp(-1 * (((hm - 275) / 25) ** 2)))) AS rt FROM t)"""


@query(f"WITH {_CIEDE} SELECT p_partkey, round(sqrt(x * x + y * y + z * z + rt * y * z), 5) AS delta FROM u")
def colour_difference(spark, d):
    k = F.col("p_partkey")
    a = [F.lit(50.0), (k % 101 - 50).cast("double"), (k % 89 - 44).cast("double"), (F.col("p_size") + 20).cast("double"), (k % 61 - 30).cast("double"), (k % 71 - 35).cast("double")]
    return colour.with_difference(D.read(spark, d, "part").select("p_partkey", "p_size"), "delta", a[:3], a[3:]).select("p_partkey", r(F.col("delta"), 5).alias("delta"))


@query("SELECT p_partkey, round(CASE WHEN z <= 5 THEN 1 WHEN z <= 10 THEN 4 ** ((z - 5) / 5) WHEN z <= 14 THEN 4 * 4 ** ((z - 10) / 4) ELSE 16 END, 6) AS width FROM (SELECT p_partkey, (p_partkey % 200) / 1e1 AS z FROM part)")
def width_at_zoom(spark, d):
    return D.read(spark, d, "part").select("p_partkey", r(colour.width_at(F.col("p_partkey") % 200 / F.lit(10.0), [(5.0, 1.0), (10.0, 4.0), (14.0, 16.0)]), 6).alias("width"))


@query("""WITH s AS (SELECT event_id, CASE WHEN value < 5 THEN 0e0 WHEN value > 80 THEN 1e0 ELSE (value - 5) / 75 END AS t FROM events), k AS (SELECT *, least(floor(t * 2), 1)::INT AS k FROM s)
SELECT event_id, round(t, 6) AS t, round([0, 250, 255][k + 1] * (1 - (t * 2 - k)) + [0, 250, 255][k + 2] * (t * 2 - k))::INT AS red, round([90, 220, 40][k + 1] * (1 - (t * 2 - k)) + [90, 220, 40][k + 2] * (t * 2 - k))::INT AS green FROM k""")
def colour_scale(spark, d):
    t = colour.fraction(F.col("value"), F.lit(5.0), F.lit(80.0))
    red, green, _ = colour.ramp(F.col("f"), [(0, 90, 0), (250, 220, 0), (255, 40, 0)])
    return D.read(spark, d, "events").select("event_id", t.alias("f")).select("event_id", r(F.col("f"), 6).alias("t"), red.alias("red"), green.alias("green"))


@query("""SELECT p_partkey, ((p_partkey % 256) * 256 + p_size + (p_partkey % 64) / 256e0 - 32768)::FLOAT::DOUBLE AS metres, round(greatest(1, 1.6 ** ((13 - p_size % 20) / 2e0)), 6) AS raised,
round(tanh(((sin(radians(45)) - sin(radians(315)) * cos(radians(45)) * dx - cos(radians(315)) * cos(radians(45)) * dy) / sqrt(1 + dx * dx + dy * dy) - sin(radians(45))) / 0.35), 6) AS shade FROM (SELECT *, (p_size % 11 - 5) / 1e1 AS dx, (p_partkey % 13 - 6) / 1e1 AS dy FROM part)""")
def elevation_shade(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    return D.read(spark, d, "part").select("p_partkey", colour.terrarium(k % 256, s, k % 64).cast("double").alias("metres"), r(colour.exaggeration(s % 20), 6).alias("raised"), r(colour.hillshade((s % 11 - 5) / F.lit(10.0), (k % 13 - 6) / F.lit(10.0)), 6).alias("shade"))


# --- groups that are folds: recursive SQL, a row of each group at a time ----------------------------------------------


@query(f"""WITH RECURSIVE v AS (SELECT p_name AS name, p_partkey % 50 / 1e2 AS lat, p_size / 2e2 AS lon, p_partkey AS pos, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS i FROM part),
k(name, i, keep, taken) AS (SELECT name, i, true, [[lat, lon]] FROM v WHERE i = 1 UNION ALL SELECT name, i, far, CASE WHEN far THEN list_append(taken, [lat, lon]) ELSE taken END
 FROM (SELECT v.*, taken, len(list_filter(taken, lambda t : {S.haversine('v.lat', 'v.lon', 't[1]', 't[2]')} <= 1000)) = 0 AS far FROM k JOIN v ON v.name = k.name AND v.i = k.i + 1))
SELECT name, lat, lon, pos FROM v JOIN k USING (name, i) WHERE keep""")
def place_points(spark, d):
    p = D.read(spark, d, "part").select(F.col("p_name").alias("name"), (F.col("p_partkey") % 50 / F.lit(100.0)).alias("lat"), (F.col("p_size") / F.lit(200.0)).alias("lon"), F.col("p_partkey").alias("pos"))
    return names.place_points(p)


@query("""WITH RECURSIVE c AS (SELECT p_brand AS view_id, p_partkey AS key, p_partkey * 37 % 500 AS x0, p_partkey * 91 % 300 AS y0, p_partkey * 37 % 500 + 60 AS x1, p_partkey * 91 % 300 + 12 AS y1,
 row_number() OVER (PARTITION BY p_brand ORDER BY p_size % 3 DESC, p_size DESC, p_partkey) AS i FROM part),
k(view_id, i, keep, taken) AS (SELECT view_id, i, true, [[x0, y0, x1, y1]] FROM c WHERE i = 1 UNION ALL SELECT view_id, i, free, CASE WHEN free THEN list_append(taken, [x0, y0, x1, y1]) ELSE taken END
 FROM (SELECT c.*, taken, len(list_filter(taken, lambda t : x0 < t[3] AND t[1] < x1 AND y0 < t[4] AND t[2] < y1)) = 0 AS free FROM k JOIN c ON c.view_id = k.view_id AND c.i = k.i + 1))
SELECT view_id, key FROM c JOIN k USING (view_id, i) WHERE keep""")
def place_labels(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    c = D.read(spark, d, "part").select(F.col("p_brand").alias("view_id"), k.alias("key"), (s % 3).alias("priority"), s.alias("rank"), k.alias("nth"), (k * 37 % 500).alias("x0"), (k * 91 % 300).alias("y0"), (k * 37 % 500 + 60).alias("x1"), (k * 91 % 300 + 12).alias("y1"))
    return inspect.place_labels(c)


@query("""SELECT s_suppkey AS id, 1 AS outlines, 1 AS holes, 0 AS orphans, 0 AS open_chains, 0 AS wrapped, 4 AS vertices, 2e0 AS twice_outline, -0.04e0 AS twice_hole FROM supplier""")
def assembled_boundaries(spark, d):
    """Relations of two half outlines, a degree square, and a hole in it: through resolve and assemble."""
    n = D.read(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), D.lat(F.col("s_suppkey")).alias("la"), D.lon(F.col("s_suppkey")).alias("lo"))
    corners = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(y).alias("y"), F.lit(x).alias("x")) for i, (y, x) in enumerate([(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0), (0.4, 0.4), (0.4, 0.6), (0.6, 0.6)]))))
    nodes = n.withColumn("c", corners).select((F.col("k") * 10 + F.col("c.i")).alias("id"), (F.col("la") + F.col("c.y")).alias("lat"), (F.col("lo") + F.col("c.x")).alias("lon"))
    refs = lambda *i: F.array(*(F.col("k") * 10 + j for j in i))
    ways = n.withColumn("w", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), v.alias("refs")) for i, v in enumerate([refs(0, 1, 2), refs(2, 3, 0), refs(4, 5, 6, 4)]))))).select((F.col("k") * 10 + F.col("w.i")).alias("id"), "w.refs")
    member = lambda i, role: F.struct(F.lit("way").alias("type"), (F.col("k") * 10 + i).alias("id"), F.lit(role).alias("role"))
    rel = n.select(F.col("k").alias("id"), F.array(member(0, "outer"), member(1, "outer"), member(2, "inner")).alias("members"))
    out = osm.assemble(osm.resolve(rel, ways, nodes))
    flat = lambda ring: F.transform(ring, lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y")))
    outline = F.col("parts")[0]["outline"]
    return out.select("id", "outlines", "holes", "orphans", "open_chains", "wrapped", F.size(outline).alias("vertices"), r(geo.shoelace(flat(outline)), 6).alias("twice_outline"), r(geo.shoelace(flat(F.col("parts")[0]["holes"][0])), 6).alias("twice_hole"))


# --- the flagship -----------------------------------------------------------------------------------------------------

_LOCATE = f"""{_STACK}, {D.SUPPLIERS}, lv AS (SELECT *, CASE WHEN height = 1 THEN 'locality' WHEN height = 2 THEN CASE depth WHEN 2 THEN 'neighbourhood' ELSE 'locality' END ELSE CASE height - depth WHEN 0 THEN 'neighbourhood' WHEN 1 THEN 'macrohood' WHEN 2 THEN 'locality' END END AS level FROM st),
p AS (SELECT point_id, feature_id, {S.haversine('pts.lat', 'pts.lon', 'sup.lat', 'sup.lon')} AS m FROM pts, sup), c AS (SELECT *, round(m, 1) AS dm FROM p WHERE m <= 400000), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY dm, m, feature_id) AS i FROM c) WHERE i = 1)"""


@query(f"""WITH {_LOCATE} SELECT pts.point_id, any_value(lv.name) FILTER (level = 'locality') AS locality, any_value(lv.name) FILTER (level = 'macrohood') AS macrohood, any_value(lv.name) FILTER (level = 'neighbourhood') AS neighbourhood,
any_value(feature_id) AS city, any_value(dm) AS city_m FROM pts LEFT JOIN lv ON pts.point_id = lv.point_id LEFT JOIN b ON pts.point_id = b.point_id GROUP BY 1""")
def locate_places(spark, d):
    """Where each customer is: the areas that hold the point by level, and the nearest city."""
    points = D.points(spark, d)
    named = spatial.levels(points, D.boxes(spark, d), "point_id", ["locality", "macrohood", "neighbourhood"])
    wide = named.groupBy("point_id").agg(*(F.max(F.when(F.col("level") == k, F.col("name"))).alias(k) for k in ("locality", "macrohood", "neighbourhood")))
    f = D.points(spark, d, "supplier", "s_suppkey").withColumnRenamed("point_id", "feature_id")
    city = spatial.nearest(points, f, "point_id", 400_000.0, grid=5.0).select("point_id", F.col("feature_id").alias("city"), F.col("distance_m").alias("city_m"))
    return wide.join(city, "point_id", "left")


# --- views ------------------------------------------------------------------------------------------------------------

_VIEW = f"""{D.POINTS}, a AS (SELECT point_id, 256 + point_id % 512 AS width, 256 + point_id % 300 AS height, {S.wx('(lon * 0.9 - 2)')} AS x0, {S.wx('(lon * 0.9 + 3)')} AS x1, {S.wy('(lat * 0.9 + 2)')} AS y0, {S.wy('(lat * 0.9 - 1)')} AS y1 FROM pts),
v AS (SELECT *, least(width / (x1 - x0), height / (y1 - y0)) AS scale FROM a), w AS (SELECT *, (x0 + x1) / 2 - width / (2 * scale) AS ox, (y0 + y1) / 2 - height / (2 * scale) AS oy, log2(scale / 256) AS zoom FROM v)"""


def _views(spark, d):
    p = D.points(spark, d)
    lon, lat, k = F.col("lon") * 0.9, F.col("lat") * 0.9, F.col("point_id")
    return V.resolve(p.select("point_id", (lon - 2).alias("w"), (lat - 1).alias("s"), (lon + 3).alias("e"), (lat + 2).alias("n"), (256 + k % 512).alias("width"), (256 + k % 300).alias("height")))


@query(f"WITH {_VIEW} SELECT point_id, round(zoom, 8) AS zoom, round(zoom)::INT AS tile_zoom, round(ox, 9) AS ox, round(oy, 9) AS oy FROM w")
def resolved_views(spark, d):
    return _views(spark, d).select("point_id", r(F.col("zoom"), 8).alias("zoom"), "tile_zoom", r(F.col("ox")).alias("ox"), r(F.col("oy")).alias("oy"))


@query(f"""WITH {_VIEW}, t AS (SELECT *, 2e0 ** round(zoom) AS n FROM w), q AS (SELECT point_id, unnest(range(greatest(0, floor(ox * n + 1e-9))::BIGINT, least(n - 1, ceil((ox + width / scale) * n - 1e-9) - 1)::BIGINT + 1)) AS tx,
greatest(0, floor(oy * n + 1e-9))::BIGINT AS a, least(n - 1, ceil((oy + height / scale) * n - 1e-9) - 1)::BIGINT AS z FROM t) SELECT point_id, tx, unnest(range(a, z + 1)) AS ty FROM q""")
def tiles_under_views(spark, d):
    return V.tiles_under(_views(spark, d)).select("point_id", "tx", "ty")


@query(f"""WITH {D.WAYS.split("dist AS")[0].split("seg AS")[0].rstrip().rstrip(",")},
p AS (SELECT way_id, i, (vlon - lon) * 1000.0::DOUBLE AS x, (vlat - lat) * 1000.0::DOUBLE AS y FROM vx), g AS (SELECT *, lead(x) OVER q - x AS dx, lead(y) OVER q - y AS dy FROM p WINDOW q AS (PARTITION BY way_id ORDER BY i)),
h AS (SELECT *, sqrt(dx * dx + dy * dy) AS size, greatest(0e0, CASE WHEN dx <> 0 THEN least((-96.5 - x) / dx, (50 - x) / dx) ELSE 0 END, CASE WHEN dy <> 0 THEN least((-50 - y) / dy, (50 - y) / dy) ELSE 0 END) AS lo,
 least(1e0, CASE WHEN dx <> 0 THEN greatest((-96.5 - x) / dx, (50 - x) / dx) ELSE 1 END, CASE WHEN dy <> 0 THEN greatest((-50 - y) / dy, (50 - y) / dy) ELSE 1 END) AS hi, (dx <> 0 OR x BETWEEN -96.5 AND 50) AND (dy <> 0 OR y BETWEEN -50 AND 50) AS able FROM g WHERE dx IS NOT NULL),
w AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY way_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS walked, able AND lo <= hi AND NOT (lo = hi AND size > 0) AS part FROM h),
o AS (SELECT *, part AND NOT coalesce(lag(part AND hi = 1) OVER q AND lo = 0, false) AS fresh FROM w WINDOW q AS (PARTITION BY way_id ORDER BY i)), n AS (SELECT *, count(*) FILTER (fresh) OVER (PARTITION BY way_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM o WHERE part)
SELECT way_id, round(max(CASE WHEN fresh THEN walked + lo * size END), 3) AS start, (count(*) + 1)::INT AS vertices FROM n GROUP BY way_id, run""")
def clipped_lines(spark, d):
    """Each order's way against a square about its customer."""
    w = D.ways(spark, d).select("way_id", F.transform("line", lambda p: F.struct(((p["lon"] - F.col("lon")) * 1000.0).alias("x"), ((p["lat"] - F.col("lat")) * 1000.0).alias("y"))).alias("points"))
    return lines.clipped(w, (-96.5, -50.0, 50.0, 50.0)).select("way_id", r(F.col("start"), 3).alias("start"), F.size("run").alias("vertices"))


@query()
def rendered_views(spark, d):
    """A picture a nation: its rectangle in its own view, with its customers as strokes."""
    b = V.resolve(D.boxes(spark, d).withColumns({"width": F.lit(96), "height": F.lit(64)}))
    ring = F.array(*(F.struct(*(c.alias(k) for k, c in zip("xy", V.pixel(F.col(x), F.col(y)), strict=True))) for x, y in (("w", "n"), ("e", "n"), ("e", "s"), ("w", "s"))))
    shape = lambda kind, ord_, red: b.select(F.col("file_pos").alias("view_id"), "width", "height", F.lit(ord_).alias("ord"), F.lit(kind).alias("kind"), F.array(ring).alias("rings"), F.lit(red).alias("red"), F.lit(90).alias("green"), F.lit(60).alias("blue"), F.lit(2.0).alias("stroke"))
    got = draw.render(shape("fill", 0, 220).union(shape("stroke", 1, 20)))
    return got.select("view_id", F.length("png").alias("bytes"), F.md5("png").alias("digest"))


from . import drawing, placing, styling  # noqa: E402  they add their queries to the table

__all__ = ["ORACLE", "QUERIES", "drawing", "placing", "styling"]
