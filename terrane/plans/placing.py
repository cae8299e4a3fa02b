"""Queries about kinds, levels, names and what a plan holds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import kinds
from ..operators import ordered, osm, places, planning
from . import derive as D
from . import sql as S
from .registry import query, r


def _pick(values: list[str | None], k):
    return F.get(F.array(*map(F.lit, values)), (k % len(values)).cast("int"))


def _sql_list(values: list[str | None]) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


# --- kinds, names, headers --------------------------------------------------------------------------------------------

_KINDS = ["city", "town", "2", "4", "+2", " 2", "6", "village", "farm", "x", None, "10", "3", "hamlet"]


@query(f"""WITH v AS (SELECT p_partkey, {_sql_list(_KINDS)}[p_partkey % {len(_KINDS)} + 1] AS kind FROM part),
n AS (SELECT *, CASE WHEN regexp_full_match(kind, '[+-]?[0-9]+') THEN kind::INT END AS i FROM v)
SELECT p_partkey, kind, coalesce(kind IN ('city', 'town'), false) AS city, coalesce(i = 2, false) AS country,
 CASE WHEN kind IN ('city', 'town') THEN 'city' WHEN i <= 2 THEN 'country' WHEN i <= 4 THEN 'region' ELSE 'locality' END AS level,
 CASE kind WHEN 'city' THEN 10e0 WHEN 'town' THEN 4e0 WHEN 'village' THEN 2e0 WHEN 'hamlet' THEN 1e0 WHEN 'farm' THEN 1e0 ELSE 3e0 END AS km FROM n""")
def area_kinds(spark, d):
    v = D.read(spark, d, "part").select("p_partkey", _pick(_KINDS, F.col("p_partkey")).alias("kind"))
    k = F.col("kind")
    return v.select("p_partkey", "kind", kinds.is_city(k).alias("city"), kinds.is_country(k).alias("country"), kinds.listed_level(k).alias("level"), kinds.point_km(k).alias("km"))


@query("""SELECT level, level IN ('locality', 'macrohood', 'neighbourhood') AS derived,
 CASE level WHEN 'country' THEN 'countries' WHEN 'region' THEN 'regions' WHEN 'water' THEN 'waters' END AS layer,
 CASE level WHEN 'country' THEN 1e6 WHEN 'region' THEN 5e5 WHEN 'locality' THEN 25e3 WHEN 'macrohood' THEN 5e3 WHEN 'neighbourhood' THEN 3e3 WHEN 'area' THEN 0e0 WHEN 'street' THEN 99e0 END AS cap
 FROM (VALUES ('country'), ('region'), ('city'), ('water'), ('locality'), ('macrohood'), ('neighbourhood'), ('area'), ('street')) AS t(level)""")
def level_rules(spark, d):
    v = spark.createDataFrame([(x,) for x in places.wanted("")], "level string")
    level = F.col("level")
    return v.select("level", kinds.is_derived(level).alias("derived"), kinds.layer_of(level).alias("layer"), places.cap(level, {"street": 99.0}).alias("cap"))


_NAMED = "[trim(p_brand), trim(upper(p_name)), CASE WHEN p_size % 2 = 0 THEN '-99' ELSE p_type END, lower(p_brand), p_type || ' ' || p_size]"


@query(f"""WITH v AS (SELECT p_partkey, p_name AS name, {_NAMED} AS named, [trim(p_type), CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE '-99' END] AS context FROM part),
u AS (SELECT p_partkey, 0 AS i, name AS a FROM v UNION ALL SELECT p_partkey, i, named[i] FROM v, range(1, 6) q(i)
 WHERE named[i] NOT IN ('', '-99') AND NOT list_contains(list_transform(list_filter(context, lambda x : x NOT IN ('', '-99')), lambda x : lower(x)), lower(named[i]))),
f AS (SELECT *, row_number() OVER (PARTITION BY p_partkey, lower(a) ORDER BY i) AS k FROM u) SELECT p_partkey, string_agg(a, '|' ORDER BY i) AS aliases, count(*) AS n FROM f WHERE k = 1 GROUP BY 1""")
def name_aliases(spark, d):
    p = D.read(spark, d, "part")
    sized = F.concat("p_type", F.lit(" "), F.col("p_size").cast("string"))
    named = [F.col("p_brand"), F.upper("p_name"), F.when(F.col("p_size") % 2 == 0, "-99").otherwise(F.col("p_type")), F.lower("p_brand"), sized]
    context = [F.col("p_type"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).otherwise("-99")]
    a = kinds.aliases(F.col("p_name"), named, context)
    return p.select("p_partkey", F.array_join(a, "|").alias("aliases"), F.size(a).cast("long").alias("n"))


_FILES = ["area-{}.bin", "area-.bin", "area-.{}.bin", "{}.bin", "area-a b{}.bin", "area-{}.bin.tmp", "area-A_{}.b.bin"]


@query(f"""WITH v AS (SELECT p_partkey, replace({_sql_list(_FILES)}[p_partkey % {len(_FILES)} + 1], '{{}}', p_partkey::VARCHAR) AS file, {_sql_list(['webp', 'png', 'mvt', '', None])}[p_partkey % 5 + 1] AS t FROM part)
SELECT p_partkey, nullif(regexp_extract(file, '^area-([A-Za-z0-9_-][A-Za-z0-9._-]{{0,63}})[.]bin$', 1), '') AS region, CASE WHEN t IN ('webp', 'png') THEN '.' || t ELSE '.mvt' END AS ext FROM v""")
def region_files(spark, d):
    k = F.col("p_partkey")
    file = F.replace(_pick(_FILES, k), F.lit("{}"), k.cast("string"))
    return D.read(spark, d, "part").select("p_partkey", kinds.region_of(file, "area-", ".bin").alias("region"), kinds.tile_ext(_pick(["webp", "png", "mvt", "", None], k)).alias("ext"))


@query("""WITH v AS (SELECT o_orderkey, (o_orderkey % 400 - 200)::DOUBLE AS w, (o_custkey % 200 - 100)::DOUBLE AS s, (o_orderkey % 370 - 180)::DOUBLE AS e, (o_custkey % 190 - 90)::DOUBLE AS n FROM orders)
SELECT o_orderkey, CASE WHEN abs(w) > 180 THEN 'west' WHEN abs(e) > 180 THEN 'east' WHEN abs(s) > 90 THEN 'south' WHEN abs(n) > 90 THEN 'north' WHEN e <= w THEN 'east of west' WHEN n <= s THEN 'north of south' END AS fault FROM v""")
def bounds_faults(spark, d):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    box = (o % 400 - 200, c % 200 - 100, o % 370 - 180, c % 190 - 90)
    return D.read(spark, d, "orders").select("o_orderkey", kinds.bounds_fault(*(v.cast("double") for v in box)).alias("fault"))


_HEADS = ["bytes {a}-{b}/{c}", "Bytes {a} - {b} / *", "bytes {b}-{a}/{c}", "items {a}-{b}/{c}", "bytes {a}-{b}", "", "bytes */{c}", "bytes {a}-x/{c}"]
_HEAD = f"replace(replace(replace({_sql_list(_HEADS)}[o_orderkey % {len(_HEADS)} + 1], '{{a}}', o_custkey::VARCHAR), '{{b}}', (o_custkey + o_orderkey % 97)::VARCHAR), '{{c}}', (o_custkey * 9)::VARCHAR)"


@query(f"""WITH h AS (SELECT o_orderkey, {_HEAD} AS h FROM orders), m AS (SELECT o_orderkey, regexp_extract(h, '^\\s*(?i:bytes)\\s+(\\d+)\\s*-\\s*(\\d+)\\s*/\\s*(\\d+|\\*)\\s*$', ['a', 'b', 'c']) AS m FROM h),
t AS (SELECT o_orderkey, try_cast(m.a AS BIGINT) AS a, try_cast(m.b AS BIGINT) AS b, try_cast(m.c AS BIGINT) AS c FROM m)
SELECT o_orderkey, CASE WHEN a <= b THEN a END AS first, CASE WHEN a <= b THEN b END AS last, CASE WHEN a <= b THEN c END AS total FROM t""")
def content_ranges(spark, d):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    h = _pick(_HEADS, o)
    for mark, v in (("{a}", c), ("{b}", c + o % 97), ("{c}", c * 9)):
        h = F.replace(h, F.lit(mark), v.cast("string"))
    return D.read(spark, d, "orders").select("o_orderkey", kinds.content_range(h).alias("r")).select("o_orderkey", "r.*")


@query("""WITH v AS (SELECT p_partkey, (p_partkey % 90) / 5e0 AS z, (p_size % 23) / 2e0 AS rise, p_partkey % 41 / 2e0 AS blur, p_partkey % 19 AS zoom FROM part),
b AS (SELECT *, CASE WHEN z < 11 THEN NULL WHEN z < 12 THEN 100 WHEN z < 13 THEN 50 WHEN z < 14 THEN 20 WHEN z < 16 THEN 10 ELSE 5 END AS base FROM v)
SELECT p_partkey, base::DOUBLE AS base, (CASE WHEN base IS NOT NULL THEN coalesce((SELECT min(s) FROM (VALUES (5), (10), (20), (50), (100), (200), (500), (1000)) AS t(s) WHERE s >= greatest(base, rise * 4)), 1000) END)::DOUBLE AS step,
 CASE WHEN blur <= 0.25 THEN 0e0 WHEN blur < 0.5 THEN 2 * blur - 0.5 ELSE least(blur, 16e0) END AS blur, least(zoom, 14)::BIGINT AS drawn FROM b""")
def contour_intervals(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    z = k % 90 / F.lit(5.0)
    return D.read(spark, d, "part").select(
        "p_partkey", kinds.zoom_interval(z).alias("base"), kinds.contour_interval(z, s % 23 / F.lit(2.0)).alias("step"),
        kinds.blur_radius(k % 41 / F.lit(2.0)).alias("blur"), kinds.drawn_zoom(k % 19, F.lit(14)).cast("long").alias("drawn"),
    )


_NOTES = "['', 'Map © a', NULL, 'x'][p_partkey % 4 + 1]"


@query(f"""SELECT p_partkey, CASE WHEN coalesce({_NOTES}, '') = '' THEN coalesce(nullif(p_brand, 'Brand#1'), '') WHEN p_brand = 'Brand#1' THEN {_NOTES} ELSE {_NOTES} || ' | ' || p_brand END AS credit FROM part""")
def joined_credits(spark, d):
    brand = F.when(F.col("p_brand") == "Brand#1", "").otherwise(F.col("p_brand"))
    return D.read(spark, d, "part").select("p_partkey", kinds.join_credits(_pick(["", "Map © a", None, "x"], F.col("p_partkey")), brand).alias("credit"))


# --- levels -----------------------------------------------------------------------------------------------------------

_LEVELS4, _DETAILS = ["country", "region", "locality", "neighbourhood"], ["city", "town", "village", "suburb", "quarter", "neighbourhood", "x"]
_FEATURES = f"""ft AS (SELECT s_suppkey AS feature_id, {_sql_list(_LEVELS4)}[s_suppkey % 4 + 1] AS level, {_sql_list(_DETAILS)}[s_suppkey % 7 + 1] AS kind, CASE WHEN s_suppkey % 11 > 0 THEN s_name END AS name,
 CASE WHEN s_suppkey % 5 > 0 THEN s_suppkey % 13 END AS min_zoom, (s_suppkey * 104729 % 17000) / 1e2 - 85.0::DOUBLE AS lat, (s_suppkey * 7919 % 36000) / 1e2 - 180.0::DOUBLE AS lon FROM supplier)"""


def _features(spark, d):
    k = F.col("s_suppkey")
    return D.read(spark, d, "supplier").select(
        k.alias("feature_id"), _pick(_LEVELS4, k).alias("level"), _pick(_DETAILS, k).alias("kind_detail"), F.when(k % 11 > 0, F.col("s_name")).alias("name"),
        F.when(k % 5 > 0, k % 13).alias("min_zoom"), D.lat(k).alias("lat"), D.lon(k).alias("lon"),
    )


@query(f"""WITH {_FEATURES} SELECT feature_id, round(25000 * least(2 ** ((8 - coalesce(min_zoom, 12)) / 2e0), 8), 6) AS reach, CASE WHEN kind = 'city' THEN 0 ELSE 1 END AS town,
 CASE WHEN level = 'neighbourhood' THEN CASE kind WHEN 'suburb' THEN 0 WHEN 'quarter' THEN 1 WHEN 'neighbourhood' THEN 2 ELSE 3 END ELSE 0 END AS hood FROM ft""")
def place_reach(spark, d):
    kind, level = F.col("kind_detail"), F.col("level")
    return _features(spark, d).select("feature_id", r(places.reach(F.col("min_zoom").cast("double"), F.lit(25_000.0)), 6).alias("reach"), places.town_rank(kind).alias("town"), places.hood_rank(kind, level).alias("hood"))


_NEAR = f"""{D.POINTS}, {_FEATURES}, p AS (SELECT point_id, ft.*, {S.haversine('pts.lat', 'pts.lon', 'ft.lat', 'ft.lon')} AS m FROM pts, ft WHERE name IS NOT NULL),
c AS (SELECT *, round(m, 1) AS distance_m, CASE level WHEN 'country' THEN 1e6 WHEN 'region' THEN 5e5 WHEN 'locality' THEN 25e4 ELSE 3e5 END AS most,
 CASE WHEN level <> 'neighbourhood' THEN 0 WHEN kind = 'suburb' THEN 0 WHEN kind = 'quarter' THEN 1 WHEN kind = 'neighbourhood' THEN 2 ELSE 3 END AS rank FROM p),
near AS (SELECT point_id, level, name, kind, distance_m, feature_id FROM (SELECT *, row_number() OVER (PARTITION BY point_id, level ORDER BY rank, distance_m, m, feature_id) AS i FROM c WHERE m <= most) WHERE i = 1)"""
_CAPS = {"locality": 250_000.0, "neighbourhood": 300_000.0}


def _near(spark, d):
    return places.near_levels(D.points(spark, d), _features(spark, d), "point_id", _LEVELS4, caps=_CAPS)


@query(f"WITH {_NEAR} SELECT * FROM near")
def locate_levels(spark, d):
    """The best named feature of each level within its cap, of its preferred kinds first."""
    return _near(spark, d)


@query(f"""WITH {_NEAR}, w AS (SELECT *, 25e4 * least(2 ** ((8 - coalesce(min_zoom, 12)) / 2e0), 8) AS reach FROM c WHERE level = 'locality' AND kind IN ('city', 'town'))
SELECT point_id, name, kind, distance_m, feature_id FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY kind <> 'city', m / reach, feature_id) AS i FROM w WHERE m <= reach) WHERE i = 1""")
def locate_prominent(spark, d):
    """The city, else town, whose reach a point is most within."""
    found = places.near_levels(D.points(spark, d), _features(spark, d), "point_id", ["locality"], prominent=True, caps=_CAPS)
    return found.drop("level")


@query(f"""WITH {_NEAR} SELECT point_id, arg_max(level, o) AS level, arg_max(name, o) AS name FROM (SELECT *, CASE level WHEN 'country' THEN 1 WHEN 'region' THEN 2 WHEN 'locality' THEN 5 ELSE 7 END AS o FROM near) GROUP BY 1""")
def deepest_level(spark, d):
    return places.deepest(_near(spark, d), "point_id")


_MATCH = """m AS (SELECT p_partkey AS point_id, p_size % 9 AS place, CASE WHEN p_partkey % 3 = 0 THEN 'near' ELSE 'contained' END AS source, ['<b>© a</b>', '', 'b &amp; c', '© a', NULL][p_partkey % 5 + 1] AS credit FROM part)"""


def _matches(spark, d):
    k = F.col("p_partkey")
    return D.read(spark, d, "part").select(k.alias("point_id"), (F.col("p_size") % 9).alias("place"), F.when(k % 3 == 0, "near").otherwise("contained").alias("source"), _pick(["<b>© a</b>", "", "b &amp; c", "© a", None], k).alias("credit"))


@query(f"WITH {_MATCH} SELECT DISTINCT replace(regexp_replace(credit, '<[^>]*>', '', 'g'), '&amp;', '&') AS credit FROM m WHERE source = 'contained' AND credit <> ''")
def contained_credits(spark, d):
    return places.contained_credits(_matches(spark, d))


@query(f"WITH {_MATCH} SELECT place, bool_or(source <> 'contained') AS near FROM m GROUP BY 1")
def any_near(spark, d):
    return places.any_near(_matches(spark, d), ["place"])


_TYPED = f"""{D.POINTS}, {D.BOXES}, ab AS (SELECT file_pos, name, ['city', '2', '4', '6', 'town', '8'][file_pos % 6 + 1] AS kind, w, s, e, n FROM box), hd AS (SELECT * FROM pts JOIN ab ON lat >= s AND lat < n AND lon >= w AND lon < e)"""


def _typed(spark, d):
    return D.boxes(spark, d).withColumn("kind", _pick(["city", "2", "4", "6", "town", "8"], F.col("file_pos")))


@query(f"""WITH {_TYPED}, c AS (SELECT point_id, name, row_number() OVER (PARTITION BY point_id ORDER BY (e - w) * (n - s), file_pos DESC) AS i FROM hd WHERE kind IN ('city', 'town'))
SELECT pts.point_id, c.name, CASE WHEN c.name IS NOT NULL THEN 'Inside' WHEN pts.point_id IN (SELECT point_id FROM hd) THEN 'Outside' ELSE 'NoData' END AS containment FROM pts LEFT JOIN c ON c.point_id = pts.point_id AND i = 1""")
def city_containment(spark, d):
    return places.city_at(D.points(spark, d), _typed(spark, d), "point_id")


@query(f"WITH {_TYPED} SELECT point_id, name FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY (e - w) * (n - s), file_pos DESC) AS i FROM hd WHERE kind = '2') WHERE i = 1")
def country_containment(spark, d):
    return places.country_at(D.points(spark, d), _typed(spark, d), "point_id")


@query("""WITH a AS (SELECT count(*) > 0 AS any_, count(*) FILTER (n_nationkey % 6 IN (0, 4)) > 0 AS city FROM nation)
SELECT level, CASE WHEN level = 'country' THEN true WHEN level IN ('region', 'water', 'area', 'street') THEN false WHEN level = 'city' THEN city ELSE any_ END AS covered
FROM a, (VALUES ('country'), ('region'), ('city'), ('water'), ('locality'), ('macrohood'), ('neighbourhood'), ('area'), ('street')) AS t(level)""")
def covered_levels(spark, d):
    files = spark.createDataFrame([("countries", 250), ("regions", 0)], "layer string, areas int")
    return places.covers(_typed(spark, d), files)


# --- names ------------------------------------------------------------------------------------------------------------

_AROUND = f"""{_TYPED}, local AS (SELECT * FROM hd WHERE kind <> '2'), near AS (SELECT point_id, arg_min(name, o) AS name, arg_min(kind, o) AS kind, list(name) AS names FROM (SELECT *, ((e - w) * (n - s)) * 100000 - coalesce(try_cast(kind AS INT), 0) * 1000 + file_pos AS o FROM local) GROUP BY 1),
rg AS (SELECT point_id, arg_min(name, (e - w) * (n - s) * 1000 + file_pos) AS name FROM hd WHERE file_pos % 2 = 0 GROUP BY 1), ct AS (SELECT point_id, arg_min(name, (e - w) * (n - s) * 1000 + file_pos) AS name FROM hd WHERE file_pos % 3 = 0 GROUP BY 1),
ctx AS (SELECT pts.point_id, CASE WHEN near.kind NOT IN ('city', 'town', '4') THEN near.name END AS shown, rg.name AS region, coalesce(ct.name, 'R ' || rg.name) AS country, ct.name AS own, near.names FROM pts LEFT JOIN near USING (point_id) LEFT JOIN rg USING (point_id) LEFT JOIN ct USING (point_id)),
inside AS (SELECT point_id, array_to_string(list_filter([shown, region, CASE WHEN country IS DISTINCT FROM shown AND country IS DISTINCT FROM region THEN country END], lambda x : x IS NOT NULL), ', ') AS within,
 list_sort(list_distinct(list_transform(list_filter(list_concat(coalesce(names, []), [region, 'Land ' || region, 'R ' || region, own, 'Land ' || own]), lambda x : x IS NOT NULL), lambda x : lower(x)))) AS context FROM ctx)"""


def _context(spark, d):
    a = _typed(spark, d)
    more = a.withColumns({"names": F.array(F.concat(F.lit("Land "), "name")), "parents": F.array(F.concat(F.lit("R "), "name"))})
    return places.context(D.points(spark, d), a, more.where("file_pos % 2 = 0"), more.where("file_pos % 3 = 0"), "point_id")


@query(f"WITH {_AROUND} SELECT point_id, within, array_to_string(context, '|') AS context FROM inside")
def name_contexts(spark, d):
    """What each point is in, as shown and as a search may qualify it."""
    return _context(spark, d).select("point_id", "within", F.array_join("context", "|").alias("context"))


_ASK = "q AS (SELECT DISTINCT split_part(c_name, '#', 1) || '#' || right(c_name, 9) || CASE WHEN c_custkey % 3 = 0 THEN ', ' || n_name WHEN c_custkey % 3 = 1 THEN ', land ' || n_name ELSE ' ,' END AS query FROM customer JOIN nation ON n_nationkey = c_custkey % 25 UNION SELECT lower(p_brand) || ' x' FROM part)"
_WITHIN = f"""{_AROUND}, {_ASK}, pl AS (SELECT point_id AS place_id, [c_name, 'Brand#' || point_id % 50 || ' x y'] AS aliases, context FROM inside JOIN customer ON c_custkey = point_id),
s AS (SELECT query, trim(split_part(query, ',', 1)) AS name, nullif(lower(trim(CASE WHEN contains(query, ',') THEN substr(query, strpos(query, ',') + 1) ELSE '' END)), '') AS within_ FROM q),
al AS (SELECT place_id, lower(unnest(aliases)) AS a FROM pl), ex AS (SELECT DISTINCT query, place_id, 'exact' AS match FROM s JOIN al ON a = lower(name)),
nr AS (SELECT DISTINCT query, place_id, 'near' AS match FROM s JOIN al ON split_part(a, ' ', 1) = split_part(lower(name), ' ', 1) AND starts_with(a, lower(name) || ' ') WHERE (query, place_id) NOT IN (SELECT (query, place_id) FROM ex)),
mt AS (SELECT u.* FROM (SELECT * FROM ex UNION ALL SELECT * FROM nr) u JOIN s USING (query) JOIN pl USING (place_id) WHERE within_ IS NULL OR list_contains(context, within_)),
fw AS (SELECT query, place_id, match FROM mt WHERE match = 'exact' OR query NOT IN (SELECT query FROM mt WHERE match = 'exact'))"""


def _find_within(spark, d):
    c = D.read(spark, d, "customer")
    n = D.read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"), "n_name")
    k = F.col("c_custkey")
    name = F.concat(F.split_part("c_name", F.lit("#"), F.lit(1)), F.lit("#"), F.expr("right(c_name, 9)"))
    tail = F.when(k % 3 == 0, F.concat(F.lit(", "), "n_name")).when(k % 3 == 1, F.concat(F.lit(", land "), "n_name")).otherwise(" ,")
    asked = c.join(n, k % 25 == F.col("k")).select(F.concat(name, tail).alias("query"))
    asked = asked.union(D.read(spark, d, "part").select(F.concat(F.lower("p_brand"), F.lit(" x"))))
    held = _context(spark, d).join(c, F.col("point_id") == k)
    held = held.select(F.col("point_id").alias("place_id"), F.array("c_name", F.concat(F.lit("Brand#"), (F.col("point_id") % 50).cast("string"), F.lit(" x y"))).alias("aliases"), "context")
    return places.find_within(asked, held)


@query(f"WITH {_WITHIN} SELECT query, place_id, match FROM fw")
def find_within(spark, d):
    """Names qualified by what they are in."""
    return _find_within(spark, d)


@query(f"""WITH {_WITHIN}, f AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY place_id) AS i, count(*) OVER (PARTITION BY query) AS found FROM fw)
SELECT query, any_value(found) AS found, string_agg('  ' || place_id, chr(10) ORDER BY i) FILTER (i <= 12) || CASE WHEN any_value(found) > 12 THEN chr(10) || '  ... and ' || (any_value(found) - 12) || ' more' ELSE '' END AS listing,
 count(*) FILTER (match = 'exact') = 1 AS "unique" FROM f GROUP BY 1""")
def candidate_listing(spark, d):
    return places.listing(_find_within(spark, d).withColumn("shown", F.col("place_id").cast("string")), "query", "shown", "place_id")


_SAME = f"{D.SUPPLIERS}, nm AS (SELECT feature_id % 10 AS name, feature_id, lat, lon, feature_id % 6 AS z FROM sup)"


@query(f"""WITH {_SAME} SELECT a.feature_id AS a, b.feature_id AS b, abs(a.lat - b.lat) < 6 * 360 / 2e0 ** least(a.z, b.z) / 256 AND abs(a.lon - b.lon) < 6 * 360 / 2e0 ** least(a.z, b.z) / 256 AS same
FROM nm a JOIN nm b ON a.name = b.name AND a.feature_id < b.feature_id AND b.feature_id - a.feature_id <= 100""")
def same_places(spark, d):
    n = D.points(spark, d, "supplier", "s_suppkey").select((F.col("point_id") % 10).alias("name"), F.col("point_id").alias("id"), "lat", "lon", (F.col("point_id") % 6).alias("z"))
    pairs = n.alias("a").join(n.alias("b"), (F.col("a.name") == F.col("b.name")) & (F.col("a.id") < F.col("b.id")) & (F.col("b.id") - F.col("a.id") <= 100))
    same = kinds.near_enough(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"), F.least("a.z", "b.z").cast("double"))
    return pairs.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), same.alias("same"))


# --- extents ----------------------------------------------------------------------------------------------------------


@query("""SELECT n_nationkey::BIGINT AS file_pos, round(((n_nationkey * 53 % 130) - 75)::DOUBLE + (n_nationkey * 11 % 30 + 10) * CASE WHEN n_nationkey % 2 = 0 THEN 0.5 ELSE 0.625 END, 9) AS lat,
 round(((n_nationkey * 37 % 300) - 180)::DOUBLE + (n_nationkey * 7 % 40 + 20) * 0.5, 9) AS lon FROM nation""")
def interior_points(spark, d):
    """Rectangles, every other one with a hole about its middle that takes the whole middle row of the lattice."""
    b = D.boxes(spark, d)
    at = lambda y, x: F.struct((F.col("s") + y * (F.col("n") - F.col("s"))).alias("lat"), (F.col("w") + x * (F.col("e") - F.col("w"))).alias("lon"))
    outline = F.col("parts")[0]["outline"]
    hole = F.array(at(0.45, -0.1), at(0.45, 1.1), at(0.55, 1.1), at(0.55, -0.1))
    holes = F.when(F.col("file_pos") % 2 == 1, F.array(hole)).otherwise(F.array().cast("array<array<struct<lat:double,lon:double>>>"))
    a = b.withColumn("parts", F.array(F.struct(outline.alias("outline"), holes.alias("holes"))))
    return places.interior_point(a).select("file_pos", r(F.col("at.lat")).alias("lat"), r(F.col("at.lon")).alias("lon"))


_PARTS = """pt AS (SELECT c_custkey % 60 AS area, c_custkey AS part, (c_custkey * 7919 % 3600) / 1e2 - 18.0::DOUBLE AS w, (c_custkey * 104729 % 3000) / 1e2 + 30.0::DOUBLE AS s,
 (c_custkey * 7919 % 3600) / 1e2 - 18.0::DOUBLE + c_custkey % 7 / 1e1 + 0.1 AS e, (c_custkey * 104729 % 3000) / 1e2 + 30.0::DOUBLE + c_custkey % 5 / 1e1 + 0.1 AS n FROM customer)"""


@query(f"""WITH RECURSIVE {_PARTS}, g AS (SELECT a.area, a.part AS p, b.part AS q FROM pt a JOIN pt b ON a.area = b.area AND a.part <> b.part
 AND sqrt((greatest(0, a.w - b.e, b.w - a.e) * 111.32 * cos(radians(least(greatest(a.s, b.s), least(a.n, b.n))))) ** 2 + (greatest(0, a.s - b.n, b.s - a.n) * 111.32) ** 2) <= 300),
l AS (SELECT area, part FROM (SELECT *, row_number() OVER (PARTITION BY area ORDER BY (e - w) * (n - s) DESC, part) AS i FROM pt) WHERE i = 1),
t(area, part) AS (SELECT area, part FROM l UNION SELECT g.area, g.q FROM t JOIN g ON g.area = t.area AND g.p = t.part)
SELECT area, round(min(w), 9) AS w, round(min(s), 9) AS s, round(max(e), 9) AS e, round(max(n), 9) AS n, count(*)::INT AS shown, any_value(c)::INT AS parts FROM t JOIN pt USING (area, part) JOIN (SELECT area, count(*) AS c FROM pt GROUP BY 1) USING (area) GROUP BY area""")
def main_extents(spark, d):
    k = F.col("c_custkey")
    w, s = k * 7919 % 3600 / F.lit(100.0) - 18.0, k * 104729 % 3000 / F.lit(100.0) + 30.0
    p = D.read(spark, d, "customer").select((k % 60).alias("area"), k.alias("part"), w.alias("w"), s.alias("s"), (w + k % 7 / F.lit(10.0) + 0.1).alias("e"), (s + k % 5 / F.lit(10.0) + 0.1).alias("n"))
    return places.main_extent(p, "area").select("area", *(r(F.col(c)).alias(c) for c in "wsen"), "shown", "parts")


# --- plans and stores -------------------------------------------------------------------------------------------------


@query("SELECT l_suppkey AS grp, min(l_partkey % 15) AS z0, max(l_partkey % 15) AS z1 FROM lineitem GROUP BY 1")
def zoom_ranges(spark, d):
    return planning.zoom_range(D.read(spark, d, "lineitem").select(F.col("l_suppkey").alias("grp"), (F.col("l_partkey") % 15).alias("z")), ["grp"])


_ARCHIVES = [("all", None, None, None, None, 0, 12), ("north", -180.0, 0.0, 180.0, 85.0, 5, 14), ("box", -20.0, -30.0, 60.0, 40.0, 8, 10)]


@query(f"""WITH {D.BOXES}, a AS (SELECT *, (file_pos % 15)::INT AS z FROM box), r AS (SELECT * FROM (VALUES ('all', NULL, NULL, NULL, NULL, 0, 12), ('north', -180e0, 0e0, 180e0, 85e0, 5, 14), ('box', -20e0, -30e0, 60e0, 40e0, 8, 10)) AS t(archive, aw, a_s, ae, an, lo, hi))
SELECT archive, file_pos, greatest(w, coalesce(aw, w)) AS w, greatest(s, coalesce(a_s, s)) AS s, least(e, coalesce(ae, e)) AS e, least(n, coalesce(an, n)) AS n, least(z, hi) AS max_zoom FROM a JOIN r ON z >= lo AND (aw IS NULL OR (e > aw AND w < ae AND n > a_s AND s < an))""")
def capped_areas(spark, d):
    a = D.boxes(spark, d).withColumn("max_zoom", (F.col("file_pos") % 15).cast("int")).select("file_pos", "w", "s", "e", "n", "max_zoom")
    arch = spark.createDataFrame(_ARCHIVES, "archive string, aw double, a_s double, ae double, an double, lo int, hi int")
    return planning.cap_areas(a, arch).select("archive", "file_pos", "w", "s", "e", "n", "max_zoom")


def _span(low: str, high: str, z: str) -> tuple[str, str]:
    top = f"((2 ** {z})::BIGINT - 1)"
    a = f"greatest(0, least({top}, floor({low} * 2 ** {z} + 1e-9)::BIGINT))"
    return a, f"greatest({a}, greatest(0, least({top}, ceil({high} * 2 ** {z} - 1e-9)::BIGINT - 1)))"


_X, _Y = _span(S.wx("w"), S.wx("e"), "z"), _span(S.wy("n"), S.wy("s"), "z")
_SHORT = f"""{D.POINTS}, {D.CELLS}, a AS (SELECT point_id, point_id % 3 AS grp, greatest(-180e0, lon - 1.5) AS w, greatest(-85e0, lat - 1) AS s, least(180e0, lon + 1.5) AS e, least(85e0, lat + 1) AS n, least(greatest(point_id % 12, 1) - 1, 9)::INT AS z FROM pts),
b AS (SELECT *, {_X[0]} AS x0, {_X[1]} AS x1, {_Y[0]} AS y0, {_Y[1]} AS y1 FROM a),
t AS (SELECT point_id, z, unnest(range(x0, x1 + 1)) AS tx, y0, y1 FROM b WHERE z >= 6), u AS (SELECT point_id, z, tx, unnest(range(y0, y1 + 1)) AS ty FROM t),
h AS (SELECT point_id, count(*) FILTER (complete AND zoom_max >= z) AS held FROM u LEFT JOIN cells ON x = tx >> (z - 6) AND y = ty >> (z - 6) GROUP BY 1),
sf AS (SELECT point_id, grp, w, s, e, n, z AS zoom, (x1 - x0 + 1) * (y1 - y0 + 1) AS wanted, coalesce(held, 0) AS held FROM b LEFT JOIN h USING (point_id))"""


def _short(spark, d):
    p = D.points(spark, d).select("point_id", F.greatest(F.lit(-180.0), F.col("lon") - 1.5).alias("w"), F.greatest(F.lit(-85.0), F.col("lat") - 1).alias("s"), F.least(F.lit(180.0), F.col("lon") + 1.5).alias("e"), F.least(F.lit(85.0), F.col("lat") + 1).alias("n"), (F.col("point_id") % 12).cast("int").alias("map_zoom"))
    return planning.shortfall(p, D.cells(spark, d), "point_id", 9, 6)


@query(f"WITH {_SHORT} SELECT point_id, zoom, wanted, held FROM sf")
def terrain_shortfall(spark, d):
    return _short(spark, d).select("point_id", "zoom", "wanted", "held")


@query(f"WITH {_SHORT} SELECT grp, round(min(w), 9) AS w, round(min(s), 9) AS s, round(max(e), 9) AS e, round(max(n), 9) AS n, max(zoom) AS zoom, sum(wanted)::BIGINT AS wanted, sum(held)::BIGINT AS held, bool_or(held < wanted) AS lacking FROM sf GROUP BY 1")
def shortfall_totals(spark, d):
    return planning.shortfall_total(_short(spark, d).withColumn("grp", F.col("point_id") % 3), ["grp"]).select("grp", *(r(F.col(c)).alias(c) for c in "wsen"), "zoom", "wanted", "held", "lacking")


@query(f"""WITH {D.CELLS}, p AS (SELECT l_suppkey % 64 AS x, l_partkey % 64 AS y, max(l_quantity::BIGINT % 16) AS depth FROM lineitem GROUP BY 1, 2)
SELECT x, y, depth IS NOT NULL OR coalesce(complete, false) AS complete, greatest(zoom_max, depth) AS zoom_max FROM cells FULL JOIN p USING (x, y)""")
def settled_cells(spark, d):
    p = D.read(spark, d, "lineitem").select((F.col("l_suppkey") % 64).alias("x"), (F.col("l_partkey") % 64).alias("y"), (F.col("l_quantity").cast("long") % 16).alias("depth"))
    return planning.settle(D.cells(spark, d), p)


@query("""WITH r AS (SELECT l_suppkey AS grp, l_partkey * 1000 AS ro, 400 + l_suppkey % 7 * 100 AS rl FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)), t AS (SELECT l_suppkey AS grp, l_partkey * 1000 + l_linenumber * 150 AS o, l_quantity::BIGINT AS len FROM lineitem)
SELECT t.grp, o AS "offset", len AS length, ro AS range_offset, o - ro AS start FROM t LEFT JOIN r ON t.grp = r.grp AND o >= ro AND o + len <= ro + rl""")
def sliced_tiles(spark, d):
    li = D.read(spark, d, "lineitem")
    ranges = li.select(F.col("l_suppkey").alias("grp"), "l_partkey").distinct().select("grp", (F.col("l_partkey") * 1000).alias("range_offset"), (400 + F.col("grp") % 7 * 100).alias("range_length"))
    tiles = li.select(F.col("l_suppkey").alias("grp"), (F.col("l_partkey") * 1000 + F.col("l_linenumber") * 150).alias("offset"), F.col("l_quantity").cast("long").alias("length"))
    return planning.slice_out(tiles, ranges, "grp")


@query("SELECT DISTINCT l_partkey % 6 AS z, l_suppkey % 32 AS x, l_partkey % 16 AS y FROM lineitem")
def tiles_seen(spark, d):
    return planning.tiles_seen(D.read(spark, d, "lineitem").select((F.col("l_partkey") % 6).alias("z"), (F.col("l_suppkey") % 32).alias("x"), (F.col("l_partkey") % 16).alias("y")))


@query("""WITH p AS (SELECT user_id AS name_id, event_id % 50 AS frame, max(value) AS strength FROM events GROUP BY 1, 2), a AS (SELECT DISTINCT user_id AS name_id, frame FROM events, (VALUES (0), (7), (49), (60)) AS t(frame))
SELECT name_id, frame::BIGINT AS frame, round(coalesce(strength, 0), 6) AS strength FROM a LEFT JOIN p USING (name_id, frame)""")
def name_strengths(spark, d):
    e = D.read(spark, d, "events")
    plan = e.groupBy(F.col("user_id").alias("name_id"), (F.col("event_id") % 50).alias("frame")).agg(F.max("value").alias("strength"))
    asked = e.select(F.col("user_id").alias("name_id")).distinct().withColumn("frame", F.explode(F.array(*(F.lit(k).cast("long") for k in (0, 7, 49, 60)))))
    return ordered.strength_at(plan, asked).select("name_id", "frame", r(F.col("strength"), 6).alias("strength"))


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, sqrt((l_partkey - lag(l_partkey) OVER q) ** 2 + (l_suppkey - lag(l_suppkey) OVER q) ** 2) AS d FROM lineitem WINDOW q AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey))
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(sum(coalesce(d, 0)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING), 6) AS along, round(sum(coalesce(d, 0)) OVER (PARTITION BY l_orderkey), 6) AS length FROM v""")
def path_lengths(spark, d):
    t = D.read(spark, d, "lineitem").withColumn("o", F.struct("l_linenumber", "l_partkey", "l_suppkey"))
    return ordered.path_lengths(t, "l_orderkey", "o", "l_partkey", "l_suppkey").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r(F.col("along"), 6).alias("along"), r(F.col("length"), 6).alias("length"))


# --- OpenStreetMap members --------------------------------------------------------------------------------------------


@query("""WITH m AS (SELECT l_orderkey AS id, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS pos FROM lineitem)
SELECT id, pos::INT AS pos, l_partkey AS way_id, CASE WHEN l_suppkey % 4 = 0 THEN 'inner' ELSE 'outer' END AS role, 2 + p_size % 3 AS points, round((2 + p_size % 3) * (p_partkey % 90)::DOUBLE + CASE p_size % 3 WHEN 0 THEN 0.01 WHEN 1 THEN 0.03 ELSE 0.06 END, 6) AS lat
FROM m JOIN part ON l_partkey = p_partkey WHERE p_partkey % 10 > 0""")
def resolved_relations(spark, d):
    """Members of relations with their ways' points: orders as relations, parts as ways, some of them not in the extract."""
    member = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    rows = D.read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(member)).alias("m"))
    role = lambda m: F.when(m["l_suppkey"] % 4 == 0, "inner").otherwise("outer")
    rel = rows.select(F.col("l_orderkey").alias("id"), F.transform("m", lambda m: F.struct(F.lit("way").alias("type"), m["l_partkey"].alias("id"), role(m).alias("role"))).alias("members"))
    p = D.read(spark, d, "part").where("p_partkey % 10 > 0").withColumn("i", F.sequence(F.lit(0), 1 + F.col("p_size") % 3))
    ways = p.select(F.col("p_partkey").alias("id"), F.transform("i", lambda i: F.col("p_partkey") * 10 + i).alias("refs"))
    nodes = p.select("p_partkey", F.explode("i").alias("i")).select((F.col("p_partkey") * 10 + F.col("i")).alias("id"), (F.col("p_partkey") % 90 + F.col("i") / F.lit(100.0)).alias("lat"), F.lit(0.0).alias("lon"))
    out = osm.resolve(rel, ways, nodes)
    total = F.aggregate("points", F.lit(0.0), lambda s, v: s + v["lat"])
    return out.select("id", "pos", "way_id", "role", F.size("points").alias("points"), r(total, 6).alias("lat"))


