"""Queries about features, names, views and palettes that are drawn."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import colour, kinds
from ..functions import mercator as M
from ..functions import view as V
from ..operators import draw, inspect, lines, style
from . import derive as D
from . import sql as S
from .queries import _CIEDE
from .registry import query, r


@query("""WITH v AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 50 ELSE 100 END AS g, p_partkey::BIGINT * 104729123 % 2000000000 - 1000000000 AS lat, p_partkey::BIGINT * 79197919 % 4000000000 - 2000000000 AS lon, (p_size - 25)::BIGINT * 1000000000 AS blat, (p_size - 25)::BIGINT * 2000000000 AS blon FROM part)
SELECT p_partkey, abs(lat) <= 90000000000 // g AND abs(lon) <= 180000000000 // g AND abs(blat + g * lat) <= 90000000000 AND abs(blon + g * lon) <= 180000000000 AS held FROM v""")
def nodes_on_earth(spark, d):
    k, s = F.col("p_partkey").cast("long"), F.col("p_size").cast("long")
    step = F.when(k % 3 == 0, F.lit(50)).otherwise(F.lit(100)).cast("long")
    lat, lon = k * 104729123 % 2000000000 - 1000000000, k * 79197919 % 4000000000 - 2000000000
    return D.read(spark, d, "part").select("p_partkey", kinds.on_earth(lat, lon, step, (s - 25) * 10**9, (s - 25) * 2 * 10**9).alias("held"))


@query(f"""WITH {D.POINTS}, t AS (SELECT DISTINCT 'places' AS layer, z, (s_suppkey * 31 % 2 ** z)::BIGINT AS x, (s_suppkey * 17 % 2 ** z)::BIGINT AS y, 4096 AS extent FROM supplier, (VALUES (2), (4)) AS v(z)),
p AS (SELECT point_id, {S.wx('lon')} AS wx, {S.wy('lat')} AS wy FROM pts WHERE point_id % 3 > 0)
SELECT point_id, z, x, y, floor((wx * 2 ** z - x) * extent)::INT AS px, floor((wy * 2 ** z - y) * extent)::INT AS py FROM p, t WHERE floor(wx * 2 ** z)::BIGINT = x AND floor(wy * 2 ** z)::BIGINT = y""")
def extra_places(spark, d):
    """Places that a caller adds to tiles; those of another layer are in none."""
    p = D.points(spark, d).withColumn("layer", F.when(F.col("point_id") % 3 > 0, "places").otherwise("roads"))
    k = F.col("s_suppkey")
    t = D.read(spark, d, "supplier").select(k, F.explode(F.array(F.lit(2), F.lit(4))).alias("z"))
    t = t.select(F.lit("places").alias("layer"), "z", *((k * m % M.side(F.col("z")).cast("long")).cast("long").alias(c) for c, m in (("x", 31), ("y", 17))), F.lit(4096).alias("extent")).distinct()
    return style.extra_features(p, t).select("point_id", "z", "x", "y", "px", "py")


@query(f"WITH {D.BOXES} SELECT file_pos AS fid, round(({S.wx('e')} - {S.wx('w')}) * ({S.wy('s')} - {S.wy('n')}), 9) AS area FROM box")
def measured_areas(spark, d):
    """Rectangles in pieces, each tile's reaching over its edges."""
    z, extent = 4, 4096
    b = D.boxes(spark, d).select(F.col("file_pos").alias("fid"), M.world_x(F.col("w")).alias("x0"), M.world_x(F.col("e")).alias("x1"), M.world_y(F.col("n")).alias("y0"), M.world_y(F.col("s")).alias("y1"))
    for axis in "xy":
        b = b.withColumn(axis, F.explode(F.sequence(*M.span(F.col(f"{axis}0"), F.col(f"{axis}1"), z))))
    spot = lambda x, y: F.struct(((F.col(x) * 2**z - F.col("x")) * extent).alias("x"), ((F.col(y) * 2**z - F.col("y")) * extent).alias("y"))
    ring = F.array(spot("x0", "y0"), spot("x1", "y0"), spot("x1", "y1"), spot("x0", "y1"))
    none = F.array().cast("array<array<struct<x:double,y:double>>>")
    f = b.select(F.lit(z).alias("z"), "x", "y", F.lit(extent).alias("extent"), "fid", F.array(F.struct(ring.alias("exterior"), none.alias("holes"))).alias("polygons"))
    return draw.measured_areas(f).select("fid", r(F.col("area")).alias("area"))


@query(f"WITH {D.POINTS} SELECT point_id, point_id % 8 AS x, point_id * 5 % 8 AS y FROM pts WHERE floor({S.wx('lon')} * 8)::BIGINT = point_id % 8 AND floor({S.wy('lat')} * 8)::BIGINT = point_id * 5 % 8")
def own_names(spark, d):
    k = F.col("point_id")
    n = D.points(spark, d).withColumns({"z": F.lit(3), "x": k % 8, "y": k * 5 % 8})
    return inspect.own_names(n).select("point_id", "x", "y")


_LINE = "SELECT l_orderkey, list({'x': l_partkey % 4096, 'y': l_suppkey * 37 % 4096} ORDER BY l_linenumber, l_partkey, l_suppkey) AS v FROM lineitem GROUP BY 1"


def _paths(spark, d):
    v = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    g = D.read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(v)).alias("v"))
    return g.withColumn("v", F.transform("v", lambda p: F.struct((p["l_partkey"] % 4096).cast("double").alias("x"), (p["l_suppkey"] * 37 % 4096).cast("double").alias("y"))))


_MID = "coalesce(v[len(v) // 2 + 1].{}, 2048)"


@query(f"""WITH l AS ({_LINE}), k AS (SELECT l_orderkey, CASE WHEN l_orderkey % 7 > 0 THEN v END AS v FROM l), w AS (SELECT l_orderkey, (l_orderkey % 64 + {_MID.format('x')} / 4096e0) / 64 AS wx, (l_orderkey * 3 % 64 + {_MID.format('y')} / 4096e0) / 64 AS wy FROM k)
SELECT l_orderkey, round(wx * 360 - 180, 9) AS lon, round({S.latitude('wy')}, 9) AS lat FROM w""")
def line_middles(spark, d):
    k = F.col("l_orderkey")
    parts = F.when(k % 7 > 0, F.array("v")).otherwise(F.array().cast("array<array<struct<x:double,y:double>>>"))
    lon, lat = lines.middle(parts, 6, k % 64, k * 3 % 64, F.lit(4096.0))
    return _paths(spark, d).select("l_orderkey", r(lon).alias("lon"), r(lat).alias("lat"))


@query("SELECT l_orderkey, min(l_partkey % 4096)::DOUBLE AS x0, min(l_suppkey * 37 % 4096)::DOUBLE AS y0, max(l_partkey % 4096)::DOUBLE AS x1, max(l_suppkey * 37 % 4096)::DOUBLE AS y1 FROM lineitem GROUP BY 1")
def path_bounds(spark, d):
    return _paths(spark, d).select("l_orderkey", lines.bounds(F.col("v")).alias("b")).select("l_orderkey", "b.*")


@query("SELECT s_nationkey, CASE WHEN count(*) FILTER (s_suppkey % 5 = 0) > 0 THEN 'Elevation: © them, http://list' ELSE '' END AS credit FROM supplier GROUP BY 1")
def short_credits(spark, d):
    ids = F.collect_list(F.when(F.col("s_suppkey") % 5 == 0, F.col("s_name")))
    return D.read(spark, d, "supplier").groupBy("s_nationkey").agg(ids.alias("ids")).select("s_nationkey", kinds.short_credit(F.col("ids"), "them", "http://list").alias("credit"))


@query("""WITH v AS (SELECT p_partkey, (p_partkey * 37 % 256)::INT AS c, (p_size * 5 % 256)::INT AS dark, CASE WHEN p_partkey % 6 > 0 THEN (p_size * 29 % 256)::INT END AS light, CASE WHEN p_partkey % 11 > 0 THEN ((p_partkey * 7 % 201) - 100) / 1e2 END AS a FROM part)
SELECT p_partkey, CASE WHEN a IS NULL OR a = 0 OR (a > 0 AND light IS NULL) THEN c WHEN a < 0 THEN floor(c + (dark - c) * (-a * 0.45e0) + 0.5)::INT ELSE floor(c + (light - c) * (a * 0.45e0) + 0.5)::INT END AS shade FROM v""")
def relief_tints(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    amount = F.when(k % 11 > 0, (k * 7 % 201 - 100) / F.lit(100.0))
    return D.read(spark, d, "part").select("p_partkey", colour.shaded(k * 37 % 256, amount, s * 5 % 256, F.when(k % 6 > 0, s * 29 % 256)).alias("shade"))


@query("""WITH v AS (SELECT p_partkey, (p_size * 3 + 1)::DOUBLE AS w, (p_partkey % 90 + 1)::DOUBLE AS h, (p_partkey % 50 + 1) * 1e3 AS dist, 30e0 + p_size % 40 AS fov, p_partkey % 1000 AS ih, CASE WHEN p_partkey % 4 = 0 THEN 300 + p_size ELSE 0 END AS side FROM part),
l AS (SELECT *, CASE WHEN side > 0 THEN side::DOUBLE ELSE floor(least(8192e0, greatest(512e0, greatest(w, h) * 1000 / (2 * dist * tan(radians(fov) / 2) / greatest(ih, 1))))) END AS n FROM v),
t AS (SELECT *, greatest(1, floor(n * least(w, h) / greatest(w, h)))::INT AS m FROM l)
SELECT p_partkey, CASE WHEN w > h THEN n::INT ELSE m END AS width, CASE WHEN w > h THEN m ELSE n::INT END AS height FROM t""")
def drape_sizes(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    w, h = V.drape_size((s * 3 + 1).cast("double"), (k % 90 + 1).cast("double"), (k % 50 + 1) * 1000.0, 30.0 + s % 40, k % 1000, F.when(k % 4 == 0, 300 + s).otherwise(0))
    return D.read(spark, d, "part").select("p_partkey", w.alias("width"), h.alias("height"))


def _snap(low: str, high: str) -> tuple[str, str]:
    c = "0.007e0"
    a, b = f"((floor({low} / {c} + 0.5) - 0.5) * {c})", f"((ceil({high} / {c} - 0.5) + 0.5) * {c})"
    return f"(CASE WHEN {a} < 0 THEN {a} + ceil(-{a} / {c}) * {c} ELSE {a} END)", f"(CASE WHEN {b} > 1 THEN {b} - ceil(({b} - 1) / {c}) * {c} ELSE {b} END)"


_SX, _SY = _snap(S.wx("w"), S.wx("e")), _snap(S.wy("n"), S.wy("s"))


@query(f"""WITH {D.BOXES}, q AS (SELECT file_pos, {_SX[0]} AS x0, {_SX[1]} AS x1, {_SY[0]} AS y0, {_SY[1]} AS y1 FROM (SELECT file_pos, w, s, CASE WHEN file_pos % 6 = 0 THEN w + 1 ELSE e END AS e, n FROM box)),
z AS (SELECT *, round((x1 - x0) / 0.007e0) AS c, round((y1 - y0) / 0.007e0) AS k FROM q)
SELECT file_pos, round(CASE WHEN c >= 2 AND k >= 2 THEN x0 * 360 - 180 END, 7) AS w, round(CASE WHEN c >= 2 AND k >= 2 THEN {S.latitude('y1')} END, 7) AS s, round(CASE WHEN c >= 2 AND k >= 2 THEN x1 * 360 - 180 END, 7) AS e, round(CASE WHEN c >= 2 AND k >= 2 THEN {S.latitude('y0')} END, 7) AS n,
 CASE WHEN c >= 2 AND k >= 2 THEN (c * 16)::INT END AS width, CASE WHEN c >= 2 AND k >= 2 THEN (k * 16)::INT END AS height FROM z""")
def lattice_views(spark, d):
    """Views grown to a lattice of the ground; some are too narrow for it."""
    b = D.boxes(spark, d).select("file_pos", "w", "s", F.when(F.col("file_pos") % 6 == 0, F.col("w") + 1).otherwise(F.col("e")).alias("e"), "n")
    out = V.on_lattice(0.007, 16)
    return b.select("file_pos", *((r(c, 7) if k in "wsen" else c).alias(k) for k, c in out.items()))


@query("""WITH v AS (SELECT l_orderkey, list({'x': (l_partkey % 2000)::DOUBLE, 'y': (l_suppkey * 37 % 2000)::DOUBLE}) FILTER (l_linenumber < 4 AND l_orderkey % 5 > 0) AS o, max(l_quantity)::DOUBLE * 10 AS width FROM lineitem GROUP BY 1)
SELECT l_orderkey, CASE WHEN o IS NULL THEN false WHEN l_orderkey % 2 = 0 THEN true ELSE len(list_filter(o, lambda p : sqrt((p.x - l_orderkey % 2000) ** 2 + (p.y - 1000) ** 2) < greatest(600, width * 4))) > 0 END AS near FROM v""")
def repeated_names(spark, d):
    k = F.col("l_orderkey")
    spot = F.struct((F.col("l_partkey") % 2000).cast("double").alias("x"), (F.col("l_suppkey") * 37 % 2000).cast("double").alias("y"))
    g = D.read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.when((F.col("l_linenumber") < 4) & (k % 5 > 0), spot)).alias("o"), (F.max("l_quantity").cast("double") * 10).alias("width"))
    return g.select("l_orderkey", inspect.too_near(F.col("o"), (k % 2000).cast("double"), F.lit(1000.0), k % 2 == 1, F.col("width")).alias("near"))


_ROLES = [["background"], ["context", "underfoot", "distinct"], ["context", "underfoot", "distinct"], ["overlay"], ["label", "distinct"], ["gap"], ["context", "underfoot", "distinct"], ["road"]]
_LAB = ", ".join(f"({' + '.join(f'{k} * n{c}' for k, c in zip(row, 'rgb', strict=True))}) / {white} AS t{i}" for i, (row, white) in enumerate(zip(colour.RGB_XYZ, colour.WHITE, strict=True)))
_F = "CASE WHEN t{0} > 216 / 24389e0 THEN cbrt(t{0}) ELSE (t{0} * (24389 / 27e0) + 16) / 116 END AS f{0}"


@query(f"""WITH ink AS (SELECT p_partkey // 8 AS palette, lpad(p_partkey::VARCHAR, 9, '0') AS name, {_ROLES}[p_partkey % 8 + 1] AS roles, p_size % 5 AS edge, p_partkey * 37 % 256 AS r, p_size * 29 % 256 AS g, p_partkey * 91 % 256 AS b FROM part),
x AS (SELECT *, {', '.join(f'{S.linear(c, 0.04045)} AS n{c}' for c in 'rgb')}, {S.luminance('r', 'g', 'b')} AS y FROM ink), xyz AS (SELECT *, {_LAB} FROM x), lf AS (SELECT *, {', '.join(_F.format(i) for i in range(3))} FROM xyz),
k AS (SELECT *, 116 * f1 - 16 AS ll, 500 * (f0 - f1) AS la, 200 * (f1 - f2) AS lb FROM lf),
v AS (SELECT {{'p': a.palette, 'a': a.name, 'b': z.name}} AS p_partkey, a.ll AS l1, a.la AS a1, a.lb AS b1, z.ll AS l2, z.la AS a2, z.lb AS b2 FROM k AS a JOIN k AS z ON a.palette = z.palette AND a.name < z.name AND a.edge <> z.edge WHERE list_contains(a.roles, 'distinct') AND list_contains(z.roles, 'distinct')),
{_CIEDE[_CIEDE.index('c AS (SELECT'):]},
e AS (SELECT a.palette, fault, a.name, z.name AS other, (greatest(a.y, z.y) + 0.05) / (least(a.y, z.y) + 0.05) AS value, least_, most_ FROM (VALUES ('context', 'background', 'loud', 0, 4.5), ('overlay', 'underfoot', 'lost', 3, 99), ('label', 'background', 'unreadable', 4.5, 99), ('label', 'road', 'unreadable', 4.5, 99), ('gap', 'background', 'gap unseen', 3, 99)) AS t(ra, rb, fault, least_, most_)
 JOIN k AS a ON list_contains(a.roles, ra) JOIN k AS z ON list_contains(z.roles, rb) AND a.palette = z.palette)
SELECT palette, fault, name, other, round(value, 5) AS value FROM e WHERE value < least_ OR value > most_
UNION ALL SELECT p_partkey.p, 'alike', p_partkey.a, p_partkey.b, round(d, 5) FROM (SELECT p_partkey, sqrt(x * x + y * y + z * z + rt * y * z) AS d FROM u) WHERE d < 6
UNION ALL SELECT palette, 'saturated', name, NULL, round(sqrt(la * la + lb * lb), 5) FROM k WHERE list_contains(roles, 'context') AND sqrt(la * la + lb * lb) > 32""")
def contrast_faults(spark, d):
    """What is wrong with palettes: eight inks each."""
    k, s = F.col("p_partkey"), F.col("p_size")
    roles = F.get(F.array(*(F.array(*map(F.lit, x)) for x in _ROLES)), (k % 8).cast("int"))
    inks = D.read(spark, d, "part").select(F.floor(k / 8).alias("palette"), F.lpad(k.cast("string"), 9, "0").alias("name"), roles.alias("roles"), (s % 5).alias("edge"), (k * 37 % 256).alias("r"), (s * 29 % 256).alias("g"), (k * 91 % 256).alias("b"))
    return style.contrast_faults(inks).select("palette", "fault", "name", "other", r(F.col("value"), 5).alias("value"))
