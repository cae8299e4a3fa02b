import math

import pytest
from pyspark.sql import functions as F

from terrane.operators import inspect, names, ordered, osm, planning, spatial

RING = "array<struct<lat:double,lon:double>>"
AREAS = f"file_pos long, name string, kind string, parts array<struct<outline:{RING},holes:array<{RING}>>>"


def square(lat, lon, side):
    return [(lat, lon), (lat, lon + side), (lat + side, lon + side), (lat + side, lon)]


def areas(spark, *rows):
    return spark.createDataFrame([(i, n, k, [([tuple(map(float, p)) for p in square(*s)], [])]) for i, (n, k, s) in enumerate(rows)], AREAS)


def at(spark, lat, lon):
    return spark.createDataFrame([(1, lat, lon)], "point_id long, lat double, lon double")


LEVELS = ["locality", "macrohood", "neighbourhood"]


@pytest.mark.parametrize(
    "rows,point,want",
    [
        ([("Horsens Kommune", "7", (55, 9, 2))], (55.5, 9.5), ("Horsens Kommune", None, None)),
        ([("Hornsby Shire", "6", (-34, 151, 2)), ("Hornsby", "9", (-33.5, 151.5, 0.2))], (-33.45, 151.55), ("Hornsby Shire", None, "Hornsby")),
        ([("Outer", "5", (-34, 151, 4)), ("Middle", "7", (-33.6, 151.4, 1)), ("Inner", "10", (-33.5, 151.5, 0.2))], (-33.45, 151.55), ("Outer", "Middle", "Inner")),
    ],
)
def test_stack_levels(spark, rows, point, want):
    got = {r["level"]: r for r in spatial.levels(at(spark, *point), areas(spark, *rows), "point_id", LEVELS).collect()}
    assert tuple(got[k]["name"] for k in LEVELS) == want
    assert all(got[k]["containment"] == ("Inside" if got[k]["name"] else "Outside") for k in LEVELS)


def test_no_area_is_no_data(spark):
    got = spatial.levels(at(spark, 0.0, 0.0), areas(spark, ("A", "7", (55, 9, 2))), "point_id", LEVELS).collect()
    assert {r["containment"] for r in got} == {"NoData"}


def test_copies_of_an_area_count_once(spark):
    a = areas(spark, ("A", "7", (55, 9, 2)), ("A", "7", (55, 9, 2)))
    assert spatial.stack(spatial.containing(at(spark, 55.5, 9.5), a), "point_id").select("depth", "height", "file_pos").collect() == [(1, 1, 0)]


def test_polar_and_wide_areas_are_found(spark):
    a = areas(spark, ("cap", "2", (86, 10, 3)), ("world", "1", (-90, -180, 90)))
    assert [r["name"] for r in spatial.containing(at(spark, 87.0, 11.0), a).collect()] == ["cap"]


def test_holes(spark):
    rows = [(0, "A", "2", [([(0.0, 0.0), (0.0, 3.0), (3.0, 3.0), (3.0, 0.0)], [[(1.0, 1.0), (1.0, 2.0), (2.0, 2.0), (2.0, 1.0)]])])]
    a = spark.createDataFrame(rows, AREAS)
    p = spark.createDataFrame([(1, 1.5, 1.5), (2, 0.5, 0.5)], "point_id long, lat double, lon double")
    assert [r["point_id"] for r in spatial.containing(p, a).collect()] == [2]


def test_nearest_over_the_antimeridian_and_pole(spark):
    p = spark.createDataFrame([(1, 0.0, 179.9), (2, 89.5, 0.0)], "point_id long, lat double, lon double")
    f = spark.createDataFrame([(1, 0.0, -179.9), (2, 89.5, 180.0)], "feature_id long, lat double, lon double")
    got = spatial.nearest(p, f, "point_id", 120_000.0).select("point_id", "feature_id").collect()
    assert sorted(map(tuple, got)) == [(1, 1), (2, 2)]


def test_rank_goes_before_distance(spark):
    f = spark.createDataFrame([(1, 0.001, 0.0, 2), (2, 0.009, 0.0, 0)], "feature_id long, lat double, lon double, r int")
    assert spatial.nearest(at(spark, 0.0, 0.0), f, "point_id", 5000.0, rank=F.col("r")).first()["feature_id"] == 2


@pytest.mark.parametrize(
    "ways,want",
    [
        ([(None, "path", 1), ("Main Road", "major_road", 25)], None),
        ([(None, "path", 1), ("Main Road", "major_road", 8)], "Main Road"),
        ([("Main Road", "major_road", 1), (None, "path", 20)], "Main Road"),
        ([("B", "aeroway", 1)], None),
        ([("Network Base", "rail", 1), ("Station Street", "minor_road", 9)], "Station Street"),
        ([("Creek Path", "path", 1), ("Main Road", "major_road", 25)], "Creek Path"),
    ],
)
def test_on_way(spark, ways, want):
    d = spark.createDataFrame([(1, k, n, float(m)) for n, k, m in ways], "point_id long, kind string, name string, distance double")
    got = spatial.on_way(d, "point_id", 50.0).collect()
    assert (got[0]["name"] if got else None) == want


def test_labels_from_neighbours(spark):
    a = spark.createDataFrame([(7, 14, 0, 5), (8, 14, 3, 5)], "fid long, z int, x long, y long")
    n = spark.createDataFrame([(7, 2**14 - 1, 5, "west", 0), (7, 1, 5, "east", 0), (8, 9, 9, "far", 0)], "fid long, x long, y long, name string, pos int")
    assert {r["fid"]: r["label"] for r in spatial.labels_for(a, n).collect()} == {7: "west", 8: None}


def test_coalesce(spark):
    rows = [(1, 0, 10), (1, 5, 10), (1, 20, 5), (1, 500, 10), (2, 0, 60), (2, 50, 60), (2, 111, 5)]
    t = spark.createDataFrame(rows, "g int, offset long, length long")
    got = sorted(map(tuple, ordered.coalesce_ranges(t, ["g"], 10, 100).collect()))
    assert got == [(1, 0, 25), (1, 500, 10), (2, 0, 110), (2, 111, 5)]  # overlapping ranges merge past the cap


def test_running_total(spark):
    t = spark.range(100).select("id", F.lit(2).alias("v"))
    got = ordered.running_total(t, F.floor(F.col("id") / 7), ["id"], "v").orderBy("id").select("running").collect()
    assert [r[0] for r in got] == list(range(2, 202, 2))


def test_smoothed_pads_both_ends(spark):
    t = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([3, 0, 0, 6])], "k int, i int, v double")
    got = ordered.smoothed(t, "k", "i", "v", 2).orderBy("i").collect()
    assert [r["smooth"] for r in got] == pytest.approx([9 / 5, 12 / 5, 15 / 5, 18 / 5])


def test_longest_run_and_change(spark):
    t = spark.createDataFrame([(1, i, v) for i, v in enumerate([1.0, 1.0, 0.0, 1.0, 1.0, 1.0])] + [(2, 0, 0.0)], "k int, i int, v double")
    assert sorted(map(tuple, ordered.longest_run(t, "k", "i", F.col("v") >= 0.5).collect())) == [(1, 3), (2, 0)]
    assert sorted(map(tuple, ordered.total_change(t, "k", "i", "v").collect())) == [(1, 2.0), (2, 0.0)]


def test_percentile_is_a_floor(spark):
    t = spark.range(20).select(F.lit(1).alias("k"), F.col("id").alias("v"))
    assert ordered.percentile_step(t, "k", "v").first()["step"] == 19


@pytest.mark.parametrize(
    "values,span,least,want",
    [
        ([0, 2, 0, 2, 0, 2, 4, 4, 4, 4, 8], [1] * 10, 4, [(0, 4, 1), (4, 10, 22 / 6)]),
        ([10, 10, 0, 0, 0], [3, 0.1, 0.1, 0.1], 100, [(0, 4, 30.5 / 3.3)]),
        ([1, 1, 1, math.nan, math.nan, math.nan, 5, 5, 5], [1] * 8, 0.5, None),
    ],
)
def test_gradient(spark, values, span, least, want):
    t = spark.createDataFrame([(1, i, float(s), float(v)) for i, (v, s) in enumerate(zip(values, [*span, 0], strict=True))], "line_id int, pos int, span double, value double")
    got = [tuple(r)[1:] for r in ordered.gradient_pieces(t, least=float(least)).orderBy("first").collect()]
    if want is None:
        assert any(v is None for _, _, v in got) and got[0][0] == 0 and got[-1][1] == 8
    else:
        assert got == [(a, b, pytest.approx(v)) for a, b, v in want]


def test_lookup_by_runs(spark):
    d = spark.createDataFrame([(5, 0, 10, 3), (8, 10, 20, 0), (300, 900, 5, 1), (301, 905, 7, 1), (65530, 1, 1, 20)], "tile_id long, offset long, length long, run_length long")
    w = spark.createDataFrame([(i,) for i in (4, 5, 7, 8, 300, 301, 65549, 65550)], "tile_id long")
    got = {r["tile_id"]: r["entry_id"] for r in planning.lookup(w, d).collect()}
    assert got == {4: None, 5: 5, 7: 5, 8: None, 300: 300, 301: 301, 65549: 65530, 65550: None}


def test_held_counts_complete_cells(spark):
    n = 2**12
    lon = lambda x: x / n * 360 - 180
    lat = lambda y: math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * y / n))))
    box = spark.createDataFrame([(1, lon(2000), lat(1501), lon(2001), lat(1500))], "a int, w double, s double, e double, n double")
    cells = spark.createDataFrame([(2000, 1500, True, 14)], "x long, y long, complete boolean, zoom_max int")
    got = [tuple(planning.held_at(box, cells, "a", z).first())[1:] for z in (12, 13, 14, 15)]
    assert got == [(1, 1), (4, 4), (16, 16), (0, 64)]
    assert planning.coverage(box, cells, "a").first()["fraction"] == 1.0


def test_eviction_skips_what_is_in_use(spark):
    rows = [("a", x, 0, f"2024-01-0{x + 1} 00:00:00", 10, x == 0) for x in range(5)]
    t = spark.createDataFrame(rows, "source_id string, x int, y int, last_used string, bytes long, in_use boolean").withColumn("last_used", F.to_timestamp("last_used"))
    assert sorted(r["x"] for r in planning.evict(t, 35, 50).collect()) == [1, 2]


def test_walk_up(spark):
    w = spark.createDataFrame([(3, 5, 6), (3, 0, 0)], "z int, x long, y long")
    h = spark.createDataFrame([(1, 1, 1), (2, 2, 3)], "z int, x long, y long")
    assert {(r["x"], r["hz"]) for r in spatial.walk_up(w, h).collect()} == {(5, 2), (0, None)}


def osm_tables(spark, ways, members, nodes=((1, 55.70, 9.50), (2, 55.70, 9.60), (3, 55.80, 9.60), (4, 55.80, 9.50))):
    n = spark.createDataFrame([(*x, {}) for x in nodes], "id long, lat double, lon double, tags map<string,string>")
    w = spark.createDataFrame([(i, r, {}) for i, r in ways], "id long, refs array<long>, tags map<string,string>")
    tags = {"boundary": "administrative", "admin_level": "8", "name": "Horsens"}
    r = spark.createDataFrame([(100, [("way", i, role) for i, role in members], tags)], "id long, members array<struct<type:string,id:long,role:string>>, tags map<string,string>")
    return r, w, n


def test_two_ways_make_a_ring(spark):
    r, w, n = osm_tables(spark, [(10, [1, 2, 3]), (11, [3, 4, 1])], [(10, "outer"), (11, "outer"), (12, "outer")])
    got = osm.assemble(osm.resolve(osm.boundaries(r), w, n)).first()
    assert (got["outlines"], got["holes"], got["open_chains"], len(got["parts"][0]["outline"])) == (1, 0, 0, 4)


def test_an_open_chain_is_no_ring(spark):
    r, w, n = osm_tables(spark, [(10, [1, 2, 3])], [(10, "outer")])
    a = osm.assemble(osm.resolve(r, w, n))
    assert tuple(osm.report(a).first())[:3] == (0, 0, 1)


def test_holes_find_their_outline(spark):
    nodes = [(i * 4 + k, float(y), float(x)) for i, (a, b, s) in enumerate([(0, 0, 9), (2, 2, 1), (20, 20, 1)]) for k, (y, x) in enumerate(square(a, b, s))]
    ways = [(i, [i * 4, i * 4 + 1, i * 4 + 2, i * 4 + 3, i * 4]) for i in range(3)]
    r, w, n = osm_tables(spark, ways, [(0, "outer"), (1, "inner"), (2, " Enclave")], nodes)
    got = osm.assemble(osm.resolve(r, w, n)).first()
    assert (got["outlines"], got["holes"], got["orphans"]) == (1, 1, 1)


def test_a_missing_node_is_an_error(spark):
    r, w, n = osm_tables(spark, [(10, [1, 2, 99])], [(10, "outer")])
    with pytest.raises(Exception, match="missing node 99"):
        osm.resolve(r, w, n).collect()


def test_find_suppresses_near(spark):
    p = spark.createDataFrame([(1, "country", "Luxembourg", ["Luxembourg"]), (2, "region", "Luxembourg District", ["Luxembourg District"]), (3, "region", "Lux", ["Luxembourg"])], "place_id int, level string, name string, aliases array<string>")
    q = spark.createDataFrame([("luxembourg",), ("Lux",)], "query string")
    got = {(r["query"], r["place_id"], r["match"]) for r in names.find(q, p).collect()}
    assert got == {("luxembourg", 1, "exact"), ("luxembourg", 3, "exact")}


def test_place_points(spark):
    t = spark.createDataFrame([("A", 0.0, 0.0, 0), ("A", 0.0, 0.005, 1), ("A", 0.0, 0.5, 2), ("B", 0.0, 0.0, 3), ("", 0.0, 0.0, 4)], "name string, lat double, lon double, pos int")
    assert sorted(r["pos"] for r in names.place_points(t).collect()) == [0, 2, 3]


def test_chains(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "a")], "a string, b string")
    got = names.chains(e, spark.createDataFrame([("a",)], "node string")).collect()
    assert {(r["node"], r["steps"]) for r in got} == {("a", 0), ("b", 1), ("c", 1)}


def test_name_plan(spark):
    rows = [("long", i, 1.0) for i in range(5)] + [("short", i, float(i == 2)) for i in range(5)]
    got = names.plan(spark.createDataFrame(rows, "name_id string, frame int, alpha double"), 1, 3)
    assert {r["name_id"] for r in got.collect()} == {"long"}


def test_labels_do_not_overlap(spark):
    rows = [("v", k, p, 0, k, x, 0, x + 10, 5) for k, (p, x) in enumerate([(1, 0), (2, 5), (1, 20)])]
    c = spark.createDataFrame(rows, "view_id string, key int, priority int, rank int, nth int, x0 int, y0 int, x1 int, y1 int")
    assert sorted(r["key"] for r in inspect.place_labels(c).collect()) == [1, 2]


def test_geojson_text(spark):
    ring = F.array(*(F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in ((0, 0), (1, 0), (1, 1))))
    tags = F.create_map(F.lit("b"), F.lit('say "x"'), F.lit("a"), F.lit("1"))
    got = spark.range(1).select(inspect.ring_json(ring), inspect.properties_json(F.lit("roads"), F.lit(7), tags)).first()
    assert got[0] == "[[1.0,1.0],[1.0,0.0],[0.0,0.0],[1.0,1.0]]"
    assert got[1] == '{"@layer":"roads","@id":7,"a":"1","b":"say \\"x\\""}'


def test_split_areas(spark):
    rows = [(i, i, lon, 10.0, lon + 0.01, 10.01) for i, lon in enumerate((0.0, 0.0, 50.0, 100.0))]
    t = spark.createDataFrame(rows, "area_id int, pos int, w double, s double, e double, n double")
    got = {r["area_id"]: r["batch"] for r in planning.split_areas(t, 2).collect()}
    assert got[0] == got[1] == 0 and got[3] >= 1


def test_joins_are_not_nested_loops(spark):
    plan = spatial.containing(at(spark, 1.0, 1.0), areas(spark, ("A", "7", (0, 0, 2))))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
