import math

import pytest
from pyspark.sql import functions as F

from terrane.functions import colour, geo, text, tileid
from terrane.functions import mercator as M


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


@pytest.mark.parametrize("lon,lat,x,y", [(0.0, 0.0, 0.5, 0.5), (-180.0, M.MAX_LAT, 0, 0), (180.0, -M.MAX_LAT, 1, 1), (90.0, 0.0, 0.75, 0.5), (0.0, 89.9, 0.5, 0)])
def test_project(spark, lon, lat, x, y):
    assert one(spark, M.world_x(F.lit(lon)), M.world_y(F.lit(lat))) == pytest.approx((x, y), abs=1e-9)


def test_unproject_inverts(spark):
    assert one(spark, M.longitude(M.world_x(F.lit(12.5))), M.latitude(M.world_y(F.lit(55.7)))) == pytest.approx((12.5, 55.7), abs=1e-9)


def test_bad_coordinates_have_no_tile(spark):
    assert one(spark, *M.tile_at(3, F.lit(float("nan")), F.lit(0.0)), *M.tile_at(3, F.lit(0.0), F.lit(91.0))) == (None,) * 4


@pytest.mark.parametrize("z,x,y,tid", [(0, 0, 0, 0), (1, 0, 0, 1), (1, 0, 1, 2), (1, 1, 1, 3), (1, 1, 0, 4), (2, 0, 0, 5), (12, 3423, 1763, 19078479)])
def test_tile_ids(spark, z, x, y, tid):
    assert one(spark, tileid.tile_id(F.lit(z), F.lit(x), F.lit(y)))[0] == tid
    assert tuple(one(spark, tileid.tile_of(F.lit(tid).cast("long")))[0]) == (z, x, y)


def test_ids_run_over_the_zoom(spark):
    tiles = spark.range(64).select((F.col("id") % 8).alias("x"), F.floor(F.col("id") / 8).alias("y"))
    ids = sorted(r[0] for r in tiles.select(tileid.tile_id(F.lit(3), F.col("x"), F.col("y"))).collect())
    assert ids == list(range(21, 85))


def test_deepest_zoom_fits(spark):
    n = 2**31 - 1
    tid = one(spark, tileid.tile_id(F.lit(31), F.lit(n), F.lit(n)))[0]
    assert tuple(one(spark, tileid.tile_of(F.lit(tid)))[0]) == (31, n, n)


def test_zigzag(spark):
    for v, w in ((0, 0), (-1, 1), (1, 2), (-2, 3), (-(2**62), 2**63 - 1)):
        assert one(spark, tileid.zigzag(F.lit(v)), tileid.unzigzag(F.lit(w))) == (w, v)


def square(lat, lon, side):
    return F.array(*(F.struct(F.lit(float(y)).alias("lat"), F.lit(float(x)).alias("lon")) for y, x in ((lat, lon), (lat, lon + side), (lat + side, lon + side), (lat + side, lon))))


def test_ring_and_hole(spark):
    outline, hole = square(54, 8, 4), F.array(square(55, 9, 1))
    at = lambda y, x: geo.in_polygon(outline, hole, F.lit(y), F.lit(x))
    assert one(spark, at(56.5, 10.5), at(55.5, 9.5), at(60.0, 10.0), at(56.0, 30.0)) == (True, False, False, False)


def test_short_rings_hold_nothing(spark):
    assert one(spark, geo.in_ring(F.slice(square(0, 0, 1), 1, 2), F.lit(0.5), F.lit(0.5)))[0] is False


def test_distances(spark):
    quarter = math.pi / 2 * geo.RADIUS
    assert one(spark, geo.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0)))[0] == pytest.approx(quarter)
    assert one(spark, geo.to_segment(*map(F.lit, (0.0, 1.0, -1.0, 0.0, 1.0, 0.0))), geo.to_segment(*map(F.lit, (3.0, 0.0, 1.0, 0.0, 1.0, 0.0)))) == (1.0, 2.0)


def test_depth_bands_include_their_edges(spark):
    deep = lambda km: geo.depth_for(F.lit(0.0), F.lit(0.0), F.lit(km / geo.KM_DEGREE), F.lit(0.0), 15)
    assert one(spark, deep(24.9), deep(79.9), deep(249.9), deep(251.0), geo.depth_for(*map(F.lit, (0.0, 0.0, 0.01, 0.01)), 11)) == (15, 14, 13, 5, 11)


def test_text(spark):
    credit = text.plain_credit(F.lit('<a href="x">&copy; OpenStreetMap</a>'))
    assert one(spark, credit, text.plain_credit(F.lit("&amp;copy; Someone")), text.plain_credit(F.lit("a<br>b")), text.plain_credit(F.lit("a < b"))) == ("© OpenStreetMap", "&copy; Someone", "a b", "a < b")
    assert one(spark, text.human_bytes(F.lit(1023)), text.human_bytes(F.lit(1536))) == ("1023 bytes", "1.5 KiB")
    assert one(spark, text.human_distance(F.lit(999.4)), text.human_distance(F.lit(2000.0)), text.human_distance(F.lit(2340.0)), text.human_distance(F.lit(12400.0))) == ("999 m", "2 km", "2.3 km", "12 km")
    assert one(spark, text.format_coordinate(F.lit(-0.0)), text.format_coordinate(F.lit(12.5)), text.format_coordinate(F.lit(100.0))) == ("0", "12.5", "100")
    assert one(spark, text.redact(F.lit("https://u:p@h/x?key=1#f")), text.redact(F.lit("https://h/x"))) == ("https://redacted@h/x?redacted", "https://h/x")
    assert [one(spark, text.admin_level(F.lit(v)))[0] for v in ("7", "+7", " 7", "7.0", "0", "13")] == [7, 7, None, None, None, None]
    assert one(spark, text.first_name([F.lit("DENMARK"), F.lit(None).cast("string"), F.lit("Denmark")]), text.first_name([F.lit("DENMARK"), F.lit(" ")])) == ("Denmark", "DENMARK")


def test_colours(spark):
    lab = lambda *v: colour.ciede2000(*(F.lit(float(x)) for x in v))
    got = one(spark, lab(50, 2.6772, -79.7751, 50, 0, -82.7485), lab(50, 0, 0, 50, -1, 2), lab(50, 2.5, 0, 73, 25, -18))
    assert got == pytest.approx((2.0425, 2.3669, 27.1492), abs=1e-4)
    black, white = (F.lit(0), F.lit(0), F.lit(0)), (F.lit(255), F.lit(255), F.lit(255))
    assert one(spark, colour.contrast_ratio(black, white))[0] == pytest.approx(21)
    assert one(spark, *colour.lab(*white)) == pytest.approx((100, 0, 0), abs=1e-2)
    assert one(spark, colour.width_at(F.lit(7.5), [(5.0, 1.0), (10.0, 4.0)]))[0] == pytest.approx(2.0)
