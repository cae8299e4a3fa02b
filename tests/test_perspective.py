import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.functions import camera
from terrane.operators import perspective as P
from terrane.sources import dem


def test_columns_and_arrays_agree(spark):
    rng = np.random.default_rng(1)
    pts = rng.normal(size=(20, 3)) * 500
    t = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], "i int, e double, n double, u double")
    c = camera.to_camera(F.col("e"), F.col("n"), F.col("u"), F.lit(30.0), F.lit(40.0), F.lit(900.0))
    x, y = camera.to_pixel(*c, F.lit(40.0), F.lit(320), F.lit(200))
    got = np.array([[np.nan if v is None else v for v in r] for r in t.orderBy("i").select(x, y, c[2]).collect()], float)
    want = P.project(pts, 30, 40, 900, 40, 320, 200)
    ok = ~np.isnan(want[:, 2])
    assert np.allclose(got[ok], want[ok]) and np.isnan(got[~ok][:, 0]).all()


def test_target_is_in_the_middle():
    assert P.project(np.zeros((1, 3)), 77, 25, 1000, 40, 320, 200)[0] == pytest.approx([160, 100, 1000])


def test_flat_ground():
    flat = np.zeros((65, 65))
    colours = np.full((65, 65, 3), 200)
    rgb, depth = P.picture(flat, colours, 50, 0, 90, 1000, 60, 40)
    assert np.nanmax(np.abs(depth - 1000)) < 1 and not np.isnan(depth).any()
    _, depth = P.picture(flat, colours, 50, 0, 10, 1000, 60, 40)
    assert np.isnan(depth[0]).all() and not np.isnan(depth[-1]).any()  # sky above, ground below


def test_a_ridge_hides_what_is_behind():
    g = np.zeros((81, 81))
    g[20:24] = 800
    _, depth = P.picture(g, np.zeros((81, 81, 3)), 50, 0, 15, 1500, 80, 60)
    spots = np.array([[0.0, 1900.0, 0.0], [0.0, 0.0, 0.0]])
    assert P.visible(depth, P.project(spots, 0, 15, 1500, P.FOV, 80, 60)).tolist() == [False, True]


def test_framing():
    pts = np.array([[-3000.0, -200.0], [3000.0, 200.0], [0.0, 100.0]])
    e, n, d = P.frame(pts, 0, 40)
    seen = P.project(np.column_stack([pts - [e, n], np.zeros(3)]), 0, 40, d, P.FOV, 300, 200)
    assert (seen[:, 0] >= 0).all() and (seen[:, 0] <= 300).all() and (seen[:, 1] >= 0).all() and (seen[:, 1] <= 200).all()
    assert P.best_heading(pts, 40)[1] <= d * 1.001
    w, s, east, north = P.footprint(0, 40, 1000, 40, 1.5, 5000)
    assert w < 0 < east and s < 0 < north and w == pytest.approx(-east)


def test_a_long_route_is_framed_by_all_its_points(spark):
    rng = np.random.default_rng(3)
    pts = np.cumsum(rng.normal(size=(3000, 2)) * 50, axis=0)
    pts[1234] += [9000, 4000]  # one outlier, which no sample would keep
    for heading in (0, 75, 200):
        assert P.frame(P.hull(pts), heading, 35) == pytest.approx(P.frame(pts, heading, 35))
    assert len(P.hull(pts)) < 100 and len(P.hull(pts[:1])) == 1 and len(P.hull(np.array([[0.0, 0.0], [1.0, 1.0], [2.0, 2.0]]))) == 2


def test_rows(spark):
    r = spark.createDataFrame([(1, 55.0, 9.0), (1, 55.1, 9.3), (2, -33.0, 151.0)], "route_id int, lat double, lon double")
    got = {x["route_id"]: x for x in P.framed(r).collect()}
    assert 54.9 < got[1]["lat"] < 55.2 and got[1]["distance"] > got[2]["distance"] > 0
    c = spark.createDataFrame([(7, 10.0, 30.0, 900.0, 40.0, 33, [float(i % 33) for i in range(33 * 33)])], "frame_id bigint, heading double, pitch double, distance double, spacing double, size int, heights array<float>")
    f = P.frames(c, 40, 30).first()
    assert dem.png(bytes(f["png"])).shape == (30, 40, 3) and 0 < f["seen"] <= 1


def test_names_fade(spark):
    rows = [(1, 0, "a", 1.0, 10.0, 10.0, 30.0, 20.0), (1, 1, "b", 1.0, 10.0, 10.0, 30.0, 20.0), (1, 2, "c", 0.5, 27.0, 10.0, 47.0, 20.0), (1, 3, "a", 1.0, 60.0, 10.0, 80.0, 20.0), (1, 4, "d", 1.0, -5.0, 50.0, 15.0, 60.0), (2, 0, "a", 0.01, 10.0, 10.0, 30.0, 20.0)]
    t = spark.createDataFrame([(*r, 100, 80, 10.0) for r in rows], "frame_id long, pos int, name string, alpha double, x0 double, y0 double, x1 double, y1 double, width int, height int, ramp double")
    got = {(r["frame_id"], r["pos"]): r["alpha"] for r in P.shown_names(t).collect()}
    # b lies wholly on a; 15 % of c does, which counts thrice; a's copy is 50 pixels away, past twice its width
    assert got == pytest.approx({(1, 0): 1.0, (1, 2): 0.5 * (1 - 0.45), (1, 3): 1.0, (1, 4): 0.5})
    assert P.covers((0, 0, 20, 10), (10, 100, 30, 110), True) == 0 and P.covers((0, 0, 20, 10), (20, 0, 40, 10), True) == pytest.approx(0.5)


def test_places_of_a_name(spark):
    from terrane.operators import names

    d = 6 * 360 / 2.0**8 / 256
    rows = [("x", 0, 0.0, 0.0, 8, 0.0, 0.0, 8), ("x", 1, d * 0.9, 0.0, 9, d * 0.9, 0.0, 9), ("x", 2, d * 1.1, 0.0, 8, 5.0, 5.0, 10), ("x", 3, 0.0, 1.0, 8, 0.0, 1.0, 8), ("y", 4, 0.0, 0.0, 8, 0.0, 0.0, 8)]
    t = spark.createDataFrame(rows, "name string, pos int, lat double, lon double, z int, fine_lat double, fine_lon double, fine_z int")
    # 2 is too far from where 0 put the place, and 1's finer zoom says so more closely
    assert {(r["pos"], r["place"]) for r in names.place_ids(t).collect()} == {(0, 0), (1, 0), (2, 1), (3, 2), (4, 0)}


def test_round_growth():
    from terrane.operators import draw

    rng = np.random.default_rng(5)
    mask = (rng.random((17, 23)) > 0.97).astype(np.uint8) * rng.integers(1, 256, (17, 23)).astype(np.uint8)
    got, on = draw.dilate(mask, 2.5), np.argwhere(mask >= 128)
    for y in range(17):
        for x in range(23):
            near = min(np.hypot(y - a, x - b) for a, b in on)
            assert got[y, x] == max(mask[y, x], int(np.floor(min(1, max(0, 3.0 - near)) * 255 + 0.5)))
    assert (draw.dilate(mask, 0) == mask).all() and not draw.dilate(np.zeros((4, 4), np.uint8), 1).any()
