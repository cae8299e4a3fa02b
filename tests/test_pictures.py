import json
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terrane import cli
from terrane.functions import view as V
from terrane.operators import draw, lines
from terrane.sources import areas, dem, mvt, osmpbf, pmtiles


def test_fill_is_exact():
    s = draw.Surface(10, 10)
    assert s.coverage([[(2, 2), (7, 2), (7, 7), (2, 7)]]).sum() == pytest.approx(25)
    assert s.coverage([[(1.5, 1.25), (4, 1.25), (4, 3), (1.5, 3)]]).sum() == pytest.approx(2.5 * 1.75)
    assert s.coverage([[(0, 0), (9, 0), (0, 9)]]).sum() == pytest.approx(40.5)
    hole = [[(0, 0), (8, 0), (8, 8), (0, 8)], [(2, 2), (2, 6), (6, 6), (6, 2)]]
    assert s.coverage(hole).sum() == pytest.approx(48)
    assert s.coverage([[(-50, -50), (50, -50), (50, 50), (-50, 50)]]).min() == 1
    assert s.coverage([[(20, 0), (30, 0), (30, 10)]]).sum() == 0


@given(st.lists(st.tuples(st.floats(0, 12), st.floats(0, 9)), min_size=3, max_size=3))
@settings(max_examples=100, deadline=None)
def test_any_triangle(p):
    (a, b), (c, d), (e, f) = p
    want = abs((c - a) * (f - b) - (e - a) * (d - b)) / 2
    assert draw.Surface(12, 9).coverage([p]).sum() == pytest.approx(want, abs=1e-6)


def test_stroke_and_dash():
    s = draw.Surface(40, 10)
    s.stroke([(-1e9, 5), (1e9, 5)], 2, (0, 0, 0))
    assert (s.rgb[4:6] == 0).all() and (s.rgb[:3] == 255).all()
    s = draw.Surface(40, 10)
    s.stroke([(0, 5), (40, 5)], 2, (0, 0, 0), dash=[4, 8])
    assert s.rgb[4, 1, 0] == 0 and s.rgb[4, 8, 0] == 255 and s.rgb[4, 13, 0] == 0


def test_png_round_trip():
    s = draw.Surface(8, 6, (10, 20, 30))
    s.fill([[(0, 0), (4, 0), (4, 6), (0, 6)]], (200, 0, 0))
    draw.hatch(s, [(4, 0, 8, 6)], (0, 0, 0), 4)
    draw.legend(s, (0, 0, 8, 1), [(0, 0, 0), (255, 255, 255)])
    got = dem.png(s.png())
    assert got.shape == (6, 8, 3) and tuple(got[3, 1]) == (200, 0, 0) and tuple(got[0, 7]) == (255, 255, 255)


def test_clip():
    box = (0, 0, 10, 10)
    assert lines.clip_segment((-5, 5), (15, 5), box) == (0.25, 0.75) and lines.clip_segment((-5, -5), (-1, 20), box) is None
    runs = lines.clip_line([(-5, 5), (5, 5), (5, 20), (8, 20), (8, 5)], box)
    assert [(s, p) for s, p in runs] == [(5.0, [(0.0, 5.0), (5, 5), (5.0, 10.0)]), (38.0, [(8.0, 10.0), (8, 5)])]
    ring = lines.clip_ring([(-5, -5), (5, -5), (5, 5), (-5, 5)], box)
    assert sorted(ring) == [(0, 0), (0, 5), (5, 0), (5, 5)]


def test_dash_phase():
    runs, phase = lines.dash([(0, 0), (10, 0)], [3, 2], 1)
    assert runs == [[(0, 0), (2, 0)], [(4, 0), (7, 0)], [(9, 0), (10, 0)]] and phase == 1
    assert lines.dash([(0, 0), (5, 0)], [])[0] == [[(0, 0), (5, 0)]]


def test_antimeridian_and_anchor():
    assert lines.cut_antimeridian([(170, 0), (-170, 10)]) == [[(170, 0), (180.0, 5.0)], [(-180.0, 5.0), (-170, 10)]]
    assert lines.cut_antimeridian([(0, 0), (1, 1)]) == [[(0, 0), (1, 1)]]
    assert lines.anchor([[(0, 0), (1, 0)], [(0, 0), (4, 0), (4, 6)]]) == (4, 1) and lines.anchor([]) is None
    square = lambda x: [(x, 0), (x + 2, 0), (x + 2, 2), (x, 2)]
    assert lines.quads_overlap(square(0), square(1)) and not lines.quads_overlap(square(0), square(2))
    assert not lines.quads_overlap(square(0), [(3, -1), (5, 1), (3, 3), (2.1, 1)])


def test_lines_as_rows(spark):
    t = spark.createDataFrame([(1, [(0.0, 5.0), (20.0, 5.0)])], "k int, points array<struct<x:double,y:double>>")
    r = lines.clipped(t, (5, 0, 10, 10)).first()
    assert (r["k"], r["start"], [tuple(p) for p in r["run"]]) == (1, 5.0, [(5.0, 5.0), (10.0, 5.0)])
    assert lines.dashed(t, [4, 4]).count() == 3


def test_views(spark):
    v = spark.createDataFrame([(1, -10.0, -10.0, 10.0, 10.0, 400, 200), (2, 0.0, 86.0, 1.0, 87.0, 10, 10)], "id int, w double, s double, e double, n double, width int, height int")
    good, flat = V.resolve(v).orderBy("id").collect()
    assert flat["scale"] is None and good["tile_zoom"] == round(good["zoom"])
    r = V.resolve(v.where("id = 1"))
    x, y = V.pixel(F.lit(0.0), F.lit(0.0))
    lon, lat = V.coordinate(F.lit(200.0), F.lit(100.0))
    assert tuple(r.select(x, y, lon, lat).first()) == pytest.approx((200, 100, 0, 0), abs=1e-9)
    assert V.tiles_under(r).count() == (math.floor((good["ox"] + 400 / good["scale"]) * 2 ** good["tile_zoom"] - 1e-9) - math.floor(good["ox"] * 2 ** good["tile_zoom"]) + 1) * 2
    f = V.fit(v.where("id = 1"), 512, 512, 18.0).first()
    assert not f["cropped"] and f["w"] < -10 and f["e"] > 10
    assert V.fit(spark.createDataFrame([(-180.0, -85.0, 180.0, 85.0)], "w double, s double, e double, n double"), 512, 256, 18.0).first()["cropped"]


@pytest.fixture(scope="module")
def tiles(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("a") / "a.pmtiles")
    body = mvt.encode_layer("land", [{"fid": 3, "kind": 3, "tags": {"name": "x"}, "commands": mvt.path(3, [(0, 0), (4096, 0), (4096, 4096), (0, 4096)])}, {"kind": 1, "tags": {"n": 4}, "commands": mvt.path(1, [(2048, 2048)])}])
    body += mvt.encode_layer("roads", [{"kind": 2, "tags": {}, "commands": mvt.path(2, [(0, 0), (4096, 4096)])}])
    pmtiles.write(path, [(0, 5, body)], {"attribution": "<b>me</b>"}, zooms=(0, 1))
    spark.dataSource.register(pmtiles.PmtilesSource)
    spark.dataSource.register(osmpbf.OsmSource)
    return path


def run(spark, capsys, *argv):
    assert cli.main([str(x) for x in argv], spark) == 0
    return json.loads(capsys.readouterr().out)


def test_commands_on_an_archive(spark, tiles, tmp_path, capsys):
    got = run(spark, capsys, "inspect", tiles)
    assert got["directory"] == {"leaves": 0, "runs": 1, "tiles": 5} and got["credit"] == "me"
    got = run(spark, capsys, "tile", tiles, 1, 1, 0, "--tags")
    assert [(r["layer"], r["features"]) for r in got[:3]] == [("land", 2), ("roads", 1), (None, 3)] and got[3]["key"] == "n"
    got = run(spark, capsys, "geojson", tiles, 0, 0, 0, "--layer", "land")
    poly, point = got["features"]
    assert poly["geometry"]["type"] == "Polygon" and poly["geometry"]["coordinates"][0][0] == poly["geometry"]["coordinates"][0][-1] and poly["properties"] == {"@layer": "land", "@id": 3, "name": "x"}
    assert point["geometry"]["coordinates"] == pytest.approx([0, 0], abs=1e-9) and point["properties"]["n"] == "4"
    out = tmp_path / "p.png"
    run(spark, capsys, "render", tiles, "-90,-60,90,60", out, "--width", 64, "--height", 48)
    assert dem.png(out.read_bytes()).shape == (48, 64, 3) and np.unique(dem.png(out.read_bytes()).reshape(-1, 3), axis=0).shape[0] > 1
    got = run(spark, capsys, "plan", tiles, "0,0,0.001,0.001")
    assert got["located"] if "located" in got else got["absent"] == got["tiles"]


def test_extract_to_locate(spark, tiles, tmp_path, capsys):
    pbf, out = str(tmp_path / "x.pbf"), str(tmp_path / "x.osmb")
    nodes = [(i, y, x, {}) for i, y, x in ((1, 55.7, 9.5), (2, 55.7, 9.6), (3, 55.8, 9.6), (4, 55.8, 9.5))]
    osmpbf.write(pbf, nodes, [(10, [1, 2, 3], {}), (11, [3, 4, 1], {})], [(100, [("way", 10, "outer"), ("way", 11, "outer")], {"boundary": "administrative", "admin_level": "8", "name": "Horsens"})])
    got = run(spark, capsys, "boundaries", pbf, out)
    assert (got["complete"], got["outlines"]) == (1, 1)
    assert areas.read_binary(spark, out).first()["name"] == "Horsens"
    got = run(spark, capsys, "locate", out, "55.75,9.55", "0,0")
    assert [{k["level"]: k["name"] if "name" in k else None for k in r["levels"]}["locality"] for r in got] == ["Horsens", None]
