import json

import pytest

from terrane.operators import terrain


def test_index_and_regions(spark, tmp_path):
    items = [{"name": "planet.pmtiles", "url": "http://h/p"}, {"name": "6-33-20.pmtiles", "url": ""}, {"name": "2-9-0.pmtiles"}, {"name": "readme.txt"}]
    (tmp_path / "i.json").write_text(json.dumps({"items": items}))
    got = terrain.read_index(spark, str(tmp_path / "i.json"), "http://b/").collect()
    assert {(r["kind"], r["url"], r["z"]) for r in got} == {("global", "http://h/p", None), ("region", "http://b/6-33-20.pmtiles", 6), ("coverage", "http://b/coverage.pmtiles", None), ("sources", "http://b/attribution.json", None)}
    cells = spark.createDataFrame([(33 * 64 + 5, 20 * 64 + 63), (0, 0)], "x long, y long")
    regions = terrain.read_index(spark, str(tmp_path / "i.json"), "http://b/")
    assert {(r["x"], r["url"]) for r in terrain.region_for(cells, regions, 12).collect()} == {(33 * 64 + 5, "http://b/6-33-20.pmtiles"), (0, None)}


def test_sources_under_a_view(spark):
    sq = lambda a, b: [(a, a), (b, a), (b, b), (a, b)]
    xy = "array<struct<x:int,y:int>>"
    world = (0, 0, 0, 4096, "wide", [(sq(0, 4096), [sq(1000, 3000)])])
    fine = (0, 0, 0, 4096, "fine", [(sq(1000, 3000), [])])
    c = spark.createDataFrame([world, fine], f"z int, x long, y long, extent int, source string, polygons array<struct<exterior:{xy},holes:array<{xy}>>>")
    v = spark.createDataFrame([(1, -1.0, -1.0, 1.0, 1.0), (2, -179.0, 80.0, -178.0, 81.0), (3, -100.0, -1.0, 0.0, 1.0)], "view_id int, w double, s double, e double, n double")
    got = {}
    for r in terrain.sources_in(v, c).collect():
        got.setdefault(r["view_id"], set()).add(r["source"])
    assert got == {1: {"fine"}, 2: {"wide"}, 3: {"fine", "wide"}}


def test_credit(spark):
    ids = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (1, 3, "glo30"), (1, 4, "zz")], "view_id int, pos int, source string")
    who = spark.createDataFrame([("a", "", "Survey  One", "CC"), ("b", "x", "Survey One", "CC"), ("c", "Named", None, "")], "source string, name string, producer string, license string")
    assert terrain.credit(ids, who, "view_id", {"glo30": "as the licence says"}).first()["credit"] == "Elevation: Survey One (CC); Named; as the licence says; zz"


def test_a_folder_of_archives(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        (tmp_path / "x.txt").write_text("")
        terrain.read_folder(spark, str(tmp_path))
    for name in ("planet.pmtiles", "coverage.pmtiles", "6-33-20.pmtiles", "2-9-0.pmtiles", "readme.txt"):
        (tmp_path / name).write_bytes(b"x")
    got = terrain.locate(spark, str(tmp_path)).collect()
    assert {(r["kind"], r["url"].split("/")[-1], r["z"], r["x"], r["y"]) for r in got} == {("global", "planet.pmtiles", None, None, None), ("coverage", "coverage.pmtiles", None, None, None), ("region", "6-33-20.pmtiles", 6, 33, 20)}
