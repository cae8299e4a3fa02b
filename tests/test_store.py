import gzip

import pytest

from terrane.operators.store import Store
from terrane.sources import pmtiles

SCHEMA = "z int, x long, y long, data binary"


def tiles(spark, *rows):
    return spark.createDataFrame([(z, x, y, bytearray(n)) for z, x, y, n in rows], SCHEMA)


def test_life_of_a_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), 4)
    assert s.bytes() == 0 and s.sources().count() == 0
    a = s.add_source("planet", "1", "© them", "gzip")
    assert len(a) == 16 and s.add_source("planet", "1", "© them all", "gzip") == a
    assert s.sources().first()["attribution"] == "© them all"
    with pytest.raises(ValueError):
        s.add_source("planet", "1", "", "zstd")
    cell = lambda *xy: spark.createDataFrame(list(xy), "x long, y long")
    s.fill(a, tiles(spark, (2, 0, 0, 3), (4, 5, 6, 10), (5, 10, 12, 20), (5, 10, 12, 20)), cell((5, 6)), 5)
    s.fill(a, tiles(spark, (4, 5, 6, 99), (4, 7, 7, 40)), cell((7, 7)), 4)
    assert s.bytes() == 73  # what is held is not written again
    got = {(r["x"], r["y"]): (r["tiles"], r["bytes"], r["zoom_max"]) for r in s.cells().collect()}
    assert got == {(5, 6): (2, 30, 5), (7, 7): (1, 40, 4)}
    assert (s.sources().first()["zoom_min"], s.sources().first()["zoom_max"]) == (4, 5)
    s.exhaust(a, 7, 7, 6)
    assert s.cells().where("x = 7").first()["zoom_max"] == 6
    assert s.tiles_at(a, 4, 1)[1] is True and len(s.tiles_at(a, 4, 9)[0]) == 2
    want = spark.createDataFrame([(a, 5, 10, 12), (a, 5, 0, 0)], "source_id string, z int, x long, y long")
    assert s.has(want).count() == 1
    s.touch(spark.createDataFrame([(a, 5, 6)], "source_id string, x long, y long"))
    assert [(r["x"], r["bytes"]) for r in s.evict(50)] == [(7, 40)]
    assert s.bytes() == 33 and s.cells().count() == 1
    assert s.evict(0, spark.createDataFrame([(a, 5, 6)], "source_id string, x long, y long")) == []


def test_a_plan_is_carried_out(spark, tmp_path):
    path, body = str(tmp_path / "a.pmtiles"), lambda k: bytes([k % 251]) * (50 + k)
    ids = [pmtiles.tile_id(4, x, y) for x in range(8) for y in range(8)]
    pmtiles.write(path, [(t, 1, body(t)) for t in sorted(ids)], leaf=16)
    s = Store(spark, str(tmp_path / "s"), 4)
    a = s.add_source("planet", "1", "", "gzip")
    spots = [(4, x, y) for x in range(10) for y in range(3)]  # x of 8 and 9 are not in the archive
    want = spark.createDataFrame(spots, "z int, x long, y long")
    cells = want.select("x", "y")
    s.fill(a, spark.createDataFrame([(4, 0, 0, bytearray(b"old"))], SCHEMA))
    s.fetch(a, path, want, cells, 4, max_gap=100, max_request=400)
    got = {(r["z"], r["x"], r["y"]): bytes(r["data"]) for r in s.tiles().collect()}
    assert got.pop((4, 0, 0)) == b"old"
    assert {k: gzip.decompress(v) for k, v in got.items()} == {k: body(pmtiles.tile_id(*k)) for k in spots if k[1] < 8 and k != (4, 0, 0)}
    held = {(r["x"], r["y"]): (r["tiles"], r["complete"]) for r in s.cells().collect()}
    assert len(held) == 30 and held[9, 1] == (0, True) and held[7, 2] == (1, True)
    before = s.bytes()
    s.fetch(a, path, want)  # all is held
    assert s.bytes() == before and s.tiles().count() == 24
