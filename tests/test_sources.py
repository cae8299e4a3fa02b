import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.sources import areas, dem, mvt, osmpbf, pmtiles, wire


def test_directory_bytes():
    b = bytes.fromhex("04 05 03 a4 02 01 03 00 01 01 0a 14 05 07 01 00 85 07 00".replace(" ", ""))
    got = [tuple(map(int, e)) for e in pmtiles.decode_directory(b)]
    assert got == [(5, 0, 10, 3), (8, 10, 20, 0), (300, 900, 5, 1), (301, 905, 7, 1)]
    assert pmtiles.encode_directory(got) == b


@pytest.mark.parametrize("bad", [b"", b"\x00", b"\x01\x05\x01\x0a", b"\x02\x05\x00\x01\x01\x0a\x0a\x01\x00", b"\x01\x05\x01\x0a\x00", b"\x80"])
def test_bad_directories(bad):
    with pytest.raises(wire.Malformed):
        pmtiles.decode_directory(bad)


@pytest.mark.parametrize("leaf", [0, 3])
@pytest.mark.parametrize("compression", [pmtiles.NONE, pmtiles.GZIP])
def test_archive(spark, tmp_path, leaf, compression):
    path = str(tmp_path / "a.pmtiles")
    pmtiles.write(path, [(i * 3, 2, b"tile %d" % i) for i in range(10)], {"attribution": "me"}, leaf=leaf, compression=compression)
    spark.dataSource.register(pmtiles.PmtilesSource)
    rows = spark.read.format("pmtiles").load(path).orderBy("tile_id").collect()
    assert [(r["tile_id"], bytes(r["data"])) for r in rows] == [(i * 3, b"tile %d" % i) for i in range(10)]
    assert (rows[1]["z"], rows[1]["x"], rows[1]["y"]) == (1, 1, 1)
    assert spark.read.format("pmtiles").option("view", "directory").load(path).agg(F.sum("run_length")).first()[0] == 20
    assert spark.read.format("pmtiles").option("view", "metadata").load(path).first()["attribution"] == "me"
    assert spark.read.format("pmtiles").option("view", "header").load(path).first()["max_zoom"] == 15


def test_bad_header(tmp_path):
    with pytest.raises(wire.Malformed):
        pmtiles.parse_header(b"PMTiles\x02" + bytes(119))
    with pytest.raises(wire.Malformed):
        pmtiles.parse_header(b"PM")


def test_inflate_is_bounded():
    with pytest.raises(wire.Malformed):
        wire.inflate(gzip.compress(bytes(1000)), 999)
    with pytest.raises(wire.Malformed):
        wire.inflate(gzip.compress(b"abc")[:-9], 999)


def tile():
    ring, hole = [(0, 0), (10, 0), (10, 10), (0, 10)], [(2, 2), (2, 4), (4, 4), (4, 2)]
    return mvt.encode_layer("a", [
        {"fid": 7, "kind": 1, "tags": {"name": "x", "n": -3, "f": 1.5, "b": True}, "commands": mvt.path(1, [(1, 2), (3, 4)])},
        {"kind": 2, "tags": {}, "commands": mvt.path(2, [(0, 0), (5, 5)], [(9, 9), (1, 1), (2, 2)])},
        {"kind": 3, "tags": {"name": "x"}, "commands": mvt.path(3, ring, hole)},
    ])


def test_features(spark):
    t = spark.createDataFrame([(1, bytearray(tile()))], "z int, data binary")
    p, line, poly = mvt.features(t).orderBy("pos").collect()
    assert (p["fid"], p["z"], p["tags"]["name"]["s"], p["tags"]["n"]["si"], p["tags"]["f"]["d"], p["tags"]["b"]["b"]) == (7, 1, "x", -3, 1.5, True)
    assert [tuple(q) for q in p["points"]] == [(1, 2), (3, 4)]
    assert line["fid"] is None and [len(x) for x in line["lines"]] == [2, 3] and line["vertices"] == 5
    assert len(poly["polygons"]) == 1 and len(poly["polygons"][0]["holes"]) == 1 and poly["vertices"] == 8


@pytest.mark.parametrize("commands", [[9, 0], [10, 0, 0], [9, 0, 0, 15], [9, 0, 0], [17, 0, 0, 0, 0]])
def test_bad_geometry(commands):
    with pytest.raises(wire.Malformed):
        list(mvt.decode(mvt.encode_layer("a", [{"kind": 3, "commands": commands}])))


def test_layer_twice():
    with pytest.raises(wire.Malformed):
        list(mvt.decode(tile() + tile()))


def test_extract(spark, tmp_path):
    path = str(tmp_path / "x.osm.pbf")
    nodes = [(1, 55.7, 9.5, {}), (2, 55.7, 9.6, {"place": "town"}), (-3, -33.25, 151.0, {})]
    ways = [(10, [1, 2, -3], {"name": "w"})]
    relations = [(100, [("way", 10, "outer"), ("node", 2, "label")], {"boundary": "administrative"})]
    osmpbf.write(path, nodes, ways, relations)
    spark.dataSource.register(osmpbf.OsmSource)
    read = lambda t: spark.read.format("osmpbf").option("table", t).load(path).collect()
    assert [(r["id"], round(r["lat"], 7), round(r["lon"], 7), r["tags"]) for r in read("nodes")] == nodes
    assert [(r["id"], r["refs"], r["tags"]) for r in read("ways")] == ways
    assert [(r["id"], [tuple(m) for m in r["members"]], r["tags"]) for r in read("relations")] == relations


def test_only_blocks_of_a_kind_are_read(spark, tmp_path):
    path = str(tmp_path / "x.osm.pbf")
    osmpbf.write(path, [(1, 5.0, 6.0, {})], [(10, [1], {})], [(100, [], {})])
    for k, table in enumerate(("nodes", "ways", "relations")):
        parts = osmpbf.OsmReader({"path": path, "table": table}).partitions()
        assert len(parts) == 1
        assert parts == osmpbf.OsmReader({"path": path, "table": "nodes"}).partitions() or k
    blocks = [{"nodes"}] * 40 + [{"nodes", "ways"}] + [{"ways"}] * 3 + [{"relations"}] * 2
    asked = []
    kinds = lambda i: asked.append(i) or blocks[i]
    assert [osmpbf.stretch(46, kinds, t) for t in ("nodes", "ways", "relations")] == [(0, 41), (40, 44), (44, 46)]
    assert len(set(asked)) < 20
    assert osmpbf.stretch(3, lambda i: set(), "ways") == (0, 3) and osmpbf.stretch(0, kinds, "ways") == (0, 0)


def test_nodes_off_the_earth_are_refused(spark, tmp_path):
    path = str(tmp_path / "x.osm.pbf")
    for lat, lon in ((91.0, 0.0), (-90.5, 0.0), (0.0, 181.0)):
        osmpbf.write(path, [(1, 5.0, 6.0, {}), (2, lat, lon, {})], [], [])
        reader = osmpbf.OsmReader({"path": path, "table": "nodes"})
        with pytest.raises(wire.Malformed):
            [list(reader.read(p)) for p in reader.partitions()]


def test_region_files(spark, tmp_path):
    ring = [(55.0, 9.0), (55.0, 10.0), (56.0, 10.0)]
    good = areas.encode([{"name": "A", "kind": "8", "parts": [[ring]]}], "src", "credit", 5, (8,))
    for name, b in (("derived-dk.osmb", good), ("derived-no.osmb", good[:30]), ("derived-.osmb", good), ("other.txt", good)):
        (tmp_path / name).write_bytes(b)
    got = areas.read_regions(spark, str(tmp_path), "derived-", ".osmb").collect()
    assert [(r["region"], r["name"], len(r["parts"])) for r in got] == [("dk", "A", 1)]
    have = lambda folder, *layers: areas.available(spark, str(folder), list(layers), "derived-", ".osmb")
    assert have(tmp_path, "a.json") and not have(tmp_path / "none", "a.json")
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.json").write_text("{}")
    assert have(tmp_path / "b", "x.json") and not have(tmp_path / "b", "x.json", "y.json")


def test_unknown_features_are_refused():
    with pytest.raises(wire.Malformed):
        osmpbf.check_header(wire.field(4, b"HistoricalInformation"))


def test_geojson(spark, tmp_path):
    square = [[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]
    feature = lambda p, t, c: {"type": "Feature", "properties": p, "geometry": {"type": t, "coordinates": c}}
    doc = {"type": "FeatureCollection", "features": [feature({"NAME": "DENMARK", "name": "Denmark", "featurecla": "Country"}, "Polygon", [square]), feature({"NAME": "M"}, "MultiPolygon", [[square], [square]]), feature({}, "Polygon", [square]), feature({"NAME": "P"}, "Point", [0, 0])]}
    path = tmp_path / "a.json"
    path.write_text(json.dumps(doc))
    got = areas.read_geojson(spark, str(path)).orderBy("file_pos").collect()
    assert [(r["name"], r["kind"], len(r["parts"])) for r in got] == [("Denmark", "Country", 1), ("M", "area", 2)]
    assert len(got[0]["parts"][0]["outline"]) == 4


def test_binary_areas(spark, tmp_path):
    ring = [(55.7, 9.5), (55.7, 9.6), (-33.1234567, 151.7654321)]
    (tmp_path / "b.osmb").write_bytes(areas.encode([{"name": "A", "kind": "8", "parts": [[ring, ring[::-1]]]}], "src", "credit", 5, (8, 9)))
    r = areas.read_binary(spark, str(tmp_path)).first()
    assert (r["name"], r["kind"], r["source"], r["attribution"], r["levels"]) == ("A", "8", "src", "credit", [8, 9])
    assert [tuple(p) for p in r["parts"][0]["outline"]] == [pytest.approx(p) for p in ring] and len(r["parts"][0]["holes"]) == 1
    for bad in (b"osmc", b"osmb\x02", b"osmb\x01\x00\x05", b"osmb\x01\x05"):
        with pytest.raises(wire.Malformed):
            areas.decode(bad)


def grid_png(grid):
    v = np.round((grid + 32768) * 256).astype(np.int64)
    return dem.write_png(np.stack([v >> 16, v >> 8 & 255, v & 255], -1).astype(np.uint8))


def test_heights(spark):
    i, j = np.meshgrid(np.arange(4), np.arange(4))
    b = grid_png(100 * i - 0.5 * j - 10)
    g = dem.heights(b)
    assert (g[0, 0], g[0, 3], g[3, 0], g[1, 2]) == (-10, 290, -11.5, 189.5)
    t = spark.createDataFrame([(1, 0, 0, bytearray(b))], "z int, x long, y long, data binary")
    assert dem.decode_tiles(t).first()["heights"][3] == 290
    assert dem.bilinear(g, np.array([0.5]), np.array([0.0]))[0] == 40


def test_cone_contour():
    y, x = np.mgrid[0:41, 0:41]
    lines = dem.contour(100 - 5 * np.hypot(x - 20, y - 20), 50)
    assert len(lines) == 1 and lines[0][0] == lines[0][-1]
    assert all(abs(np.hypot(a - 20, b - 20) - 10) < 0.3 for a, b in lines[0])


def test_unknown_heights_are_skipped():
    g = np.full((4, 4), np.nan)
    assert dem.contour(g, 1) == []
    g = np.zeros((4, 4))
    assert dem.slopes(g, 10)[0].sum() == 0 and dem.box_blur(g + 3, 1.5)[0, 0] == pytest.approx(3)


def test_stream(spark, tmp_path):
    from terrane.streaming import locate

    src = str(tmp_path / "in")
    spark.createDataFrame([(1, 1.0, 1.0), (2, 50.0, 50.0)], "point_id long, lat double, lon double").write.parquet(src)
    ring = "array<struct<lat:double,lon:double>>"
    a = spark.createDataFrame([(0, "A", "2", [([(0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (2.0, 0.0)], [])])], f"file_pos long, name string, kind string, parts array<struct<outline:{ring},holes:array<{ring}>>>")
    points = spark.readStream.schema("point_id long, lat double, lon double").parquet(src)
    q = locate.locate(points, a).select("point_id", "name").writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [tuple(r) for r in spark.table("found").collect()] == [(1, "A")]


@pytest.mark.parametrize("leaf", [0, 4])
def test_one_tile_is_looked_up(spark, tmp_path, monkeypatch, leaf):
    """A tile inside a run is found, one in a gap is not, and little more than the tile is read."""
    path = str(tmp_path / "a.pmtiles")
    first = pmtiles.first_id(5)
    pmtiles.write(path, [(first + 3 * k, 2, b"tile %d " % k * 500) for k in range(40)], {}, leaf=leaf, compression=pmtiles.NONE)
    for k in (0, 7, 39):
        for step, want in ((0, k), (1, k), (2, None)):
            z, x, y = pmtiles.zxy(first + 3 * k + step)
            assert pmtiles.tile_id(z, x, y) == first + 3 * k + step
            assert pmtiles.tile(spark, path, z, x, y) == (None if want is None else b"tile %d " % want * 500)
    read, asked = pmtiles.opener(path), []
    monkeypatch.setattr(pmtiles, "opener", lambda p: lambda o, n: asked.append(n) or read(o, n))
    r = pmtiles.PmtilesReader({"path": path, "tile_id": str(first + 60)})
    assert [row[0] for part in r.partitions() for row in r.read(part)] == [first + 60]
    assert sum(asked) < 6000  # of some 150,000 bytes: header, directories, one tile
    rows = lambda **o: [row[0] for r in [pmtiles.PmtilesReader({"path": path, "view": "directory"} | o)] for part in r.partitions() for row in r.read(part)]
    assert rows(least_zoom="5", most_zoom="5") == rows() == [first + 3 * k for k in range(40)] and rows(most_zoom="4") == []


def test_stored_bytes(spark, tmp_path):
    import gzip

    path = str(tmp_path / "a.pmtiles")
    pmtiles.write(path, [(0, 1, b"hello")], {}, compression=pmtiles.GZIP)
    assert pmtiles.tile(spark, path, 0, 0, 0) == b"hello" and gzip.decompress(pmtiles.tile(spark, path, 0, 0, 0, raw=True)) == b"hello"


def test_ranges_over_http_are_checked(tmp_path):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Server(BaseHTTPRequestHandler):
        said = "bytes {a}-{b}/100"

        def do_GET(self):
            a, b = map(int, self.headers["Range"].removeprefix("bytes=").split("-"))
            self.send_response(206)
            self.send_header("Content-Range", Server.said.format(a=a, b=b))
            self.end_headers()
            self.wfile.write(bytes(range(a, b + 1)))

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    read = pmtiles.opener(f"http://127.0.0.1:{server.server_port}/a")
    assert read(3, 4) == bytes([3, 4, 5, 6])
    for said in ("bytes {a}-{b}/101", "bytes 0-{b}/100", "", "items {a}-{b}/100"):
        Server.said = said
        with pytest.raises(OSError):
            read(3, 4)
    server.shutdown()
