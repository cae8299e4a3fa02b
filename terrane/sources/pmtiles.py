"""PMTiles version 3 archives as a Spark data source.

spark.dataSource.register(PmtilesSource); spark.read.format("pmtiles").load(path) gives a row a tile run; option("view",
"directory") leaves the bytes unread, option("raw", "true") leaves them as stored, and option("tile", "z/x/y") or zooms leave all
else unread.  The header and root directory are read on the driver (at most 16 KiB); each leaf
directory is a partition, read and expanded by its own task."""

from __future__ import annotations

import json
import re
import struct
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import wire

#: Fixed values of the format.
MAGIC, VERSION, HEADER, ROOT_MOST, DEPTH = b"PMTiles", 3, 127, 16257, 4
NONE, GZIP = 1, 2
_LAYOUT = struct.Struct("<7sB11Q6B4iB2i")
#: How far a directory and a tile may expand.
DIRECTORY_MOST, TILE_MOST = 64 << 20, 64 << 20
_NAMES = "root_offset root_length metadata_offset metadata_length leaf_offset leaf_length data_offset data_length addressed_tiles tile_entries tile_contents clustered internal_compression tile_compression tile_type min_zoom max_zoom min_lon min_lat max_lon max_lat center_zoom center_lon center_lat".split()


def parse_header(b: bytes) -> dict:
    if len(b) < HEADER:
        raise wire.Malformed(f"a header has {HEADER} bytes, this has {len(b)}")
    magic, version, *rest = _LAYOUT.unpack_from(b)
    if magic != MAGIC or version != VERSION:
        raise wire.Malformed(f"not a version {VERSION} archive: {magic!r} {version}")
    h = dict(zip(_NAMES, rest, strict=True))
    for k in ("min_lon", "min_lat", "max_lon", "max_lat", "center_lon", "center_lat"):
        h[k] /= 1e7
    h["clustered"] = bool(h["clustered"])
    if h["max_zoom"] < h["min_zoom"] or h["max_zoom"] > 31:
        raise wire.Malformed("zooms run backwards or too deep")
    if not 0 < h["root_length"] <= ROOT_MOST:
        raise wire.Malformed(f"a root directory of {h['root_length']} bytes")
    if max(h["internal_compression"], h["tile_compression"]) > 4:
        raise wire.Malformed("a compression that the format does not define")
    return h


def expand(b: bytes, compression: int, limit: int) -> bytes:
    if compression == NONE:
        if len(b) > limit:
            raise wire.Malformed(f"more than {limit} bytes")
        return b
    if compression == GZIP:
        return wire.inflate(b, limit)
    raise wire.Malformed(f"compression {compression} cannot be read here")


def decode_directory(b: bytes) -> np.ndarray:
    """Columns tile_id, offset, length, run_length of a directory's entries."""
    v = wire.varints(b)
    n = int(v[0]) if len(v) else 0
    if not n or len(v) != 1 + 4 * n:
        raise wire.Malformed("a directory whose runs do not add up")
    ids, runs, lengths, offsets = v[1:].reshape(4, n).astype(np.int64)
    ids = np.cumsum(ids)
    if n > 1 and (np.diff(ids) <= 0).any() or (lengths <= 0).any():
        raise wire.Malformed("tile ids out of order, or an empty entry")
    # 0 says: right after the entry before; else the offset is one less
    fixed = offsets > 0
    if not fixed[0]:
        raise wire.Malformed("the first entry has none before it")
    before = np.cumsum(lengths) - lengths
    base = np.maximum.accumulate(np.where(fixed, np.arange(n), 0))
    return np.rec.fromarrays([ids, (offsets - 1)[base] + before - before[base], lengths, runs], names="tile_id,offset,length,run_length")


def encode_directory(entries: list[tuple[int, int, int, int]]) -> bytes:
    """Entries (tile_id, offset, length, run_length) in order of tile_id."""
    ids = [e[0] for e in entries]
    out = [len(entries), *(b - a for a, b in zip([0, *ids], ids, strict=False)), *(e[3] for e in entries), *(e[2] for e in entries)]
    end = None
    for _, o, n, _ in entries:
        out.append(0 if o == end else o + 1)
        end = o + n
    return b"".join(map(wire.put, out))


def first_id(z: int) -> int:
    """The id of a zoom's first tile."""
    return (4**z - 1) // 3


def tile_id(z: int, x: int, y: int) -> int:
    """The place of a tile along the zooms' curves: zxy() the other way round."""
    d, k = 0, 1 << z >> 1
    while k:
        rx, ry = int(x & k > 0), int(y & k > 0)
        d += k * k * (3 * rx ^ ry)
        x, y = x & (k - 1), y & (k - 1)
        if not ry:
            if rx:
                x, y = k - 1 - x, k - 1 - y
            x, y = y, x
        k >>= 1
    return first_id(z) + d


def tile(spark, path: str, z: int, x: int, y: int, raw: bool = False) -> bytes | None:
    """One tile's bytes, or None where the archive has none: the header, the directories on its way, and the tile are fetched."""
    spark.dataSource.register(PmtilesSource)
    found = spark.read.format("pmtiles").option("tile", f"{z}/{x}/{y}").option("raw", str(raw)).load(path).select("data").collect()
    return bytes(found[0]["data"]) if found else None


def zxy(tid: int) -> tuple[int, int, int]:
    z, first = 0, 0
    while tid >= first + 4**z:
        first, z = first + 4**z, z + 1
    t, x, y = tid - first, 0, 0
    for k in range(z):
        s, rx = 1 << k, t >> 1 & 1
        ry = (t ^ rx) & 1
        if not ry:
            if rx:
                x, y = s - 1 - x, s - 1 - y
            x, y = y, x
        x, y, t = x + s * rx, y + s * ry, t >> 2
    return z, x, y


_RANGE = re.compile(r"\s*bytes\s+(\d+)\s*-\s*(\d+)\s*/\s*(\d+|\*)\s*", re.I)


class _SameHost(urllib.request.HTTPRedirectHandler):
    """Redirects stay on their host and never leave https."""

    def redirect_request(self, req, fp, code, msg, headers, newurl):
        old, new = urllib.parse.urlsplit(req.full_url), urllib.parse.urlsplit(newurl)
        if old.hostname != new.hostname or (old.scheme == "https" and new.scheme != "https"):
            raise OSError(f"a redirect to another host or off https: {new.hostname}")
        return super().redirect_request(req, fp, code, msg, headers, newurl)


def opener(path: str):
    """read(offset, length) of a local file or an http(s) URL that serves ranges.  A server's answer must be the range asked for, and
    the object must not change its size between reads."""
    if path.startswith(("http://", "https://")):
        web, size = urllib.request.build_opener(_SameHost), []

        def read(offset: int, length: int) -> bytes:
            ask = urllib.request.Request(path, headers={"Range": f"bytes={offset}-{offset + length - 1}"})
            with web.open(ask, timeout=60) as got:
                if got.status != 206:
                    raise OSError(f"the server does not serve ranges: {got.status}")
                said = _RANGE.fullmatch(got.headers.get("Content-Range", ""))
                if not said or int(said[1]) != offset or int(said[2]) >= offset + length:
                    raise OSError(f"asked for {length} bytes at {offset}, the server says {got.headers.get('Content-Range')!r}")
                if said[3] != "*":
                    size[:] = size or [said[3]]
                    if size[0] != said[3]:
                        raise OSError("the archive changed its size while it was read")
                return got.read(length)
    else:
        local = path.removeprefix("file://")

        def read(offset: int, length: int) -> bytes:
            with open(local, "rb") as f:
                f.seek(offset)
                return f.read(length)

    return read


@dataclass
class Leaf(InputPartition):
    """A leaf directory to read, or entries already known."""

    offset: int = -1
    length: int = 0
    entries: list = field(default_factory=list)


class PmtilesReader(DataSourceReader):
    """Options: view; raw (bytes as stored); and what is read at all: tile (z/x/y) or tile_id for the entry that covers one tile,
    least_zoom and most_zoom for some zooms.  Only the directories and tiles that these need are fetched."""

    def __init__(self, options: dict):
        self.path, self.view = options["path"], options.get("view", "tiles")
        self.raw = options.get("raw", "false").lower() == "true"
        self.covered = None  # the one tile that is asked for
        self.low, self.high = first_id(int(options.get("least_zoom", 0))), first_id(int(options.get("most_zoom", 31)) + 1) - 1
        if "tile" in options or "tile_id" in options:
            self.covered = tile_id(*map(int, options["tile"].split("/"))) if "tile" in options else int(options["tile_id"])
            self.low = self.high = self.covered
        read = opener(self.path)
        self.header = parse_header(read(0, HEADER))
        h = self.header
        self.root = decode_directory(expand(read(h["root_offset"], h["root_length"]), h["internal_compression"], DIRECTORY_MOST))

    def _wanted(self, directory: np.ndarray) -> list[tuple]:
        """Entries that hold ids asked for; a leaf goes on to the next entry."""
        upto = np.append(directory["tile_id"][1:], 2**62)
        last = np.where(directory["run_length"] > 0, directory["tile_id"] + directory["run_length"], upto) - 1
        # without one tile in question an entry counts as its first id's row
        first = last if self.covered is not None else np.where(directory["run_length"] > 0, directory["tile_id"], last)
        return [tuple(map(int, e)) for e in directory[(directory["tile_id"] <= self.high) & (first >= self.low)]]

    def partitions(self):
        if self.view in ("header", "metadata"):
            return [Leaf()]
        root = self._wanted(self.root)
        own = [e for e in root if e[3]]
        leaves = [Leaf(e[1], e[2]) for e in root if not e[3]]
        return [*(Leaf(entries=own[i : i + 512]) for i in range(0, len(own), 512)), *leaves] or [Leaf(entries=[])]

    def _entries(self, read, leaf: Leaf, depth: int = 1) -> Iterator[tuple]:
        if leaf.offset < 0:
            yield from leaf.entries
            return
        if depth > DEPTH:
            raise wire.Malformed("leaf directories nest too deep")
        h = self.header
        if leaf.offset + leaf.length > h["leaf_length"]:
            raise wire.Malformed("a leaf directory past its section")
        for e in self._wanted(decode_directory(expand(read(h["leaf_offset"] + leaf.offset, leaf.length), h["internal_compression"], DIRECTORY_MOST))):
            if e[3]:
                yield e
            else:
                yield from self._entries(read, Leaf(e[1], e[2]), depth + 1)

    def read(self, partition: Leaf) -> Iterator[tuple]:
        read, h = opener(self.path), self.header
        if self.view == "header":
            yield tuple(h[k] for k in _NAMES)
        elif self.view == "metadata":
            text = expand(read(h["metadata_offset"], h["metadata_length"]), h["internal_compression"], DIRECTORY_MOST).decode() if h["metadata_length"] else "{}"
            yield text, json.loads(text).get("attribution")
        else:
            for tid, offset, length, run in self._entries(read, partition):
                if offset + length > h["data_length"]:
                    raise wire.Malformed("a tile past its section")
                data = read(h["data_offset"] + offset, length) if self.view == "tiles" else None
                if data is not None and not self.raw:
                    data = expand(data, h["tile_compression"], TILE_MOST)
                yield tid, offset, length, run, *zxy(tid), data


class PmtilesSource(DataSource):
    """Views: tiles (default), directory, header, metadata."""

    @classmethod
    def name(cls) -> str:
        return "pmtiles"

    def schema(self) -> str:
        view = self.options.get("view", "tiles")
        if view == "header":
            kinds = {"clustered": "boolean"} | {k: "double" for k in _NAMES if k.endswith(("lon", "lat"))} | {k: "int" for k in ("internal_compression", "tile_compression", "tile_type", "min_zoom", "max_zoom", "center_zoom")}
            return ", ".join(f"{k} {kinds.get(k, 'long')}" for k in _NAMES)
        if view == "metadata":
            return "metadata string, attribution string"
        return "tile_id long, offset long, length long, run_length long, z int, x long, y long, data binary"

    def reader(self, schema) -> DataSourceReader:
        return PmtilesReader(dict(self.options))


def write(path: str, tiles: list[tuple[int, int, bytes]], metadata: dict | None = None, zooms: tuple[int, int] = (0, 15), box=(-180.0, -85.0, 180.0, 85.0), leaf: int = 0, compression: int = GZIP) -> None:
    """An archive of (tile_id, run_length, bytes) in order of id; leaf: entries to a leaf directory, 0 for none."""
    import gzip as gz

    squeeze = (lambda b: gz.compress(b, mtime=0)) if compression == GZIP else (lambda b: b)
    data, entries, at = [], [], 0
    for tid, run, b in tiles:
        data.append(squeeze(b))
        entries.append((tid, at, len(data[-1]), run))
        at += len(data[-1])
    leaves, root, lat = [], entries, 0
    if leaf:
        root = []
        for i in range(0, len(entries), leaf):
            leaves.append(squeeze(encode_directory(entries[i : i + leaf])))
            root.append((entries[i][0], lat, len(leaves[-1]), 0))
            lat += len(leaves[-1])
    r, m = squeeze(encode_directory(root)), squeeze(json.dumps(metadata or {}).encode())
    offsets = [HEADER, HEADER + len(r), HEADER + len(r) + len(m), HEADER + len(r) + len(m) + lat]
    w, s, e, n = (round(v * 1e7) for v in box)
    head = _LAYOUT.pack(MAGIC, VERSION, offsets[0], len(r), offsets[1], len(m), offsets[2], lat, offsets[3], at, sum(t[1] for t in tiles), len(tiles), len(tiles), 1, compression, compression, 1, *zooms, w, s, e, n, zooms[0], (w + e) // 2, (s + n) // 2)
    with open(path, "wb") as f:
        f.write(b"".join([head, r, m, *leaves, *data]))
