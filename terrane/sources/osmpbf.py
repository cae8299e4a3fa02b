"""OpenStreetMap PBF extracts as a Spark data source: tables nodes, ways and relations.

The driver walks the file's blob headers only; each data blob is a partition, inflated and decoded by its own task.  Dense
nodes are delta-coded runs, decoded as prefix sums over whole arrays."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import wire
from .pmtiles import opener

#: Fixed values of the format: size limits, features that this reader knows, member types, roles of fields.
HEADER_MOST, BLOB_MOST = 64 << 10, 32 << 20
KNOWN = {"OsmSchema-V0.6", "DenseNodes"}
SORTED = "Sort.Type_then_ID"
TYPES = ("node", "way", "relation")
TAGS = "tags map<string,string>"
SCHEMAS = {
    "nodes": f"id bigint, lat double, lon double, {TAGS}",
    "ways": f"id bigint, refs array<bigint>, {TAGS}",
    "relations": f"id bigint, members array<struct<type:string,id:bigint,role:string>>, {TAGS}",
}


@dataclass
class Blob(InputPartition):
    offset: int
    length: int


def blobs(read) -> Iterator[tuple[str, int, int]]:
    """(kind, offset, length) of each blob, from their headers alone."""
    at = 0
    while len(size := read(at, 4)) == 4:
        n = struct.unpack(">I", size)[0]
        if n > HEADER_MOST:
            raise wire.Malformed(f"a blob header of {n} bytes")
        head = dict(wire.fields(read(at + 4, n)))
        length = head.get(3, -1)
        if not 0 <= length <= BLOB_MOST or 1 not in head:
            raise wire.Malformed("a blob header without type or size, or too large")
        yield bytes(head[1]).decode(), at + 4 + n, length
        at += 4 + n + length
    if size:
        raise wire.Malformed("the file is cut off")


def payload(b: bytes) -> bytes:
    got = dict(wire.fields(b))
    if 1 in got:
        return bytes(got[1])
    if 3 in got:
        out = wire.inflate(bytes(got[3]), BLOB_MOST, 15)
        if len(out) != got.get(2, len(out)):
            raise wire.Malformed("a blob expands to another size than it says")
        return out
    raise wire.Malformed("a blob compressed in a way that cannot be read here")


def check_header(b: bytes) -> None:
    needs = {bytes(v).decode() for n, v in wire.fields(b) if n == 4}
    if needs - KNOWN:
        raise wire.Malformed(f"the file needs {sorted(needs - KNOWN)}")


def is_sorted(b: bytes) -> bool:
    """Does the header say that nodes come first, then ways, then relations."""
    return SORTED in {bytes(v).decode() for n, v in wire.fields(b) if n == 5}


def stretch(count: int, kinds, table: str) -> tuple[int, int]:
    """Of `count` blocks sorted by kind the first and the end of those that may hold a table's rows.  kinds(i) is asked for a logarithm
    of the blocks; one that holds nothing tells no side, and then all of them count."""
    want = list(SCHEMAS).index(table)

    def first(after) -> int:
        lo, hi = 0, count
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if after([list(SCHEMAS).index(k) for k in kinds(mid)]) else (mid + 1, hi)
        return lo

    try:
        return first(lambda ks: max(ks) >= want), first(lambda ks: min(ks) > want)
    except ValueError:  # of an empty list
        return 0, count


def _signed(v: int) -> int:
    return v - (v >> 63 << 64)


class Block:
    """A primitive block: its strings, its scale, its groups."""

    def __init__(self, b: bytes):
        got: dict[int, list] = {}
        for n, v in wire.fields(b):
            got.setdefault(n, []).append(v)
        self.strings = [bytes(v).decode() for n, v in wire.fields(got[1][0]) if n == 1] if 1 in got else [""]
        self.groups = got.get(2, [])
        self.step = got.get(17, [100])[-1]
        self.base = _signed(got.get(19, [0])[-1]), _signed(got.get(20, [0])[-1])

    def degrees(self, lat, lon):
        return 1e-9 * (self.base[0] + self.step * lat), 1e-9 * (self.base[1] + self.step * lon)

    def on_earth(self, lat, lon) -> None:
        """Raises where a coordinate, before or after the block's origin is added, is none of the earth's.  Limits are divided and not
        coordinates multiplied, so that no product can wrap."""
        for v, base, most in ((lat, self.base[0], 90 * 10**9), (lon, self.base[1], 180 * 10**9)):
            v = np.atleast_1d(v)
            if len(v) and (int(v.min()) < -(most // self.step) or int(v.max()) > most // self.step or base + self.step * int(v.min()) < -most or base + self.step * int(v.max()) > most):
                raise wire.Malformed(f"a node off the earth, in units of {self.step} nanodegrees")

    def kinds(self) -> set[str]:
        """Which elements it holds; nothing of them is decoded."""
        names = {1: "nodes", 2: "nodes", 3: "ways", 4: "relations"}
        return {names[n] for g in self.groups for n, _ in wire.fields(g) if n in names}

    def _tags(self, keys, values) -> dict:
        return {self.strings[int(k)]: self.strings[int(v)] for k, v in zip(keys, values, strict=True)}

    def nodes(self) -> Iterator[tuple]:
        for g in self.groups:
            for n, v in wire.fields(g):
                if n == 1:
                    f = dict(wire.fields(v))
                    lat, lon = wire.unzigzag(f.get(8, 0)), wire.unzigzag(f.get(9, 0))
                    self.on_earth(lat, lon)
                    lat, lon = self.degrees(lat, lon)
                    yield wire.unzigzag(f.get(1, 0)), lat, lon, self._tags(wire.varints(f.get(2, b"")), wire.varints(f.get(3, b"")))
                elif n == 2:
                    f = dict(wire.fields(v))
                    ids, lats, lons = (np.cumsum(wire.unzigzag(wire.varints(f.get(k, b"")))) for k in (1, 8, 9))
                    if not len(ids) == len(lats) == len(lons):
                        raise wire.Malformed("dense nodes whose runs differ in length")
                    self.on_earth(lats, lons)
                    lat, lon = self.degrees(lats, lons)
                    flat = wire.varints(f.get(10, b"")).tolist()
                    # a 0 ends each node's keys and values; an empty run says that no node has any
                    tags, at = [], 0
                    for _ in range(len(ids) if flat else 0):
                        own = {}
                        while at < len(flat) and flat[at]:
                            own[self.strings[flat[at]]] = self.strings[flat[at + 1]]
                            at += 2
                        tags.append(own)
                        at += 1
                    yield from zip(ids.tolist(), lat.tolist(), lon.tolist(), tags or [{}] * len(ids), strict=True)

    def ways(self) -> Iterator[tuple]:
        for g in self.groups:
            for n, v in wire.fields(g):
                if n == 3:
                    f = dict(wire.fields(v))
                    yield _signed(f.get(1, 0)), np.cumsum(wire.unzigzag(wire.varints(f.get(8, b"")))).tolist(), self._tags(wire.varints(f.get(2, b"")), wire.varints(f.get(3, b"")))

    def relations(self) -> Iterator[tuple]:
        for g in self.groups:
            for n, v in wire.fields(g):
                if n == 4:
                    f = dict(wire.fields(v))
                    roles, ids, types = wire.varints(f.get(8, b"")).tolist(), np.cumsum(wire.unzigzag(wire.varints(f.get(9, b"")))).tolist(), wire.varints(f.get(10, b"")).tolist()
                    if not len(roles) == len(ids) == len(types):
                        raise wire.Malformed("members whose runs differ in length")
                    yield _signed(f.get(1, 0)), [(TYPES[t], i, self.strings[r]) for t, i, r in zip(types, ids, roles, strict=True)], self._tags(wire.varints(f.get(2, b"")), wire.varints(f.get(3, b"")))


class OsmReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.table = options["path"], options.get("table", "nodes")
        if self.table not in SCHEMAS:
            raise ValueError(f"table is one of {sorted(SCHEMAS)}")

    def partitions(self):
        read = opener(self.path)
        found, by_kind = list(blobs(read)), False
        for kind, at, n in found:
            if kind == "OSMHeader":
                head = payload(read(at, n))
                check_header(head)
                by_kind = is_sorted(head)
        data = [Blob(at, n) for kind, at, n in found if kind == "OSMData"]
        if by_kind:  # the other kinds' blocks are not read at all
            first, end = stretch(len(data), lambda i: Block(payload(read(data[i].offset, data[i].length))).kinds(), self.table)
            data = data[first:end]
        return data or [Blob(0, 0)]

    def read(self, partition: Blob) -> Iterator[tuple]:
        if partition.length:
            block = Block(payload(opener(self.path)(partition.offset, partition.length)))
            if self.table in block.kinds():
                yield from getattr(block, self.table)()


class OsmSource(DataSource):
    """spark.read.format("osmpbf").option("table", "nodes" | "ways" | "relations").load(path)"""

    @classmethod
    def name(cls) -> str:
        return "osmpbf"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "nodes")]

    def reader(self, schema) -> DataSourceReader:
        return OsmReader(dict(self.options))


def write(path: str, nodes: list[tuple], ways: list[tuple], relations: list[tuple], step: int = 100) -> None:
    """A small extract, a block for each kind of element, sorted; rows as in SCHEMAS."""
    import zlib

    def blob(kind: str, body: bytes) -> bytes:
        inner = wire.field(2, len(body)) + wire.field(3, zlib.compress(body))
        head = wire.field(1, kind.encode()) + wire.field(3, len(inner))
        return struct.pack(">I", len(head)) + head + inner

    def run(v: list[int]) -> bytes:
        return b"".join(wire.put(wire.zigzag(b - a)) for a, b in zip([0, *v], v, strict=False))

    def block(make) -> bytes:
        strings: dict[str, int] = {"": 0}
        s = lambda t: strings.setdefault(t, len(strings))
        group = make(s)
        return blob("OSMData", wire.field(1, b"".join(wire.field(1, t.encode()) for t in strings)) + wire.field(2, group) + wire.field(17, step))

    tag = lambda s, t: wire.field(2, b"".join(wire.put(s(k)) for k in t)) + wire.field(3, b"".join(wire.put(s(v)) for v in t.values()))

    def dense(s):
        flat = b"".join(b"".join(wire.put(s(k)) + wire.put(s(v)) for k, v in n[3].items()) + b"\0" for n in nodes)
        return wire.field(2, wire.field(1, run([n[0] for n in nodes])) + wire.field(8, run([round(n[1] * 1e9 / step) for n in nodes])) + wire.field(9, run([round(n[2] * 1e9 / step) for n in nodes])) + wire.field(10, flat))

    def way(s):
        return b"".join(wire.field(3, wire.field(1, w[0]) + tag(s, w[2]) + wire.field(8, run(w[1]))) for w in ways)

    def relation(s):
        return b"".join(wire.field(4, wire.field(1, r[0]) + tag(s, r[2]) + wire.field(8, b"".join(wire.put(s(m[2])) for m in r[1])) + wire.field(9, run([m[1] for m in r[1]])) + wire.field(10, b"".join(wire.put(TYPES.index(m[0])) for m in r[1]))) for r in relations)

    with open(path, "wb") as f:
        f.write(blob("OSMHeader", b"".join(wire.field(4, k.encode()) for k in sorted(KNOWN)) + wire.field(5, SORTED.encode())) + block(dense) + block(way) + block(relation))
