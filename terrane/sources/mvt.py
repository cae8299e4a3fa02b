"""Mapbox vector tiles (version 1 and 2): bytes to a row a feature."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import wire

POINT, LINE, POLYGON = 1, 2, 3
XY = "struct<x:int,y:int>"
VALUE = "struct<kind:string,s:string,f:float,d:double,i:bigint,u:decimal(20,0),si:bigint,b:boolean>"
FEATURES = f"layer string, version int, extent int, pos int, fid bigint, geom_type int, tags map<string,{VALUE}>, points array<{XY}>, lines array<array<{XY}>>, polygons array<struct<exterior:array<{XY}>,holes:array<array<{XY}>>>>, vertices int"
_EMPTY = dict.fromkeys(("s", "f", "d", "i", "u", "si", "b"))


def value(b) -> dict:
    """One of seven kinds; the last one written holds."""
    out = None
    for n, v in wire.fields(b):
        if n == 1:
            out = {"kind": "string", "s": bytes(v).decode()}
        elif n == 2:
            out = {"kind": "float", "f": struct.unpack("<f", v.to_bytes(4, "little"))[0]}
        elif n == 3:
            out = {"kind": "double", "d": struct.unpack("<d", v.to_bytes(8, "little"))[0]}
        elif n == 4:
            out = {"kind": "int", "i": v - (v >> 63 << 64)}
        elif n == 5:
            out = {"kind": "uint", "u": v}
        elif n == 6:
            out = {"kind": "sint", "si": wire.unzigzag(v)}
        elif n == 7:
            out = {"kind": "bool", "b": bool(v)}
    if out is None:
        raise wire.Malformed("a value without content")
    return _EMPTY | out


def _area(ring: np.ndarray) -> int:
    """Twice the signed area, in whole numbers of any size."""
    x, y = (ring[:, k].astype(object) for k in (0, 1))
    return int((x * np.roll(y, -1) - np.roll(x, -1) * y).sum())


def geometry(kind: int, commands: np.ndarray, extent: int) -> tuple[list, list, list]:
    """Points, lines and polygons of a command stream."""
    paths, start, at, x, y = [], None, 0, 0, 0
    most = min(256 * extent, 1 << 20)
    n = len(commands)
    current: list[tuple[int, int]] = []
    while at < n:
        op, count = int(commands[at]) & 7, int(commands[at]) >> 3
        at += 1
        if op in (1, 2):
            if not count or at + 2 * count > n:
                raise wire.Malformed("a command without its coordinates")
            step = wire.unzigzag(commands[at : at + 2 * count].astype(np.uint64)).reshape(-1, 2)
            at += 2 * count
            where = np.cumsum(step, axis=0) + (x, y)
            if np.abs(where).max() > most:
                raise wire.Malformed("a coordinate far outside its tile")
            x, y = map(int, where[-1])
            moved = [tuple(map(int, p)) for p in where]
            if op == 1:
                if kind == POINT:
                    paths.append(moved)
                    continue
                if count != 1 or current:
                    raise wire.Malformed("a path is begun twice")
                current = moved
            elif not current or kind == POINT:
                raise wire.Malformed("a line from nowhere")
            else:
                current = current + moved
                if kind == LINE:
                    paths.append(current)
                    current = []
        elif op == 7 and count == 1 and kind == POLYGON and len(current) >= 3:
            paths.append(current)
            current = []
        else:
            raise wire.Malformed(f"command {op} is not valid here")
    if current or not paths:
        raise wire.Malformed("a path without an end, or no geometry")
    if kind == POINT:
        return [p for m in paths for p in m], [], []
    if kind == LINE:
        return [], paths, []
    return [], [], polygons(paths)


def polygons(rings: list[list]) -> list[tuple[list, list]]:
    """The first ring's winding is that of exteriors; others, and rings of no area, are holes of the last exterior.  Exteriors
    come out clockwise as drawn (y down), holes the other way."""
    out: list[tuple[list, list]] = []
    first = 0
    for r in rings:
        area = _area(np.array(r))
        sign = (area > 0) - (area < 0)
        if not out:
            first = sign or 1
        outer = not out or sign == first
        turned = r if sign == (1 if outer else -1) or not sign else [r[0], *r[:0:-1]]
        if outer:
            out.append((turned, []))
        else:
            out[-1][1].append(turned)
    return out


def _packed(v) -> np.ndarray:
    return wire.varints(v) if not isinstance(v, int) else np.array([v], np.uint64)


def decode(b: bytes) -> Iterator[dict]:
    """The features of a tile, as rows of FEATURES."""
    seen = set()
    for n, layer in wire.fields(b):
        if n != 3:
            continue
        name, version, extent, keys, values, features = None, None, 4096, [], [], []
        for k, v in wire.fields(layer):
            if k == 1:
                name = bytes(v).decode()
            elif k == 2:
                features.append(v)
            elif k == 3:
                keys.append(bytes(v).decode())
            elif k == 4:
                values.append(value(v))
            elif k == 5:
                extent = v
            elif k == 15:
                version = v
        if name is None or version not in (1, 2) or not extent:
            raise wire.Malformed("a layer needs a name, version 1 or 2 and an extent")
        if name in seen:
            raise wire.Malformed(f"layer {name} twice")
        seen.add(name)
        for pos, f in enumerate(features):
            fid, kind, tags, commands = None, 0, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
            for k, v in wire.fields(f):
                if k == 1:
                    fid = v - (v >> 63 << 64)
                elif k == 2:
                    tags = np.append(tags, _packed(v))
                elif k == 3:
                    kind = v
                elif k == 4:
                    commands = np.append(commands, _packed(v))
            if len(tags) % 2 or len(tags) and (tags[::2].max() >= len(keys) or tags[1::2].max() >= len(values)):
                raise wire.Malformed("tags out of their tables")
            points, lines, shapes = geometry(kind, commands, extent) if kind in (POINT, LINE, POLYGON) else ([], [], [])
            xy = lambda ps: [{"x": x, "y": y} for x, y in ps]
            count = len(points) + sum(map(len, lines)) + sum(len(e) + sum(map(len, h)) for e, h in shapes)
            yield {"layer": name, "version": version, "extent": extent, "pos": pos, "fid": fid, "geom_type": kind, "tags": {keys[a]: values[c] for a, c in zip(tags[::2].astype(int), tags[1::2].astype(int), strict=True)}, "points": xy(points), "lines": [xy(p) for p in lines], "polygons": [{"exterior": xy(e), "holes": [xy(h) for h in hs]} for e, hs in shapes], "vertices": count}


def features(tiles: DataFrame, data_col: str = "data") -> DataFrame:
    """tiles (..., data) to a row a feature; the tile's other columns repeat."""
    kept = [c for c in tiles.columns if c != data_col]
    ddl = ", ".join(f"`{c}` {tiles.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.strip().split(" ")[0] for x in "layer,version,extent,pos,fid,geom_type,tags,points,lines,polygons,vertices".split(",")]
        for pdf in batches:
            rows = [{k: r[k] for k in kept} | f for r in pdf.to_dict("records") for f in decode(bytes(r[data_col]))]
            out = pd.DataFrame(rows, columns=[*kept, *names])
            out["fid"] = out["fid"].astype("Int64")
            yield out

    return tiles.mapInPandas(run, f"{ddl}, {FEATURES}" if kept else FEATURES)


def encode_layer(name: str, items: list[dict], extent: int = 4096, version: int = 2) -> bytes:
    """A layer of features {fid, kind, tags: {str: str|int|float|bool}, commands: [int]}."""
    keys: dict = {}
    values: dict = {}
    body = b""
    for it in items:
        tags = []
        for k, v in it.get("tags", {}).items():
            tags += [keys.setdefault(k, len(keys)), values.setdefault((type(v), v), len(values))]
        f = (wire.field(1, it["fid"]) if it.get("fid") is not None else b"") + wire.field(2, b"".join(map(wire.put, tags))) + wire.field(3, it["kind"]) + wire.field(4, b"".join(map(wire.put, it["commands"])))
        body += wire.field(2, f)
    out = wire.field(15, version) + wire.field(1, name.encode()) + body + b"".join(wire.field(3, k.encode()) for k in keys)
    for kind, v in values:
        out += wire.field(4, wire.field(7, int(v)) if kind is bool else wire.field(1, v.encode()) if kind is str else wire.field(6, wire.zigzag(v)) if kind is int else wire.field(3, v))
    return wire.field(3, out + wire.field(5, extent))


def path(kind: int, *parts: list[tuple[int, int]]) -> list[int]:
    """The command stream of lines or rings, or of points in one part."""
    out, x, y = [], 0, 0
    for part in parts:
        steps = []
        for px, py in part:
            steps.append((wire.zigzag(px - x), wire.zigzag(py - y)))
            x, y = px, py
        if kind == POINT:
            out += [len(steps) << 3 | 1, *(v for s in steps for v in s)]
        else:
            out += [9, *steps[0], (len(steps) - 1) << 3 | 2, *(v for s in steps[1:] for v in s), *([15] if kind == POLYGON else [])]
    return out
