"""Elevation tiles: decoding, sampling, relief and contours, with numpy inside Arrow batches."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .wire import Malformed, inflate

#: A tile's longest side, and heights that mean "unknown".
SIDE_MOST = 4096


def png(b: bytes) -> np.ndarray:
    """An 8-bit RGB or RGBA PNG, not interlaced, as height x width x channels."""
    if b[:8] != b"\x89PNG\r\n\x1a\n":
        raise Malformed("not a PNG")
    at, data, head = 8, [], None
    while at + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, at)
        body = b[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"IEND":
            break
        at += 12 + n
    if head is None:
        raise Malformed("no header")
    w, h, depth, colour, _, _, interlace = head
    if depth != 8 or colour not in (2, 6) or interlace or max(w, h) > SIDE_MOST:
        raise Malformed("not an 8-bit RGB tile")
    c = 3 if colour == 2 else 4
    raw = np.frombuffer(inflate(b"".join(data), h * (w * c + 1), 15), np.uint8).reshape(h, w * c + 1)
    out = np.zeros((h, w * c), np.uint8)
    above = np.zeros(w * c, np.uint8)
    for y in range(h):
        kind, line = int(raw[y, 0]), raw[y, 1:]
        if kind == 0:
            row = line.copy()
        elif kind == 1:
            row = np.cumsum(line.reshape(w, c), axis=0, dtype=np.uint64).astype(np.uint8).reshape(-1)
        elif kind == 2:
            row = line + above
        else:
            row = np.zeros(w * c, np.uint8)
            for i in range(w * c):
                left, up, corner = (int(row[i - c]), int(above[i]), int(above[i - c])) if i >= c else (0, int(above[i]), 0)
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    guess = min((left, up, corner), key=lambda v: abs(p - v))
                row[i] = (int(line[i]) + guess) & 255
        out[y] = above = row
    return out.reshape(h, w, c)


def write_png(rgb: np.ndarray) -> bytes:
    h, w, c = rgb.shape
    chunk = lambda k, v: struct.pack(">I", len(v)) + k + v + struct.pack(">I", zlib.crc32(k + v))
    lines = b"".join(b"\0" + rgb[y].tobytes() for y in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if c == 3 else 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def heights(b: bytes) -> np.ndarray:
    """A terrarium tile as metres."""
    rgb = png(b).astype(np.float32)
    if rgb.shape[0] != rgb.shape[1]:
        raise Malformed("a tile is square")
    return rgb[..., 0] * 256 + rgb[..., 1] + rgb[..., 2] / 256 - 32768


def bilinear(grid: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Heights between samples; beyond the edge the edge's."""
    h, w = grid.shape
    x, y = np.clip(x, 0, w - 1), np.clip(y, 0, h - 1)
    i, j = np.minimum(np.floor(x).astype(int), max(w - 2, 0)), np.minimum(np.floor(y).astype(int), max(h - 2, 0))
    u, v = x - i, y - j
    i1, j1 = np.minimum(i + 1, w - 1), np.minimum(j + 1, h - 1)
    return (grid[j, i] * (1 - u) + grid[j, i1] * u) * (1 - v) + (grid[j1, i] * (1 - u) + grid[j1, i1] * u) * v


def slopes(grid: np.ndarray, metres: float) -> tuple[np.ndarray, np.ndarray]:
    """Horn's gradient, east and north, for samples so many metres apart; edges repeat."""
    p = np.pad(grid, 1, mode="edge")
    west, east = p[:-2, :-2] + 2 * p[1:-1, :-2] + p[2:, :-2], p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:]
    north, south = p[:-2, :-2] + 2 * p[:-2, 1:-1] + p[:-2, 2:], p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:]
    return (east - west) / (8 * metres), (north - south) / (8 * metres)


def box_blur(f: np.ndarray, radius: float, passes: int = 3) -> np.ndarray:
    """Separable box blurs; a fractional radius weighs the outermost samples."""
    whole, part = int(radius), radius - int(radius)
    for _ in range(passes):
        for axis in (0, 1):
            n = f.shape[axis]
            at = np.arange(n)
            total = np.zeros_like(f)
            for k in range(-whole - 1, whole + 2):
                total += np.take(f, np.clip(at + k, 0, n - 1), axis) * (part if abs(k) == whole + 1 else 1.0)
            f = total / (2 * whole + 1 + 2 * part)
    return f


def contour(grid: np.ndarray, level: float) -> list[list[tuple[float, float]]]:
    """Marching squares at a level: chains of (x, y); closed ones end where they begin.  A saddle is split by the mean of its
    corners; cells with an unknown corner are skipped."""
    h, w = grid.shape
    high = grid >= level
    links: dict[tuple, list[tuple]] = {}

    def point(edge: tuple) -> tuple[float, float]:
        x, y, across = edge
        a, b = grid[y, x], grid[y, x + 1] if across else grid[y + 1, x]
        t = float((level - a) / (b - a))
        return (x + t, float(y)) if across else (float(x), y + t)

    codes = high[:-1, :-1] * 1 + high[:-1, 1:] * 2 + high[1:, 1:] * 4 + high[1:, :-1] * 8
    known = ~(np.isnan(grid[:-1, :-1]) | np.isnan(grid[:-1, 1:]) | np.isnan(grid[1:, 1:]) | np.isnan(grid[1:, :-1]))
    for y, x in zip(*np.nonzero((codes % 15 > 0) & known), strict=True):
        x, y, c = int(x), int(y), int(codes[y, x])
        top, right, bottom, left = (x, y, True), (x + 1, y, False), (x, y + 1, True), (x, y, False)
        if c in (5, 10):
            middle = grid[y : y + 2, x : x + 2].mean() >= level
            pairs = [(left, bottom), (top, right)] if (c == 5) == bool(middle) else [(left, top), (right, bottom)]
        else:
            crossed = [e for e, on in ((top, high[y, x] != high[y, x + 1]), (right, high[y, x + 1] != high[y + 1, x + 1]), (bottom, high[y + 1, x] != high[y + 1, x + 1]), (left, high[y, x] != high[y + 1, x])) if on]
            pairs = [tuple(crossed)]
        for a, b in pairs:
            links.setdefault(a, []).append(b)
            links.setdefault(b, []).append(a)
    out = []
    for start in sorted(links, key=lambda e: len(links[e])):  # open chains begin at their ends
        while links[start]:
            chain = [start]
            while links[chain[-1]]:
                nxt = links[chain[-1]].pop()
                links[nxt].remove(chain[-1])
                chain.append(nxt)
            out.append([point(e) for e in chain])
    return out


def decode_tiles(tiles: DataFrame, data_col: str = "data") -> DataFrame:
    """tiles (z, x, y, data) to (z, x, y, size, heights)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            grids = [heights(bytes(b)) for b in pdf[data_col]]
            yield pd.DataFrame({"z": pdf["z"], "x": pdf["x"], "y": pdf["y"], "size": [g.shape[0] for g in grids], "heights": [g.reshape(-1) for g in grids]})

    return tiles.mapInPandas(run, "z int, x long, y long, size int, heights array<float>")


def contours(grids: DataFrame, interval: float) -> DataFrame:
    """(z, x, y, size, heights) to a row a contour: level, closed, points; height 0 has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                g = np.asarray(r.heights, np.float64).reshape(r.size, r.size)
                if np.isnan(g).all():
                    continue
                for k in range(int(np.ceil(np.nanmin(g) / interval)), int(np.floor(np.nanmax(g) / interval)) + 1):
                    for line in contour(g, k * interval) if k else ():
                        rows.append((r.z, r.x, r.y, k * interval, line[0] == line[-1], [{"x": x, "y": y} for x, y in line]))
            yield pd.DataFrame(rows, columns=["z", "x", "y", "level", "closed", "points"])

    return grids.mapInPandas(run, "z int, x long, y long, level double, closed boolean, points array<struct<x:double,y:double>>")
