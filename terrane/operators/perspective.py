"""Pictures of the ground from a camera: frames are rows, each drawn by one task with numpy.

Rays are marched over the height grid, all pixels of a frame at once, and the crossing is refined by halving; a pixel's
colour fades into haze with its distance.  Framing steps the camera back until all of a route's points fit."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions.camera import FOV, NEAR
from ..functions.mercator import CIRCUMFERENCE
from ..sources.dem import bilinear, write_png

SKY, HORIZON, MARGIN = (74, 130, 200), (198, 217, 238), 0.08


def axes(heading: float, pitch: float) -> np.ndarray:
    """The camera's right, up and forward, as rows of (east, north, up)."""
    h, p = math.radians(heading), math.radians(pitch)
    ahead = np.array([math.sin(h) * math.cos(p), math.cos(h) * math.cos(p), -math.sin(p)])
    right = np.array([math.cos(h), -math.sin(h), 0.0])
    return np.array([right, np.cross(right, ahead), ahead])


def project(points: np.ndarray, heading: float, pitch: float, distance: float, fov: float, width: int, height: int) -> np.ndarray:
    """(east, north, up) of the target to image x, y and depth; NaN behind the camera."""
    c = points @ axes(heading, pitch).T + [0, 0, distance]
    f = height / 2 / math.tan(math.radians(fov) / 2)
    z = np.where(c[:, 2] >= NEAR, c[:, 2], np.nan)
    return np.column_stack([width / 2 + c[:, 0] / z * f, height / 2 - c[:, 1] / z * f, z])


def picture(heights: np.ndarray, colours: np.ndarray, spacing: float, heading: float, pitch: float, distance: float, width: int, height: int, fov: float = FOV, raised: float = 1.0, haze: float | None = None, steps: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """RGB and depth of ground whose samples are `spacing` metres apart, north at the top, the target at its middle."""
    n, m = heights.shape
    ground = np.nan_to_num(heights) * raised
    base = float(bilinear(ground, np.array([(m - 1) / 2]), np.array([(n - 1) / 2]))[0])
    right, up, ahead = axes(heading, pitch)
    eye = -ahead * distance + [0, 0, base]
    f = height / 2 / math.tan(math.radians(fov) / 2)
    x, y = np.meshgrid(np.arange(width) + 0.5 - width / 2, height / 2 - np.arange(height) - 0.5)
    rays = ahead + (x[..., None] * right + y[..., None] * up) / f  # one metre forward along the camera's axis
    def over(t):
        p = eye + rays * t[..., None]
        i, j = p[..., 0] / spacing + (m - 1) / 2, (n - 1) / 2 - p[..., 1] / spacing
        inside = (i >= 0) & (i <= m - 1) & (j >= 0) & (j <= n - 1)
        return p[..., 2] - bilinear(ground, i, j), inside, i, j

    far = distance + 2 * spacing * math.hypot(n, m)
    marks = NEAR * (far / NEAR) ** (np.arange(steps + 1) / steps)
    hit, low, high = np.zeros(x.shape, bool), np.zeros(x.shape), np.zeros(x.shape)
    was = np.ones(x.shape, bool)
    for a, b in zip(marks, marks[1:], strict=False):
        above, inside, *_ = over(np.full(x.shape, b))
        new = ~hit & was & inside & (above <= 0)
        hit |= new
        low[new], high[new] = a, b
        was = (above > 0) | ~inside
    for _ in range(20):
        mid = (low + high) / 2
        above, *_ = over(mid)
        low, high = np.where(above > 0, mid, low), np.where(above > 0, high, mid)
    _, _, i, j = over(high)
    i, j = np.clip(np.round(i).astype(int), 0, m - 1), np.clip(np.round(j).astype(int), 0, n - 1)
    down = np.linspace(0, 1, height)[:, None, None]
    sky = np.array(SKY) * (1 - down) + np.array(HORIZON) * down + np.zeros((1, width, 1))
    fade = 1 - np.exp(-((high / (haze or 3 * distance)) ** 2))
    land = colours[j, i] * (1 - fade[..., None]) + np.array(HORIZON) * fade[..., None]
    return np.round(np.where(hit[..., None], land, sky)).astype(np.uint8), np.where(hit, high, np.nan)


def visible(depth: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Which projected points (x, y, depth) the picture shows: on it, and not behind the ground."""
    h, w = depth.shape
    on = (seen[:, 0] >= 0) & (seen[:, 0] < w) & (seen[:, 1] >= 0) & (seen[:, 1] < h)
    i, j = (np.where(on, seen[:, k], 0).astype(int) for k in (0, 1))
    front = depth[j, i]
    return on & ~np.isnan(front) & (seen[:, 2] <= front + np.maximum(5, front / 20))


def footprint(heading: float, pitch: float, distance: float, fov: float, aspect: float, most: float) -> tuple[float, float, float, float]:
    """The ground rectangle (west, south, east, north metres of the target) that a camera sees, out to `most` metres."""
    right, up, ahead = axes(heading, pitch)
    eye, t = -ahead * distance, math.tan(math.radians(fov) / 2)
    spots = [(0.0, 0.0)]
    for sx in (-1, 1):
        for sy in (-1, 1):
            ray = ahead + sx * t * aspect * right + sy * t * up
            size = float(np.linalg.norm(ray))
            reach = min(-eye[2] / ray[2] if ray[2] < 0 else math.inf, most / size)
            p = eye + ray * reach
            spots.append((float(p[0]), float(p[1])))
    e, n = zip(*spots, strict=True)
    return min(e), min(n), max(e), max(n)


def frame(points: np.ndarray, heading: float, pitch: float, fov: float = FOV, aspect: float = 1.5) -> tuple[float, float, float]:
    """(east, north, distance): where to look and from how far, so that all points (east, north) fit with a margin and sit
    evenly between the edges."""
    t = math.tan(math.radians(fov) / 2) * (1 - 2 * MARGIN)
    r, u, a = axes(heading, pitch)
    flat = np.column_stack([points, np.zeros(len(points))])
    centre = (flat.max(0) + flat.min(0)) / 2
    span = max(1.0, float(np.hypot(*(points.max(0) - points.min(0)))))
    forward = np.array([math.sin(math.radians(heading)), math.cos(math.radians(heading)), 0])
    across = np.array([r[0], r[1], 0])

    def spread(at: np.ndarray, d: float):
        c = (flat - at) @ np.array([r, u, a]).T + [0, 0, d]
        return None if (c[:, 2] < NEAR).any() else (c[:, 0] / c[:, 2] / (t * aspect), c[:, 1] / c[:, 2] / t)

    def least(at: np.ndarray) -> float:
        lo, hi = 0.0, 100 * span
        for _ in range(60):
            d = (lo + hi) / 2
            s = spread(at, d)
            fits = s is not None and max(np.abs(s[0]).max(), np.abs(s[1]).max()) <= 1
            lo, hi = (lo, d) if fits else (d, hi)
        return hi

    at = centre
    for _ in range(30):
        d = least(at)
        x, y = spread(at, d)
        at = at + across * (x.max() + x.min()) / 2 * t * aspect * d * 0.5 + forward * (y.max() + y.min()) / 2 * t * d * 0.5 / max(0.2, math.sin(math.radians(pitch)))
    return float(at[0]), float(at[1]), least(at)


def hull(points: np.ndarray) -> np.ndarray:
    """The corners of the convex hull.  On level ground before a camera the outermost of any points on a picture are among them, so a
    route of any length is framed by these few, and by all of its points."""
    rows = np.unique(points, axis=0)
    if len(rows) < 3:
        return rows

    def side(ps: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for q in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]):
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(side(rows) + side(rows[::-1]))


def best_heading(points: np.ndarray, pitch: float, fov: float = FOV, aspect: float = 1.5, headings: int = 24) -> tuple[float, float]:
    """(heading, distance) from which a route fits nearest; an earlier heading stays unless one is a thousandth nearer."""
    best = (0.0, math.inf)
    for k in range(headings):
        h = 360.0 * k / headings
        d = frame(points, h, pitch, fov, aspect)[2]
        if d < best[1] * 0.999:
            best = (h, d)
    return best


def framed(routes: DataFrame, pitch: float = 35.0, aspect: float = 1.5) -> DataFrame:
    """routes (route_id, lat, lon) to a camera each: lat, lon, heading, distance."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        rad = np.radians(np.clip(pdf["lat"].to_numpy(), -85, 85))
        x, y = pdf["lon"].to_numpy() / 360, np.log(np.tan(np.pi / 4 + rad / 2)) / (2 * np.pi)
        x0, y0 = (x.min() + x.max()) / 2, (y.min() + y.max()) / 2
        lat0 = math.degrees(2 * math.atan(math.exp(2 * math.pi * y0)) - math.pi / 2)
        k = CIRCUMFERENCE * math.cos(math.radians(lat0))
        p = np.column_stack([(x - x0) * k, (y - y0) * k])
        p = hull(p)
        heading, _ = best_heading(p, pitch, aspect=aspect)
        e, n, d = frame(p, heading, pitch, aspect=aspect)
        lat = math.degrees(2 * math.atan(math.exp(2 * math.pi * (y0 + n / k))) - math.pi / 2)
        return pd.DataFrame([(pdf["route_id"].iloc[0], lat, (x0 + e / k) * 360, heading, d)], columns=["route_id", "lat", "lon", "heading", "distance"])

    return routes.groupBy("route_id").applyInPandas(one, f"route_id {routes.schema['route_id'].dataType.simpleString()}, lat double, lon double, heading double, distance double")


def frames(cameras: DataFrame, width: int, height: int) -> DataFrame:
    """cameras (frame_id, heading, pitch, distance, spacing, size, heights) to (frame_id, png, seen): the ground in shades of
    its own height; seen is the share of pixels that show ground."""

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                g = np.asarray(r.heights, float).reshape(r.size, r.size)
                t = np.clip((g - np.nanmin(g)) / max(1e-9, np.nanmax(g) - np.nanmin(g)), 0, 1)[..., None]
                colours = np.array([90, 140, 70]) * (1 - t) + np.array([235, 230, 220]) * t
                rgb, depth = picture(g, colours, r.spacing, r.heading, r.pitch, r.distance, width, height)
                rows.append((r.frame_id, write_png(rgb), float((~np.isnan(depth)).mean())))
            yield pd.DataFrame(rows, columns=["frame_id", "png", "seen"])

    return cameras.mapInPandas(run, "frame_id bigint, png binary, seen double")


#: The faintest name that is drawn, and how much more than its share a covered part counts (fixed values).
FAINTEST, COVERED = 1 / 64, 3


def covers(a: tuple, b: tuple, same: bool) -> float:
    """How much box b takes of a name in box a (left, top, right, bottom); a copy of the name takes of it from beside it too."""
    wide, high = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    small = min((a[2] - a[0]) * (a[3] - a[1]), (b[2] - b[0]) * (b[3] - b[1]))
    taken = min(1.0, COVERED * wide * high / small) if wide > 0 and high > 0 and small > 0 else 0.0
    reach = 2 * max(a[2] - a[0], b[2] - b[0])
    if same and reach > 0:
        apart = math.hypot((a[0] + a[2] - b[0] - b[2]) / 2, (a[1] + a[3] - b[1] - b[3]) / 2)
        taken = max(taken, 1 - apart / reach)
    return taken


def edge_fade(box: tuple, width: int, height: int, ramp: float) -> float:
    """1 inside the picture, 0 once a box is `ramp` pixels over its edge, eased between."""
    t = min(1.0, max(0.0, (min(box[0], box[1], width - box[2], height - box[3]) + ramp) / ramp)) if ramp > 0 else 1.0
    return t * t * (3 - 2 * t)


def shown_names(names: DataFrame) -> DataFrame:
    """Names of pictures (frame_id, pos, name, alpha, x0, y0, x1, y1, width, height, ramp) as strong as they are shown: faded at the edge
    and by the names before them that they lie on; too faint ones go.  A fold, so a picture is a group; it holds its own names."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        shown: list[tuple] = []
        for r in pdf.sort_values("pos").itertuples():
            box = (r.x0, r.y0, r.x1, r.y1)
            alpha = r.alpha * edge_fade(box, r.width, r.height, r.ramp)
            for _, _, other, a, b in shown:
                alpha *= 1 - a * covers(box, b, other == r.name)
            if alpha >= FAINTEST:
                shown.append((r.frame_id, r.pos, r.name, alpha, box))
        return pd.DataFrame([s[:4] for s in shown], columns=["frame_id", "pos", "name", "alpha"])

    return names.groupBy("frame_id").applyInPandas(one, "frame_id bigint, pos int, name string, alpha double")
