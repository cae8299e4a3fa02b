"""Boundaries from OpenStreetMap elements: members resolved by joins, rings assembled group by group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text

#: Roles that make a way an inner one, and how many continuations a fork may have.
INNER, FORKS = ("inner", "enclave"), 8


def boundaries(relations: DataFrame, language: str = "en", levels: list[int] | None = None) -> DataFrame:
    """Administrative relations of the levels wanted, and cities and towns; nameless ones are left out."""
    tag = lambda k: F.try_element_at("tags", F.lit(k))
    level = text.admin_level(tag("admin_level"))
    city = (tag("boundary") == "place") & tag("place").isin("city", "town")
    admin = (tag("boundary") == "administrative") & level.isNotNull()
    if levels:
        admin = admin & level.isin(levels)
    named = relations.withColumns({"name": text.preferred_name(F.col("tags"), language), "kind": F.when(city, tag("place")).when(admin, level.cast("string"))})
    return named.where("name is not null and kind is not null")


def resolve(relations: DataFrame, ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, pos, way_id, role, points): each relation's way members in order with their points in order.  Ways missing from
    the extract are skipped; a way named twice is there twice; a way's missing node is an error.  Semi-joins first reduce
    ways and nodes to those asked for."""
    members = relations.select("id", F.posexplode("members").alias("pos", "m")).where("m.type = 'way'").select("id", "pos", F.col("m.id").alias("way_id"), F.col("m.role").alias("role"))
    wanted = ways.join(members.select(F.col("way_id").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("way_id"), "refs")
    refs = wanted.select("way_id", F.posexplode("refs").alias("i", "node_id"))
    placed = refs.join(nodes.select(F.col("id").alias("node_id"), "lat", "lon"), "node_id", "left")
    gone = F.when(F.col("lat").isNull(), F.raise_error(F.concat(F.lit("missing node "), F.col("node_id").cast("string"))).cast("double"))
    point = F.struct("i", "node_id", F.coalesce("lat", gone).alias("lat"), "lon")
    lines = placed.groupBy("way_id").agg(F.transform(F.array_sort(F.collect_list(point)), lambda p: F.struct(p["node_id"].alias("id"), p["lat"].alias("lat"), p["lon"].alias("lon"))).alias("points"))
    return members.join(lines, "way_id").select("id", "pos", "way_id", "role", "points")


def _rings(ways: list[list]) -> tuple[list[list], list[list]]:
    """Closed rings and what stays open.  Points are (id, lat, lon).  A chain grows at its end while one way continues it;
    at a fork it takes the way that closes it, if that is the only one."""
    rings = [w[:-1] for w in ways if len(w) > 3 and w[0][0] == w[-1][0]]
    rest = [w for w in ways if not (len(w) > 3 and w[0][0] == w[-1][0]) and len(w) > 1]
    ends: dict[int, list[int]] = {}
    for k, w in enumerate(rest):
        for e in (w[0][0], w[-1][0]):
            ends.setdefault(e, []).append(k)
    used, open_ = [False] * len(rest), []

    def grow(chain: list) -> list:
        while chain[0][0] != chain[-1][0]:
            tip = chain[-1][0]
            found = [k for k in dict.fromkeys(ends.get(tip, ())) if not used[k]]
            if len(found) > 1:
                closing = [k for k in found[:FORKS] if chain[0][0] in (rest[k][0][0], rest[k][-1][0])]
                found = closing if len(found) <= FORKS and len(closing) == 1 else []
            if len(found) != 1:
                return chain
            k = found[0]
            used[k] = True
            w = rest[k] if rest[k][0][0] == tip else rest[k][::-1]
            chain = chain + w[1:]
        return chain

    for k, w in enumerate(rest):
        if used[k]:
            continue
        used[k] = True
        chain = grow(list(w))
        if chain[0][0] != chain[-1][0]:
            chain = grow(chain[::-1])
        if chain[0][0] == chain[-1][0] and len(chain) > 3:
            rings.append(chain[:-1])
        else:
            open_.append(chain)
    return rings, open_


def _twice_area(ring: list) -> float:
    return sum(a[2] * b[1] - b[2] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))


def _inside(ring: list, lat: float, lon: float) -> bool:
    odd = False
    for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
        if (a[1] > lat) != (b[1] > lat) and lon < a[2] + (lat - a[1]) / (b[1] - a[1]) * (b[2] - a[2]):
            odd = not odd
    return odd


def _box(ring: list) -> float:
    lat, lon = [p[1] for p in ring], [p[2] for p in ring]
    return (max(lon) - min(lon)) * (max(lat) - min(lat))


def polygons(outers: list[list], holes: list[list]) -> tuple[list[tuple[list, list]], list[list]]:
    """Outlines with their holes, and holes of no outline.  A hole is probed at a few vertices; the first that any outline
    holds decides, and of those outlines the one of least box."""
    out, orphans = [(o, []) for o in outers], []
    for h in holes:
        for p in h[:: max(len(h) // 5, 1)]:
            inside = [k for k, o in enumerate(outers) if _inside(o, p[1], p[2])]
            if inside:
                out[min(inside, key=lambda k: (_box(outers[k]), k))][1].append(h)
                break
        else:
            orphans.append(h)
    return out, orphans


POINT = "struct<lat:double,lon:double>"
PARTS = f"array<struct<outline:array<{POINT}>,holes:array<array<{POINT}>>>>"


def assemble(resolved: DataFrame) -> DataFrame:
    """(id, parts, outlines, holes, orphans, open_chains, wrapped): a group is one relation, so groups are small and many.
    Rings that cross the antimeridian are dropped and counted; outer rings run counter-clockwise, holes clockwise."""
    import pandas as pd

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        sides: dict[bool, list] = {True: [], False: []}
        for role, points in zip(pdf["role"], pdf["points"], strict=True):
            sides[(role or "").strip().lower() in INNER].append([(p["id"], p["lat"], p["lon"]) for p in points])
        wrapped, kept, chains = 0, {}, 0
        for inner, ways in sides.items():
            rings, open_ = _rings(ways)
            chains += len(open_)
            good = [r for r in rings if all(abs(a[2] - b[2]) <= 180 for a, b in zip(r, r[1:] + r[:1], strict=True))]
            wrapped += len(rings) - len(good)
            kept[inner] = [r if (_twice_area(r) < 0) == inner else r[::-1] for r in good]
        shapes, orphans = polygons(kept[False], kept[True])
        ring = lambda r: [{"lat": p[1], "lon": p[2]} for p in r]
        parts = [{"outline": ring(o), "holes": [ring(h) for h in hs]} for o, hs in shapes]
        return pd.DataFrame([(pdf["id"].iloc[0], parts, len(shapes), sum(len(h) for _, h in shapes), len(orphans), chains, wrapped)], columns=["id", "parts", "outlines", "holes", "orphans", "open_chains", "wrapped"])

    return resolved.groupBy("id").applyInPandas(one, f"id long, parts {PARTS}, outlines int, holes int, orphans int, open_chains int, wrapped int")


def report(assembled: DataFrame) -> DataFrame:
    """Complete, partial and unclosed boundaries and what they are made of: one row."""
    return assembled.agg(
        F.count_if((F.col("outlines") > 0) & (F.col("open_chains") == 0)).alias("complete"), F.count_if((F.col("outlines") > 0) & (F.col("open_chains") > 0)).alias("partial"), F.count_if(F.col("outlines") == 0).alias("unclosed"),
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("outlines", "holes", "orphans", "open_chains", "wrapped")),
    )
