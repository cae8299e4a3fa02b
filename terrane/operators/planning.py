"""Which tiles and bytes an area needs, what a store holds of it, and what to drop first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo
from ..functions import mercator as M
from . import ordered

#: The zoom of a store's cells and how deep a cell's pyramid may go (fixed values).
CELL_ZOOM, CELL_DEPTH = 12, 6


def tiles_over(areas: DataFrame, zoom: int, x: str = "x", y: str = "y") -> DataFrame:
    """Areas (w, s, e, n, ...) by the tiles of a zoom that they touch."""
    x0, x1 = M.span(M.world_x(F.col("w")), M.world_x(F.col("e")), zoom)
    y0, y1 = M.span(M.world_y(F.col("n")), M.world_y(F.col("s")), zoom)
    return areas.withColumn(x, F.explode(F.sequence(x0, x1))).withColumn(y, F.explode(F.sequence(y0, y1)))


def cell_count(zoom: int = CELL_ZOOM):
    x0, x1 = M.span(M.world_x(F.col("w")), M.world_x(F.col("e")), zoom)
    y0, y1 = M.span(M.world_y(F.col("n")), M.world_y(F.col("s")), zoom)
    return (x1 - x0 + 1) * (y1 - y0 + 1)


def pyramid(cells: DataFrame, cell_zoom: int, deepest: int) -> DataFrame:
    """Cells (x, y) by all their descendants down to `deepest`: z, tx, ty."""
    levels = cells.withColumn("z", F.explode(F.sequence(F.lit(cell_zoom), F.lit(deepest))))
    levels = levels.withColumn("__n", F.pow(F.lit(2), F.col("z") - cell_zoom).cast("long"))
    return levels.withColumn("tx", F.explode(F.expr("sequence(x * __n, x * __n + __n - 1)"))).withColumn("ty", F.explode(F.expr("sequence(y * __n, y * __n + __n - 1)"))).drop("__n")


def ancestors(cells: DataFrame, cell_zoom: int, least: int = 0) -> DataFrame:
    up = cells.withColumn("z", F.explode(F.sequence(F.lit(least), F.lit(cell_zoom - 1))))
    return up.withColumns({"tx": F.expr(f"shiftright(x, {cell_zoom} - z)"), "ty": F.expr(f"shiftright(y, {cell_zoom} - z)")})


def plan_areas(areas: DataFrame, source_max: int = 15, cell_zoom: int = CELL_ZOOM) -> DataFrame:
    """The union of areas as cells, each to the deepest zoom that any area asks for."""
    deep = areas.withColumn("depth", geo.depth_for(F.col("w"), F.col("s"), F.col("e"), F.col("n"), source_max))
    return tiles_over(deep, cell_zoom).groupBy("x", "y").agg(F.max("depth").alias("depth"))


#: Block sizes for runs, as powers of two: a run lies in at most two blocks of the least size that holds it.
SCALES = (6, 14, 22, 30, 40, 62)


def lookup(wanted: DataFrame, directory: DataFrame) -> DataFrame:
    """wanted (tile_id) with the directory entry (entry_id, offset, length, run_length) that covers it, or null.  An entry
    covers run_length ids.  Entries are keyed by blocks of a size that suits their run, so a block holds a bounded number of
    them however the directory is spread, and the interval join is an equi-join with a residual."""
    runs = directory.where("run_length > 0").select(F.col("tile_id").alias("entry_id"), "offset", "length", "run_length")
    block = lambda v, k: F.call_function("shiftright", v, k)
    runs = runs.withColumn("__s", F.coalesce(*(F.when(F.col("run_length") <= 2**k, F.lit(k)) for k in SCALES)))
    runs = runs.withColumn("__b", F.explode(F.sequence(block(F.col("entry_id"), F.col("__s")), block(F.col("entry_id") + F.col("run_length") - 1, F.col("__s")))))
    keys = F.explode(F.array(*(F.struct(F.lit(k).alias("s"), block(F.col("tile_id"), F.lit(k)).alias("b")) for k in SCALES)))
    asked = wanted.select(F.col("tile_id").cast("long").alias("tile_id")).distinct().withColumn("__k", keys)
    found = asked.join(runs, (F.col("__k.s") == runs["__s"]) & (F.col("__k.b") == runs["__b"]) & (F.col("tile_id") >= F.col("entry_id")) & (F.col("tile_id") < F.col("entry_id") + F.col("run_length")))
    return wanted.join(found.select("tile_id", "entry_id", "offset", "length", "run_length"), "tile_id", "left")


def split_plan(wanted: DataFrame, held: DataFrame, directory: DataFrame) -> DataFrame:
    """wanted (tile_id) as held, absent or located, the last with their bytes."""
    flagged = wanted.join(held.select("tile_id").distinct().withColumn("__h", F.lit(True)), "tile_id", "left")
    found = lookup(flagged, directory)
    status = F.when(F.col("__h"), "held").when(F.col("offset").isNull(), "absent").otherwise("located")
    return found.select(*wanted.columns, status.alias("status"), *(F.when(status == "located", F.col(c)).alias(c) for c in ("offset", "length")))


def totals(plan: DataFrame, by: list[str]) -> DataFrame:
    """Tiles by status, bytes, transfer, requests and waste of a plan (status, offset, length)."""
    counts = plan.groupBy(*by).agg(F.count("*").alias("tiles"), F.count_if(F.col("status") == "held").alias("held"), F.count_if(F.col("status") == "absent").alias("absent"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
    located = plan.where("status = 'located'")
    useful = located.dropDuplicates([*by, "offset", "length"]).groupBy(*by).agg(F.sum("length").alias("useful"))
    ranges = ordered.coalesce_ranges(located.select(*by, "offset", "length"), by).groupBy(*by).agg(F.sum("length").alias("transfer"), F.count("*").alias("requests"))
    out = counts.join(useful, by, "left").join(ranges, by, "left").na.fill(0, ["useful", "transfer", "requests"])
    return out.withColumn("waste", F.greatest(F.lit(0), F.col("transfer") - F.col("useful")))


def coverage(areas: DataFrame, cells: DataFrame, by: str, cell_zoom: int = CELL_ZOOM) -> DataFrame:
    """For each area its cells: complete, partial (begun) and missing, and the complete share.  cells: x, y, complete."""
    wanted = tiles_over(areas, cell_zoom).join(cells.select("x", "y", "complete"), ["x", "y"], "left")
    c = wanted.groupBy(by).agg(F.count("*").alias("cells"), F.count_if(F.col("complete")).alias("complete"), F.count_if(~F.col("complete")).alias("partial"), F.count_if(F.col("complete").isNull()).alias("missing"))
    return c.withColumn("fraction", F.when(F.col("cells") == 0, 0.0).otherwise(F.col("complete") / F.col("cells")))


def held_at(areas: DataFrame, cells: DataFrame, by: str, zoom: int, cell_zoom: int = CELL_ZOOM) -> DataFrame:
    """Held and wanted tiles of a zoom at or below the cells'; a tile is held if its cell is complete to that zoom, whether
    or not the archive had it.  cells: x, y, complete, zoom_max."""
    wanted = tiles_over(areas, zoom, "tx", "ty").withColumns({"x": F.expr(f"shiftright(tx, {zoom - cell_zoom})"), "y": F.expr(f"shiftright(ty, {zoom - cell_zoom})")})
    joined = wanted.join(cells.select("x", "y", "complete", "zoom_max"), ["x", "y"], "left")
    return joined.groupBy(by).agg(F.count_if(F.coalesce(F.col("complete") & (F.col("zoom_max") >= zoom), F.lit(False))).alias("held"), F.count("*").alias("wanted"))


def evict(cells: DataFrame, budget: int, total: int, day: str = "last_used") -> DataFrame:
    """The least recently used cells (last_used, source_id, y, x, bytes, in_use) to drop until `total` is within budget."""
    idle = cells.where(~F.coalesce("in_use", F.lit(False)))
    order = [F.col(day), F.col("source_id"), F.col("y"), F.col("x")]
    freed = ordered.running_total(idle, F.date_trunc("day", F.col(day)), order, "bytes", "freed")
    return freed.where(F.col("freed") - F.col("bytes") < total - budget)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new replace those of old with the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def fill(tiles: DataFrame, held: DataFrame, also: list[str] | None = None) -> DataFrame:
    """Tiles (source_id, z, x, y, data) that a store does not hold yet; also: further columns that equal tiles have in common."""
    key = ["source_id", *(also or []), "z", "x", "y"]
    return tiles.join(held.select(*key), key, "left_anti")


def split_areas(areas: DataFrame, most_cells: int = 1024, cell_zoom: int = CELL_ZOOM) -> DataFrame:
    """Areas (area_id, pos, ...) in order, batched while their distinct cells are at most most_cells: batch numbers.  Greedy
    in the order given, so one group; it holds areas, not tiles."""
    cells = tiles_over(areas, cell_zoom).groupBy("area_id", "pos").agg(F.collect_set(F.struct("x", "y")).alias("cells"))

    def batch(pdf):
        seen, number, out = set(), 0, []
        for r in pdf.sort_values("pos").itertuples():
            own = {(c["x"], c["y"]) for c in r.cells}
            if seen and len(seen | own) > most_cells:
                seen, number = set(), number + 1
            seen |= own
            out.append((r.area_id, number))
        import pandas as pd

        return pd.DataFrame(out, columns=["area_id", "batch"])

    return cells.withColumn("__g", F.lit(0)).groupBy("__g").applyInPandas(batch, f"area_id {areas.schema['area_id'].dataType.simpleString()}, batch int")


def by_source(ids: DataFrame, last: str = "glo30") -> DataFrame:
    """Source ids ascending, one of them always last."""
    return ids.orderBy(F.col("id") == last, "id")


def latest(matches: DataFrame, by: list[str]) -> DataFrame:
    """The preferred match of each key: better rank, then nearer."""
    return matches.withColumn("__r", F.row_number().over(W.partitionBy(*by).orderBy("rank", "distance_m"))).where("__r = 1").drop("__r")


def zoom_range(refs: DataFrame, by: list[str]) -> DataFrame:
    """The least and most zoom of tile references (z) by key."""
    return refs.groupBy(*by).agg(F.min("z").alias("z0"), F.max("z").alias("z1"))


def cap_areas(areas: DataFrame, archives: DataFrame) -> DataFrame:
    """areas (w, s, e, n, max_zoom) as each archive (archive, aw, as, ae, an, lo, hi) is asked for them: no deeper than it goes, inside
    its bounds, none that ends above its first zoom.  Bounds that are null take all.  Archives are a list, checked to be short."""
    if archives.count() > 1000:
        raise ValueError("cap_areas takes a list of archives, 1000 at most")
    pairs = areas.join(F.broadcast(archives), F.col("max_zoom") >= F.col("lo"))
    open_ = F.col("aw").isNull()
    touches = (F.col("e") > F.col("aw")) & (F.col("w") < F.col("ae")) & (F.col("n") > F.col("a_s")) & (F.col("s") < F.col("an"))
    inside = pairs.where(open_ | touches)
    cut = {"w": F.greatest("w", "aw"), "s": F.greatest("s", "a_s"), "e": F.least("e", "ae"), "n": F.least("n", "an"), "max_zoom": F.least("max_zoom", "hi")}
    return inside.withColumns(cut).drop("aw", "a_s", "ae", "an", "lo", "hi")


def shortfall(areas: DataFrame, cells: DataFrame, by: str, deepest: int, cell_zoom: int = CELL_ZOOM) -> DataFrame:
    """What a terrain store lacks for areas drawn at `map_zoom`: for each the zoom that it is asked at (one above the map's, no deeper
    than the archive), wanted and held tiles.  An area's tiles are counted by their cells, not one by one."""
    zoom = F.least(F.greatest(F.col("map_zoom"), F.lit(1)) - 1, F.lit(deepest))
    asked = areas.withColumn("zoom", zoom)
    x0, x1 = M.span(M.world_x(F.col("w")), M.world_x(F.col("e")), F.col("zoom"))
    y0, y1 = M.span(M.world_y(F.col("n")), M.world_y(F.col("s")), F.col("zoom"))
    asked = asked.withColumns({"x0": x0, "x1": x1, "y0": y0, "y1": y1, "up": F.greatest(F.col("zoom") - cell_zoom, F.lit(0))})
    # a cell holds the tiles of the rectangle that lie in it; a zoom above the cells' has tiles wider than a cell
    deep = asked.where(F.col("zoom") >= cell_zoom)
    shift = lambda c, up="up": F.expr(f"shiftright({c}, {up})")
    grid = deep.withColumn("x", F.explode(F.sequence(shift("x0"), shift("x1")))).withColumn("y", F.explode(F.sequence(shift("y0"), shift("y1"))))
    side = F.pow(F.lit(2), F.col("up")).cast("long")
    across = lambda c, a, b: F.least(F.col(b), F.col(c) * side + side - 1) - F.greatest(F.col(a), F.col(c) * side) + 1
    grid = grid.withColumn("tiles", across("x", "x0", "x1") * across("y", "y0", "y1")).join(cells.select("x", "y", "complete", "zoom_max"), ["x", "y"], "left")
    full = F.coalesce(F.col("complete") & (F.col("zoom_max") >= F.col("zoom")), F.lit(False))
    held = grid.groupBy(by).agg(F.sum(F.when(full, F.col("tiles")).otherwise(0)).alias("held"))
    out = asked.withColumn("wanted", (F.col("x1") - F.col("x0") + 1) * (F.col("y1") - F.col("y0") + 1)).join(held, by, "left")
    return out.select(by, "w", "s", "e", "n", "zoom", "wanted", F.coalesce("held", F.lit(0)).alias("held"))


def shortfall_total(parts: DataFrame, by: list[str]) -> DataFrame:
    """Shortfalls summed: bounds around all, the deepest zoom, and whether any lacks a tile."""
    edges = [F.min("w").alias("w"), F.min("s").alias("s"), F.max("e").alias("e"), F.max("n").alias("n")]
    return parts.groupBy(*by).agg(*edges, F.max("zoom").alias("zoom"), F.sum("wanted").alias("wanted"), F.sum("held").alias("held"), F.bool_or(F.col("held") < F.col("wanted")).alias("lacking"))


def settle(cells: DataFrame, planned: DataFrame) -> DataFrame:
    """cells (x, y, complete, zoom_max) after a plan's cells (x, y, depth) are marked as complete to their depth, whatever the archive
    had; cells that were not known are added, and none becomes shallower."""
    both = cells.join(planned.groupBy("x", "y").agg(F.max("depth").alias("depth")), ["x", "y"], "full")
    done = F.col("depth").isNotNull()
    return both.select("x", "y", (done | F.coalesce("complete", F.lit(False))).alias("complete"), F.greatest("zoom_max", "depth").alias("zoom_max"))


def slice_out(tiles: DataFrame, ranges: DataFrame, by: str) -> DataFrame:
    """tiles (offset, length) of each group with the fetched range (range_offset, range_length) that holds them and where in it they
    begin.  Ranges of a group neither overlap nor touch, so a tile's is the last that begins at or before it: a window over both,
    not an interval join."""
    none = F.lit(None).cast("long")
    rows = ranges.select(by, F.col("range_offset").alias("at"), F.lit(0).alias("kind"), "range_offset", "range_length", none.alias("length"))
    rows = rows.unionByName(tiles.select(by, F.col("offset").alias("at"), F.lit(1).alias("kind"), none.alias("range_offset"), none.alias("range_length"), F.col("length").cast("long").alias("length")))
    last = W.partitionBy(by).orderBy("at", "kind").rowsBetween(W.unboundedPreceding, 0)
    held = rows.withColumn("r", F.last(F.when(F.col("kind") == 0, F.struct("range_offset", "range_length")), True).over(last)).where("kind = 1")
    fits = F.col("at") + F.col("length") <= F.col("r.range_offset") + F.col("r.range_length")
    return held.select(by, F.col("at").alias("offset"), "length", F.when(fits, F.col("r.range_offset")).alias("range_offset"), F.when(fits, F.col("at") - F.col("r.range_offset")).alias("start"))


def tiles_seen(frames: DataFrame) -> DataFrame:
    """The different tiles (z, x, y) that frames show."""
    return frames.select("z", "x", "y").distinct()
