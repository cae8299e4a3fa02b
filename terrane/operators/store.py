"""A store of tiles on any file system that Spark reaches.

Tiles lie in Parquet partitioned by source and cell, so one cell is read or dropped without touching another.  What is known
of sources and cells is append-only: the last entry of a key holds, a dropped cell is an entry too, so a writer that fails
half way leaves what was there before."""

from __future__ import annotations

import time

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text, tileid
from ..sources import pmtiles
from . import ordered, planning

#: Bytes of an archive whose ranges are merged by one task.
BLOCK = 256 << 20
TILES = "source_id string, cell long, z int, x long, y long, size long, data binary"
CELLS = "source_id string, x long, y long, zoom_min int, zoom_max int, tiles long, bytes long, fetched timestamp, last_used timestamp, complete boolean, gone boolean, seq long"
SOURCES = "source_id string, source string, build string, attribution string, compression string, zoom_min int, zoom_max int, created timestamp, seq long"


class Store:
    def __init__(self, spark: SparkSession, root: str, cell_zoom: int = planning.CELL_ZOOM):
        self.spark, self.root, self.cell_zoom = spark, root.rstrip("/"), cell_zoom

    def _read(self, table: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{table}")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], schema)
            raise

    def _append(self, df: DataFrame, table: str, schema: str) -> None:
        names = [x.strip().split(" ")[0] for x in schema.split(",")]
        df.withColumn("seq", F.lit(time.time_ns())).select(*names).write.mode("append").parquet(f"{self.root}/{table}")

    @staticmethod
    def _last(df: DataFrame, *key: str) -> DataFrame:
        return df.withColumn("__r", F.row_number().over(W.partitionBy(*key).orderBy(F.col("seq").desc()))).where("__r = 1").drop("__r")

    def sources(self) -> DataFrame:
        return self._last(self._read("sources", SOURCES), "source_id").orderBy("source_id")

    def cells(self) -> DataFrame:
        return self._last(self._read("cells", CELLS), "source_id", "x", "y").where("not gone").orderBy("source_id", "y", "x")

    def tiles(self) -> DataFrame:
        return self._read("tiles", TILES).withColumn("source_id", F.col("source_id").cast("string"))

    def add_source(self, source: str, build: str, attribution: str, compression: str) -> str:
        """Adds a source or refreshes its description; its compression may not change, its age and zooms stay."""
        one = self.spark.createDataFrame([(source, build, attribution, compression)], "source string, build string, attribution string, compression string")
        one = one.withColumn("source_id", text.source_id(F.col("source"), F.col("build")))
        old = self.sources().select("source_id", F.col("compression").alias("was"), "zoom_min", "zoom_max", "created")
        row = one.join(old, "source_id", "left").first()
        if row["was"] is not None and row["was"] != compression:
            raise ValueError(f"source {row['source_id']} holds {row['was']} tiles, not {compression}")
        joined = one.join(old, "source_id", "left").withColumns({"zoom_min": F.coalesce("zoom_min", F.lit(1)), "zoom_max": F.coalesce("zoom_max", F.lit(0)), "created": F.coalesce("created", F.current_timestamp())})
        self._append(joined, "sources", SOURCES)
        return row["source_id"]

    def _cell(self, z, x, y):
        """A tile's cell as one number; overview tiles, above the cells' zoom, are cell -1."""
        up = F.expr(f"shiftright(y, z - {self.cell_zoom}) * {2**self.cell_zoom} + shiftright(x, z - {self.cell_zoom})")
        return F.when(z < self.cell_zoom, F.lit(-1)).otherwise(up).cast("long")

    def fill(self, source_id: str, tiles: DataFrame, cells: DataFrame | None = None, zoom_max: int | None = None) -> None:
        """Writes tiles (z, x, y, data) that are not held.  cells (x, y): these are complete down to zoom_max afterwards, and
        are entered only once their tiles are written."""
        new = tiles.withColumns({"source_id": F.lit(source_id), "cell": self._cell(F.col("z"), F.col("x"), F.col("y"))})
        # the cell is a key of the join, so that only partitions of cells in question are read
        new = planning.fill(new.dropDuplicates(["source_id", "z", "x", "y"]).withColumn("size", F.octet_length("data").cast("long")), self.tiles().where(F.col("source_id") == source_id), ["cell"])
        new.select("source_id", "cell", "z", "x", "y", "size", "data").repartition("cell").write.mode("append").partitionBy("source_id", "cell").parquet(f"{self.root}/tiles")
        if cells is None:
            return
        held = self.tiles().where((F.col("source_id") == source_id) & (F.col("cell") >= 0)).groupBy("cell").agg(F.count("*").alias("tiles"), F.sum("size").alias("bytes"))
        side = 2**self.cell_zoom
        done = cells.select("x", "y").distinct().withColumn("cell", F.col("y") * side + F.col("x")).join(held, "cell", "left")
        before = self.cells().where(F.col("source_id") == source_id).select("x", "y", F.col("zoom_max").alias("was"))
        entry = done.join(before, ["x", "y"], "left").select(
            F.lit(source_id).alias("source_id"), "x", "y", F.lit(self.cell_zoom).alias("zoom_min"), F.greatest(F.lit(zoom_max or self.cell_zoom), F.col("was")).alias("zoom_max"),
            F.coalesce("tiles", F.lit(0)).alias("tiles"), F.coalesce("bytes", F.lit(0)).alias("bytes"), F.current_timestamp().alias("fetched"), F.current_timestamp().alias("last_used"), F.lit(True).alias("complete"), F.lit(False).alias("gone"),
        )
        self._append(entry, "cells", CELLS)
        widest = self.sources().where(F.col("source_id") == source_id)
        low, high = F.lit(self.cell_zoom), F.lit(zoom_max or self.cell_zoom)
        empty = F.col("zoom_min") > F.col("zoom_max")
        self._append(widest.withColumns({"zoom_min": F.when(empty, low).otherwise(F.least("zoom_min", low)), "zoom_max": F.when(empty, high).otherwise(F.greatest("zoom_max", high))}), "sources", SOURCES)

    def exhaust(self, source_id: str, x: int, y: int, through: int) -> None:
        """Raises a complete cell's recorded depth: the archive has nothing deeper."""
        mine = self.cells().where((F.col("source_id") == source_id) & (F.col("x") == x) & (F.col("y") == y) & F.col("complete"))
        self._append(mine.withColumn("zoom_max", F.greatest("zoom_max", F.lit(through))), "cells", CELLS)

    def touch(self, cells: DataFrame) -> None:
        """cells (source_id, x, y) were used now."""
        self._append(self.cells().join(cells, ["source_id", "x", "y"], "left_semi").withColumn("last_used", F.current_timestamp()), "cells", CELLS)

    def has(self, wanted: DataFrame) -> DataFrame:
        """wanted (source_id, z, x, y) that are held; no data is read, and only their cells."""
        keyed = wanted.withColumn("cell", self._cell(F.col("z"), F.col("x"), F.col("y")))
        key = ["source_id", "cell", "z", "x", "y"]
        return keyed.join(self.tiles().select(*key), key, "left_semi").select(*wanted.columns)

    def tiles_at(self, source_id: str, zoom: int, limit: int) -> tuple[list, bool]:
        """Up to `limit` tiles held at a zoom, and whether there are more."""
        got = self.tiles().where((F.col("source_id") == source_id) & (F.col("z") == zoom)).select("z", "x", "y").orderBy("y", "x").limit(limit + 1).collect()
        return got[:limit], len(got) > limit

    def bytes(self) -> int:
        return self.tiles().agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]

    def evict(self, budget: int, held: DataFrame | None = None) -> list:
        """Drops the least recently used cells until the store is within budget; held (source_id, x, y) stay."""
        cells = self.cells()
        marked = cells.withColumn("in_use", F.lit(False)) if held is None else cells.join(held.select("source_id", "x", "y").distinct().withColumn("in_use", F.lit(True)), ["source_id", "x", "y"], "left")
        drop = planning.evict(marked, budget, self.bytes()).select(*cells.columns).cache()
        rows = drop.select("source_id", "x", "y", "bytes").collect()  # cells, not tiles
        self._append(drop.withColumn("gone", F.lit(True)), "cells", CELLS)
        fs = self.spark._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for r in rows:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/tiles/source_id={r['source_id']}/cell={r['y'] * 2**self.cell_zoom + r['x']}"), True)
        drop.unpersist()
        return rows

    def fetch(self, source_id: str, archive: str, wanted: DataFrame, cells: DataFrame | None = None, zoom_max: int | None = None, max_gap: int = 64 << 10, max_request: int = 8 << 20) -> None:
        """Carries out a plan: wanted tiles (z, x, y) that are not held are read from an archive and filled in.  Their ranges of bytes are
        merged into requests by blocks of BLOCK bytes, and each request is one row, so a lost executor repeats its own requests only.
        Tiles stay compressed as the archive has them; those that it lacks are left out, as a cell may be complete without them."""
        self.spark.dataSource.register(pmtiles.PmtilesSource)
        view = lambda v: self.spark.read.format("pmtiles").option("view", v).load(archive)
        base = view("header").first()["data_offset"]
        asked = wanted.select("z", "x", "y").distinct().withColumn("source_id", F.lit(source_id))
        missing = asked.join(self.has(asked), ["source_id", "z", "x", "y"], "left_anti").withColumn("tile_id", tileid.tile_id(F.col("z"), F.col("x"), F.col("y")))
        found = planning.lookup(missing, view("directory")).where("offset is not null").withColumn("block", F.floor(F.col("offset") / BLOCK))
        pieces = found.select("block", "offset", "length").distinct()  # a run of equal tiles is one piece
        requests = ordered.coalesce_ranges(pieces, ["block"], max_gap, max_request)
        ranges = requests.select("block", F.col("offset").alias("range_offset"), F.col("length").alias("range_length"))
        sliced = planning.slice_out(pieces, ranges, "block").groupBy("block", "range_offset").agg(F.collect_list(F.struct("offset", "length", "start")).alias("pieces"))

        def run(batches):
            read = pmtiles.opener(archive)
            for pdf in batches:
                for r in pdf.itertuples():
                    got = read(base + r.range_offset, r.range_length)
                    if len(got) != r.range_length:
                        raise OSError(f"asked for {r.range_length} bytes, got {len(got)}")
                    yield pd.DataFrame([(p["offset"], p["length"], got[p["start"] : p["start"] + p["length"]]) for p in r.pieces], columns=["offset", "length", "data"])

        rows = ranges.join(sliced, ["block", "range_offset"]).select("range_offset", "range_length", "pieces")
        fetched = rows.repartition("range_offset").mapInPandas(run, "offset long, length long, data binary")
        tiles = found.select("z", "x", "y", "offset", "length").join(fetched, ["offset", "length"]).select("z", "x", "y", "data")
        self.fill(source_id, tiles, cells, zoom_max)
