"""Batch operators on streams: points arrive, areas and features are static.

The join is stream-static and stateless, so no watermark is needed and a restarted query resumes from its checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import mercator as M
from ..operators import spatial


def locate(points: DataFrame, areas: DataFrame) -> DataFrame:
    """Every (point, area) that holds it, as points (lat, lon, ...) arrive."""
    return spatial.containing(points, areas).drop("parts")


def tile_counts(points: DataFrame, zoom: int, time_col: str = "ts", window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Points by tile and time window; rows later than `late` are dropped and a window's state with them."""
    x, y = M.tile_at(zoom, F.col("lon"), F.col("lat"))
    rows = points.withWatermark(time_col, late).select(F.window(time_col, window).alias("w"), x.alias("x"), y.alias("y"))
    return rows.groupBy("w", "x", "y").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "x", "y", "n")
