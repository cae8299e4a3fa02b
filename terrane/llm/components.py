"""Connected components by alternating large-star and small-star rounds, in DataFrame operations alone.

Every round is two minima by key (pre-aggregated before their shuffle) and two equi-joins whose other side has one row for
each key.  That side is a written table, so that a hub's edges, which are then plain shuffled rows, can be split between tasks by
adaptive skew joins.  Each round's edges are written to shared storage too; nothing is collected but a count and a checksum.
Rounds go on until no edge changes (a logarithm of the longest path, in practice)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) -> (node, component): the least node of each component; nodes without an edge are not in it."""
    now = C.Table(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = lambda t: tuple(t.df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
    old, seen = None, mark(now)
    while seen != old and seen[0]:
        e = now.df
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).union(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = C.Table(both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m")), "least")
        large = both.where("y > x").join(least.df, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = C.Table(small.union(lowest.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now.drop()
        least.drop()
        now, old, seen = new, seen, mark(new)
    e = now.df  # stars: each node points at its component's least
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v"), F.col("v")).distinct())
