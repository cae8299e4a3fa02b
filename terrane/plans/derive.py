"""Geometry derived from the driver's tables by formula, in both engines: the tables themselves hold no coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def lon(k: Column) -> Column:
    return (k * 7919 % 36000) / F.lit(100.0) - 180.0


def lat(k: Column) -> Column:
    return (k * 104729 % 17000) / F.lit(100.0) - 85.0


def points(spark: SparkSession, sf_dir: str, table: str = "customer", key: str = "c_custkey") -> DataFrame:
    return read(spark, sf_dir, table).select(F.col(key).alias("point_id"), lat(F.col(key)).alias("lat"), lon(F.col(key)).alias("lon"))


POINTS = "pts AS (SELECT c_custkey AS point_id, (c_custkey * 104729 % 17000) / 1e2 - 85.0::DOUBLE AS lat, (c_custkey * 7919 % 36000) / 1e2 - 180.0::DOUBLE AS lon FROM customer)"
SUPPLIERS = "sup AS (SELECT s_suppkey AS feature_id, (s_suppkey * 104729 % 17000) / 1e2 - 85.0::DOUBLE AS lat, (s_suppkey * 7919 % 36000) / 1e2 - 180.0::DOUBLE AS lon FROM supplier)"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rectangle a nation, with its outline; kind is an administrative level."""
    k = F.col("n_nationkey").cast("long")
    d = read(spark, sf_dir, "nation").select(k.alias("file_pos"), F.col("n_name").alias("name"), (k % 7 + 4).cast("string").alias("kind"), ((k * 37 % 300) - 180).cast("double").alias("w"), ((k * 53 % 130) - 75).cast("double").alias("s"), (k * 7 % 40 + 20).alias("dx"), (k * 11 % 30 + 10).alias("dy"))
    d = d.withColumns({"e": F.col("w") + F.col("dx"), "n": F.col("s") + F.col("dy")}).drop("dx", "dy")
    corner = lambda y, x: F.struct(F.col(y).alias("lat"), F.col(x).alias("lon"))
    none = F.array().cast("array<array<struct<lat:double,lon:double>>>")
    return d.withColumn("parts", F.array(F.struct(F.array(corner("s", "w"), corner("s", "e"), corner("n", "e"), corner("n", "w")).alias("outline"), none.alias("holes"))))


BOXES = """box AS (SELECT n_nationkey::BIGINT AS file_pos, n_name AS name, (n_nationkey % 7 + 4)::VARCHAR AS kind, ((n_nationkey * 37 % 300) - 180)::DOUBLE AS w,
 ((n_nationkey * 53 % 130) - 75)::DOUBLE AS s, ((n_nationkey * 37 % 300) - 180 + n_nationkey * 7 % 40 + 20)::DOUBLE AS e, ((n_nationkey * 53 % 130) - 75 + n_nationkey * 11 % 30 + 10)::DOUBLE AS n FROM nation)"""
HELD = "held AS (SELECT * FROM pts JOIN box ON lat >= s AND lat < n AND lon >= w AND lon < e)"


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A polyline an order near its customer's point: point_id, way_id, kind, name, line, and the point."""
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("v"))
    rows = read(spark, sf_dir, "orders").join(line.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("v")).alias("vs")), F.col("o_orderkey") == F.col("l_orderkey"))
    rows = rows.withColumns({"lat": lat(F.col("o_custkey")), "lon": lon(F.col("o_custkey"))})
    vertex = lambda v: F.struct((F.col("lat") + (v["l_partkey"] % 200 - 100) / F.lit(1000.0)).alias("lat"), (F.col("lon") + (v["l_suppkey"] % 200 - 100) / F.lit(1000.0)).alias("lon"))
    kind = F.when(F.col("o_orderpriority").startswith("1"), "rail").when(F.col("o_orderpriority").startswith("2"), "path").otherwise("road")
    name = F.when(F.col("o_orderstatus") != "O", F.concat(F.lit("way "), F.col("o_orderkey").cast("string")))
    return rows.select(F.col("o_custkey").alias("point_id"), F.col("o_orderkey").alias("way_id"), kind.alias("kind"), name.alias("name"), "lat", "lon", F.transform("vs", vertex).alias("line"))


WAYS = """vx AS (SELECT o_custkey AS point_id, o_orderkey AS way_id, CASE WHEN o_orderpriority LIKE '1%' THEN 'rail' WHEN o_orderpriority LIKE '2%' THEN 'path' ELSE 'road' END AS kind,
 CASE WHEN o_orderstatus <> 'O' THEN 'way ' || o_orderkey END AS name, (o_custkey * 104729 % 17000) / 1e2 - 85.0::DOUBLE AS lat, (o_custkey * 7919 % 36000) / 1e2 - 180.0::DOUBLE AS lon,
 (o_custkey * 104729 % 17000) / 1e2 - 85.0::DOUBLE + (l_partkey % 200 - 100) / 1e3 AS vlat, (o_custkey * 7919 % 36000) / 1e2 - 180.0::DOUBLE + (l_suppkey % 200 - 100) / 1e3 AS vlon,
 row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i, count(*) OVER (PARTITION BY o_orderkey) AS c FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
seg AS (SELECT *, (vlon - lon) * cos(radians(lat)) * 111319.49079444444 AS ax, (vlat - lat) * 111319.49079444444 AS ay,
 (lead(vlon) OVER q - lon) * cos(radians(lat)) * 111319.49079444444 AS bx, (lead(vlat) OVER q - lat) * 111319.49079444444 AS by_ FROM vx WINDOW q AS (PARTITION BY way_id ORDER BY i)),
par AS (SELECT *, CASE WHEN (bx - ax) ** 2 + (by_ - ay) ** 2 > 0 THEN greatest(0, least(1, (-ax * (bx - ax) - ay * (by_ - ay)) / ((bx - ax) ** 2 + (by_ - ay) ** 2))) ELSE 0 END AS t FROM seg),
dist AS (SELECT point_id, way_id, any_value(kind) AS kind, any_value(name) AS name, round(CASE WHEN any_value(c) = 1
 THEN any_value(2 * 6371008.8 * asin(least(1, sqrt(sin(radians(vlat - lat) / 2) ** 2 + cos(radians(lat)) * cos(radians(vlat)) * sin(radians(vlon - lon) / 2) ** 2))))
 ELSE min(CASE WHEN i < c THEN sqrt((ax + t * (bx - ax)) ** 2 + (ay + t * (by_ - ay)) ** 2) END) END, 3) AS distance FROM par GROUP BY point_id, way_id)"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store cells of zoom 6 from orders."""
    d = read(spark, sf_dir, "orders").select((F.col("o_custkey") % 64).alias("x"), (F.col("o_orderkey") % 64).alias("y"), "o_orderstatus", "o_orderdate", "o_totalprice")
    return d.groupBy("x", "y").agg((F.min("o_orderstatus") == "F").alias("complete"), (F.count("*") % 4 + 6).alias("zoom_max"), F.sum(F.floor("o_totalprice").cast("long")).alias("bytes"), F.max("o_orderdate").alias("last_used"))


CELLS = "cells AS (SELECT o_custkey % 64 AS x, o_orderkey % 64 AS y, min(o_orderstatus) = 'F' AS complete, count(*) % 4 + 6 AS zoom_max, sum(floor(o_totalprice)::BIGINT)::BIGINT AS bytes, max(o_orderdate) AS last_used FROM orders GROUP BY 1, 2)"
