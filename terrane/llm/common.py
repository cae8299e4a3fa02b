"""Shared plumbing: eager intermediate tables on shared storage, work units of bounded size, compact binary columns."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import math
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one in-memory work unit aims at; a longer document is a unit of its own.
UNIT_BYTES = 8_000_000
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where all run on one machine, a fresh local one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = getattr(spark, "_terrane_shared", None)
        if not found:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            found = spark._terrane_shared = tempfile.mkdtemp(prefix="terrane-")
            spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared store through Hadoop, so any file system works."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _remove_late(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone at exit
        remove(spark, path)


class Table:
    """A DataFrame written once as Parquet in the shared folder: cuts lineage and survives lost executors."""

    def __init__(self, df: DataFrame, name: str, options: dict | None = None):
        self.spark = spark = df.sparkSession
        self.path = f"{shared_dir(spark)}/terrane-{name}-{uuid.uuid4().hex}"
        self.schema = df.schema
        before = spark.conf.get(_CLEANUP, "false")
        spark.conf.set(_CLEANUP, "true")  # the shuffles of this write are not read again
        try:
            df.write.options(**({"compression": "zstd"} | (options or {}))).parquet(self.path)
        finally:
            spark.conf.set(_CLEANUP, before)
        atexit.register(_remove_late, spark, self.path)

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        remove(self.spark, self.path)


#: Rows to an Arrow batch: Spark's default of 10,000 is meant for numbers, and long texts would fill a worker.
BATCH_ROWS = 2000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def text_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches for the session, unless it has a size of its own."""
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone, a null text as the empty text; other columns, whatever their names, are left out."""
    text_batches(df.sparkSession)
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """These names, each after as many underscores as make it none of df's columns (Spark's names know no case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def id_crc(col: Column) -> Column:
    """crc32 of the id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")))


def unit_count(df: DataFrame, text_col: str = "text", unit_bytes: int = UNIT_BYTES) -> int:
    """How many work units the texts make, from their total size."""
    total = df.select(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0
    return max(1, math.ceil(total / unit_bytes))


def unit(n: int) -> Column:
    """The unit of a (doc_id, text) row: a fixed function of the row, so that a second read deals out alike."""
    return F.pmod(F.xxhash64("doc_id", F.octet_length("text"), F.substring("text", 1, 64)), F.lit(n)).cast("int")


def pack(a: np.ndarray) -> bytes:
    """Compress integers, byte plane by byte plane."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def unpack(b: bytes, dtype) -> np.ndarray:
    dtype = np.dtype(dtype)
    flat = np.frombuffer(zstandard.decompress(b), np.uint8).reshape(dtype.itemsize, -1)
    return np.ascontiguousarray(flat.T).view(dtype).reshape(-1)


def release() -> None:
    """Give back to the system what this worker, which Spark keeps for later tasks, has freed."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


#: Cached functions whose results a worker keeps from task to task.
_KEPT: list = []


def kept(cached):
    """A cached function that `enter` knows."""
    _KEPT.append(cached)
    return cached


def enter(*own) -> None:
    """Begin a task: what tasks of other operators left in this worker goes; own: the cached functions that stay filled."""
    for f in _KEPT:
        if f not in own:
            f.cache_clear()
    release()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer (the constants are splitmix64's)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
