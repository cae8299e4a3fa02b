"""Token ids as Parquet list columns.

Documents are dealt by ranges of doc_id, tokenized, and written in that order by Spark's own writer (so a lost executor's
files are written again), with dictionary or delta encoding, row groups and pages of a stated size, and page indexes.  Row
counts and starts are columns beside the ids, so a reader that wants only these touches none of the ids' pages, and one
that wants a few documents finds their pages by the index on doc_id.

Defined cases: a null or empty text is the end id alone; equal ids are ordered by their text's size and hash; a null doc_id
comes first; ids of any type that has an order; an empty table gives no rows; a text of any length is one list; other columns,
whatever their names, are not read."""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .bpe import encoder
from .packing import offsets

#: Writer settings for the two encodings; parquet-format names.
ENCODINGS = {"dictionary": {"parquet.enable.dictionary": "true", "parquet.writer.version": "v1"}, "delta": {"parquet.enable.dictionary": "false", "parquet.writer.version": "v2"}}
#: Up to so many ranges each holds one work unit; beyond it their number grows as the root of the input, so that the driver's
#: numbers, one a range, stay few (a range is sorted with spilling and read as a stream, so its size is not bound by memory).
MANY = 1000
FILE = "part int, doc_id {}, before long, n_tokens long, tokens array<int>"


def _encode(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, before = encoder(path), 0  # a task is one range
        for batch in batches:
            for at in range(0, batch.num_rows, 2500):
                some = batch.slice(at, 2500)
                ids = [np.append(x, enc.dtype.type(end)) for x in enc.encode(some["text"])]
                n = np.array([len(x) for x in ids], np.int64)
                start = before + np.cumsum(n) - n
                before += int(n.sum())
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(n)]).astype(np.int32), pa.array(np.concatenate(ids).astype(np.int32)))
                yield pa.record_batch({"part": some["part"], "doc_id": some["doc_id"], "before": start, "n_tokens": n, "tokens": lists})

    return run


def write(df: DataFrame, vocabulary: str, path: str, end: int = 2, encoding: str = "dictionary", row_group_bytes: int = 16 << 20, page_bytes: int = 64 << 10, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all documents in ascending doc_id order."""
    docs = C.documents(df, id_col, text_col).withColumns({"size": F.octet_length("text"), "hash": F.xxhash64("text")})
    units = max(1, C.unit_count(docs))
    parts = units if units <= MANY else math.ceil(math.sqrt(units * MANY))
    # rows that agree in id and text, whose order is of no matter, are parted by their place, so that no range is all copies
    keys = ["doc_id", "size", "hash", "place"]
    dealt = docs.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).withColumn("part", F.spark_partition_id())
    dealt = dealt.sortWithinPartitions(*keys[:3]).select("part", "doc_id", "text")
    options = ENCODINGS[encoding] | {"compression": "zstd", "parquet.compression.codec.zstd.level": "1", "parquet.block.size": str(row_group_bytes), "parquet.page.size": str(page_bytes), "parquet.page.row.count.limit": "2000"}
    spark = df.sparkSession
    # the two-level form of lists writes a list's items in one call, not a group for each; readers know both
    wanted = {C._CLEANUP: "true", "spark.sql.parquet.writeLegacyFormat": "true"}
    before = {k: spark.conf.get(k, "false") for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        dealt.mapInArrow(_encode(vocabulary, end), FILE.format(docs.schema["doc_id"].dataType.simpleString())).write.options(**options).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def read(spark: SparkSession, path: str, kind: str = "bigint") -> DataFrame:
    """(doc_id, start, n_tokens, tokens): starts by prefix sums over the files' totals, which need no page of ids."""
    files = spark.read.schema(FILE.format(kind)).parquet(path)
    base = offsets(files.groupBy("part").agg(F.sum("n_tokens").alias("n")))
    at = spark.createDataFrame(sorted(base.items()) or [(-1, 0)], "part int, base long")  # a number for each file
    return files.join(F.broadcast(at), "part").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "tokens")


def _digest(base: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["tokens"]
            flat, at = lists.values.to_numpy(zero_copy_only=False).view("<u4"), lists.offsets.to_numpy()
            start = batch["before"].to_numpy() + np.array([base[p] for p in batch["part"].to_pylist()], np.int64)
            yield pa.record_batch({"doc_id": batch["doc_id"], "start": start, "n_tokens": np.diff(at).astype(np.int64), "ids_crc32": np.array([zlib.crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], np.int64)})

    return run


def round_trip(df: DataFrame, vocabulary: str, end: int = 2, encoding: str = "dictionary") -> DataFrame:
    """Write, read back and digest: doc_id, start, n_tokens, ids_crc32."""
    spark, kind = df.sparkSession, df.schema["doc_id"].dataType.simpleString()
    path = f"{C.shared_dir(spark)}/terrane-tokens-{uuid.uuid4().hex}"
    write(df, vocabulary, path, end, encoding)
    C.atexit.register(C._remove_late, spark, path)
    files = spark.read.schema(FILE.format(kind)).parquet(path)
    base = offsets(files.groupBy("part").agg(F.sum("n_tokens").alias("n")))
    return files.mapInArrow(_digest(base), f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")
