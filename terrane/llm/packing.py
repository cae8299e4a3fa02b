"""Packing by concatenate and cut.

Pass one tokenizes each partition, writes the ids to a shared table with their place in the partition, and totals them.
Prefix sums over the partitions' totals (one number each) give every document its place in the whole stream; pass two cuts
the stream into fixed windows and writes a record for each piece, with flags where a window's boundary cuts a document.
No document moves between tasks and no id is padded but in the last window.

Defined cases: a null or empty text is the closing id alone; repeated rows and ids are documents of their own; an empty
table gives no rows; a document of any length is cut into as many windows as it takes."""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .bpe import encoder

PIECES = "doc_id {}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cut_before boolean, cut_after boolean"


def _tokenize(path: str, closing: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.enter(encoder)
        enc, part, before = encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            C.release()
            for at in range(0, batch.num_rows, 2500):
                some = batch.slice(at, 2500)
                ids = [np.append(x, enc.dtype.type(closing)) for x in enc.encode(some["text"])]
                n = np.array([len(x) for x in ids], np.int64)
                start = before + np.cumsum(n) - n
                before += int(n.sum())
                yield pa.record_batch({"part": np.full(len(n), part, np.int32), "doc_id": some["doc_id"], "before": start, "n": n, "width": np.full(len(n), enc.dtype.itemsize, np.int32), "ids": pa.array([x.tobytes() for x in ids], pa.binary())})

    return run


def offsets(totals: DataFrame) -> dict[int, int]:
    """Prefix sums of (part, n): one number for each partition, not for each row."""
    rows = sorted((r["part"], r["n"]) for r in totals.collect())
    return dict(zip((p for p, _ in rows), itertools.accumulate((n for _, n in rows), initial=0), strict=False))


def pack(df: DataFrame, vocabulary: str, length: int = 2048, closing: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, cut_before, cut_after."""
    docs = C.documents(df, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    stream = C.Table(docs.mapInArrow(_tokenize(vocabulary, closing), f"part int, doc_id {kind}, before long, n long, width int, ids binary"), "stream")
    base = offsets(stream.df.groupBy("part").agg(F.sum("n").alias("n")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            parts, before, n = (batch[k].to_numpy(zero_copy_only=False) for k in ("part", "before", "n"))
            first = np.array([base[p] for p in parts.tolist()], np.int64) + before
            pieces = (first + n - 1) // length - first // length + 1
            row = np.repeat(np.arange(len(n)), pieces)
            k = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            seq = first[row] // length + k
            start = np.maximum(seq * length, first[row]) - first[row]
            end = np.minimum((seq + 1) * length, first[row] + n[row]) - first[row]
            crc, at, ids = np.empty(len(row), np.int64), -1, b""
            for i, (r, s, e) in enumerate(zip(row.tolist(), start.tolist(), end.tolist(), strict=True)):
                if r != at:
                    at, ids = r, np.frombuffer(batch["ids"][r].as_buffer(), f"<u{batch['width'][r].as_py()}").astype("<u4")
                crc[i] = zlib.crc32(ids[s:e])
            yield pa.record_batch({
                "doc_id": batch["doc_id"].take(pa.array(row)), "start": start, "length": end - start, "ids_crc32": crc, "doc_tokens": n[row],
                "sequence_id": seq, "offset": first[row] + start - seq * length, "cut_before": start > 0, "cut_after": end < n[row],
            })

    return stream.df.mapInArrow(cut, PIECES.format(kind))
