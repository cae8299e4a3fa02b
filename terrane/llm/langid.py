"""Language by prediction by partial matching.

Each language has a variable-order context tree over bytes: for every context of up to `order` bytes the counts of the
symbols that followed.  A symbol seen in a context costs -log2 n/(n+d) bits there (n: its context's total, d: how many kinds
followed); one not seen pays the escape, -log2 d/(n+d), and asks the next shorter context, down to 8 bits flat.  The
statistics are frozen, so a text's code length is a sum over its bytes, and equal runs of order + 1 bytes cost the same: a
batch prices each distinct run once for all languages.  The language with the shortest code is predicted.

The trees are fitted on a bounded sample: `sample_docs` training texts for each language, chosen by a hash of the id.
Predictions read whole texts.

Defined cases: a null text, or one without a letter, is `und` with score 0; so is every text when nothing could be learned;
rows with a null lang teach nothing; repeated rows are each predicted; an empty table gives no rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Bytes that are priced at a time.
STEP = 1 << 19
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _runs(data: np.ndarray, starts: np.ndarray, order: int) -> np.ndarray:
    """For each byte, itself and the `order` bytes before it as one number; spaces stand before a text."""
    place = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    out = data.astype(np.uint64)
    for k in range(1, order + 1):
        back = np.full(len(data), 32, np.uint64)
        back[k:] = data[:-k] if len(data) > k else 0
        back[place < k] = 32
        out |= back << np.uint64(8 * k)
    return out


def _joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.as_buffer() for t in texts]
    sizes = np.array([len(b) for b in raw], np.int64)
    data = _LOWER[np.frombuffer(b"".join(raw), np.uint8)]
    return data, np.cumsum(sizes) - sizes


def _count(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.enter()
        for batch in batches:
            langs = np.array(batch["lang"].to_pylist(), object)
            for lang in sorted(set(langs)):
                data, starts = _joined(batch["text"].filter(pa.array(langs == lang)))
                u, n = np.unique(_runs(data, starts, order), return_counts=True)
                yield pa.record_batch({"lang": pa.array([lang] * len(u), pa.string()), "run": u.astype(np.int64), "n": n.astype(np.int64)})

    return run


class Model:
    """For each order the price of each run and the escape of each context, a column for each language."""

    def __init__(self, langs: list[str], lang: np.ndarray, run: np.ndarray, n: np.ndarray, order: int):
        self.langs, self.levels = langs, []
        for k in range(order + 1):
            keys, inv = np.unique(run & np.uint64(2 ** (8 * (k + 1)) - 1), return_inverse=True)
            count = np.zeros((len(keys), len(langs)))
            np.add.at(count, (inv, lang), n)
            contexts, up = np.unique(keys >> np.uint64(8), return_inverse=True)
            total, kinds = np.zeros((len(contexts), len(langs))), np.zeros((len(contexts), len(langs)))
            np.add.at(total, up, count)
            np.add.at(kinds, up, count > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                price = np.where(count > 0, -np.log2(count / (total + kinds)[up]), -1)
                escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0)
            self.levels.append((keys, price.astype(np.float32), contexts, escape.astype(np.float32)))

    def bits(self, runs: np.ndarray) -> np.ndarray:
        """The code length of each run's last byte, a column for each language."""
        cost = np.full((len(runs), len(self.langs)), 8, np.float32)
        for k, (keys, price, contexts, escape) in enumerate(self.levels):
            part = runs & np.uint64(2 ** (8 * (k + 1)) - 1)
            at = np.minimum(np.searchsorted(contexts, part >> np.uint64(8)), len(contexts) - 1)
            known = contexts[at] == part >> np.uint64(8)
            cost = cost + np.where(known[:, None], escape[at], 0)
            at = np.minimum(np.searchsorted(keys, part), len(keys) - 1)
            own = np.where((keys[at] == part)[:, None], price[at], -1)
            cost = np.where(own >= 0, own, cost)
        return cost


def picked(id_col: str, share: dict[str, float]) -> Column:
    """Is the row in its language's share, told by a hash of the id in units of a millionth of a millionth, one at least."""
    million, h = F.lit(1_000_000), F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("sample"))
    rest = F.pmod(F.shiftright(h, 20), million)  # finer than the millionths
    units = F.coalesce(*(F.when(F.col("lang") == k, F.lit(max(1, int(v * 10**12)))) for k, v in sorted(share.items())))
    return F.pmod(h, million) * million + rest < units


def fit(df: DataFrame, order: int = 4, sample_docs: int = 500, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train=None) -> Model | None:
    """Frozen trees from at most about `sample_docs` texts a language (rows where `train` holds, if given)."""
    rows = df.where(train) if train is not None else df
    rows = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null and text != ''")
    share = {r["lang"]: min(1.0, sample_docs / r["n"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not share:
        return None
    some = rows.where(picked("id", share))
    counts = some.select("lang", "text").mapInArrow(_count(order), "lang string, run long, n long").groupBy("lang", "run").agg(F.sum("n").alias("n")).toArrow()
    if not counts.num_rows:
        return None
    langs = sorted(set(counts["lang"].to_pylist()))
    code = {k: i for i, k in enumerate(langs)}
    return Model(langs, np.array([code[x] for x in counts["lang"].to_pylist()]), counts["run"].to_numpy().astype(np.uint64), counts["n"].to_numpy().astype(float), order)


def _score(model: Model, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.enter()
        for batch in batches:
            for some in _slices(batch):
                data, starts = _joined(some["__text"])
                sizes = np.diff(np.append(starts, len(data)))
                bits, owner = np.zeros((len(starts), len(model.langs))), np.repeat(np.arange(len(starts)), sizes)
                runs = _runs(data, starts, order)
                for a in range(0, len(runs), STEP):
                    u, inv = np.unique(runs[a : a + STEP], return_inverse=True)
                    cost = model.bits(u)
                    for k in range(len(model.langs)):
                        bits[:, k] += np.bincount(owner[a : a + STEP], cost[inv, k], len(starts))
                best = bits.argmin(1)
                less = (bits - bits.min(1, keepdims=True)) / np.sqrt(np.maximum(sizes, 1))[:, None]
                score = 1 / np.exp2(-np.minimum(less, 1000)).sum(1)
                told = some["__letters"].to_numpy(zero_copy_only=False) & (sizes > 0)
                names = pa.array([model.langs[b] if t else "und" for b, t in zip(best, told, strict=True)], pa.string())
                kept = [c for c in some.schema.names if c not in ("__text", "__letters")]
                yield pa.RecordBatch.from_arrays([*(some[c] for c in kept), names, pa.array(np.where(told, score, 0.0))], names=[*kept, "lang_pred", "score"])

    return run


def _slices(batch: pa.RecordBatch, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about so many bytes of text; a longer text is alone."""
    size, first = 0, 0
    for i, t in enumerate(batch["__text"]):
        size += len(t.as_buffer())
        if size >= most:
            yield batch.slice(first, i + 1 - first)
            size, first = 0, i + 1
    if first < batch.num_rows:
        yield batch.slice(first)


def predict(df: DataFrame, model: Model | None, order: int = 4, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """The columns `keep` of each row with lang_pred and score."""
    C.text_batches(df.sparkSession)
    keep = [c for c in (df.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    if model is None:
        return df.select(*keep, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    rows = df.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("__text"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("__letters"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name not in ("__text", "__letters"))
    return rows.mapInArrow(_score(model, order), f"{fields}, lang_pred string, score double")


def identify(df: DataFrame, order: int = 4, sample_docs: int = 500) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the rows whose crc32(doc_id) mod 3 is not 1."""
    held = F.pmod(C.id_crc(F.col("doc_id")), F.lit(3)) == 1
    rows = df.select("doc_id", "text", "lang", held.alias("held_out"))
    return predict(rows, fit(rows, order, sample_docs, train=~F.col("held_out")), order, ["doc_id", "held_out"])
