"""Language-model scores by deleted interpolation.

Maximum-likelihood estimates of every order are mixed; the weights depend on how often the context was seen (buckets of
powers of two) and are learned by expectation-maximisation on counts of a part of the training texts that the estimates
leave out while the weights are fitted.  The final scores use the counts of all training texts.

How it is dealt out: texts form work units of bounded size.  Each unit sends its distinct n-grams, as packed sorted 64-bit
hashes with their counts, to buckets of the hash space; a bucket adds up the counts of all units and answers each unit in
the unit's own order.  So one shuffle moves a number for each distinct n-gram of a unit (a frequent one is already counted
there), no table of n-grams is ever held whole, and the work is sorting arrays.

Defined cases: a null or empty text is the single end token; rows that repeat count as often as they occur; an empty table
gives no rows; a null id is the empty text for the fold.  Without training texts every token is unseen.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Fixed hashes of the end token and of what stands before a text.
END, START = np.uint64(0x9AE16A3B2F90404F), np.uint64(0xC949D7C7509E6557)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Context buckets: 0 for an unseen context, else 1 + floor(log2(count)), at most this.
TOP = 24
#: Bins to the octave for the ratios that the weights are fitted on.
FINE = 4


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens in order, each text closed by the end token, and where each text begins."""
    words = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(texts)))
    flat, offsets = words.flatten(), words.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    coded = flat.dictionary_encode()
    table = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    hashes = table[coded.indices.to_numpy()] if len(table) else np.zeros(0, np.uint64)
    empty = (pc.binary_length(flat).to_numpy(zero_copy_only=False) == 0) if len(flat) else np.zeros(0, bool)
    if empty.any():  # a blank text splits into one empty word
        before = np.concatenate([[0], np.cumsum(~empty)])
        hashes, offsets = hashes[~empty], before[offsets]
    n = len(offsets) - 1
    starts = offsets[:-1] + np.arange(n)
    out = np.empty(len(hashes) + n, np.uint64)
    ends = offsets[1:] + np.arange(n)
    out[ends] = END
    keep = np.ones(len(out), bool)
    keep[ends] = False
    out[keep] = hashes
    return out, starts


def _grams(seq: np.ndarray, starts: np.ndarray, order: int) -> list[np.ndarray]:
    """For each n the hash of the n tokens that end at each place; the start mark stands in before a text."""
    lags = [seq]
    for _ in range(order - 1):
        last = np.empty_like(seq)
        last[1:] = lags[-1][:-1]
        last[starts] = START
        lags.append(last)
    out = [seq]
    for n in range(2, order + 1):
        h = lags[n - 1]
        for k in range(n - 2, -1, -1):
            h = C.mix(h * _STEP + lags[k])
        out.append(h)
    return out


def _ask(order: int, buckets: int):
    """A unit's distinct n-grams with their counts, cut by bucket."""
    edges = (np.arange(1, buckets, dtype=object) * (2**64 // buckets)).astype(np.uint64)

    def run(table: pa.Table) -> pa.Table:
        unit = table["unit"][0].as_py()
        fold = table["fold"].to_numpy()
        seq, starts = _tokens(table["text"].combine_chunks())
        fold = np.repeat(fold, np.diff(np.append(starts, len(seq))))
        out = {k: [] for k in ("bucket", "n", "unit", "grams", "train", "dev")}
        for n, g in enumerate(_grams(seq, starts, order), 1):
            u, inv = np.unique(g, return_inverse=True)
            train = np.bincount(inv, fold != 0, len(u)).astype(np.uint32)
            dev = np.bincount(inv, fold == 1, len(u)).astype(np.uint32)
            at = np.concatenate([[0], np.searchsorted(u, edges), [len(u)]])
            for b in np.flatnonzero(np.diff(at)):
                s = slice(at[b], at[b + 1])
                for k, v in zip(out, (int(b), n, unit, C.pack(np.diff(u[s], prepend=np.uint64(0))), C.pack(train[s]), C.pack(dev[s])), strict=True):
                    out[k].append(v)
        return pa.table(out, schema=_ASKED)

    return run


_ASKED = pa.schema([("bucket", pa.int32()), ("n", pa.int32()), ("unit", pa.int32()), ("grams", pa.binary()), ("train", pa.binary()), ("dev", pa.binary())])
_REPLY = pa.schema([("bucket", pa.int32()), ("n", pa.int32()), ("unit", pa.int32()), ("train", pa.binary()), ("dev", pa.binary()), ("seen", pa.int64()), ("total", pa.int64()), ("left", pa.int64())])
REPLY_DDL = "bucket int, n int, unit int, train binary, dev binary, seen long, total long, left long"


def _answer(table: pa.Table) -> pa.Table:
    """Counts over all units, given back to each unit; and of single tokens how many kinds and how many in all."""
    rows = table.to_pylist()
    grams = [np.cumsum(C.unpack(r["grams"], np.uint64), dtype=np.uint64) for r in rows]
    cut = np.cumsum([len(g) for g in grams])[:-1]
    u, inv = np.unique(np.concatenate(grams), return_inverse=True)
    sums = [np.bincount(inv, np.concatenate([C.unpack(r[k], np.uint32) for r in rows]), len(u)) for k in ("train", "dev")]
    train, dev = (np.split(s[inv].astype(np.uint32), cut) for s in sums)
    out = [{"bucket": r["bucket"], "n": r["n"], "unit": r["unit"], "train": C.pack(t), "dev": C.pack(d), "seen": 0, "total": 0, "left": 0} for r, t, d in zip(rows, train, dev, strict=True)]
    if rows[0]["n"] == 1:
        out[0] |= {"seen": int((sums[0] > 0).sum()), "total": int(sums[0].sum()), "left": int(sums[1].sum())}
    return pa.Table.from_pylist(out, _REPLY)


def _counts(texts: pa.Table, reply: pa.Table, order: int, docs: tuple[int, int], fit: bool):
    """For every place of the unit's tokens: the count of each n-gram and of its context.  docs: training texts, of them
    left out; fit: counts without those left out."""
    seq, starts = _tokens(texts["text"].combine_chunks())
    parts: dict[int, list] = {}
    for r in sorted(reply.to_pylist(), key=lambda r: r["bucket"]):
        c = C.unpack(r["train"], np.uint32).astype(np.float64)
        parts.setdefault(r["n"], []).append(c - C.unpack(r["dev"], np.uint32) if fit else c)
    counts = []
    for n, g in enumerate(_grams(seq, starts, order), 1):
        u, inv = np.unique(g, return_inverse=True)
        counts.append(np.concatenate(parts[n])[inv])
        assert len(u) == sum(map(len, parts[n])), "a unit was dealt out in two ways"
    contexts = []
    for c in counts[:-1]:
        x = np.empty_like(c)
        x[1:] = c[:-1]
        x[starts] = docs[0] - docs[1] * fit
        contexts.append(x)
    return starts, counts, contexts


def _bucket(contexts: list[np.ndarray], size: int) -> np.ndarray:
    """By the count of the longest context that was seen; which length that is counts too."""
    b = np.zeros(size, np.int64)
    for k, c in enumerate(contexts):
        seen = c > 0
        b[seen] = k * TOP + np.minimum(TOP, 1 + np.log2(c[seen]).astype(np.int64))
    return b


def _estimates(counts, contexts, total: float) -> list[np.ndarray]:
    out = [counts[0] / max(total, 1)]
    for c, x in zip(counts[1:], contexts, strict=True):
        out.append(np.divide(c, x, out=np.zeros_like(c), where=x > 0))
    return out


def learn(bins: dict[tuple, int], order: int, rounds: int = 40) -> np.ndarray:
    """Mixture weights for each bucket, lowest order first, by expectation-maximisation.  bins: how often a bucket and
    the ratios of the estimates to the uniform one occurred, each ratio as a step of its logarithm (-1: zero)."""
    size = (max(1, order - 1)) * TOP + 1
    weights = np.full((size, order + 1), 1 / (order + 1))
    if not bins:
        return weights
    keys, n = np.array(list(bins), np.int64), np.array(list(bins.values()), float)
    ratio = np.column_stack([np.ones(len(keys)), np.where(keys[:, 1:] < 0, 0, 2.0 ** (np.maximum(keys[:, 1:], 0) / FINE - RATIO_LEAST))])
    for _ in range(rounds):
        part = weights[keys[:, 0]] * ratio
        part *= (n / part.sum(1))[:, None]
        new = np.column_stack([np.bincount(keys[:, 0], part[:, k], size) for k in range(order + 1)])
        everywhere = new.sum(0) / new.sum()
        new += 10 * everywhere  # a bucket with few places leans on what holds over all
        weights = new / new.sum(1, keepdims=True)
    return np.maximum(weights, 1e-9)


#: Ratios below 2 ** -this count as that.
RATIO_LEAST = 8


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 2, unit_bytes: int = C.UNIT_BYTES) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities)."""
    spark = df.sparkSession
    docs = C.documents(df, id_col, text_col).withColumn("fold", F.pmod(C.id_crc(F.col("doc_id")), F.lit(10)).cast("int"))
    head = docs.agg(F.sum(F.octet_length("text")).alias("b"), F.count_if(F.col("fold") != 0).alias("t"), F.count_if(F.col("fold") == 1).alias("d")).first()
    units = max(1, -(-(head["b"] or 0) // unit_bytes))
    n_docs = (head["t"], head["d"])
    docs = docs.withColumn("unit", C.unit(units))
    asked = docs.groupBy("unit").applyInArrow(_ask(order, -(-units // 3)), "bucket int, n int, unit int, grams binary, train binary, dev binary")
    reply = C.Table(asked.groupBy("bucket", "n").applyInArrow(_answer, REPLY_DDL), "lm")
    sums = reply.df.agg(F.sum("seen").alias("v"), F.sum("total").alias("n"), F.sum("left").alias("d")).first()
    kinds, total, left_out = sums["v"] or 0, sums["n"] or 0, sums["d"] or 0

    def bins(key, texts: pa.Table, answers: pa.Table) -> pa.Table:
        """How often each bucket and each step of the ratios occurs in the texts left out."""
        if not len(texts):
            return pa.table({"k": [], "n": []}, schema=pa.schema([("k", pa.list_(pa.int64())), ("n", pa.int64())]))
        fold = texts["fold"].to_numpy()
        starts, counts, contexts = _counts(texts, answers, order, n_docs, True)
        fold = np.repeat(fold, np.diff(np.append(starts, len(counts[0]))))
        left = fold == 1
        counts, contexts = [c[left] for c in counts], [c[left] for c in contexts]
        cols = [_bucket(contexts, int(left.sum()))]
        for p in _estimates(counts, contexts, total - left_out):
            with np.errstate(divide="ignore"):
                cols.append(np.where(p > 0, np.maximum(0, np.round((np.log2(p * (kinds + 1)) + RATIO_LEAST) * FINE)), -1).astype(np.int64))
        u, n = np.unique(np.column_stack(cols), axis=0, return_counts=True) if left.any() else (np.zeros((0, len(cols)), np.int64), np.zeros(0, np.int64))
        return pa.table({"k": pa.array(u.tolist(), pa.list_(pa.int64())), "n": n})

    by_unit = docs.groupBy("unit").cogroup(reply.df.select("bucket", "n", "unit", "train", "dev").groupBy("unit"))
    found = by_unit.applyInArrow(bins, "k array<long>, n long").groupBy("k").agg(F.sum("n").alias("n"))
    weights = learn({tuple(r["k"]): r["n"] for r in found.collect()}, order)  # bounded by the number of bins

    def scores(key, texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(texts):
            return _SCORED.empty_table()
        starts, counts, contexts = _counts(texts, answers, order, n_docs, False)
        w = weights[_bucket(contexts, len(counts[0]))]
        p = w[:, 0] / (kinds + 1)
        for k, e in enumerate(_estimates(counts, contexts, total), 1):
            p = p + w[:, k] * e
        base = np.log10((counts[0] + 0.1) / (total + 0.1 * (kinds + 1)))
        return pa.table({
            "doc_id": texts["doc_id"], "held_out": texts["fold"].to_numpy() == 0, "n_tokens": np.diff(np.append(starts, len(p))),
            "n_known": np.add.reduceat((counts[0] > 0).astype(np.int64), starts), "train_tokens": np.full(len(starts), total, np.int64),
            "base_score": np.add.reduceat(base, starts), "score": np.add.reduceat(np.log10(p), starts),
        })

    kind = docs.schema["doc_id"].dataType.simpleString()
    return by_unit.applyInArrow(scores, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
