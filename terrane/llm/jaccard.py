"""Join of documents whose sets of word n-grams have a Jaccard similarity of a threshold or more.

1. Each text's distinct n-grams give a digest (texts with equal sets are one class representative) and MinHash values; bands
   of these are the candidate keys.  With 24 bands of 4 a pair at exactly 0.8 shares none once in 300,000 times.
2. Representatives that share a band, directly or through others, form a neighbourhood (connected components over one edge
   from each member of a band to the band's least member; no pairs are written).
3. Neighbourhoods up to `block` texts are handled together, many to a task; larger ones are cut into blocks, and each pair of
   blocks is a task of its own, so memory is bounded and a large group is spread.  Inside a task MinHash values of candidate
   pairs are compared 16 at a time; a pair is dropped when the posterior probability (uniform prior) that its similarity
   reaches the threshold falls under `tolerance`; the rest are verified exactly on their sets.  A task returns a row for each
   text (its links and a root), never one for each pair.

Words are lower-case and split at ASCII white space; a text of fewer than n words has one n-gram, all its words.

Defined cases: null, empty and blank texts have no n-grams and link to nothing; repeated rows count as documents; a class
is named by its least doc_id; an empty table gives no rows; columns besides id and text, whatever their names, are not read; a
text of any length is one set of n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .components import components

BANDS, ROWS, STEP = 24, 4, 16
HASHES = BANDS * ROWS
_STEP64 = np.uint64(0x9E3779B97F4A7C15)
_MULTIPLY = C.mix(np.arange(1, HASHES + 1, dtype=np.uint64) * _STEP64) | np.uint64(1)
_ADD = C.mix(np.arange(1001, HASHES + 1001, dtype=np.uint64) * _STEP64)


def shingles(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of all texts in order (with repeats), and where each text's begin, with the end."""
    words = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.utf8_lower(texts)))
    flat, at = words.flatten(), words.offsets.to_numpy().astype(np.int64)
    at = at - at[0]
    coded = flat.dictionary_encode()
    table = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    h = table[coded.indices.to_numpy()] if len(table) else np.zeros(0, np.uint64)
    count = np.diff(at)
    blank = np.zeros(len(count), bool)
    one = count == 1
    blank[one] = h[at[:-1][one]] == np.uint64(xxhash.xxh3_64_intdigest(""))
    grams = np.where(blank | (count == 0), 0, np.maximum(count - n + 1, 1))
    starts = np.concatenate([[0], np.cumsum(grams)])
    place = np.repeat(at[:-1], grams) + np.arange(starts[-1]) - np.repeat(starts[:-1], grams)
    wide = np.repeat(np.minimum(count, n), grams)
    out = wide.astype(np.uint64)
    for k in range(n):
        w = h[np.minimum(place + k, len(h) - 1)] if len(place) else h[:0]
        out = np.where(k < wide, C.mix(out * _STEP64 + w), out)
    return out, starts


def signatures(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """MinHash values (texts x HASHES); all texts must have n-grams."""
    out = np.empty((len(starts) - 1, HASHES), np.uint64)
    for k in range(HASHES):
        out[:, k] = np.minimum.reduceat(flat * _MULTIPLY[k] + _ADD[k], starts[:-1])
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    out = np.empty((len(sig), BANDS), np.uint64)
    for b in range(BANDS):
        h = np.full(len(sig), b, np.uint64)
        for k in range(b * ROWS, (b + 1) * ROWS):
            h = C.mix(h * _STEP64 + sig[:, k])
        out[:, b] = h
    return out


def _describe(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.enter()
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                some = batch.slice(at, 250)
                flat, starts = shingles(some["text"], n)
                has = np.flatnonzero(np.diff(starts))
                digest: list = [None] * some.num_rows
                for i in has:
                    digest[i] = xxhash.xxh3_128_digest(np.unique(flat[starts[i] : starts[i + 1]]).tobytes())
                keys: list = [None] * some.num_rows
                if len(has):
                    for i, b in zip(has, bands(signatures(flat, np.append(starts[has], starts[-1]))).view(np.int64), strict=True):
                        keys[i] = b
                yield pa.record_batch({"doc_id": some["doc_id"], "digest": pa.array(digest, pa.binary()), "hash": some["hash"], "bands": pa.array(keys, pa.list_(pa.int64()))})

    return run


@cache
def least_matches(threshold: float, tolerance: float) -> list[int]:
    """For n = STEP, 2 STEP, ...: the fewest equal MinHash values of n with which a pair stays."""
    x = (np.arange(200_000) + 0.5) / 200_000
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        for m in range(n + 1):
            log = m * np.log(x) + (n - m) * np.log1p(-x)
            p = np.exp(log - log.max())
            if p[x >= threshold].sum() / p.sum() >= tolerance:
                out.append(m)
                break
    return out


def _links(flat, starts, sig, cand: np.ndarray, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i < j) of the candidate matrix that reach the threshold."""
    i, j = np.nonzero(np.triu(cand, 1))
    equal = np.zeros(len(i), np.int64)
    for s, least in enumerate(least_matches(threshold, tolerance)):
        for a in range(0, len(i), 200_000):
            p = slice(a, a + 200_000)
            equal[p] += (sig[i[p], s * STEP : (s + 1) * STEP] == sig[j[p], s * STEP : (s + 1) * STEP]).sum(1)
        stay = equal >= least
        i, j, equal = i[stay], j[stay], equal[stay]
    sets = [np.unique(flat[starts[k] : starts[k + 1]]) for k in range(len(sig))]
    size = np.array([len(s) for s in sets], np.int64)
    if len(i) > 8 * len(sig):  # dense: shared n-grams by matrix products over slices of the vocabulary
        owner = np.repeat(np.arange(len(sets)), size)
        _, col, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner, col = owner[n[col] > 1], col[n[col] > 1]
        col = np.unique(col, return_inverse=True)[1]
        order = np.argsort(col, kind="stable")
        owner, col, both = owner[order], col[order], np.zeros((len(sets), len(sets)), np.float32)
        for a in range(0, int(col[-1]) + 1 if len(col) else 0, 4096):
            lo, hi = np.searchsorted(col, [a, a + 4096])
            m = np.zeros((len(sets), min(4096, int(col[-1]) + 1 - a)), np.float32)
            m[owner[lo:hi], col[lo:hi] - a] = 1
            both += m @ m.T
        shared = both[i, j].astype(np.int64)
    else:
        shared = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j, strict=True)], np.int64)
    # compared in whole numbers of millionths, so that 0.8 is not a question of rounding
    ok = shared * 1_000_000 >= round(threshold * 1_000_000) * (size[i] + size[j] - shared)
    return i[ok], j[ok]


_FOUND = pa.schema([("digest", pa.binary()), ("root", pa.binary()), ("texts", pa.int64()), ("docs", pa.int64())])


def _compare(n: int, threshold: float, tolerance: float):
    def run(table: pa.Table) -> pa.Table:
        rows: dict[tuple, dict] = {}
        for k, (hood, digest) in enumerate(zip(table["hood"].to_pylist(), table["digest"].to_pylist(), strict=True)):
            rows.setdefault(hood, {}).setdefault(digest, k)  # repeated rows of a representative count once
        cross = table["i"][0].as_py() != table["j"][0].as_py()
        side, copies, texts = table["block"].to_numpy(), table["copies"].to_numpy(), table["text"].combine_chunks()
        out = {k: [] for k in _FOUND.names}
        for members in rows.values():
            names, at = list(members), np.array(list(members.values()))
            if len(names) < 2:
                continue
            flat, starts = shingles(texts.take(pa.array(at)), n)
            sig = signatures(flat, starts)
            cand = np.zeros((len(names), len(names)), bool)
            for b in bands(sig).T:
                cand |= b[:, None] == b[None, :]
            if cross:
                cand &= side[at][:, None] != side[at][None, :]
            i, j = _links(flat, starts, sig, cand, threshold, tolerance)
            if not len(i):
                continue
            rank = np.argsort(np.argsort(np.array(names, object)))
            top = np.argsort(np.array(names, object))
            low = rank.copy()  # the least name that a text's links reach, by rounds of minima
            while True:
                new = low.copy()
                np.minimum.at(new, i, low[j])
                np.minimum.at(new, j, low[i])
                new = np.minimum(new, new[top[new]])
                if (new == low).all():
                    break
                low = new
            root = top[low]
            w = copies[at]
            t = np.bincount(np.concatenate([i, j]), minlength=len(names))
            d = np.bincount(np.concatenate([i, j]), np.concatenate([w[j], w[i]]), len(names)).astype(np.int64)
            for k in np.flatnonzero(t):
                for c, v in zip(_FOUND.names, (names[k], names[root[k]], int(t[k]), int(d[k])), strict=True):
                    out[c].append(v)
        return pa.table(out, schema=_FOUND)

    return run


def _classes(df: DataFrame, threshold: float, n: int, tolerance: float, block: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest, hash of the text) of each row; (digest, copies, texts, docs, first, class_first) of each set of n-grams."""
    docs = C.documents(df, id_col, text_col).withColumn("hash", F.xxhash64("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    seen = C.Table(docs.mapInArrow(_describe(n), f"doc_id {kind}, digest binary, hash long, bands array<long>"), "sets")
    texts = C.Table(seen.df.where("digest is not null").groupBy("digest", "bands").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "hash")).alias("first")), "texts")
    keys = texts.df.select("digest", F.explode("bands").alias("band"))
    shared = keys.groupBy("band").agg(F.min("digest").alias("least"), F.count("*").alias("n")).where("n > 1").select("band", "least")
    hoods = components(keys.join(shared, "band").select(F.col("digest").alias("u"), F.col("least").alias("v")))
    # a written side: a large neighbourhood's rows are then plain shuffled rows, which adaptive skew joins split
    sizes = C.Table(hoods.groupBy("component").agg(F.count("*").alias("size")), "sizes")
    members = C.Table(hoods.join(sizes.df, "component").join(texts.df.select(F.col("digest").alias("node"), "copies", "first"), "node"), "members")
    total = members.df.count()
    blocks = F.ceil(F.col("size") / block).cast("int")
    few = F.col("size") <= block
    dealt = (
        members.df.select("node", "component", "size", "copies", F.col("first.doc_id").alias("own_id"), F.col("first.hash").alias("own_hash"))
        .join(docs.hint("merge"), F.expr("own_id <=> doc_id and own_hash = hash"))  # one way at every size: no broadcast of members
        .withColumn("block", F.when(few, 0).otherwise(F.pmod(F.xxhash64("node"), blocks)).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.when(few, 0).otherwise(blocks - 1))))
        .select(F.col("node").alias("digest"), F.col("component").alias("hood"), "size", "copies", "block", "text", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                F.when(few, F.pmod(F.xxhash64("component"), F.lit(max(1, -(-total // 300))))).otherwise(F.lit(-1) - F.pmod(F.xxhash64("component"), F.lit(1 << 40))).alias("task"))
    )
    found = C.Table(dealt.groupBy("task", "i", "j").applyInArrow(_compare(n, threshold, tolerance), "digest binary, root binary, texts long, docs long"), "links")
    # within one block pair a root is final only if the neighbourhood has no other block; so roots are joined up
    roots = components(found.df.select(F.col("digest").alias("u"), F.col("root").alias("v")))
    links = found.df.groupBy("digest").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    info = texts.df.select("digest", "copies", "first").join(roots.select(F.col("node").alias("digest"), "component"), "digest", "left").join(links, "digest", "left")
    info = info.withColumn("class", F.coalesce("component", "digest"))
    named = C.Table(info.join(info.groupBy("class").agg(F.min("first").alias("class_first")), "class").select("digest", "copies", "texts", "docs", "first", "class_first"), "classes")
    for t in (texts, sizes, members, found):
        t.drop()
    return seen.df.select("doc_id", "digest", "hash"), named.df


def join(df: DataFrame, threshold: float = 0.8, n: int = 5, tolerance: float = 1e-9, block: int = 1000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id, n_links (other documents at or over the threshold), n_texts (of these,
    different sets of n-grams), n_copies (other documents with the same set), digest."""
    seen, named = _classes(df, threshold, n, tolerance, block, id_col, text_col)
    return seen.join(named, "digest", "left").select(
        "doc_id",
        F.when(F.col("copies").isNull(), F.col("doc_id")).otherwise(F.col("class_first.doc_id")).alias("class_id"),
        (F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("docs", F.lit(0))).alias("n_links"),
        F.coalesce("texts", F.lit(0)).cast("long").alias("n_texts"),
        (F.coalesce("copies", F.lit(1)) - 1).alias("n_copies"),
        F.lower(F.hex("digest")).alias("digest"),
    )


def deduplicate(df: DataFrame, threshold: float = 0.8, n: int = 5, tolerance: float = 1e-9, block: int = 1000) -> DataFrame:
    """The rows of df, one of each class (the least doc_id; of equal ids the least hash of the text) and every row without
    n-grams; rows that agree in id and text are one, whatever their other columns."""
    own, doc, hashed = C.fresh(df, "own", "d", "h")
    seen, named = _classes(df, threshold, n, tolerance, block, "doc_id", "text")
    kept = named.select("class_first.*").union(seen.where("digest is null").select("doc_id", "hash")).distinct()
    kept = C.Table(kept.select(F.col("doc_id").alias(doc), F.col("hash").alias(hashed)), "kept").df
    twice = seen.groupBy("doc_id", "hash").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    rows = df.withColumn(own, F.xxhash64(F.coalesce("text", F.lit(""))))
    one = rows.join(kept, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(own) == F.col(hashed)), "left_semi")
    return (one.dropDuplicates(["doc_id", own]) if twice else one).drop(own)
