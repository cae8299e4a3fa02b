"""Removal of repeated byte strings: every byte covered by a `length`-byte string that also starts anywhere else.

A suffix array of the whole corpus would be one global sort of all its bytes.  The same answer is had from far fewer suffixes:

1. Anchors.  Among the hashes of all `gram`-byte strings inside a window of `length` bytes the least are anchors (all ties).
   Equal windows have equal anchors at equal places, so a repeated window meets its twin under the anchor's string.  About
   one byte in `length - gram` over two is an anchor; each carries hashes of its string and of its whole surroundings (all
   windows through it).
2. Surroundings that occur twice or more are repeated as a whole.  Counting them is a pre-aggregated group-by, so thousands
   of copies cost a row for each task.
3. Where one string has several surroundings, one text of each is fetched, and the suffixes that start at the anchors, and
   the reversed ones before them, are sorted by a hash-compared suffix sort: prefix polynomial hashes and binary search give
   two suffixes' common extension in logarithmic time, a mergesort ranks them, and neighbours' extensions are verified on
   the bytes (a collision falls back to comparing bytes).  Equal windows are then runs in both orders.  Strings with more
   surroundings than `group` are answered by hashes of all their windows, grouped across the cluster.

Nothing is capped and matches never cross documents.  Steps 1 and 2 compare by two independent 64-bit polynomial hashes with
random byte tables.

Passages told by their number of words (`remove` with `words`) take the same way: each word becomes WORD bytes of its hash, so
that `words` words are one string of fixed length, whatever their own lengths.

Defined cases: null and short texts lose nothing; repeated rows are repeats of each other; runs of one byte repeat within
themselves; an empty table gives no rows; a text of any length is read in segments; other columns, whatever their names, stay as
they are."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Bytes hashed at a time.
SEGMENT = 1 << 19
#: Bytes of hash that stand for a word, and the bytes that end one.
WORD = 4
_SPACE = np.isin(np.arange(256), [*range(9, 14), *range(28, 33)])
_ODD = (np.uint64(0x5851F42D4C957F2D), np.uint64(0x2545F4914F6CDD1D))
_TABLE = [C.mix(np.arange(256, dtype=np.uint64) + np.uint64(1000 * s + 1)) for s in (1, 2)]


@C.kept
@lru_cache(4)
def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    base = int(_ODD[which])
    out = []
    for b in (base, pow(base, -1, 2**64)):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


class Prefix:
    """Prefix polynomial hashes: the hash of any substring in constant time, comparable between places."""

    def __init__(self, data: np.ndarray, which: int = 0, least: int = 1 << 10):
        """least: of the table of powers, for many pieces that differ in size."""
        size = max(least, 1 << int(len(data)).bit_length())
        self.power, self.inverse = _powers(which, size)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        value = _TABLE[which][data] if data.dtype == np.uint8 else C.mix(data + np.uint64(1000 * which + 1))
        np.cumsum(value * self.power[: len(data)], out=self.sums[1:])

    def of(self, start, length) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.inverse[start]


def _slide(x: np.ndarray, w: int, f) -> np.ndarray:
    """f over every w neighbours, by doubling."""
    s = 1
    while 2 * s <= w:
        x, s = f(x[:-s], x[s:]), 2 * s
    return f(x[: len(x) - (w - s)], x[w - s :]) if w > s else x


def anchors(data: np.ndarray, ends: np.ndarray, starts: np.ndarray, length: int, gram: int):
    """Places, and hashes there of the string and of its surroundings.  data: bytes, or numbers of 64 bits that each stand for
    one symbol.  starts, ends: of the text that each symbol is in, as far as it lies in `data`."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none.astype(np.uint64), none.astype(np.uint64)
    one, two, w = Prefix(data, 0), Prefix(data, 1), length - gram + 1
    at = np.arange(len(data) - gram + 1)
    h = C.mix(one.of(at, gram)) >> np.uint64(1)
    h[ends[: len(h)] - at < gram] = np.uint64(2**64 - 1)
    least = _slide(h, w, np.minimum)
    whole = ends[: len(least)] - at[: len(least)] >= length
    most = np.zeros(len(least) + 2 * (w - 1), np.uint64)
    most[w - 1 : w - 1 + len(least)] = np.where(whole, least, 0)
    p = np.flatnonzero((h == _slide(most, w, np.maximum)) & (h < np.uint64(2**63)) & (h > 0))
    left, right = np.minimum(p - starts[p], length - gram), np.minimum(ends[p] - p, length)
    around = C.mix(two.of(p - left, left + right) ^ C.mix((left * 4096 + right).astype(np.uint64)))
    return p, h[p], around


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text, what ASCII white space parts, start and end."""
    edge = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[data], [True]]).astype(np.int8)))
    return edge[::2], edge[1::2]


def coded(data: np.ndarray) -> bytes:
    """WORD bytes for each word of a text."""
    start, end = words_of(data)
    out = np.zeros(len(start), np.uint32)
    a = 0
    while a < len(start):  # one word at least, then all that begin in a segment
        b = max(a + 1, int(np.searchsorted(start, start[a] + SEGMENT)))
        own = Prefix(data[start[a] : end[b - 1]], 0, 2 * SEGMENT)
        out[a:b] = C.mix(own.of(start[a:b] - start[a], end[a:b] - start[a:b])) >> np.uint64(32)
        a = b
    return out.tobytes()


def _code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, their texts coded; called inside the task's one Python step, as each more would hold a worker of its own."""
    for batch in batches:
        codes = pa.array([coded(np.frombuffer(t.as_buffer(), np.uint8)) for t in batch["text"]], pa.binary())
        yield pa.RecordBatch.from_arrays([codes if c == "text" else batch[c] for c in batch.schema.names], names=batch.schema.names)


def _anchor_rows(length: int, gram: int, code: bool = False):
    """length, gram, and all places count bytes; of coded texts the symbols are words."""
    reach, unit = length - gram, WORD if code else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.enter(_powers)
        for batch in _code(batches) if code else batches:
            C.release()
            raw, held, size = [t.as_buffer() for t in batch["text"]], [], 0
            pieces = []  # (row, from, to, core from, core to)
            for r, b in enumerate(raw):
                for core in range(0, len(b), SEGMENT):
                    end = min(len(b), core + SEGMENT)
                    pieces.append((r, max(0, core - reach), min(len(b), end + length), core, end))
            for piece in [*pieces, None]:
                if piece:
                    held.append(piece)
                    size += piece[2] - piece[1]
                if held and (size >= SEGMENT or piece is None):
                    yield from rows(batch, raw, held)
                    held, size = [], 0

    def rows(batch, raw, held):
        flat = b"".join(memoryview(raw[r])[a:b] for r, a, b, _, _ in held)
        data = np.frombuffer(flat, np.uint32).astype(np.uint64) if code else np.frombuffer(flat, np.uint8)
        row, a, b, core, core_end = np.array(held, np.int64).T
        sizes = (b - a) // unit
        first = np.cumsum(sizes) - sizes
        starts, ends, owner = (np.repeat(x, sizes) for x in (first, first + sizes, np.arange(len(held))))
        p, key, around = anchors(data, ends, starts, length // unit, gram // unit)
        o = owner[p]
        pos = (p - first[o]) * unit + a[o]
        keep = (pos >= core[o]) & (pos < core_end[o])
        p, key, around, o, pos = p[keep], key[keep], around[keep], o[keep], pos[keep]
        total = np.array([len(raw[r]) for r in row], np.int64)[o]
        take = pa.array(row[o])
        yield pa.record_batch({"doc_id": batch["doc_id"].take(take), "hash": batch["hash"].take(take), "pos": pos, "left": np.minimum(pos, reach).astype(np.int32), "right": np.minimum(total - pos, length).astype(np.int32), "key": key.astype(np.int64), "around": around.view(np.int64)})

    return run


def prefix_hashes(rows: np.ndarray) -> np.ndarray:
    """For each row of bytes the polynomial hashes of its prefixes, of length 0 and up; comparable between rows."""
    n, width = rows.shape
    power = _powers(0, 1 << max(10, width.bit_length()))[0][:width]
    out = np.zeros((n, width + 1), np.uint64)
    for a in range(0, n, 4096):
        np.cumsum(_TABLE[0][rows[a : a + 4096]] * power, axis=1, out=out[a : a + 4096, 1:])
    return out


def order(rows: np.ndarray, sizes: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash-compared suffix sort of rows of bytes (padded to one width): their order within their groups, and each one's
    common extension with its predecessor (-1 at a group's first)."""
    hashes, n, width = prefix_hashes(rows), len(sizes), rows.shape[1]

    def extension(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        lo, hi = np.zeros(len(i), np.int64), np.minimum(sizes[i], sizes[j])
        for _ in range(width.bit_length() + 1):
            if (lo >= hi).all():
                break
            mid = (lo + hi + 1) >> 1
            same = hashes[i, mid] == hashes[j, mid]
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def before(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Is suffix i less than suffix j."""
        e = extension(i, j)
        at = np.minimum(e, width - 1)
        return np.where(e >= sizes[i], e < sizes[j], (e < sizes[j]) & (rows[i, at] < rows[j, at]))

    out, run = np.argsort(groups, kind="stable"), 1
    _, first, size = np.unique(groups[out], return_index=True, return_counts=True)
    first, size = np.repeat(first, size), np.repeat(size, size)  # of each place's group
    while run < n:
        # all pairs of neighbouring runs of all groups at once: an element's new place is its own plus its rank in the other
        place = np.flatnonzero(size > run)
        if not len(place):
            break
        start, end = first[place], first[place] + size[place]
        number = (place - start) // run
        mine, other = start + number * run, start + (number ^ 1) * run
        low = np.minimum(other, end)
        lo, hi, right = low.copy(), np.minimum(other + run, end), number % 2 == 1
        while True:
            k = np.flatnonzero(lo < hi)
            if not len(k):
                break
            mid = (lo[k] + hi[k]) >> 1
            x, y = out[place[k]], out[mid]
            up = np.empty(len(k), bool)  # ties: the left run's first
            r = right[k]
            up[r], up[~r] = ~before(x[r], y[r]), before(y[~r], x[~r])
            lo[k], hi[k] = np.where(up, mid + 1, lo[k]), np.where(up, hi[k], mid)
        new = out.copy()
        new[np.minimum(mine, other) + (place - mine) + (lo - low)] = out[place]
        out, run = new, 2 * run
    common = np.full(n, -1, np.int64)
    if n > 1:
        same = groups[out[1:]] == groups[out[:-1]]
        common[1:][same] = extension(out[1:][same], out[:-1][same])
    return out, common


def verified_order(rows: np.ndarray, sizes: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """order(), its extensions checked on the bytes; a hash collision means sorting by the bytes themselves."""
    out, common = order(rows, sizes, groups)
    for _ in range(2):
        true = np.full(len(out), -1, np.int64)
        for a in range(1, len(out), 4096):
            i, j = out[a - 1 : a + 4095][: len(out[a : a + 4096])], out[a : a + 4096]
            differ = rows[i] != rows[j]
            first = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
            true[a : a + 4096] = np.where(groups[i] == groups[j], np.minimum(first, np.minimum(sizes[i], sizes[j])), -1)
        if (true == common).all():
            break
        out = np.array(sorted(range(len(sizes)), key=lambda k: (groups[k], rows[k, : sizes[k]].tobytes())), np.int64)
        common = true  # of the old order: the second pass sets it right
    return out, true


def _padded(parts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(p) for p in parts], np.int64)
    return np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), np.uint8).reshape(-1, width), sizes


def repeated_windows(texts: list[bytes], left: np.ndarray, groups: np.ndarray, length: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text, with its anchor `left` bytes in: the least and most bytes before the anchor with which a window through
    it equals another text's of the group (-1: none does).  All windows hold the anchor, so what they cover is one run."""
    n = len(texts)
    cut = left.tolist()
    rows, right = _padded([t[k : k + length] for t, k in zip(texts, cut, strict=True)], length)
    r_order, r_common = verified_order(rows, right, groups)
    rows, _ = _padded([t[:k][::-1] for t, k in zip(texts, cut, strict=True)], max(1, reach))
    l_order, l_common = verified_order(rows, left, groups)
    del rows
    low, high = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    count = np.bincount(groups)[groups]
    # of two texts the windows that fit into the common extension to both sides
    second = np.flatnonzero((count[r_order] == 2) & (r_common >= 0))
    i, j = r_order[second], r_order[second - 1]
    back_common = np.empty(n, np.int64)
    back_common[l_order] = l_common
    least, most = np.maximum(0, length - r_common[second]), np.minimum(reach, np.maximum(back_common[i], back_common[j]))
    ok = least <= most
    for k in (i[ok], j[ok]):
        low[k], high[k] = least[ok], most[ok]
    # of more, the runs of equal right parts meet those of equal left parts, for each place of the anchor in the window
    some = np.flatnonzero(count > 2)
    if len(some):
        keep_r, keep_l = count[r_order] > 2, count[l_order] > 2
        r_order, r_common, l_order, l_common = r_order[keep_r], r_common[keep_r], l_order[keep_l], l_common[keep_l]
        r_class, l_class = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for a in range(reach + 1):
            able = some[(left[some] >= a) & (right[some] >= length - a)]
            r_class[r_order] = np.cumsum(r_common < length - a)
            l_class[l_order] = np.cumsum(l_common < a)
            code = r_class[able] * (n + 1) + l_class[able]
            by = np.argsort(code, kind="stable")
            same = code[by][1:] == code[by][:-1]
            twice = np.zeros(len(by), bool)
            twice[1:] |= same
            twice[:-1] |= same
            rows = able[by[twice]]
            high[rows] = a
            low[rows[low[rows] < 0]] = a
    return low, high


_SOLVED = pa.schema([("key", pa.int64()), ("around", pa.int64()), ("low", pa.int32()), ("high", pa.int32())])


def _solve(length: int, reach: int):
    def run(table: pa.Table) -> pa.Table:
        once: dict[tuple, int] = {}
        for k, x in enumerate(zip(table["key"].to_pylist(), table["around"].to_pylist(), strict=True)):
            once.setdefault(x, k)
        some = table.take(pa.array(sorted(once.values())))
        groups = np.unique(some["key"].to_numpy(), return_inverse=True)[1]
        low, high = repeated_windows(some["bytes"].to_pylist(), some["left"].to_numpy().astype(np.int64), groups, length, reach)
        ok = low >= 0
        return pa.table({"key": some["key"].to_numpy()[ok], "around": some["around"].to_numpy()[ok], "low": low[ok].astype(np.int32), "high": high[ok].astype(np.int32)}, schema=_SOLVED)

    return run


def _fetch(batches: Iterator[pa.RecordBatch], code: bool = False) -> Iterator[pa.RecordBatch]:
    for batch in _code(batches) if code else batches:
        for r in range(batch.num_rows):
            text, want = memoryview(batch["text"][r].as_buffer()), batch["want"][r].values
            pos, left, right = (want.field(k).to_numpy() for k in ("pos", "left", "right"))
            yield pa.record_batch({"key": want.field("key"), "around": want.field("around"), "d": want.field("d"), "left": want.field("left"), "bytes": pa.array([bytes(text[p - a : p + b]) for p, a, b in zip(pos.tolist(), left.tolist(), right.tolist(), strict=True)], pa.binary())})


def _windows(length: int, reach: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                data, left = np.frombuffer(batch["bytes"][r].as_buffer(), np.uint8), batch["left"][r].as_py()
                a = np.arange(max(0, length - (len(data) - left)), min(left, reach) + 1)
                if len(a):
                    h = [Prefix(data, w).of(left - a, length).view(np.int64) for w in (0, 1)]
                    yield pa.record_batch({"key": np.full(len(a), batch["key"][r].as_py()), "around": np.full(len(a), batch["around"][r].as_py()), "a": a.astype(np.int32), "w": h[0], "x": h[1]})

    return run


def repeats(docs: DataFrame, length: int = 400, gram: int = 200, group: int = 30_000, *, code: bool = False) -> DataFrame:
    """code: length, gram and spans count bytes of the coded text.  group: surroundings of one string that a task takes at once, some 6 KB each.  docs: doc_id, text, hash.  (doc_id, hash, spans): for texts that have repeated strings, where (bytes, may overlap)."""
    kind, reach = docs.schema["doc_id"].dataType.simpleString(), length - gram
    found = docs.where(F.octet_length("text") >= (2 * length // WORD - 1 if code else length)).mapInArrow(_anchor_rows(length, gram, code), f"doc_id {kind}, hash long, pos long, left int, right int, key long, around long")
    places = C.Table(found, "anchors")
    # of each surroundings any one place: firsts of plain columns, all of one row, are hashed where a least struct would be sorted
    counted = C.Table(places.df.groupBy("key", "around").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("hash", "doc_id", "pos", "left", "right"))), "around")
    # a written side, so that a string with very many surroundings is plain shuffled rows, which adaptive skew joins split
    keys = C.Table(counted.df.groupBy("key").agg(F.count("*").alias("d"), F.min("n").alias("least")).where("d > 1 and least = 1").select("key", "d"), "keys")
    wanted = counted.df.join(keys.df, "key").groupBy("doc_id", "hash").agg(F.collect_list(F.struct("pos", "left", "right", "key", "around", "d")).alias("want"))
    wanted = wanted.select(F.col("doc_id").alias("__d"), F.col("hash").alias("__h"), "want")
    texts = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("hash") == F.col("__h"))).select("text", "want")
    fetched = C.Table(texts.mapInArrow(partial(_fetch, code=code), "key long, around long, d long, left int, bytes binary"), "fetched")
    few = fetched.df.where(F.col("d") <= group)
    tasks = max(1, -(-few.count() // 4_000))
    solved = few.withColumn("task", F.pmod(F.xxhash64("key"), F.lit(tasks))).groupBy("task").applyInArrow(_solve(length, reach), "key long, around long, low int, high int")
    many = fetched.df.where(F.col("d") > group).dropDuplicates(["key", "around"])
    if many.limit(1).count():
        every = C.Table(many.select("key", "around", "left", "bytes").mapInArrow(_windows(length, reach), "key long, around long, a int, w long, x long"), "windows").df
        twice = every.groupBy("key", "a", "w", "x").agg(F.count("*").alias("n")).where("n > 1").drop("n")
        solved = solved.unionByName(every.join(twice, ["key", "a", "w", "x"]).groupBy("key", "around").agg(F.min("a").alias("low"), F.max("a").alias("high")))
    whole = counted.df.where((F.col("n") > 1) & (F.col("left") + F.col("right") >= length)).select("key", "around", F.lit(None).cast("int").alias("low"), F.lit(None).cast("int").alias("high"))
    single = counted.df.where("n = 1").select("key", "around")
    verdicts = C.Table(whole.unionByName(solved.join(single, ["key", "around"], "left_semi")), "verdicts")
    spans = places.df.join(verdicts.df, ["key", "around"]).select("doc_id", "hash", (F.col("pos") - F.coalesce("high", "left")).alias("start"), (F.col("pos") + F.coalesce(F.lit(length) - F.col("low"), "right")).alias("end"))
    spans = C.Table(spans.groupBy("doc_id", "hash").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "spans")
    for t in (places, counted, keys, fetched, verdicts):
        t.drop()
    return spans.df


def passages(docs: DataFrame, words: int) -> DataFrame:
    """repeats() of strings of `words` words; spans count bytes of the coded text.  docs: doc_id, text, hash."""
    return repeats(docs, WORD * words, WORD * (words // 2), code=True)


def _in_bytes(text: bytes, spans: np.ndarray) -> np.ndarray:
    """Spans of a coded text as spans of the text: whole words, and the white space after them."""
    start, _ = words_of(np.frombuffer(text, np.uint8))
    after = np.concatenate([[0], start[1:], [len(text)]])  # where the text goes on after so many words
    return np.column_stack([after[-(-spans[:, 0] // WORD)], after[spans[:, 1] // WORD]])


def _runs(spans: np.ndarray) -> np.ndarray:
    """Spans (start, end) as maximal runs, in order."""
    if len(spans) < 2:
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.flatnonzero(np.concatenate([[True], spans[1:, 0] > reach[:-1]]))
    return np.column_stack([spans[new, 0], reach[np.append(new[1:], len(spans)) - 1]])


def _keep(text: memoryview, spans: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Maximal removed runs, and what remains."""
    runs = _runs(spans)
    at = [0, *runs.ravel().tolist(), len(text)]
    return runs, b"".join(text[a:b] for a, b in zip(at[::2], at[1::2], strict=True))


def _spans(column: pa.Array) -> list[np.ndarray]:
    """Of each row the spans (start, end); a null has none."""
    inner = column.values
    pairs = np.column_stack([inner.field(k).to_numpy(zero_copy_only=False) for k in ("start", "end")]).astype(np.int64).reshape(-1, 2)
    at, none = column.offsets.to_numpy().tolist(), column.is_null().to_pylist()
    return [pairs[:0] if x else pairs[a:b] for a, b, x in zip(at[:-1], at[1:], none, strict=True)]


def _joined(df: DataFrame, length: int, gram: int, words: int | None = None) -> tuple[DataFrame, str, str]:
    """df (with doc_id, text) and two more columns, whose names are given too: the spans of each row and, with words, those of
    the coded text."""
    own, doc, hashed, spans, coded_spans = C.fresh(df, "own", "d", "h", "spans", "words")
    docs = C.documents(df).withColumn("hash", F.xxhash64("text"))
    found = repeats(docs, length, gram).select(F.col("doc_id").alias(doc), F.col("hash").alias(hashed), F.col("spans").alias(spans))
    if words:
        more = passages(docs, words).select(F.col("doc_id").alias(doc), F.col("hash").alias(hashed), F.col("spans").alias(coded_spans))
        found = found.unionByName(more, allowMissingColumns=True).groupBy(doc, hashed).agg(*(F.first(c, True).alias(c) for c in (spans, coded_spans)))
    rows = df.withColumn(own, F.xxhash64(F.coalesce("text", F.lit(""))))
    return rows.join(found, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(own) == F.col(hashed)), "left").drop(doc, hashed, own), spans, coded_spans


def digest(df: DataFrame, length: int = 400, gram: int = 200, words: int = 51) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans; and n_passage_bytes, the bytes of strings of `words` words or
    more that also start anywhere else, however few their bytes (they are reported, not removed)."""

    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_bytes")}
            every = []
            for text, plain, coded in zip((t.as_buffer() for t in batch["text"]), _spans(batch[spans]), _spans(batch[coded_spans]), strict=True):
                text = memoryview(text)
                runs, kept = _keep(text, plain)
                told = _runs(_in_bytes(text, coded)) if len(coded) else coded
                for k, v in zip(out, (len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), int((told[:, 1] - told[:, 0]).sum())), strict=True):
                    out[k].append(v)
                every.append(runs)
            flat = np.concatenate(every) if every else np.zeros((0, 2), np.int64)
            at = np.concatenate([[0], np.cumsum([len(r) for r in every], dtype=np.int64)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["start", "end"]))
            yield pa.record_batch([batch["doc_id"], *(pa.array(out[k], pa.int64()) for k in ("n_bytes", "n_removed", "n_spans")), pa.array(out["kept_sha256"], pa.string()), lists.cast(span), pa.array(out["n_passage_bytes"], pa.int64())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "n_passage_bytes"])

    kind = df.schema["doc_id"].dataType.simpleString()
    rows, spans, coded_spans = _joined(df.select("doc_id", "text"), length, gram, words)
    rows = rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), spans, coded_spans)
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>, n_passage_bytes long")


def remove(df: DataFrame, length: int = 400, gram: int = 200, words: int | None = None) -> DataFrame:
    """df with text cut: all its columns, in order.  A character that a removed run cuts in two goes with it; a null text
    stays null.  words: strings of so many words that also start anywhere else go too, however few their bytes."""

    names = list(df.columns)

    def cut(text: pa.StringScalar, plain: np.ndarray, coded: np.ndarray) -> str | None:
        if not text.is_valid or not (len(plain) or len(coded)):
            return text.as_py()
        raw = text.as_buffer()
        every = np.concatenate([plain, _in_bytes(raw, coded)]) if len(coded) else plain
        return _keep(memoryview(raw), every)[1].decode("utf-8", "ignore")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = _spans(batch[coded_spans]) if words else [np.zeros((0, 2), np.int64)] * batch.num_rows
            texts = [cut(*x) for x in zip(batch["text"], _spans(batch[spans]), told, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else batch[c] for c in names], names=names)

    rows, spans, coded_spans = _joined(df, length, gram, words)
    return rows.mapInArrow(run, df.schema)
