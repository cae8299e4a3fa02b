"""Media columns by signature sniffing.

An Aho-Corasick automaton finds the magic bytes of all formats in one pass over a value; at each hit the format's validator
follows the structure (sizes, chunks, checksums, offsets) and says how long the object is, or that it is none.  A valid
object at the start gives the value's true type, whatever was declared; valid objects further in are carved out, each once
and none inside another of the same nesting.

Defined cases: a null or empty value is type `application/octet-stream` with no parts; a truncated or corrupt object is
not one (its declared type stands if it has no better, marked not confirmed); equal values give equal results; an empty
table gives no rows; very long values are read once, in time proportional to their length and hits (a zip's heads each meet
the end records after them); of two formats with one magic the first that confirms wins; other columns, whatever their names,
stay as they are."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

BLANK, BLOCK, RATE = 32, 192, 8000
UNKNOWN = "application/octet-stream"


def _riff(b: bytes, i: int, form: bytes, first: tuple[bytes, ...]) -> int:
    """The length of a RIFF object whose chunks fill it exactly and include one of `first`; else 0."""
    if len(b) < i + 12 or b[i + 8 : i + 12] != form:
        return 0
    end, at, seen = i + 8 + struct.unpack_from("<I", b, i + 4)[0], i + 12, False
    if end > len(b):
        return 0
    while at + 8 <= end:
        kind, size = b[at : at + 4], struct.unpack_from("<I", b, at + 4)[0]
        if not kind.isascii() or at + 8 + size > end:
            return 0
        seen |= kind in first
        at += 8 + size + size % 2
    return end - i if seen and at - end in (0, 1) else 0


def wav(b: bytes, i: int) -> int:
    return _riff(b, i, b"WAVE", (b"data",))


def webp(b: bytes, i: int) -> int:
    return _riff(b, i, b"WEBP", (b"VP8 ", b"VP8L", b"VP8X"))


def png(b: bytes, i: int) -> int:
    at = i + 8
    while at + 12 <= len(b):
        size, kind = struct.unpack_from(">I4s", b, at)
        if at + 12 + size > len(b) or (at == i + 8) != (kind == b"IHDR"):
            return 0
        if zlib.crc32(b[at + 4 : at + 8 + size]) != struct.unpack_from(">I", b, at + 8 + size)[0]:
            return 0
        at += 12 + size
        if kind == b"IEND":
            return at - i
    return 0


def gif(b: bytes, i: int) -> int:
    def blocks(at: int) -> int:
        while at < len(b) and b[at]:
            at += 1 + b[at]
        return at + 1

    if len(b) < i + 14:
        return 0
    at = i + 13 + (3 << (b[i + 10] % 8 + 1) if b[i + 10] & 128 else 0)
    while at < len(b):
        if b[at] == 0x3B:
            return at + 1 - i
        if b[at] == 0x21:
            at = blocks(at + 2)
        elif b[at] == 0x2C and at + 10 < len(b):
            at = blocks(at + 11 + (3 << (b[at + 9] % 8 + 1) if b[at + 9] & 128 else 0))
        else:
            return 0
    return 0


def bmp(b: bytes, i: int) -> int:
    if len(b) < i + 54:
        return 0
    size, zero, start, head, w, h, planes, bits = struct.unpack_from("<IIIIiiHH", b, i + 2)
    rows = abs(h) * ((w * bits + 31) // 32 * 4) if w > 0 else 0
    return size if zero == 0 and head in (40, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and rows and start + rows <= size <= len(b) - i else 0


def jpeg(b: bytes, i: int) -> int:
    at, frame = i + 2, False
    while at + 4 <= len(b) and b[at] == 0xFF:
        kind, size = b[at + 1], struct.unpack_from(">H", b, at + 2)[0]
        if kind < 0xC0 or size < 2 or at + 2 + size > len(b):
            return 0
        frame |= 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC)
        at += 2 + size
        if kind == 0xDA:  # compressed data up to a marker that is neither stuffing nor a restart
            m = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]", re.S).search(b, at)
            if not m:
                return 0
            if b[m.start() + 1] == 0xD9:
                return m.end() - i if frame else 0
            at = m.start()
    return 0


@lru_cache(3)
def _marks(b: bytes, mark: bytes) -> list[int]:
    """Where a value's end marks are: looked for once, whatever the number of heads that ask."""
    return [m.start() for m in re.finditer(re.escape(mark), b)]


def pdf(b: bytes, i: int) -> int:
    if not re.match(rb"%PDF-[12]\.\d[\r\n ]", b[i : i + 9]):
        return 0
    ends = _marks(b, b"%%EOF")
    k = bisect_left(ends, i)
    if k == len(ends):
        return 0
    end = ends[k]
    m = re.search(rb"startxref\s+(\d+)\s+$", b[max(i, end - 60) : end])
    return end + 5 - i if m and i + int(m[1]) < end and re.match(rb"xref|\d+ \d+ obj", b[i + int(m[1]) : i + int(m[1]) + 20]) else 0


def archive(b: bytes, i: int) -> int:
    """A zip: the central directory lies where its end record says and holds as many entries."""
    ends, heads = _marks(b, b"PK\5\6"), _marks(b, b"PK\1\2")
    for at in ends[bisect_left(ends, i) :]:
        if at + 22 > len(b):
            break
        here, n, size, start, note = struct.unpack_from("<HIIH", b, at + 8)[0], *struct.unpack_from("<HIIH", b, at + 10)
        if here == n and i + start + size == at and bisect_left(heads, at) - bisect_left(heads, i + start) >= n and at + 22 + note <= len(b):
            return at + 22 + note - i
    return 0


def gzip(b: bytes, i: int) -> int:
    try:
        d = zlib.decompressobj(31)
        rest = memoryview(b)[i:]
        while not d.eof and len(rest):
            d.decompress(rest, 1 << 20)
            rest = d.unconsumed_tail
        return len(b) - i - len(d.unused_data) if d.eof else 0
    except zlib.error:
        return 0


def ogg(b: bytes, i: int) -> int:
    at, last = i, False
    while at + 27 <= len(b) and b[at : at + 5] == b"OggS\0":
        n = b[at + 26]
        end = at + 27 + n + sum(b[at + 27 : at + 27 + n])
        if end > len(b):
            return 0
        at, last = end, bool(b[at + 5] & 4)
        if last:
            break
    return at - i if last else 0


def flac(b: bytes, i: int) -> int:
    at = i + 4
    while at + 4 <= len(b):
        last, size = b[at] >> 7, int.from_bytes(b[at + 1 : at + 4])
        if at == i + 4 and (b[at] & 127 or size != 34):
            return 0
        at += 4 + size
        if last:  # frames have no length of their own: the stream runs on
            return len(b) - i if at + 2 <= len(b) and b[at] == 0xFF and b[at + 1] >> 2 == 0x3E else 0
    return 0


#: Magic bytes (fixed values), type, and the check of what follows.
FORMATS: dict[bytes, list[tuple[str, Callable[[bytes, int], int]]]] = {
    b"RIFF": [("audio/wav", wav), ("image/webp", webp)],
    b"\x89PNG\r\n\x1a\n": [("image/png", png)],
    b"GIF87a": [("image/gif", gif)],
    b"GIF89a": [("image/gif", gif)],
    b"BM": [("image/bmp", bmp)],
    b"\xff\xd8\xff": [("image/jpeg", jpeg)],
    b"%PDF-": [("application/pdf", pdf)],
    b"PK\x03\x04": [("application/zip", archive)],
    b"\x1f\x8b\x08": [("application/gzip", gzip)],
    b"OggS": [("audio/ogg", ogg)],
    b"fLaC": [("audio/flac", flac)],
}


@cache
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for magic in FORMATS:
        a.add_word(magic.decode("latin-1"), magic)
    a.make_automaton()
    return a


def objects(b: bytes) -> list[tuple[int, int, str, int]]:
    """(offset, length, type, depth) of the valid objects: depth 1 are those in no other one, 2 those right inside one."""
    out: list[tuple[int, int, str, int]] = []
    open_: list[int] = []  # ends of the objects around
    for last, magic in _automaton().iter(b.decode("latin-1")):
        i = last + 1 - len(magic)
        while open_ and i >= open_[-1]:
            open_.pop()
        for kind, length in ((k, f(b, i)) for k, f in FORMATS[magic]):
            if length and (not open_ or i + length <= open_[-1]):
                open_.append(i + length)
                out.append((i, length, kind, len(open_)))
                break
    return out


def samples(b: bytes) -> bytes:
    """The bytes of a WAV's data chunk."""
    at = 12
    while b[at : at + 4] != b"data":
        at += 8 + struct.unpack_from("<I", b, at + 4)[0]
    return b[at + 8 : at + 8 + struct.unpack_from("<I", b, at + 4)[0]]


def as_wav(payload: bytes) -> bytes:
    """One channel of unsigned 8-bit samples."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + len(payload) % 2, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload)) + payload + b"\0" * (len(payload) % 2)


#: Types of what sniff adds: type, confirmed, size, parts.
PARTS = ["string", "boolean", "long", "array<struct<offset:long,length:long,type:string,depth:int,sha256:string>>"]


def sniff(df: DataFrame, media_col: str = "media", declared_col: str | None = None) -> DataFrame:
    """All columns of df with type (corrected), confirmed, size and the parts carved from it; where df has a column of such a
    name, the new one has an underscore before it."""
    names, own = list(df.columns), C.fresh(df, "type", "confirmed", "size", "parts", "m", "d")
    kinds = dict(zip(names, (f.dataType.simpleString() for f in df.schema.fields), strict=True))
    media, declared = own[4:]
    rows = df.select(*(F.col(f"`{c}`") for c in names), F.col(media_col).alias(media), (F.col(declared_col) if declared_col else F.lit(None).cast("string")).alias(declared))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, sure, size, parts = [], [], [], []
            for b, d in zip(batch[media].to_pylist(), batch[declared].to_pylist(), strict=True):
                found = objects(b or b"")
                true = next((k for i, _, k, _ in found if i == 0), None)
                kind.append(true or d or UNKNOWN)
                sure.append(true is not None)
                size.append(len(b or b""))
                parts.append([{"offset": i, "length": n, "type": k, "depth": e, "sha256": hashlib.sha256(b[i : i + n]).hexdigest()} for i, n, k, e in found if i])
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(kind, pa.string()), pa.array(sure, pa.bool_()), pa.array(size, pa.int64()), pa.array(parts, _PARTS)], names=[*names, *own[:4]])

    fields = [f"`{c}` {kinds[c]}" for c in names] + [f"`{c}` {kind}" for c, kind in zip(own, PARTS, strict=False)]
    return rows.mapInArrow(run, ", ".join(fields))


_PARTS = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("depth", pa.int32()), ("sha256", pa.string())]))


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            some = batch.slice(at, 500)
            raw = [x.as_buffer().to_pybytes() for x in some["text"]]
            yield pa.record_batch({"doc_id": some["doc_id"], "n_bytes": pa.array([len(x) for x in raw], pa.int64()), "declared": pa.array([UNKNOWN] * len(raw)), "media": pa.array([as_wav(x + bytes([BLANK]) * (max(BLOCK, -(-len(x) // BLOCK) * BLOCK) - len(x))) for x in raw], pa.binary())})


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for i in range(batch.num_rows):
            media, n, kind, parts = (batch[k][i].as_py() for k in ("media", "n_bytes", "type", "parts"))
            payload = samples(media)
            level = np.frombuffer(payload, np.uint8).mean()
            rows.append({"doc_id": batch["doc_id"][i].as_py(), "n_bytes": n, "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-16:]), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": f"{kind};rate={RATE};samples={len(payload)};level={level:.4f};parts={','.join(p['type'] for p in parts)}"})
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("doc_id", batch.schema.field("doc_id").type), *((k, pa.int64()) for k in ("n_bytes", "payload_bytes")), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]))


def media_features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text as a stored WAV, sniffed and read back: the digest columns of each document."""
    docs = C.documents(df, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    stored = C.Table(docs.mapInArrow(_store, f"doc_id {kind}, n_bytes long, declared string, media binary"), "media").df
    return sniff(stored, "media", "declared").mapInArrow(_digest, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
