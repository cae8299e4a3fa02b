import gzip as gz
import hashlib
import io
import struct
import zipfile
import zlib

import pytest

from terrane.llm import media


def png():
    chunk = lambda k, v: struct.pack(">I", len(v)) + k + v + struct.pack(">I", zlib.crc32(k + v))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def zipped():
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("a.txt", "hello")
    return b.getvalue()


GIF = b"GIF89a\x01\0\x01\0\x80\0\0" + b"\0" * 6 + b",\0\0\0\0\x01\0\x01\0\0\x02\x02D\x01\0;"
BMP = b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0" * 4
JPEG = b"\xff\xd8\xff\xc0\0\x0b\x08\0\x01\0\x01\x01\x01\x11\0\xff\xda\0\x08\x01\x01\0\0?\0\x12\xff\0\x34\xff\xd9"
PDF = b"%PDF-1.4\nxref\n0 1\ntrailer\nstartxref\n9\n%%EOF"
OGG = b"OggS\0\4" + bytes(20) + b"\x01\x03abc"
FLAC = b"fLaC\x80\0\0\x22" + bytes(34) + b"\xff\xf8rest"
GOOD = {"audio/wav": media.as_wav(b"x" * 192), "image/png": png(), "image/gif": GIF, "image/bmp": BMP, "image/jpeg": JPEG, "application/pdf": PDF, "application/zip": zipped(), "application/gzip": gz.compress(b"abc"), "audio/ogg": OGG, "audio/flac": FLAC, "image/webp": b"RIFF" + struct.pack("<I", 16) + b"WEBPVP8 " + struct.pack("<I", 4) + b"data"}


@pytest.mark.parametrize("kind", list(GOOD))
def test_whole_and_cut(kind):
    b = GOOD[kind]
    assert media.objects(b)[0] == (0, len(b), kind, 1)
    if kind != "audio/flac":  # its frames have no length
        assert not any(i == 0 for i, *_ in media.objects(b[:-1]))


def test_carving():
    b = b"junk RIFF GIF89a BM \xff\xd8\xff" + GIF + b"text" + png() + b"%PDF-"
    got = media.objects(b)
    assert [(k, b[i : i + n]) for i, n, k, _ in got] == [("image/gif", GIF), ("image/png", png())]
    inside = media.as_wav(b"pad " + GIF + b" ")
    assert [(k, d) for _, _, k, d in media.objects(inside)] == [("audio/wav", 1), ("image/gif", 2)]


def test_types_are_corrected(spark):
    rows = [(1, GIF, "image/png"), (2, b"plain", "text/plain"), (3, None, None), (4, b"", "x/y"), (5, png()[:20], "image/png")]
    t = spark.createDataFrame([(i, b and bytearray(b), d) for i, b, d in rows], "i int, media binary, declared string").withColumnRenamed("i", "size_")
    got = {r["size_"]: (r["type"], r["confirmed"]) for r in media.sniff(t, "media", "declared").collect()}
    assert got == {1: ("image/gif", True), 2: ("text/plain", False), 3: (media.UNKNOWN, False), 4: ("x/y", False), 5: ("image/png", False)}


def test_round_trip(edge, nothing):
    from .conftest import EDGE

    want = sorted((i is None, i or 0, hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])) for i, t in EDGE for p in [(t or "").encode() + b" " * (max(192, -(-len((t or "").encode()) // 192) * 192) - len((t or "").encode()))])
    got = media.media_features(edge).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["payload_sha256"], r["tail_crc32"]) for r in got) == want
    assert all(r["payload_bytes"] % 192 == 0 and r["media_bytes"] == r["payload_bytes"] + 44 for r in got)
    assert len({r["feature"] for r in got if r["doc_id"] in (5, 6)}) == 1
    assert media.media_features(nothing).collect() == []


def test_media_are_read_back_from_a_table(spark, docs, monkeypatch):
    """What is lost on the way to storage is seen: with an empty store there is nothing to read."""
    from terrane.llm import common

    monkeypatch.setattr(common.Table, "df", property(lambda t: t.spark.read.schema(t.schema).parquet(t.path).limit(0)))
    assert media.media_features(docs).count() == 0


def test_columns_of_any_name_stay(spark):
    df = spark.createDataFrame([(1, bytearray(b"\x89PNG"), "t", 5, True, "p", 3)], "id int, media binary, type string, size int, confirmed boolean, Parts string, m int")
    got = media.sniff(df)
    assert got.columns == [*df.columns, "_type", "_confirmed", "_size", "_parts"]
    assert tuple(got.first()) == (*df.first(), media.UNKNOWN, False, 4, [])


def test_many_false_heads_take_little_time():
    import time

    began = time.perf_counter()
    assert media.objects(b"%PDF-1.4\nPK\3\4" * 100_000) == []
    assert time.perf_counter() - began < 5
