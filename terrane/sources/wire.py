"""Varints and protobuf fields, read and written, over bytes held in memory.  Every count is checked against what is left."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np


class Malformed(ValueError):
    """Bytes that are not what they claim to be."""


def varints(b: bytes | memoryview) -> np.ndarray:
    """All varints of a run at once: seven bits a byte, the last of each with its high bit clear."""
    data = np.frombuffer(b, np.uint8)
    ends = np.flatnonzero(data < 128)
    if len(data) and (not len(ends) or ends[-1] != len(data) - 1):
        raise Malformed("a varint is cut off")
    if not len(ends):
        return np.zeros(0, np.uint64)
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(data)) - np.repeat(starts, ends - starts + 1)
    if place.max() > 9:
        raise Malformed("a varint has more than ten bytes")
    return np.add.reduceat((data & 127).astype(np.uint64) << (7 * place).astype(np.uint64), starts)


def varint(b, at: int) -> tuple[int, int]:
    out = 0
    for k in range(10):
        if at + k >= len(b):
            raise Malformed("a varint is cut off")
        out |= (b[at + k] & 127) << 7 * k
        if b[at + k] < 128:
            return out & (1 << 64) - 1, at + k + 1
    raise Malformed("a varint has more than ten bytes")


def unzigzag(v):
    """Of one number or an array of unsigned ones."""
    if isinstance(v, np.ndarray):
        return (v >> np.uint64(1)).astype(np.int64) ^ -(v & np.uint64(1)).astype(np.int64)
    return (v >> 1) ^ -(v & 1)


def zigzag(v: int) -> int:
    return (v << 1) ^ (v >> 63)


def put(v: int) -> bytes:
    out = bytearray()
    v &= (1 << 64) - 1
    while v > 127:
        out.append(v & 127 | 128)
        v >>= 7
    out.append(v)
    return bytes(out)


def field(number: int, value: int | bytes | float) -> bytes:
    """A field as varint, bytes or double."""
    if isinstance(value, float):
        return put(number << 3 | 1) + struct.pack("<d", value)
    if isinstance(value, int):
        return put(number << 3) + put(value)
    return put(number << 3 | 2) + put(len(value)) + value


def fields(b: bytes | memoryview) -> Iterator[tuple[int, int | memoryview]]:
    """(number, value) of each field: varints and fixed ones as whole numbers, others as bytes."""
    b, at = memoryview(b), 0
    while at < len(b):
        key, at = varint(b, at)
        number, wire = key >> 3, key & 7
        if not number:
            raise Malformed("field number 0")
        if wire == 0:
            value, at = varint(b, at)
        else:
            size, at = varint(b, at) if wire == 2 else ({1: 8, 5: 4}.get(wire, -1), at)
            if size < 0 or at + size > len(b):
                raise Malformed(f"field {number} runs past the end or has wire type {wire}")
            value, at = b[at : at + size], at + size
            if wire != 2:
                value = int.from_bytes(value, "little")
        yield number, value


def inflate(b: bytes, limit: int, form: int = 31) -> bytes:
    """gzip (31) or zlib (15) expanded to at most `limit` bytes."""
    d = zlib.decompressobj(form)
    try:
        out = d.decompress(b, limit + 1)
    except zlib.error as e:
        raise Malformed(f"not compressed as declared: {e}") from e
    if len(out) > limit:
        raise Malformed(f"expands past {limit} bytes")
    if not d.eof:
        raise Malformed("compressed bytes are cut off")
    return out
