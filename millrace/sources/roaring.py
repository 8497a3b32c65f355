"""Deletion vectors: sets of row numbers as arrays of Roaring bitmaps, in the published portable layout.

A 64-bit number is split in three: the upper 32 bits choose a bitmap, the next 16 a
container in it, and the last 16 are held by the container as a sorted array, as a
bitmap of 65,536 bits, or as runs.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

# Fixed values of the portable formats.
MAGIC = 1681511377
COOKIE, COOKIE_RUNS = 12346, 12347
OFFSETS_FROM = 4  # containers from which on a bitmap with runs lists their offsets
ARRAY_MAX = 4096  # numbers in an array container at most
VERSION = b"\x01"


def _containers(data: memoryview, at: int) -> tuple[list[np.ndarray], int]:
    """The 32-bit numbers of the bitmap that starts at ``at``, by container, and where it ends."""
    (cookie,) = struct.unpack_from("<I", data, at)
    at += 4
    if cookie & 0xFFFF == COOKIE_RUNS:
        n = (cookie >> 16) + 1
        flags = np.unpackbits(np.frombuffer(data, np.uint8, (n + 7) // 8, at), bitorder="little")[:n]
        at += (n + 7) // 8
        listed = n >= OFFSETS_FROM
    elif cookie == COOKIE:
        (n,) = struct.unpack_from("<I", data, at)
        flags, at, listed = np.zeros(n, np.uint8), at + 4, True
    else:
        raise ValueError(f"not a Roaring bitmap: cookie {cookie}")
    heads = np.frombuffer(data, "<u2", 2 * n, at).reshape(n, 2).astype(np.int64)
    at += 4 * n + (4 * n if listed else 0)
    out = []
    for (key, less), runs in zip(heads.tolist(), flags.tolist(), strict=True):
        if runs:
            (count,) = struct.unpack_from("<H", data, at)
            pairs = np.frombuffer(data, "<u2", 2 * count, at + 2).reshape(count, 2).astype(np.int64)
            low = np.concatenate([np.arange(a, a + more + 1) for a, more in pairs.tolist()])
            at += 2 + 4 * count
        elif less < ARRAY_MAX:
            low = np.frombuffer(data, "<u2", less + 1, at).astype(np.int64)
            at += 2 * (less + 1)
        else:
            low = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, 8192, at), bitorder="little"))
            at += 8192
        if len(low) != less + 1:
            raise ValueError("a Roaring container does not hold what its head says")
        out.append(low + (key << 16))
    return out, at


def numbers(data: bytes) -> np.ndarray:
    """All numbers of a serialised vector, ascending."""
    view = memoryview(data)
    magic, count = struct.unpack_from("<IQ", view, 0)
    if magic != MAGIC:
        raise ValueError(f"unknown deletion vector format {magic}")
    at, out = 12, [np.empty(0, np.int64)]
    for _ in range(count):
        (high,) = struct.unpack_from("<I", view, at)
        found, at = _containers(view, at + 4)
        out += [low + (high << 32) for low in found]
    return np.concatenate(out)


def stored(content: bytes, offset: int, size: int) -> bytes:
    """One vector of a file of vectors, its length and checksum verified."""
    if content[:1] != VERSION:
        raise ValueError(f"unknown deletion vector file version {content[:1]!r}")
    (length,) = struct.unpack_from(">i", content, offset)
    data = content[offset + 4 : offset + 4 + size]
    if length != size or len(data) != size:
        raise ValueError("a deletion vector's length differs from the log's")
    if struct.unpack_from(">I", content, offset + 4 + size)[0] != zlib.crc32(data):
        raise ValueError("a deletion vector's checksum differs")
    return data


def packed(rows) -> bytes:
    """The serialised vector of some numbers, in array and bitmap containers."""
    all_rows = np.unique(np.asarray(rows, np.int64))
    highs = np.unique(all_rows >> 32)
    out = [struct.pack("<IQ", MAGIC, len(highs))]
    for high in highs.tolist():
        low = all_rows[all_rows >> 32 == high] & 0xFFFFFFFF
        keys, counts = np.unique(low >> 16, return_counts=True)
        bodies = []
        for part in np.split(low & 0xFFFF, np.cumsum(counts)[:-1]):
            bits = np.zeros(65536, np.uint8)
            bits[part] = 1
            bodies.append(part.astype("<u2").tobytes() if len(part) <= ARRAY_MAX else np.packbits(bits, bitorder="little").tobytes())
        first = 8 + 8 * len(keys)
        starts = first + np.cumsum([0, *map(len, bodies)])[:-1]
        out += [struct.pack("<I", high), struct.pack("<II", COOKIE, len(keys)), np.column_stack([keys, counts - 1]).astype("<u2").tobytes(), starts.astype("<u4").tobytes(), *bodies]
    return b"".join(out)


def filed(vectors: list[bytes]) -> tuple[bytes, list[int]]:
    """A file of vectors, and the offset of each."""
    out, at = VERSION, []
    for v in vectors:
        at.append(len(out))
        out += struct.pack(">i", len(v)) + v + struct.pack(">I", zlib.crc32(v))
    return out, at
