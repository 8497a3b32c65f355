"""MPEG audio media columns.

Reading: a stream is scanned for frame headers, resynchronising over anything
else; ID3v2, ID3v1 and Xing/Info tags are parsed; the CRC-16 of protected Layer
III frames is verified; and the exact duration (samples over sampling rate) and
the byte offset of every frame are kept, so a reader can seek to any frame.

Writing: bytes are stored losslessly as the ancillary data of silent MPEG-1
Layer III frames (44.1 kHz stereo, CRC protected; 320 kbit/s but for the last,
which takes the lowest bit rate that holds the rest: a variable-bitrate stream
with a Xing table of contents).  An ID3v2 comment keeps the payload's length and
CRC-32.

Scale: a row at a time, no exchange; memory is a few copies of the longest text.

Defined cases: null counts as empty; bytes without any frame parse to zero
frames and an empty payload; repeated rows give repeated results; an empty table
gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import table

# Fixed values of ISO/IEC 11172-3 and 13818-3: bit rates in kbit/s by (version 1?, layer), index 1 to 14.
RATES = {
    (True, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
# Sampling rates by version bits (3: MPEG-1, 2: MPEG-2, 0: MPEG-2.5).
SAMPLING = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
SIDE = 32  # side information of a stereo MPEG-1 Layer III frame
HEAD = 4 + 2 + SIDE


def _crc_table() -> np.ndarray:
    """CRC-16 of MPEG audio: polynomial x^16 + x^15 + x^2 + 1, most significant bit first."""
    out = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        out = np.where(out & 0x8000, (out << 1) ^ 0x8005, out << 1) & 0xFFFF
    return out


CRC = _crc_table()


def crc16(rows: np.ndarray) -> np.ndarray:
    """CRC-16 of each row of a byte matrix, from 0xFFFF."""
    crc = np.full(len(rows), 0xFFFF, np.uint32)
    for column in rows.T:
        crc = ((crc << 8) & 0xFFFF) ^ CRC[(crc >> 8) ^ column]
    return crc


@dataclass
class Header:
    version: int
    layer: int
    protected: bool
    kbps: int
    rate: int
    mono: bool
    length: int
    samples: int

    @property
    def side(self) -> int:
        """Bytes of Layer III side information."""
        if self.layer != 3:
            return 0
        return (17 if self.mono else 32) if self.version == 3 else (9 if self.mono else 17)


_HEADERS: dict[bytes, Header | None] = {}


def header(raw: bytes) -> Header | None:
    """A frame header of four bytes, or None if they are none."""
    if raw in _HEADERS:
        return _HEADERS[raw]
    found = None
    if len(raw) == 4 and raw[0] == 0xFF and raw[1] & 0xE0 == 0xE0:
        version, layer = raw[1] >> 3 & 3, 4 - (raw[1] >> 1 & 3)
        bits, rate = raw[2] >> 4, raw[2] >> 2 & 3
        if version != 1 and layer != 4 and 0 < bits < 15 and rate < 3:
            kbps, hertz, pad = RATES[(version == 3, layer)][bits - 1], SAMPLING[version][rate], raw[2] >> 1 & 1
            samples = 384 if layer == 1 else 1152 if layer == 2 or version == 3 else 576
            length = (12 * kbps * 1000 // hertz + pad) * 4 if layer == 1 else samples // 8 * kbps * 1000 // hertz + pad
            found = Header(version, layer, not raw[1] & 1, kbps, hertz, raw[3] >> 6 == 3, length, samples)
    if len(_HEADERS) > 4096:
        _HEADERS.clear()
    _HEADERS[raw] = found
    return found


@dataclass
class Stream:
    frames: int = 0
    samples: int = 0
    rate: int = 0
    duration_us: int = 0
    checked: int = 0
    crc_ok: int = 0
    resyncs: int = 0
    kbps: dict = field(default_factory=dict)
    tags: dict = field(default_factory=dict)
    xing: dict = field(default_factory=dict)
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    payload: bytes = b""


def _syncsafe(raw: bytes) -> int:
    return raw[0] << 21 | raw[1] << 14 | raw[2] << 7 | raw[3]


def _id3v2(data: bytes) -> tuple[int, dict]:
    """Where the audio begins, and the tag's user text fields."""
    if len(data) < 10 or data[:3] != b"ID3":
        return 0, {}
    end, at, tags = min(len(data), 10 + _syncsafe(data[6:10])), 10, {}
    while at + 10 <= end and data[at] != 0:
        name, size = data[at : at + 4], _syncsafe(data[at + 4 : at + 8]) if data[3] >= 4 else struct.unpack(">I", data[at + 4 : at + 8])[0]
        body = data[at + 10 : min(end, at + 10 + size)]
        if name == b"TXXX" and body:
            key, _, value = body[1:].partition(b"\0")
            tags[key.decode("utf-8", "replace")] = value.rstrip(b"\0").decode("utf-8", "replace")
        elif name[:1] == b"T" and body:
            tags[name.decode("latin-1")] = body[1:].rstrip(b"\0").decode("utf-8", "replace")
        at += 10 + size
    return end, tags


def _xing(data: bytes, at: int, h: Header) -> dict:
    start = at + 4 + 2 * h.protected + h.side
    if h.layer != 3 or data[start : start + 4] not in (b"Xing", b"Info"):
        return {}
    flags, pos, out = int.from_bytes(data[start + 4 : start + 8], "big"), start + 8, {"kind": data[start : start + 4].decode()}
    for bit, key, size in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100), (8, "quality", 4)):
        if flags & bit:
            raw = data[pos : pos + size]
            out[key] = raw if key == "toc" else int.from_bytes(raw, "big")
            pos += size
    return out


def _vbri(data: bytes, at: int, h: Header) -> dict:
    """The other encoder table of variable-bitrate streams: 32 bytes behind the header, seek entries of 1 to 4 bytes."""
    start = at + 36
    if h.layer != 3 or data[start : start + 4] != b"VBRI" or start + 26 > len(data):
        return {}
    _, _, quality, size, frames, entries, scale, width, each = struct.unpack(">HHHIIHHHH", data[start + 4 : start + 26])
    raw = data[start + 26 : start + 26 + entries * width]
    toc = [int.from_bytes(raw[i : i + width], "big") * scale for i in range(0, len(raw) - width + 1, width)] if 1 <= width <= 4 else []
    return {"kind": "VBRI", "frames": frames, "bytes": size, "quality": quality, "toc": toc, "frames_per_entry": each}


def parse(data: bytes) -> Stream:
    """Everything a stream says of itself, with checks, offsets and ancillary payload."""
    out = Stream()
    at, out.tags = _id3v2(data)
    end = len(data) - 128 if len(data) >= 128 and data[-128:-125] == b"TAG" else len(data)
    if end < len(data):
        out.tags["id3v1"] = data[-125:-95].rstrip(b"\0 ").decode("latin-1")
    offsets, heads, lost = [], [], False
    while at + 4 <= end:
        h = header(data[at : at + 4])
        after = at + h.length if h else 0
        # a header counts if the next one follows it, or the stream ends there
        if h and (after == end or after < end and ((len(offsets) and not lost) or header(data[after : after + 4]) is not None)):
            lost = False
            if not offsets and not out.xing and (x := _xing(data, at, h) or _vbri(data, at, h)):
                out.xing = x
            else:
                offsets.append(at)
                heads.append(h)
            at = after
            continue
        out.resyncs += not lost
        lost = True
        nxt = data.find(b"\xff", at + 1, end)
        at = nxt if nxt >= 0 else end
    out.frames, out.offsets = len(offsets), np.asarray(offsets, np.int64)
    if not offsets:
        return out
    out.rate, out.samples = heads[0].rate, sum(h.samples for h in heads)
    out.duration_us = sum(h.samples * 1_000_000 * n // h.rate for h, n in _counted(heads))
    for h in heads:
        out.kbps[h.kbps] = out.kbps.get(h.kbps, 0) + 1
    raw = np.frombuffer(data, np.uint8)
    sides = np.asarray([h.side if h.protected else 0 for h in heads])
    for side in set(sides[sides > 0].tolist()):
        pos = out.offsets[sides == side]
        body = raw[pos[:, None] + np.r_[2, 3, 6 : 6 + side][None, :]]
        stored = raw[pos + 4].astype(np.uint32) << 8 | raw[pos + 5]
        out.checked += len(pos)
        out.crc_ok += int((crc16(body) == stored).sum())
    held = b"".join([data[o + 4 + 2 * h.protected + h.side : o + h.length] for o, h in zip(offsets, heads, strict=True)])
    out.payload = held[: _number(out.tags, "payload_bytes", len(held))]
    return out


def _number(tags: dict[str, str], key: str, otherwise: int) -> int:
    """A tag's count; ``otherwise`` if it is missing or damaged."""
    value = tags.get(key, "")
    return int(value) if value.isascii() and value.isdigit() else otherwise


def _counted(heads: list[Header]):
    """Each kind of frame and how many there are: durations then round once per kind."""
    seen: dict[tuple[int, int], list] = {}
    for h in heads:
        seen.setdefault((h.samples, h.rate), [h, 0])[1] += 1
    return [tuple(x) for x in seen.values()]


def _room(kbps: int) -> int:
    return 144 * kbps * 1000 // 44100 - HEAD


def _frame(index: int, body: bytes, side: bytes = bytes(SIDE)) -> bytes:
    head = bytes((0xFF, 0xFA, index << 4, 0))
    crc = int(crc16(np.frombuffer(head[2:] + side, np.uint8)[None, :])[0])
    return head + crc.to_bytes(2, "big") + side + body


_HEADS = {i: _frame(i, b"") for i in range(1, 15)}


def build(payload: bytes) -> bytes:
    """An MPEG stream that carries ``payload``."""
    rates, full = RATES[(True, 3)], _room(320)
    frames = [_HEADS[14] + payload[a : a + full] for a in range(0, len(payload) - len(payload) % full, full)]
    if rest := payload[len(payload) - len(payload) % full :]:
        index = next(i for i, k in enumerate(rates, 1) if _room(k) >= len(rest))
        frames.append(_HEADS[index] + rest.ljust(_room(rates[index - 1]), b"\0"))
    size = sum(map(len, frames)) + _room(128) + HEAD
    starts = np.cumsum([_room(128) + HEAD] + [len(f) for f in frames])[:-1] if frames else np.zeros(1)
    toc = bytes(min(255, int(256 * starts[len(frames) * i // 100]) // size) for i in range(100))
    table_ = b"Xing" + struct.pack(">III", 7, len(frames), size) + toc
    first = _HEADS[9] + table_.ljust(_room(128), b"\0")
    fields = b""
    for key, value in (("payload_bytes", len(payload)), ("payload_crc32", zlib.crc32(payload))):
        body = b"\x03" + key.encode() + b"\0" + str(value).encode()
        fields += b"TXXX" + bytes(((len(body) >> 7 * k) & 127) for k in (3, 2, 1, 0)) + b"\0\0" + body
    tag = b"ID3\x04\0\0" + bytes(((len(fields) >> 7 * k) & 127) for k in (3, 2, 1, 0)) + fields
    return tag + first + b"".join(frames)


def padded(raw: bytes, unit: int = 64) -> bytes:
    """Bytes 0 appended up to a positive multiple of ``unit``."""
    return raw.ljust(max(unit, -(-len(raw) // unit) * unit), b"\0")


def feature(s: Stream) -> str:
    kinds = ",".join(f"{k}x{n}" for k, n in sorted(s.kbps.items()))
    sound = zlib.crc32(s.payload) == _number(s.tags, "payload_crc32", -1)
    return (
        f"frames={s.frames};samples={s.samples};rate={s.rate};duration_us={s.duration_us};kbps={kinds};crc={s.crc_ok}/{s.checked};"
        f"resyncs={s.resyncs};xing={s.xing.get('frames', 0)};whole={int(sound)};offsets={zlib.crc32(s.offsets.astype('<i8').tobytes()):08x}"
    )


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes and the text's bytes as an MPEG stream (``media``)."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("raw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                raw = [r.as_py() for r in batch.column(1)]
                media = [build(padded(r)) for r in raw]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_bytes long, media binary")


READ = (
    "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
    "frames long, duration_us long, crc_ok long, checked long, resyncs long, offsets array<bigint>"
)


def read(media: DataFrame, keep: tuple[str, ...] = ("doc_id", "n_bytes"), media_col: str = "media") -> DataFrame:
    """Parse a media column; ``keep`` names the columns carried along."""
    rows = media.select(*[F.col(f"`{k}`") for k in keep], F.col(f"`{media_col}`").alias("media"))
    names = [x.split()[0] for x in READ.split(", ")]
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for cell in batch.column(len(keep)):
                data = cell.as_py() or b""
                s = parse(data)
                got.append(
                    (
                        len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-64:]), len(data), hashlib.sha256(data).hexdigest(),
                        feature(s), s.frames, s.duration_us, s.crc_ok, s.checked, s.resyncs, s.offsets,
                    )
                )
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 5, pa.list_(pa.int64())]
            cols = [pa.array([g[i] for g in got], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], *cols], [*keep, *names])

    return rows.mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", " + READ)


def query(spark, sf_dir: str) -> DataFrame:
    found = read(store(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "frames", "duration_us", "offsets")
