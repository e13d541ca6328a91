"""MPEG audio columns: streams that carry bytes without loss, and their parser.

``encode`` puts a payload into Layer III frames of 48 kHz mono: an ID3v2 tag, an information frame with frame
count, byte count and table of contents, then one protected frame for each 576 bytes. The payload takes
the place of the frame's main data, which a parser never looks into. ``parse`` reads any stream of MPEG 1, 2 or 2.5,
layers I to III: it skips tags, finds the first header that another header follows, walks from frame to
frame, finds its way again after damage, reads Xing, Info and VBRI tables, and verifies Layer III's checksums.
Duration is a count of samples over a sample rate, so it is exact.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written

#: Fixed values of the format: bit rates (kbit/s) by index for MPEG 1 layers I, II, III and for MPEG 2 and 2.5 layer I, layers II and III.
RATES_1_1 = (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448)
RATES_1_2 = (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384)
RATES_1_3 = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
RATES_2_1 = (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256)
RATES_2_2 = (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)
#: Sample rates of MPEG 1; MPEG 2 has half, 2.5 a quarter of them.
SAMPLE_RATES = (44100, 48000, 32000)

UNIT = 576
PAD = 255
_INDEX_AUDIO, _INDEX_INFO = 12, 5  # 224 and 64 kbit/s: frames of 672 and 192 bytes
AUDIO_FRAME, INFO_FRAME, SIDE = 672, 192, 17


def _crc_table() -> np.ndarray:
    table = np.zeros(256, np.uint16)
    for i in range(256):
        r = i << 8
        for _ in range(8):
            r = (r << 1 ^ 0x8005) & 0xFFFF if r & 0x8000 else r << 1
        table[i] = r
    return table


_CRC = _crc_table()


def crc16(rows: np.ndarray) -> np.ndarray:
    """CRC-16 (polynomial 8005, start FFFF) of each row of bytes."""
    c = np.full(len(rows), 0xFFFF, np.uint16)
    for col in rows.T:
        c = (c << np.uint16(8)) ^ _CRC[(c >> np.uint16(8)) ^ col]
    return c


@dataclass(frozen=True)
class Header:
    """One frame's header: version (1, 2, 25), layer, checksum present, bit rate, sample rate, channels, bytes and samples of the frame."""

    version: int
    layer: int
    protected: bool
    kbps: int
    rate: int
    channels: int
    size: int
    samples: int

    @property
    def side(self) -> int:
        """Bytes of Layer III's side information."""
        return (32 if self.channels == 2 else 17) if self.version == 1 else (17 if self.channels == 2 else 9)


_headers: dict[int, Header | None] = {}


def header(word: int) -> Header | None:
    """The header that four bytes (as a number) hold, or None if they hold none of known length."""
    key = word & 0xFFFFFFC0
    if key not in _headers:
        if len(_headers) > 65536:
            _headers.clear()
        _headers[key] = _header(word)
    return _headers[key]


def _header(word: int) -> Header | None:
    v, l, b, s = word >> 19 & 3, word >> 17 & 3, word >> 12 & 15, word >> 10 & 3
    if word >> 21 != 0x7FF or v == 1 or l == 0 or b in (0, 15) or s == 3:
        return None
    version, layer, pad = {0: 25, 2: 2, 3: 1}[v], 4 - l, word >> 9 & 1
    rates = (RATES_1_1, RATES_1_2, RATES_1_3)[layer - 1] if version == 1 else RATES_2_1 if layer == 1 else RATES_2_2
    rate = SAMPLE_RATES[s] // {1: 1, 2: 2, 25: 4}[version]
    samples = 384 if layer == 1 else 1152 if layer == 2 or version == 1 else 576
    kbps = rates[b]
    size = (12 * kbps * 1000 // rate + pad) * 4 if layer == 1 else samples // 8 * kbps * 1000 // rate + pad
    return Header(version, layer, not word >> 16 & 1, kbps, rate, 1 if word >> 6 & 3 == 3 else 2, size, samples)


@dataclass
class Stream:
    """What a parse found. ``offsets`` and ``sizes``: of audio frames, in order."""

    offsets: np.ndarray
    sizes: np.ndarray
    samples: int = 0
    rate: int = 0
    kbps: tuple[int, ...] = ()
    tags: dict[str, str] = field(default_factory=dict)
    table: dict[str, int] = field(default_factory=dict)
    crc_ok: int = 0
    crc_bad: int = 0
    resyncs: int = 0
    skipped: int = 0


def syncsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def read_syncsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def id3v2(data: bytes) -> tuple[int, dict[str, str]]:
    """(bytes of the tag at the start, its text frames); (0, {}) if there is none."""
    if data[:3] != b"ID3" or len(data) < 10 or any(x & 128 for x in data[6:10]):
        return 0, {}
    end, at, tags = 10 + read_syncsafe(data[6:10]), 10, {}
    if data[5] & 0x40 and len(data) >= 14:
        at += read_syncsafe(data[10:14]) + (4 if data[3] == 3 else 0)
    while at + 10 <= min(end, len(data)) and data[at]:
        name = data[at : at + 4].decode("latin-1")
        n = read_syncsafe(data[at + 4 : at + 8]) if data[3] == 4 else int.from_bytes(data[at + 4 : at + 8], "big")
        body = data[at + 10 : at + 10 + n]
        if name[:1] == "T" and body:
            how = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1")
            parts = body[1:].decode(how, "replace").rstrip("\0").split("\0", 1)
            tags[f"{name}:{parts[0]}" if name == "TXXX" else name] = parts[-1]
        at += 10 + n
    return end + (10 if data[5] & 0x10 else 0), tags


def _table(frame: bytes, h: Header) -> dict[str, int]:
    """Counts from a Xing, Info or VBRI table in a frame; empty if it has none."""
    for at in {4 + h.side, 4 + 2 * h.protected + h.side}:
        if frame[at : at + 4] in (b"Xing", b"Info"):
            flags, at, out = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8, {}
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    out[name] = int.from_bytes(frame[at : at + 4], "big")
                    at += 4
            if flags & 4:
                out["toc_crc"] = zlib.crc32(frame[at : at + 100])
            return out or {"frames": 0}
    if frame[36:40] == b"VBRI":
        return {"bytes": int.from_bytes(frame[46:50], "big"), "frames": int.from_bytes(frame[50:54], "big")}
    return {}


def _alike(a: Header, b: Header | None) -> bool:
    return b is not None and (a.version, a.layer, a.rate) == (b.version, b.layer, b.rate)


def parse(data: bytes) -> Stream:
    """Frames, tags, tables and checksums of a stream. Bytes that hold no frame are skipped and counted; none at all give an empty result."""
    at, tags = id3v2(data)
    end = len(data) - 128 if len(data) >= 128 and data[-128:-125] == b"TAG" else len(data)
    if end < len(data):
        tags["ID3v1"] = data[-125:-95].rstrip(b"\0 ").decode("latin-1")
    out = Stream(np.zeros(0, np.int64), np.zeros(0, np.int64), tags=tags)
    offsets, heads, like, lost = [], [], None, False
    word = lambda i: int.from_bytes(data[i : i + 4], "big")
    while at + 4 <= end:
        h = header(word(at))
        ok = h is not None and at + h.size <= end and (like is None or _alike(like, h))
        if ok and (like is None or lost):  # a header alone may be chance: another must follow, or the end
            after = at + h.size
            ok = after == end or after + 4 <= end and _alike(h, header(word(after)))
        if ok:
            if lost:
                out.resyncs += 1
            if like is None and (t := _table(data[at : at + h.size], h)):
                out.table = t
            else:
                offsets.append(at)
                heads.append(h)
            like, lost, at = h, False, at + h.size
        else:
            nxt = data.find(b"\xff", at + 1, end)
            nxt = end if nxt < 0 else nxt
            out.skipped += nxt - at
            lost, at = True, nxt
    out.skipped += end - at if at < end else 0
    if offsets:
        out.offsets, out.sizes = np.array(offsets, np.int64), np.array([h.size for h in heads], np.int64)
        out.samples, out.rate, out.kbps = sum(h.samples for h in heads), heads[0].rate, tuple(sorted({h.kbps for h in heads}))
        raw = np.frombuffer(data, np.uint8)
        for side in {h.side for h in heads if h.protected and h.layer == 3}:
            own = out.offsets[[h.protected and h.layer == 3 and h.side == side for h in heads]]
            rows = raw[own[:, None] + np.r_[2:4, 6 : 6 + side][None, :]]
            want = raw[own + 4].astype(np.uint16) << np.uint16(8) | raw[own + 5]
            good = int((crc16(rows) == want).sum())
            out.crc_ok, out.crc_bad = out.crc_ok + good, out.crc_bad + len(own) - good
    return out


def _head(index: int) -> bytes:
    """MPEG 1, Layer III, protected, 48 kHz, no padding, mono."""
    return bytes((0xFF, 0xFA, index << 4 | 1 << 2, 0xC0))


def padded(text: bytes) -> bytes:
    """The payload: at least one unit, filled up with 255."""
    return text + bytes([PAD]) * (-len(text) % UNIT if text else UNIT)


def encode(payload: bytes) -> bytes:
    """A stream whose frames hold the payload, 576 bytes each."""
    n = len(payload) // UNIT
    frames = np.zeros((n, AUDIO_FRAME), np.uint8)
    frames[:, :4] = np.frombuffer(_head(_INDEX_AUDIO), np.uint8)
    # the side information holds the frame's number, so that checksums differ and a lost frame shows
    frames[:, 6:10] = np.arange(n, dtype=">u4").view(np.uint8).reshape(n, 4)
    c = crc16(frames[:, np.r_[2:4, 6 : 6 + SIDE]])
    frames[:, 4], frames[:, 5] = c >> 8, c & 255
    frames[:, 6 + SIDE : 6 + SIDE + UNIT] = np.frombuffer(payload, np.uint8).reshape(n, UNIT)
    info = bytearray(INFO_FRAME)
    info[:4] = _head(_INDEX_INFO)
    toc = bytes(min(255, 256 * i // 100) for i in range(100))
    body = b"Xing" + struct.pack(">III", 7, n, INFO_FRAME + n * AUDIO_FRAME) + toc
    info[6 + SIDE : 6 + SIDE + len(body)] = body
    c = int(crc16(np.frombuffer(bytes(info[2:4] + info[6 : 6 + SIDE]), np.uint8)[None, :])[0])
    info[4:6] = c >> 8, c & 255
    tag = b"\x03payload-bytes\0" + str(len(payload)).encode()
    tag = b"TXXX" + syncsafe(len(tag)) + b"\0\0" + tag
    return b"ID3\x04\0\0" + syncsafe(len(tag)) + tag + bytes(info) + frames.tobytes()


def payload_of(data: bytes, s: Stream) -> bytes:
    """The payload that ``encode`` put in: the bytes behind each audio frame's side information."""
    rows = s.offsets[:, None] + np.arange(6 + SIDE, 6 + SIDE + UNIT)[None, :]
    return np.frombuffer(data, np.uint8)[rows].tobytes()


def feature(s: Stream) -> str:
    """Duration in samples and seconds, bit rates, table, checksums, and the seek offsets, every 64th frame's and a checksum of all."""
    seek = ",".join(map(str, s.offsets[::64].tolist()))
    return (
        f"frames={len(s.offsets)};samples={s.samples};rate={s.rate};seconds={s.samples / s.rate if s.rate else 0:.6f};kbps={','.join(map(str, s.kbps))};"
        f"vbr_frames={s.table.get('frames', -1)};vbr_bytes={s.table.get('bytes', -1)};crc_ok={s.crc_ok};crc_bad={s.crc_bad};resyncs={s.resyncs};skipped={s.skipped};"
        f"offsets_crc32={zlib.crc32(s.offsets.astype('<i8').tobytes())};seek={seek}"
    )


def _slices(column, most: int = 4 << 20):
    """(first row, values) of a column in parts of a few megabytes."""
    at, part, total = 0, [], 0
    for i, x in enumerate(column):
        v = x.as_py() or b""
        part.append(v)
        total += len(v)
        if total >= most:
            yield at, part
            at, part, total = i + 1, [], 0
    if part:
        yield at, part


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as a stream. Null text counts as empty."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            for at, texts in _slices(b.column(1).cast(pa.large_binary() if pa.types.is_large_string(b.column(1).type) else pa.binary())):
                media = [encode(padded(t)) for t in texts]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def analysed(media: DataFrame) -> DataFrame:
    """What the stored streams hold: payload's and stream's sizes and checksums, and the feature."""
    import pyarrow as pa

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches):
        for b in batches:
            rows = [[] for _ in range(6)]
            for _, part in _slices(b.column(2)):
                for data in part:
                    s = parse(data)
                    p = payload_of(data, s)
                    values = (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature(s))
                    for column, v in zip(rows, values, strict=True):
                        column.append(v)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = [x.split()[0] for x in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(r, k) for r, k in zip(rows, kinds, strict=True))], names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def round_trip(docs: DataFrame, **columns) -> DataFrame:
    """Store every document as a stream in the shared folder, read the stored bytes back and analyse them. Repeated rows stay; a null id stays null."""
    return analysed(written(to_media(docs, **columns), "media"))
