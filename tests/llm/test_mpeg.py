"""MPEG streams: round trips, damage, tags and foreign headers."""

import hashlib
import random
import zlib

import numpy as np

from tessera.llm import mpeg


def test_round_trip_of_bytes():
    rng = random.Random(1)
    for text in [b"", b"a", b"x" * 576, b"\xff\xfa\xc4\xc0" * 1000, bytes(rng.randrange(256) for _ in range(5000)), b"\xff" * 2000]:
        p = mpeg.padded(text)
        assert len(p) % 576 == 0 and len(p) >= 576 and p[: len(text)] == text and set(p[len(text) :]) <= {255}
        data = mpeg.encode(p)
        s = mpeg.parse(data)
        n = len(p) // 576
        assert mpeg.payload_of(data, s) == p and s.samples == 1152 * n and s.rate == 48000 and s.crc_ok == n and not (s.crc_bad or s.resyncs or s.skipped)
        assert s.table["frames"] == n and s.tags["TXXX:payload-bytes"] == str(len(p))
        assert s.table["bytes"] == 192 + 672 * n and (np.diff(s.offsets) == 672).all()


def test_damage_is_found_and_passed():
    data = bytearray(mpeg.encode(mpeg.padded(b"abc" * 4000)))
    s = mpeg.parse(bytes(data))
    at = int(s.offsets[5])
    data[at] = 0  # a header lost
    data[int(s.offsets[9]) + 7] ^= 1  # a side information changed
    t = mpeg.parse(bytes(data[:at]) + b"\xff\xfb\x90\x00junk" + bytes(data[at:]) + b"TAG" + b"Title".ljust(30, b"\0") + bytes(95))
    assert len(t.offsets) == len(s.offsets) - 1 and t.resyncs == 1 and t.crc_bad == 1 and t.skipped == 672 + 8 and t.tags["ID3v1"] == "Title"


def test_headers_of_other_kinds():
    h = mpeg.header(0xFFFB9064)  # MPEG 1 Layer III 128 kbit/s 44.1 kHz joint stereo
    assert (h.version, h.layer, h.kbps, h.rate, h.channels, h.size, h.samples, h.side, h.protected) == (1, 3, 128, 44100, 2, 417, 1152, 32, False)
    h = mpeg.header(0xFFF344C4)  # MPEG 2 Layer III 32 kbit/s 24 kHz mono
    assert (h.version, h.kbps, h.rate, h.size, h.samples, h.side) == (2, 32, 24000, 96, 576, 9)
    h = mpeg.header(0xFFFF1800)  # MPEG 1 Layer I 32 kbit/s 32 kHz
    assert (h.layer, h.kbps, h.rate, h.size, h.samples) == (1, 32, 32000, 48, 384)
    assert not any(map(mpeg.header, (0xFFFBF064, 0xFFFB0064, 0xFFFB9C64, 0xFFEB9064, 0xFFF99064, 0x49443303)))
    assert len(mpeg.parse(b"").offsets) == len(mpeg.parse(b"plain text \xff\xfb\x90\x64").offsets) == 0


def test_vbri():
    h = bytes((0xFF, 0xFB, 0x90, 0x64))
    frame = bytearray(417)
    frame[:4], frame[36:40], frame[46:50], frame[50:54] = h, b"VBRI", (1251).to_bytes(4, "big"), (2).to_bytes(4, "big")
    plain = h + bytes(413)
    s = mpeg.parse(bytes(frame) + plain * 2)
    assert s.table == {"bytes": 1251, "frames": 2} and s.offsets.tolist() == [417, 834]


def test_query_rows(spark):
    texts = [None, "", "é", "same", "same", "w " * 90000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "same", "y")], "doc_id long, text string, media string")
    got = mpeg.round_trip(df).collect()
    assert len(got) == 7
    for r in got:
        t = "same" if r.doc_id is None else texts[r.doc_id] or ""
        p = mpeg.padded(t.encode())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(t.encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    assert len({tuple(r)[1:] for r in got if r.n_bytes == 4}) == 1
    assert mpeg.round_trip(df.limit(0)).count() == 0
