"""Validators of chained formats: shared walks, time in proportion to the blob, CRC of parts, carving."""

import hashlib
import random
import struct
import time
import zlib

from kinespark.llm import media


def chunk(kind, data):
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


HEAD = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0))
GIF = b"GIF89a\x01\x00\x01\x00\x80\x00\x00\xff\xff\xff\x00\x00\x00,\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x02D\x01\x00;"
JPEG = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x05abc\xff\xda\x00\x03a12\xff\x00z\xff\xd0q\xff\xd9"
OGG = b"OggS\0\2" + b"\0" * 20 + b"\1\3abcOggS\0\4" + b"\0" * 20 + b"\1\2xy"
FLAC = b"fLaC\x00\x00\x00\x22" + b"x" * 34 + b"\x84\x00\x00\x01y\xff\xf8"
MP4 = struct.pack(">I", 16) + b"ftypisom0000" + struct.pack(">I", 12) + b"moovabcd"
AVI = b"RIFF" + struct.pack("<I", 16) + b"AVI JUNK" + struct.pack("<I", 3) + b"abc\0"


def test_every_chained_format_is_found_and_cut_ones_are_not():
    whole = {"gif": GIF, "jpeg": JPEG, "ogg": OGG, "mp4": MP4, "avi": AVI, "png": HEAD + chunk(b"IDAT", bytes(70_000)) + chunk(b"IEND", b""), "wav": media.wave(b"abcd"), "flac": FLAC}
    for name, blob in whole.items():
        tail = b"" if name == "flac" else b" tail"
        assert (name, 7, len(blob)) in media.findings(b"before " + blob + tail), name
        assert [f for f in media.findings(blob[:-3]) if f[0] == name] == [], name
    assert media.findings(b"RIFF" + struct.pack("<I", 12) + b"WAVEfmt " + struct.pack("<I", 0)) == []  # no data chunk


def test_walks_are_linear():
    """Beginnings without an end, whose parts lead into each other: twice the blob takes about twice the time, not four times."""
    # a chain of small chunks that 4,000 files lead into, each ending with it
    suffix, hits = b"JUNK\0\0\0\0" * 4000, 4000
    nested = b"".join(b"RIFF" + struct.pack("<I", (hits - k) * 20 - 8 + len(suffix)) + b"WAVEJUNK" + struct.pack("<I", (hits - k - 1) * 20) for k in range(hits)) + suffix
    begun = time.monotonic()
    for blob in (b"GIF89aAAAAAAA!a" * 200_000, JPEG[:-2] * 60_000, OGG[:32] * 60_000, MP4[:16] * 60_000, FLAC[:42] * 60_000, (HEAD + struct.pack(">I", 1 << 20) + b"IDAT") * 40_000, nested):
        assert media.findings(blob) == []
    assert time.monotonic() - begun < 90


def test_crc_of_parts():
    b = random.Random(1).randbytes(50_000)
    crc = media.Crc(b)
    for start, end in ((0, 50_000), (1, 49_999), (4096, 40_960), (12_345, 45_678), (30_000, 30_001), (7, 7)):
        assert crc.part(start, end) == zlib.crc32(b[start:end])


def test_embedded_objects_are_carved(spark):
    """Texts that hold a GIF: its place, length and digest are in the row; what lies in it is not carved again."""
    text = "see " + GIF.decode("latin-1").encode("ascii", "ignore").decode() + " and " + "%PDF-1 %PDF-2 startxref 1 %%EOF"
    stored = media.store_texts(spark.createDataFrame([(1, text), (2, "plain")], "doc_id long, text string"))
    rows = {r.doc_id: r for r in media.audio_features(stored).collect()}
    pdf = b"%PDF-1 %PDF-2 startxref 1 %%EOF"
    at = bytes(stored.filter("doc_id = 1").first().media).index(pdf)
    assert rows[1].embedded == f"pdf@{at}+{len(pdf)}:{hashlib.sha256(pdf).hexdigest()}" and rows[1].feature.endswith("embedded=2")
    assert rows[2].embedded == ""
