"""Signature sniffing in media columns: find magic bytes, confirm structure, correct types, carve what is embedded.

One Aho-Corasick automaton looks for all signatures in one pass over a blob, and for the marks that end PDF and ZIP files.
At each hit a validator of that format walks the structure (chunks, boxes, blocks, pages) and returns the length it vouches
for, or nothing. Walks of one format share what they found, so a part of the blob is walked once however many hits lead
there; the hits of formats that end in a mark are paired with the marks found. A valid object at the blob's start gives the
blob's true type, whatever was declared; valid objects elsewhere are embedded media, and are carved.

The WAVE functions store a payload as 8-bit mono samples and read it back.

Defined results: a null blob has no findings and keeps its declared type, as does an empty one and one without a valid
object at its start; repeated rows are repeated findings; other columns are not read.
"""

from __future__ import annotations

import hashlib
import random
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kinespark.llm.common import text_or_empty, text_slices

#: format, media type, magic bytes, how far into the object they stand. Fixed values.
SIGNATURES = (
    ("png", "image/png", b"\x89PNG\r\n\x1a\n", 0),
    ("jpeg", "image/jpeg", b"\xff\xd8\xff", 0),
    ("gif", "image/gif", b"GIF87a", 0),
    ("gif", "image/gif", b"GIF89a", 0),
    ("bmp", "image/bmp", b"BM", 0),
    ("riff", "application/x-riff", b"RIFF", 0),
    ("flac", "audio/flac", b"fLaC", 0),
    ("ogg", "audio/ogg", b"OggS", 0),
    ("mp4", "video/mp4", b"ftyp", 4),
    ("pdf", "application/pdf", b"%PDF-", 0),
    ("zip", "application/zip", b"PK\x03\x04", 0),
    ("gzip", "application/gzip", b"\x1f\x8b\x08", 0),
)
#: The form types of RIFF files. Fixed values.
RIFF_TYPES = {b"WAVE": ("wav", "audio/wav"), b"WEBP": ("webp", "image/webp"), b"AVI ": ("avi", "video/x-msvideo")}
TYPES = {name: kind for name, kind, _, _ in SIGNATURES} | dict(RIFF_TYPES.values())


class Walk:
    """Chains of places in a blob, each with one successor: what a place leads to is found once, whichever hits come by it.

    step(x) gives (next place or None, end, flags): without a next place the chain is over, and has an end or is broken. A
    place's result is (end, flags of the places from there on).
    """

    def __init__(self, step: Callable[[int], tuple[int | None, int | None, int]]):
        self.step, self.known = step, {}

    def __call__(self, x: int) -> tuple[int | None, int]:
        path = []
        while x not in self.known:
            after, end, flags = self.step(x)
            path.append((x, flags))
            if after is None:
                self.known[x] = end, flags
                break
            x = after
        end, seen = self.known[x]
        for x, flags in reversed(path):
            seen |= flags
            self.known[x] = end, seen
        return end, seen


#: The polynomial of CRC-32, its bits in reverse order. Fixed value.
CRC_POLYNOMIAL = 0xEDB88320
CRC_STEP = 4096


class Crc:
    """CRC-32 of any part of a blob in bounded time, from those of its beginnings at every CRC_STEP bytes."""

    def __init__(self, b: bytes):
        self.b, self.heads = b, []

    def head(self, to: int) -> int:
        while len(self.heads) <= to // CRC_STEP:
            k = len(self.heads)
            self.heads.append(zlib.crc32(self.b[(k - 1) * CRC_STEP : k * CRC_STEP], self.heads[-1]) if k else 0)
        k = to // CRC_STEP
        return zlib.crc32(self.b[k * CRC_STEP : to], self.heads[k])

    def part(self, start: int, end: int) -> int:
        if end - start <= 4 * CRC_STEP:
            return zlib.crc32(self.b[start:end])
        return self.head(end) ^ shifted(self.head(start), end - start)


def times(a: int, b: int) -> int:
    """Product of two residues of the CRC's polynomial."""
    out = 0
    for k in range(32):
        if a >> (31 - k) & 1:
            out ^= b
        b = b >> 1 ^ (CRC_POLYNOMIAL if b & 1 else 0)
    return out


def shifted(crc: int, n: int) -> int:
    """What n zero bytes make of a CRC before its final inversion and start value."""
    power, square = 1 << 31, 1 << 23  # 1, and a byte's shift
    while n:
        if n & 1:
            power = times(power, square)
        square = times(square, square)
        n >>= 1
    return times(power, crc)


def png_walk(b: bytes) -> Callable[[int], int | None]:
    crc = Crc(b)

    def step(x: int) -> tuple[int | None, int | None, int]:
        if x + 12 > len(b):
            return None, None, 0
        n, kind = struct.unpack_from(">I4s", b, x)
        if x + 12 + n > len(b) or crc.part(x + 4, x + 8 + n) != struct.unpack_from(">I", b, x + 8 + n)[0]:
            return None, None, 0
        return (None, x + 12 + n, 0) if kind == b"IEND" else (x + 12 + n, None, 0)

    walk = Walk(step)
    return lambda at: walk(at + 8)[0] if b[at + 8 : at + 16] == b"\0\0\0\rIHDR" else None


def jpeg_walk(b: bytes) -> Callable[[int], int | None]:
    """Segments at places x, entropy-coded data at ~x; the flag tells of a frame header."""

    def step(x: int) -> tuple[int | None, int | None, int]:
        if x < 0:
            x = b.find(b"\xff", ~x)
            if x < 0 or x + 1 >= len(b):
                return None, None, 0
            if b[x + 1] == 0xD9:
                return None, x + 2, 0
            return (~(x + 2) if b[x + 1] == 0 or 0xD0 <= b[x + 1] <= 0xD7 else x), None, 0
        if x + 4 > len(b) or b[x] != 0xFF or b[x + 1] < 0xC0 or (n := struct.unpack_from(">H", b, x + 2)[0]) < 2:
            return None, None, 0
        return (~(x + 2 + n) if b[x + 1] == 0xDA else x + 2 + n), None, int(b[x + 1] in (0xC0, 0xC1, 0xC2, 0xC3))

    walk = Walk(step)

    def end(at: int) -> int | None:
        found, frame = walk(at + 2)
        return found if frame else None

    return end


def gif_walk(b: bytes) -> Callable[[int], int | None]:
    """Blocks at places x, their sub-blocks at ~x."""
    colours = lambda flags: 3 << (flags & 7) + 1 if flags & 0x80 else 0

    def step(x: int) -> tuple[int | None, int | None, int]:
        if x < 0:
            x = ~x
            if x >= len(b):
                return None, None, 0
            return (~(x + 1 + b[x]) if b[x] else x + 1), None, 0
        if x < len(b) and b[x] == 0x3B:
            return None, x + 1, 0
        if x < len(b) and b[x] == 0x21:
            return ~(x + 2), None, 0
        if x + 10 < len(b) and b[x] == 0x2C:
            return ~(x + 11 + colours(b[x + 9])), None, 0
        return None, None, 0

    walk = Walk(step)
    return lambda at: walk(at + 13 + colours(b[at + 10]))[0] if at + 13 <= len(b) else None


def bmp_length(b: bytes, at: int) -> int | None:
    if at + 30 > len(b):
        return None
    size, reserved, pixels, header, width, height, planes, bits = struct.unpack_from("<IIIIiiHH", b, at + 2)
    row = (abs(width) * bits + 31) // 32 * 4
    good = reserved == 0 and header in (12, 40, 52, 56, 64, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and 14 + header <= pixels <= size
    return size if good and pixels + row * abs(height) <= size <= len(b) - at else None


def riff_chunks(b: bytes, at: int) -> tuple[int, bytes, list[tuple[bytes, int, int]]] | None:
    """Length, form type and chunks (name, offset, size) of a RIFF file whose chunks fill it exactly."""
    if at + 12 > len(b) or b[at : at + 4] != b"RIFF":
        return None
    n, form = struct.unpack_from("<I4s", b, at + 4)
    x, end, chunks = at + 12, at + 8 + n, []
    while x + 8 <= end <= len(b):
        name, size = struct.unpack_from("<4sI", b, x)
        chunks.append((name, x + 8, size))
        x += 8 + size + (size & 1)
    return (8 + n, form, chunks) if chunks and x == end <= len(b) else None


def riff_lengths(b: bytes, hits: list[int]) -> dict[int, int]:
    """Lengths of the RIFF files at hits whose chunks fill them exactly.

    Chunks form paths that join. Hits are taken in a shuffled order, so that one passes by about log(hits) paths.
    """
    path_of: dict[int, tuple[int, int]] = {}
    paths: list[tuple[list[int], dict[bytes, list[int]], int]] = []
    found = {}

    def follow(x: int) -> None:
        places, named = [], {b"fmt ": [], b"data": []}
        while x not in path_of and x + 8 <= len(b):
            name, size = struct.unpack_from("<4sI", b, x)
            path_of[x] = len(paths), len(places)
            places.append(x)
            if name in named:
                named[name].append(x)
            x += 8 + size + (size & 1)
        paths.append((places, named, x))

    for at in random.Random(len(hits)).sample(hits, len(hits)):
        if b[at + 8 : at + 12] not in RIFF_TYPES:
            continue
        end, x, seen = at + 8 + struct.unpack_from("<I", b, at + 4)[0], at + 12, set()
        if not x < end <= len(b):
            continue
        while x < end and x + 8 <= len(b):
            if x not in path_of:
                follow(x)
            path, k = path_of[x]
            places, named, after = paths[path]
            to = bisect_left(places, end, k)
            seen |= {name for name, stand in named.items() if bisect_left(stand, x) < bisect_left(stand, end)}
            x = places[to] if to < len(places) else after
        if x == end and (b[at + 8 : at + 12] != b"WAVE" or len(seen) == 2):
            found[at] = end - at
    return found


def flac_walk(b: bytes) -> Callable[[int], int | None]:
    """To the end of the blob: FLAC frames state no length; the metadata blocks are walked."""

    def step(x: int) -> tuple[int | None, int | None, int]:
        if x + 4 > len(b):
            return None, None, 0
        n, after = int.from_bytes(b[x + 1 : x + 4], "big"), x + 4
        if b[x] & 0x7F == 127 or after + n > len(b):
            return None, None, 0
        if b[x] & 0x80:
            return None, len(b) if b[after + n : after + n + 1] == b"\xff" else None, 0
        return after + n, None, 0

    walk = Walk(step)
    return lambda at: walk(at + 4)[0] if b[at + 4 : at + 5] in (b"\0", b"\x80") and b[at + 5 : at + 8] == b"\0\0\x22" else None


def ogg_walk(b: bytes) -> Callable[[int], int | None]:
    def step(x: int) -> tuple[int | None, int | None, int]:
        if b[x : x + 4] != b"OggS" or x + 27 > len(b) or b[x + 4]:
            return None, None, 0
        n = b[x + 26]
        to = x + 27 + n + sum(b[x + 27 : x + 27 + n])
        if to > len(b):
            return None, None, 0
        return (None, to, 0) if b[x + 5] & 4 else (to, None, 0)

    walk = Walk(step)
    return lambda at: walk(at)[0] if b[at + 5 : at + 6] and b[at + 5] & 2 else None


#: Boxes that stand at the top of an MP4 file. Fixed values.
BOXES = (b"ftyp", b"moov", b"mdat", b"free", b"skip", b"wide", b"uuid", b"meta", b"moof", b"mfra", b"sidx", b"styp")


def mp4_walk(b: bytes) -> Callable[[int], int | None]:
    """Boxes to the first place that holds none; the flag tells of a box with an index."""

    def step(x: int) -> tuple[int | None, int | None, int]:
        if x + 8 > len(b):
            return None, x, 0
        n, name = struct.unpack_from(">I4s", b, x)
        if n == 1 and x + 16 <= len(b):
            n = struct.unpack_from(">Q", b, x + 8)[0]
        if n < 8 or x + n > len(b) or name not in BOXES:
            return None, x, 0
        return x + n, None, int(name in (b"moov", b"moof", b"meta"))

    walk = Walk(step)

    def end(at: int) -> int | None:
        found, index = walk(at)
        return found if b[at + 4 : at + 8] == b"ftyp" and index else None

    return end


def pdf_length(b: bytes, at: int, marks: dict[str, list[int]]) -> int | None:
    """To the first end mark after the first startxref."""
    starts, ends = marks["startxref"], marks["%%EOF"]
    if not b[at + 5 : at + 6].isdigit() or (k := bisect_left(starts, at)) == len(starts):
        return None
    k = bisect_left(ends, starts[k])
    return ends[k] + 5 - at if k < len(ends) else None


def zip_ends(b: bytes, ends: list[int]) -> dict[int, int]:
    """Where archives begin, by their end records (the first of each), and where they end."""
    found: dict[int, int] = {}
    for end in ends:
        if end + 22 <= len(b):
            n, directory, n_comment = struct.unpack_from("<IIH", b, end + 12)
            at = end - n - directory
            if at >= 0 and b[at + directory : at + directory + 4] in (b"PK\x01\x02", b"PK\x05\x06"):
                found.setdefault(at, min(end + 22 + n_comment, len(b)))
    return found


def gzip_length(b: bytes, at: int) -> int | None:
    """By inflating, without keeping what comes out."""
    if at + 18 > len(b) or b[at + 3] & 0xE0:
        return None
    unpack, x, rest = zlib.decompressobj(31), at, b""
    try:
        while not unpack.eof and (rest or x < len(b)):
            if not rest:
                rest, x = b[x : x + 65536], x + 65536
            unpack.decompress(rest, 1 << 20)
            rest = unpack.unconsumed_tail
    except zlib.error:
        return None
    return min(x, len(b)) - len(unpack.unused_data) - at if unpack.eof else None


#: Formats whose objects are chains of parts: a walk of the blob that gives where the object at a place ends.
WALKS = {"png": png_walk, "jpeg": jpeg_walk, "gif": gif_walk, "flac": flac_walk, "ogg": ogg_walk, "mp4": mp4_walk}
#: What ends a PDF or ZIP file. Fixed values.
MARKS = (("startxref", b"startxref"), ("%%EOF", b"%%EOF"), ("zip end", b"PK\x05\x06"))
_AUTOMATON: list = []


def automaton():
    """One automaton a worker, over bytes as the characters of the same number."""
    if not _AUTOMATON:
        import ahocorasick

        found = ahocorasick.Automaton()
        for name, _, magic, inside in SIGNATURES:
            found.add_word(magic.decode("latin-1"), (name, len(magic) - 1 + inside))
        for name, mark in MARKS:
            found.add_word(mark.decode("latin-1"), (name, len(mark) - 1))
        found.make_automaton()
        _AUTOMATON.append(found)
    return _AUTOMATON[0]


def findings(blob: bytes) -> list[tuple[str, int, int]]:
    """(format, offset, length) of every valid object, outermost first; what lies in an object is found as well, but for
    gzip inside gzip, whose bytes are compressed."""
    hits, marks = [], {name: [] for name, _ in MARKS}
    for end, (name, back) in automaton().iter(blob.decode("latin-1")):
        if name in marks:
            marks[name].append(end - back)
        elif end >= back:
            hits.append((name, end - back))
    archives, packed_to, found = zip_ends(blob, marks["zip end"]), 0, []
    files, walks = riff_lengths(blob, [at for name, at in hits if name == "riff"]), {}
    for name, at in hits:
        if name == "pdf":
            n = pdf_length(blob, at, marks)
        elif name == "zip":
            n = archives[at] - at if at in archives else None
        elif name == "gzip":
            n = gzip_length(blob, at) if at >= packed_to else None
            packed_to = at + n if n else packed_to
        elif name == "riff":
            n = files.get(at)
        elif name == "bmp":
            n = bmp_length(blob, at)
        else:
            if name not in walks:
                walks[name] = WALKS[name](blob)
            end = walks[name](at)
            n = None if end is None else end - at
        if n is not None:
            found.append((RIFF_TYPES[blob[at + 8 : at + 12]][0] if name == "riff" else name, at, n))
    return sorted(found, key=lambda f: (f[1], -f[2]))


def true_type(found: list[tuple[str, int, int]], declared: str | None) -> str | None:
    return TYPES[found[0][0]] if found and found[0][1] == 0 else declared


def carved(blob: bytes, found: list[tuple[str, int, int]]) -> str:
    """What is embedded: format, offset, length and sha256 of the objects behind the start that lie in no other of these."""
    parts, to = [], 1
    for name, at, n in found:
        if at >= to:
            parts.append(f"{name}@{at}+{n}:{hashlib.sha256(blob[at : at + n]).hexdigest()}")
            to = at + n
    return ";".join(parts)


def sniff(blobs: DataFrame, id_col: str, blob_col: str, declared_col: str, carve: bool = False) -> DataFrame:
    """(id, declared, corrected, format, offset, length, media) by valid object, or one row without format.

    media holds the carved bytes if asked for.
    """
    kind = blobs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                blob, declared = batch.column("__blob")[k].as_py(), batch.column("__declared")[k].as_py()
                found = findings(blob) if blob else []
                n = max(1, len(found))
                rows = found or [(None, None, None)]
                media = [blob[at : at + size] if carve and at is not None else None for _, at, size in rows]
                yield pa.RecordBatch.from_arrays([
                    pa.array([batch.column("__id")[k].as_py()] * n, batch.column("__id").type), pa.array([declared] * n, pa.string()), pa.array([true_type(found, declared)] * n, pa.string()),
                    pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array(media, pa.binary()),
                ], names=["id", "declared", "corrected", "format", "offset", "length", "media"])

    read = blobs.select(blobs[id_col].alias("__id"), blobs[blob_col].alias("__blob"), blobs[declared_col].alias("__declared"))
    return read.mapInArrow(run, f"id {kind}, declared string, corrected string, format string, offset long, length long, media binary").withColumnRenamed("id", id_col)


def wave(payload: bytes, rate: int = 8000) -> bytes:
    """A WAVE file of unsigned 8-bit mono samples."""
    pad = len(payload) & 1
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + pad, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload + b"\0" * pad


def wave_samples(media: bytes) -> tuple[bytes, tuple[int, int, int]]:
    """The sample bytes of a WAVE file, and its channels, rate and bits."""
    _, _, chunks = riff_chunks(media, 0)
    parts = {name: (at, n) for name, at, n in chunks}
    _, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, parts[b"fmt "][0])
    at, n = parts[b"data"]
    return media[at : at + n], (channels, rate, bits)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: int = 192) -> DataFrame:
    """(id, n_bytes, media, declared): each text's UTF-8, padded with spaces to a positive multiple of unit, as a WAVE.

    The type is declared as unknown; sniffing has to find it.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in text_slices(batches, "__text"):
            raw, bounds = data.tobytes(), offsets.tolist()
            media = [wave((t := raw[a:b]) + b" " * (max(unit, -(-len(t) // unit) * unit) - len(t))) for a, b in zip(bounds, bounds[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([part.column("__id"), pa.array(np.diff(offsets), pa.int64()), pa.array(media, pa.binary()), pa.array(["application/octet-stream"] * len(media))], names=["id", "n_bytes", "media", "declared"])

    read = docs.select(docs[id_col].alias("__id"), text_or_empty(text_col).alias("__text"))
    return read.mapInArrow(run, f"id {kind}, n_bytes long, media binary, declared string").withColumnRenamed("id", id_col)


def audio_features(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Sniff each stored blob, carve the object that gives it its type, read its samples and describe them.

    embedded lists what else is in the blob, as carved() tells.
    """
    kind = stored.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for blob, declared in zip(batch.column("media"), batch.column("declared").to_pylist(), strict=True):
                blob = blob.as_py()
                hits = findings(blob)
                corrected = true_type(hits, declared)
                if corrected != "audio/wav" or hits[0][2] != len(blob):
                    raise ValueError("a stored text is not the WAVE file that was written")
                samples, (channels, rate, bits) = wave_samples(blob[: hits[0][2]])
                values = np.frombuffer(samples, np.uint8)
                level = values.astype(np.int32) - 128
                crossings = int(np.count_nonzero((level[1:] < 0) != (level[:-1] < 0)))
                feature = f"{corrected};{channels}ch;{rate}Hz;{bits}bit;mean={level.mean():.6f};rms={np.sqrt((level * level).mean()):.6f};crossings={crossings};embedded={len(hits) - 1}"
                found.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(blob), hashlib.sha256(blob).hexdigest(), feature, corrected, carved(blob, hits)))
            columns = list(zip(*found, strict=True)) if found else [()] * 8
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(id_col), batch.column("n_bytes"), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "corrected_type", "embedded"])

    schema = f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, corrected_type string, embedded string"
    return stored.select(id_col, "n_bytes", "media", "declared").mapInArrow(run, schema).withColumnRenamed("id", id_col)
