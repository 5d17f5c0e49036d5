"""WARC records in ZIP packages, read by ranges without extraction.

A package holds two stored (uncompressed) members: archive/data.warc.gz, a gzip member a record, and indexes/index.jsonl,
a line a record with its offset and length. The reader parses the end record, the ZIP64 locator and directory and the
central directory, finds where the stored members' bytes begin, and reads index and records by ranges.

Of the records with equal payloads of at least MIN_REVISIT bytes, the one with the largest page_id is the response; the
others are revisit records without payload that name it. Groups are found on digests, pre-aggregated in each task.

Defined results: null html counts as empty; a null page_id sorts below all ids; rows with equal id and payload take the
same type; a null url gives a record without target; an empty table gives no package. A package is written under a name of
its attempt and renamed when whole.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import zipfile
from collections.abc import Iterator
from contextlib import ExitStack
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinespark.llm.common import filesystem, n_partitions, scratch, stored

MIN_REVISIT, PACKAGE_BYTES, RANGE_BYTES = 1000, 256 << 20, 8 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
WHEN = "2024-01-01T00:00:00Z"


def urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def urn_id(text: str) -> int | None:
    number = text[len("<urn:page:") : -1]
    return int(number) if number else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {urn(page_id)}", f"WARC-Date: {WHEN}", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += [f"WARC-Refers-To: {urn(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Record:
    kind: str
    page_id: int | None
    url: str | None
    digest: str
    refers_to: int | None
    payload_bytes: int
    payload: bytes


def parse(raw: bytes) -> Record:
    """One record; a response's payload is held against its digest and length."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("no WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    n = next(int(line.split(b":")[1]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:"))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != n or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its digest")
    refers = fields.get("WARC-Refers-To")
    return Record(fields["WARC-Type"], urn_id(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), digest, urn_id(refers) if refers else None, n, payload)


class Package:
    """Writes one package: records as they come, then their index."""

    def __init__(self, out):
        self.zip = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(DATA, "w", force_zip64=True)
        self.at, self.index = 0, []

    def add(self, page_id: int | None, raw: bytes) -> None:
        packed = gzip.compress(raw, 6, mtime=0)
        self.data.write(packed)
        self.index.append(json.dumps({"id": page_id, "offset": self.at, "length": len(packed)}))
        self.at += len(packed)

    def close(self) -> None:
        self.data.close()
        self.zip.writestr(INDEX, "\n".join(self.index))
        self.zip.close()


@dataclass
class Member:
    name: str
    method: int
    size: int
    header_at: int


def directory(source) -> list[Member]:
    """The members of a ZIP file, from the end record, ZIP64 where its fields are full, and the central directory."""
    size = source.size()
    tail_at = max(0, size - 65_557 - 20)
    source.seek(tail_at)
    tail = source.read(size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no ZIP end record")
    n, length, at = struct.unpack_from("<HII", tail, end + 10)
    if (n == 0xFFFF or length == 0xFFFFFFFF or at == 0xFFFFFFFF) and tail[end - 20 : end - 16] == b"PK\x06\x07":
        (end64,) = struct.unpack_from("<Q", tail, end - 12)
        source.seek(end64)
        record64 = source.read(56)
        if record64[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end record")
        n, length, at = struct.unpack_from("<QQQ", record64, 32)
    source.seek(at)
    raw, at, found = source.read(length), 0, []
    for _ in range(n):
        if raw[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, packed, whole, n_name, n_extra, n_comment = struct.unpack_from("<H8xIIHHH", raw, at + 10)
        (header_at,) = struct.unpack_from("<I", raw, at + 42)
        name = raw[at + 46 : at + 46 + n_name].decode()
        extra, x = raw[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while x + 4 <= len(extra):
            kind, n_field = struct.unpack_from("<HH", extra, x)
            if kind == 1:  # the ZIP64 field holds just those values that are full in the entry, in this order
                y = x + 4
                if whole == 0xFFFFFFFF:
                    (whole,), y = struct.unpack_from("<Q", extra, y), y + 8
                if packed == 0xFFFFFFFF:
                    (packed,), y = struct.unpack_from("<Q", extra, y), y + 8
                if header_at == 0xFFFFFFFF:
                    (header_at,) = struct.unpack_from("<Q", extra, y)
            x += 4 + n_field
        found.append(Member(name, method, whole, header_at))
        at += 46 + n_name + n_extra + n_comment
    return found


def data_offset(source, member: Member) -> int:
    """Where a stored member's bytes begin: behind its local header."""
    if member.method:
        raise ValueError(f"{member.name} is compressed; only stored members are read by ranges")
    source.seek(member.header_at)
    head = source.read(30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("no local header")
    return member.header_at + 30 + sum(struct.unpack_from("<HH", head, 26))


def marked(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """(page_id, url, payload, digest, revisit, refers_to) of every page."""
    payload = F.encode(F.coalesce(pages["html"].cast("string"), F.lit("")), "utf-8")
    base = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    thin = base.filter(F.octet_length("payload") >= min_bytes).select("page_id", "digest")
    chosen = thin.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").drop("n")
    # ids of revisits, however many, meet the pages by id, which no group of copies makes uneven
    revisits = thin.distinct().join(stored(chosen, "warc-chosen"), "digest").filter(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    revisits = stored(revisits, "warc-revisits").select(F.col("page_id").alias("i"), F.col("digest").alias("d"), "refers_to")
    joined = base.join(revisits, base["page_id"].eqNullSafe(revisits["i"]) & (base["digest"] == revisits["d"]), "left")
    return joined.select("page_id", "url", "payload", "digest", F.col("d").isNotNull().alias("revisit"), "refers_to")


def write(pages: DataFrame, folder: str | None = None, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """Write packages; returns the manifest (path, n_records, n_bytes)."""
    spark = pages.sparkSession
    folder = folder or scratch(spark, "warc")
    filesystem(folder)[0].create_dir(filesystem(folder)[1], recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, package, k = TaskContext.get(), None, 0
        fs, root = filesystem(folder)

        def finish() -> pa.RecordBatch:
            package.close()
            out.close()
            # each attempt has names of its own: a second one may deal its rows to packages differently, and the manifest
            # holds the packages of the attempt that counts
            name = f"{context.partitionId():06d}-{k:04d}-{context.taskAttemptId()}.zip"
            fs.move(draft, f"{root}/{name}")
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "n_records": [len(package.index)], "n_bytes": [package.at]})

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to", "revisit")]
            for row in zip(*columns, strict=True):
                page_id, url, payload, digest, refers_to, revisit = (x.as_py() for x in row)
                if package is None:
                    draft = f"{root}/.{context.partitionId()}-{k}-{context.taskAttemptId()}"
                    out = fs.open_output_stream(draft)
                    package = Package(out)
                package.add(page_id, record(page_id, url, payload, digest, refers_to, revisit))
                if package.at >= PACKAGE_BYTES:
                    yield finish()
                    package, k = None, k + 1
        if package is not None:
            yield finish()

    return stored(marked(pages, min_bytes).mapInArrow(run, "path string, n_records long, n_bytes long"), "warc-manifest")


def index(manifest: DataFrame) -> DataFrame:
    """(path, at, length) of every record, from the packages' directories and index members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, name = filesystem(path)
                with fs.open_input_file(name) as source:
                    members = {m.name: m for m in directory(source)}
                    base = data_offset(source, members[DATA])
                    source.seek(data_offset(source, members[INDEX]))
                    lines = [json.loads(x) for x in source.read(members[INDEX].size).splitlines()]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(lines)), pa.array([base + x["offset"] for x in lines], pa.int64()), pa.array([x["length"] for x in lines], pa.int64())], names=["path", "at", "length"])

    paths = manifest.select("path").repartition(n_partitions(manifest), "path")
    return paths.mapInArrow(run, "path string, at long, length long")


def read(manifest: DataFrame) -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload) of every record, by range reads.

    The index is dealt out in runs of RANGE_BYTES of a package, so large packages are read by many tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ExitStack() as files:
            opened, source = None, None
            for batch in batches:
                found = []
                for path, at, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if path != opened:
                        files.close()  # one package is open at a time
                        fs, name = filesystem(path)
                        opened, source = path, files.enter_context(fs.open_input_file(name))
                    source.seek(at)
                    found.append(parse(gzip.decompress(source.read(n))))
                yield pa.RecordBatch.from_arrays([
                    pa.array([r.page_id for r in found], pa.int64()), pa.array([r.url for r in found], pa.string()), pa.array([r.kind for r in found], pa.string()),
                    pa.array([r.payload_bytes for r in found], pa.int64()), pa.array([r.digest for r in found], pa.string()), pa.array([r.refers_to for r in found], pa.int64()),
                    pa.array([r.payload if r.kind == "response" else None for r in found], pa.binary()),
                ], names=["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"])

    spread = index(manifest).withColumn("run", F.floor(F.col("at") / RANGE_BYTES)).repartition(n_partitions(manifest), "path", "run").sortWithinPartitions("path", "at").drop("run")
    return spread.mapInArrow(run, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")


ORACLE = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, CASE WHEN payload_bytes >= {MIN_REVISIT} THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS head FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN head = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN head = page_id THEN NULL ELSE head END AS refers_to FROM g"""
