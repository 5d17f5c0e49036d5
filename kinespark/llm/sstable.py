"""Token ids in sorted-string-table shards, one file a range partition, documents in ascending order of their ids.

Shard layout (all integers little-endian unless said otherwise):
  data blocks    zstd of entries: varint shared, varint unshared, varint value bytes, key suffix, value. A key is cut to
                 what differs from the key before it; every RESTART-th entry and each block begin with a whole key.
  Bloom filter   bits of all keys
  block index    for each block: last key (length-prefixed), offset, length, entries
  footer         fixed size: offsets and lengths of index and filter, counts, hashes a key, id width, magic

A key is the id as 8 bytes, big-endian, sign bit flipped, so byte order is number order; a null id is the empty key and
comes first. Equal ids stay beside each other, ordered by text. Values are ids of 2 bytes where the vocabulary allows,
else 4. A shard is written under a name of its attempt and renamed when whole, so a lost executor leaves no half file.

Null or empty texts hold only the end id; an empty table gives no shard; repeated rows are entries of their own; a long text is
one value, in a block of its own size; other columns are left out, whatever their names.
"""

from __future__ import annotations

import json
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinespark.llm.bpe import PieceEncoder
from kinespark.llm.common import filesystem, scratch, stored, text_or_empty, text_slices

BLOCK_BYTES, SHARD_BYTES, RESTART, MAGIC = 64 << 10, 256 << 20, 16, b"KSSTTOK1"
FOOTER = struct.Struct("<QQQQQQBB6x8s")


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def varint(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        byte = data[at]
        at += 1
        n |= (byte & 0x7F) << shift
        if byte < 0x80:
            return n, at
        shift += 7


def key_hashes(key: bytes) -> tuple[int, int]:
    """Two independent halves of a hash, the second odd."""
    a, b = divmod(xxhash.xxh3_128_intdigest(key), 1 << 64)
    return a, b | 1


def bloom_places(key: bytes, hashes: int, bits: int) -> list[int]:
    a, b = key_hashes(key)
    return [(a + k * b) % bits for k in range(hashes)]


class Writer:
    """Writes one shard; keys must come in ascending order."""

    def __init__(self, out, width: int, level: int = 1):
        self.out, self.width, self.pack = out, width, zstandard.ZstdCompressor(level=level)
        self.at = self.entries = self.ids = 0
        self.index: list[tuple[bytes, int, int, int]] = []
        self.hashes = array("Q")  # 16 bytes a key
        self.begin()

    def begin(self) -> None:
        self.block, self.size, self.n, self.last = [], 0, 0, b""

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.n % RESTART:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        head = varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:]
        self.block += (head, value)
        self.size += len(head) + len(value)
        self.n += 1
        self.last = key
        self.hashes.extend(key_hashes(key))
        self.entries += 1
        self.ids += len(value) // self.width
        if self.size >= BLOCK_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.n:
            data = self.pack.compress(b"".join(self.block))
            self.out.write(data)
            self.index.append((self.last, self.at, len(data), self.n))
            self.at += len(data)
            self.begin()

    def close(self, bits_a_key: int = 10, hashes: int = 7) -> None:
        self.flush()
        bits = max(64, bits_a_key * self.entries) + 7 & ~7
        bloom = np.zeros(bits // 8, np.uint8)
        a, b = np.frombuffer(self.hashes, np.uint64).reshape(-1, 2).T % np.uint64(bits)
        for k in range(hashes):
            p = (a + np.uint64(k) * b) % np.uint64(bits)
            np.bitwise_or.at(bloom, (p >> np.uint64(3)).astype(np.int64), np.uint8(1) << (p & np.uint64(7)).astype(np.uint8))
        packed = bloom.tobytes()
        index = b"".join(varint(len(k)) + k + struct.pack("<QQQ", a, n, e) for k, a, n, e in self.index)
        self.out.write(packed + index)
        self.out.write(FOOTER.pack(self.at, len(packed), self.at + len(packed), len(index), self.entries, self.ids, hashes, self.width, MAGIC))


class Reader:
    """Reads one shard by ranges: the footer, the index and the filter at once, blocks as they are asked for."""

    def __init__(self, source):
        self.source = source
        self.bloom_at, n_bloom, index_at, n_index, self.entries, self.ids, self.hashes, self.width, magic = FOOTER.unpack(self.range(source.size() - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("no token shard")
        self.bloom, index, at = self.range(self.bloom_at, n_bloom), self.range(index_at, n_index), 0
        self.index: list[tuple[bytes, int, int, int]] = []
        while at < len(index):
            n, at = read_varint(index, at)
            self.index.append((index[at : at + n], *struct.unpack_from("<QQQ", index, at + n)))
            at += n + 24

    def range(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def block(self, k: int) -> Iterator[tuple[bytes, bytes]]:
        _, at, n, _ = self.index[k]
        data, at, key = zstandard.ZstdDecompressor().decompressobj().decompress(self.range(at, n)), 0, b""
        while at < len(data):
            shared, at = read_varint(data, at)
            rest, at = read_varint(data, at)
            size, at = read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, data[at : at + size]
            at += size

    def values(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for k in range(len(self.index)):
            for key, value in self.block(k):
                yield id_of(key), np.frombuffer(value, f"<u{self.width}")

    def lookup(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every document of that id: filter, binary search of the sparse index, then the blocks in question."""
        key = key_of(doc_id)
        if any(not self.bloom[p >> 3] >> (p & 7) & 1 for p in bloom_places(key, self.hashes, 8 * len(self.bloom))):
            return []
        low, high = 0, len(self.index)
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if self.index[mid][0] < key else (low, mid)
        found: list[np.ndarray] = []
        while low < len(self.index):
            here = list(self.block(low))
            found += [np.frombuffer(v, f"<u{self.width}") for k, v in here if k == key]
            if here[-1][0] > key:
                break
            low += 1
        return found


_CODERS: dict[tuple[str, bool], PieceEncoder] = {}


def coder(path: str, special_as_text: bool = False) -> PieceEncoder:
    """The library's ids of a text's pieces. Special tokens' strings are their tokens, or ordinary text if asked for.

    Added tokens that take in white space around them can't be found in pieces; with such, texts are encoded whole.
    """
    if (path, special_as_text) not in _CODERS:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = special_as_text
        wide = any(t.lstrip or t.rstrip or t.single_word or t.content.split() != [t.content] for t in tokenizer.get_added_tokens_decoder().values())
        _CODERS[path, special_as_text] = PieceEncoder(lambda texts: [x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)], cuts=not wide)
    return _CODERS[path, special_as_text]


def vocabulary(path: str) -> int:
    with open(path) as f:
        return max(json.load(f)["model"]["vocab"].values()) + 1


def write_shards(docs: DataFrame, tokenizer: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, special_as_text: bool = False) -> DataFrame:
    """Encode the texts and write the shards under folder; returns the manifest (shard, path, n_docs, n_ids).

    Texts are range-partitioned by id and sorted within partitions; rows of one id (or none) are also cut by their texts'
    beginnings. A single text moves once. A partition's shard ends at SHARD_BYTES and another begins, so what a task holds
    (a block, the index, 16 bytes a key) is bounded however few partitions there are.
    """
    spark = docs.sparkSession
    folder = folder or scratch(spark, "sst")
    filesystem(folder)[0].create_dir(filesystem(folder)[1], recursive=True)
    width = 2 if vocabulary(tokenizer) <= 1 << 16 else 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, writer, encode, k = TaskContext.get(), None, coder(tokenizer, special_as_text), 0
        fs, root = filesystem(folder)
        draft = f"{root}/.{context.partitionId()}-{context.taskAttemptId()}"

        def finish() -> pa.RecordBatch:
            writer.close()
            out.close()
            name = f"{context.partitionId():08d}-{k:06d}.sst"
            fs.move(draft, f"{root}/{name}")
            return pa.RecordBatch.from_pydict({"shard": [context.partitionId() << 32 | k], "path": [f"{folder}/{name}"], "n_docs": [writer.entries], "n_ids": [writer.ids]})

        for part, data, offsets in text_slices(batches, "__text"):
            ids, bounds = encode(data, offsets)
            raw, end = ids.astype(f"<u{width}").tobytes(), end_id.to_bytes(width, "little")
            for doc_id, a, b in zip(part.column("__id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if writer is None:
                    out = fs.open_output_stream(draft)
                    writer = Writer(out, width)
                writer.add(key_of(doc_id), raw[width * a : width * b] + end)
                if writer.at + writer.size >= SHARD_BYTES:
                    yield finish()
                    writer, k = None, k + 1
        if writer is not None:
            yield finish()

    ordered = docs.select(docs[id_col].cast("long").alias("__id"), text_or_empty(text_col).alias("__text")).repartitionByRange("__id", F.substring("__text", 1, 64)).sortWithinPartitions("__id", "__text")
    return stored(ordered.mapInArrow(run, "shard long, path string, n_docs long, n_ids long"), "sst-manifest")


def read_shards(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every stored document, from the files.

    start counts the ids of all documents before it. The driver sees the manifest alone: a row a shard.
    """
    spark, start, rows = manifest.sparkSession, 0, []
    for shard in sorted(manifest.collect()):
        rows.append((shard.path, start))
        start += shard.n_ids
    todo = spark.createDataFrame(rows, "path string, start long").repartition(max(1, len(rows)), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, name = filesystem(path)
                with fs.open_input_file(name) as source:
                    found = {"id": [], "start": [], "n_tokens": [], "ids_crc32": []}
                    for doc_id, ids in Reader(source).values():
                        for column, value in zip(found.values(), (doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())), strict=True):
                            column.append(value)
                        start += len(ids)
                        if len(found["id"]) >= 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found.values()], names=list(found))
                            found = {k: [] for k in found}
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found.values()], names=list(found))

    return todo.mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id_col)


def lookup(manifest: DataFrame, doc_id: int | None) -> list[np.ndarray]:
    """A document's ids by binary search in the shards, on the driver: it reads footers, filters and a block or two."""
    found = []
    for shard in sorted(manifest.collect()):
        fs, name = filesystem(shard.path)
        with fs.open_input_file(name) as source:
            found += Reader(source).lookup(doc_id)
    return found
