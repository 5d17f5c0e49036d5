"""What the training-data operators share: the shared scratch folder, bounded Arrow slices, hashed words.

Words are handled as byte spans of a whole Arrow batch, so the per-word work is NumPy's and no Python object is made for
a word. Spans are told apart by 64-bit hashes of their bytes.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task works on at once; a longer single text is taken alone.
SLICE_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a folder under /tmp in local mode where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file:///tmp/checkpoints"


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_STEPS: ContextVar[list[str] | None] = ContextVar("steps", default=None)


def stored(df: DataFrame, name: str, keep: bool = False, more: Iterable[DataFrame] = ()) -> DataFrame:
    """Write df to the shared folder and read it back: later failures recompute from the files, not from the source.

    more are written after it, one by one, as further rows: each one's shuffle is gone when the next begins. Inside temporary(), the table goes with the others of the block unless it is to be kept; else it goes when the driver
    ends.
    """
    spark = df.sparkSession
    df.write.parquet(path := scratch(spark, name))
    steps = _STEPS.get()
    (_AT_END if keep or steps is None else steps).append(path)
    for other in more:
        other.write.mode("append").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_AT_END: list[str] = []


def delete(paths: list[str]) -> None:
    for path in paths:
        fs, folder = filesystem(path)
        if fs.get_file_info(folder).type != pafs.FileType.NotFound:
            fs.delete_dir(folder)
    paths.clear()


atexit.register(delete, _AT_END)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables that stored() writes in the block are deleted at its end; nothing lazy that reads them may leave it."""
    token = _STEPS.set([])
    try:
        yield
    finally:
        delete(_STEPS.get())
        _STEPS.reset(token)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1) if uri.startswith("file:") else f"file://{uri}")


def n_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of whole rows with at most limit text bytes (or one row), each with its bytes and n + 1 row offsets.

    A null text counts as empty.
    """
    for batch in batches:
        texts = batch.column(column)
        if not pa.types.is_string(texts.type):
            texts = texts.cast(pa.string())
        if texts.null_count:
            texts = texts.fill_null("")
        n = len(texts)
        if not n:
            continue
        bounds = np.frombuffer(texts.buffers()[1], np.int32, n + 1, texts.offset * 4).astype(np.int64)
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at), data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at]
            at = to


_ZSTD = pa.Codec("zstd")


def pack(text: bytes) -> bytes:
    """The text compressed, after its length in 8 bytes: equal texts, equal bytes."""
    return len(text).to_bytes(8, "little") + (_ZSTD.compress(text, asbytes=True) if text else b"")


def unpack(packed: bytes) -> bytes:
    n = int.from_bytes(packed[:8], "little")
    return _ZSTD.decompress(packed[8:], n, asbytes=True) if n else b""


def packed(df: DataFrame, column: str) -> DataFrame:
    """df with a text column compressed, for shuffles and steps on disk; a null stays one."""
    kinds = ", ".join(f"`{f.name}` {'binary' if f.name == column else f.dataType.simpleString()}" for f in df.schema)
    place = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [None if t is None else pack(t) for t in batch.column(column).cast(pa.binary()).to_pylist()]
            yield batch.set_column(place, column, pa.array(made, pa.binary()))

    return df.mapInArrow(run, kinds)


def packed_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows whose packed texts have at most limit bytes unpacked (or one row)."""
    at, held = 0, 0
    for k, text in enumerate(batch.column(column)):
        n = int.from_bytes(text.as_py()[:8], "little")
        if k > at and held + n > limit:
            yield batch.slice(at, k - at)
            at, held = k, 0
        held += n
    if len(batch) > at:
        yield batch.slice(at)


def unpacked_slices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """text_slices of a column of packed texts without nulls."""
    for part in packed_slices(batch.select([column]), column):
        texts = pa.array([unpack(t) for t in part.column(column).to_pylist()], pa.binary()).cast(pa.string())
        yield from text_slices(iter([pa.RecordBatch.from_arrays([texts], names=[column])]), column)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_S29, _S32 = np.uint64(29), np.uint64(32)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of bytes other than space's (0x20 and 0x09-0x0D), and each row's first word (n + 1 bounds)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~space[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    at = np.flatnonzero(starts)
    return at, np.flatnonzero(ends) + 1 - at, np.searchsorted(at, offsets)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _S32)) * _K2
    h ^= h >> _S29
    h *= _K1
    return h ^ (h >> _S32)


def span_hashes(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, eight bytes a step."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    h = lens.astype(np.uint64) * _K1
    live, at, left = None, starts, lens
    while len(at):
        part = eight[at] & _MASKS[np.minimum(left, 8)]
        if live is None:
            h = mixed(h ^ part)
        else:
            h[live] = mixed(h[live] ^ part)
        more = np.flatnonzero(left > 8)
        live = more if live is None else live[more]
        at, left = at[more] + 8, left[more] - 8
    return h


def same_spans(one: np.ndarray, starts: np.ndarray, other: np.ndarray, others: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Whether the bytes of spans of equal lengths agree, eight bytes a step."""

    def eight(data: np.ndarray) -> np.ndarray:
        padded = np.zeros(len(data) + 8, np.uint8)
        padded[: len(data)] = data
        return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))

    a, b = eight(one), eight(other)
    same, live, at = np.ones(len(lens), bool), np.arange(len(lens)), 0
    while len(live):
        differ = ((a[starts[live] + at] ^ b[others[live] + at]) & _MASKS[np.minimum(lens[live] - at, 8)]) != 0
        same[live[differ]] = False
        at += 8
        live = live[~differ & (lens[live] > at)]
    return same


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges [start, start + len)."""
    total = int(lens.sum())
    ends = np.cumsum(lens)
    return np.arange(total) + np.repeat(starts - (ends - lens), lens)


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
