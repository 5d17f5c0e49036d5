"""Intermediate tables in the folder that all executors share, so a lost executor costs a reading and not a recomputation."""

from __future__ import annotations

import atexit
import uuid
from contextlib import suppress

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

_AT_END: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode where that is unset, a folder under /tmp."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file:///tmp/checkpoints"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df, written to the shared folder (with the writer's options) and read from there. The table is deleted when the driver ends."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _AT_END.append(path)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def store_of(path: str) -> tuple[pafs.FileSystem, str]:
    """The store that a path lies in, and the path there."""
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")


@atexit.register
def clear() -> None:
    """Delete the tables of this driver, where pyarrow reaches their store."""
    for path in _AT_END:
        with suppress(OSError, pa.ArrowInvalid):
            store, folder = store_of(path)
            if store.get_file_info(folder).type != pafs.FileType.NotFound:
                store.delete_dir(folder)
    _AT_END.clear()
