"""Draws that are the same in every run, partitioning and engine: they come from md5 of the key and a seed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unit(*parts: Column | str, seed: int = 42) -> Column:
    """A number from 0 (included) to 1, by the parts' text."""
    text = F.concat_ws(":", *(F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / float(1 << 48)


def unit_sql(*parts: str, seed: int = 42) -> str:
    """The same as SQL."""
    text = "concat_ws(':', " + ", ".join(f"({p})::VARCHAR" for p in parts) + f", '{seed}')"
    return f"(('0x' || substr(md5({text}), 1, 12))::BIGINT / 281474976710656.0::DOUBLE)"
