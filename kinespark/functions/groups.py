"""Small groups as a sorted stream of each task: a grouped function costs some milliseconds a group, a slice of a batch hardly any."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


def changes(table: pa.Table) -> np.ndarray:
    """Whether each row but the first differs from the one before it; nulls are equal."""
    out = np.zeros(max(0, table.num_rows - 1), bool)
    for column in table.columns:
        a, b = column[1:], column[:-1]
        out |= pc.fill_null(pc.not_equal(a, b), False).to_numpy() | (a.is_null().to_numpy() != b.is_null().to_numpy())
    return out


def values(column: pa.ChunkedArray) -> np.ndarray:
    """A column as an array, a column of lists of one length as a matrix, of several as rows; null numbers are NaN."""
    whole = column.combine_chunks()
    if pa.types.is_list(whole.type):
        flat, sizes = whole.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(whole).to_numpy(zero_copy_only=False)
        if len(sizes) and (sizes == sizes[0]).all():
            return flat.reshape(len(whole), -1)
        rows = np.empty(len(whole), object)
        rows[:] = np.split(flat, np.cumsum(sizes)[:-1])
        return rows
    return whole.to_numpy(zero_copy_only=False)


def streamed(df: DataFrame, keys: Sequence[str], order: Sequence[str], run: Callable[[Mapping[str, np.ndarray]], Mapping[str, np.ndarray]], schema: str) -> DataFrame:
    """(keys, run's columns): run on the other columns of each group of keys, its rows in order.

    A task holds the groups of a batch of rows, and a group that goes on over batches.
    """
    first = schema.strip().split(" ")[0]

    def each(columns: Mapping[str, np.ndarray], bounds: np.ndarray) -> tuple[Mapping[str, np.ndarray], np.ndarray]:
        found = [run({c: v[a:b] for c, v in columns.items()}) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return {c: np.concatenate([f[c] for f in found]) for c in found[0]}, np.array([len(f[first]) for f in found])

    return streamed_together(df, keys, order, each, schema)


def streamed_together(df: DataFrame, keys: Sequence[str], order: Sequence[str], run: Callable[[Mapping[str, np.ndarray], np.ndarray], tuple[Mapping[str, np.ndarray], np.ndarray]], schema: str) -> DataFrame:
    """As streamed(), but run gets the columns of several groups and their n + 1 bounds, and gives their rows and how many each has."""
    names, rest = list(keys), [c for c in df.columns if c not in keys]
    made = [c.strip().split(" ")[0] for c in schema.split(",")]
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in names)

    def groups(parts: list[pa.RecordBatch], starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts)
        found, sizes = run({c: values(table.column(c)) for c in rest}, np.append(starts, table.num_rows))
        own = table.select(names).take(pa.array(np.repeat(starts, sizes)))
        yield from pa.table([*own.columns, *(pa.array(found[c]) for c in made)], names=[*names, *made]).combine_chunks().to_batches()

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            last = [held[-1].slice(held[-1].num_rows - 1)] if held else []
            starts = np.flatnonzero(changes(pa.Table.from_batches([*last, batch]).select(names))) + (not held)
            if not held:
                starts = np.r_[0, starts]
            if not len(starts):
                held.append(batch)
                continue
            if held:
                yield from groups([*held, batch.slice(0, starts[0])] if starts[0] else held, np.zeros(1, np.int64))
            if len(starts) > 1:
                yield from groups([batch.slice(starts[0], starts[-1] - starts[0])], starts[:-1] - starts[0])
            held = [batch.slice(starts[-1])]
        if held:
            yield from groups(held, np.zeros(1, np.int64))

    return df.repartition(*names).sortWithinPartitions(*names, *order).mapInArrow(stream, f"{kinds}, {schema}")
