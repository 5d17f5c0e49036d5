"""Table functions for SQL: sliding windows of an array, and of the rows of each trial of a table.

    SELECT t.id, w.* FROM t, LATERAL sliding_windows(t.samples, 200, 100) w
    SELECT * FROM sliding_windows_of(TABLE(samples), 'trial', 'idx', 'value', 200, 100)
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.types import ArrayType, IntegralType, LongType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn


def positive(argument: AnalyzeArgument, name: str) -> None:
    if not argument.isConstantExpression or not isinstance(argument.dataType, IntegralType) or argument.value is None or argument.value < 1:
        raise ValueError(f"{name} must be a whole number of at least 1")


class SlidingWindows:
    """(window_start, window): the whole windows of an array, in order. A null array has none."""

    @staticmethod
    def analyze(values: AnalyzeArgument, length: AnalyzeArgument, step: AnalyzeArgument) -> AnalyzeResult:
        if not isinstance(values.dataType, ArrayType):
            raise ValueError("the first argument must be an array")
        positive(length, "length")
        positive(step, "step")
        return AnalyzeResult(StructType().add("window_start", LongType()).add("window", values.dataType))

    def eval(self, values: list | None, length: int, step: int) -> Iterator[tuple[int, list]]:
        for start in range(0, len(values or []) - length + 1, step):
            yield start, values[start : start + length]


class SlidingWindowsOf:
    """(key, window_start, window) of each trial of a table: rows are dealt out by the key and read in order of the second column.

    A trial is a stream: only a window's rows are held. Rows of a null key are a trial too.
    """

    def __init__(self) -> None:
        self.seen, self.held = 0, deque()

    @staticmethod
    def analyze(rows: AnalyzeArgument, key: AnalyzeArgument, order: AnalyzeArgument, value: AnalyzeArgument, length: AnalyzeArgument, step: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("the first argument must be TABLE(...)")
        for argument in (key, order, value):
            if not argument.isConstantExpression or argument.value not in rows.dataType.names:
                raise ValueError("key, order and value must name columns of the table")
        positive(length, "length")
        positive(step, "step")
        made = StructType().add(key.value, rows.dataType[key.value].dataType).add("window_start", LongType()).add("window", ArrayType(rows.dataType[value.value].dataType))
        return AnalyzeResult(made, partitionBy=[PartitioningColumn(key.value)], orderBy=[OrderingColumn(order.value)])

    def eval(self, rows: Row, key: str, order: str, value: str, length: int, step: int) -> Iterator[tuple[object, int, list]]:
        self.held.append(rows[value])
        self.seen += 1
        if len(self.held) > length:
            self.held.popleft()
        if self.seen >= length and (self.seen - length) % step == 0:
            yield rows[key], self.seen - length, list(self.held)


def register(spark: SparkSession) -> None:
    """Make sliding_windows and sliding_windows_of known to the session's SQL."""
    from pyspark.sql.functions import udtf

    spark.udtf.register("sliding_windows", udtf(SlidingWindows))
    spark.udtf.register("sliding_windows_of", udtf(SlidingWindowsOf))
