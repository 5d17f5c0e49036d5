"""Running totals in a global order without one task for all: ranges of the order, then a window inside each."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinespark.functions.steps import written

#: Ranges that an order is cut into at most; the cuts are one expression.
MOST = 256


def place(cuts: Sequence[float], value: Column) -> Column:
    """The number of cuts at or below value, by halving."""

    def half(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(value < F.lit(cuts[mid]), half(low, mid)).otherwise(half(mid + 1, high))

    return half(0, len(cuts))


def same(keys: Sequence[str], prefix: str) -> Column:
    """Equality of keys with those of a table whose columns carry a prefix; nulls are equal."""
    return reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"{prefix}{k}")) for k in keys), F.lit(True))


def range_cuts(df: DataFrame, *orders: str) -> list[list[float]]:
    """The quantiles that cut each order into ranges, of all orders in one pass."""
    parts = min(MOST, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = df.approxQuantile(list(orders), [k / parts for k in range(1, parts)], 0.25 / parts)
    return [sorted(set(cuts)) for cuts in found]


def running(df: DataFrame, keys: Sequence[str], order: str, totals: Mapping[str, str], cuts: Sequence[float] | None = None, least: bool = False, backward: bool = False) -> DataFrame:
    """df with running totals {into: value} by keys in ascending numeric order, each row included.

    The order's quantiles cut it into ranges. Totals of ranges are summed over a row a key and range, and windows run
    inside a range. Rows of one key and equal order are no group of their own: count them first where they are many.
    Without cuts, df is written first and the cuts are taken from there, so that its lineage runs once. Cuts that are known
    already can be given; none at all ([]) where keys have few rows each. least takes minima instead of sums, backward the
    descending order.
    """
    if cuts is None:
        df = written(df, "running")
        cuts = range_cuts(df, order)[0]
    total, along = (F.min if least else F.sum), (lambda c: F.col(c).desc() if backward else F.col(c).asc())
    if not cuts:
        whole = Window.partitionBy(*keys).orderBy(along(order)).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({into: total(v).over(whole) for into, v in totals.items()})
    ranged = df.withColumn("_range", place(cuts, F.col(order)))
    here = [*keys, "_range"]
    sums = ranged.groupBy(*here).agg(*(total(v).alias(f"_sum_{into}") for into, v in totals.items()))
    earlier = Window.partitionBy(*keys).orderBy(along("_range")).rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*(F.col(k).alias(f"_of_{k}") for k in here), *(total(f"_sum_{into}").over(earlier).alias(f"_before_{into}") for into in totals))
    inside = Window.partitionBy(*here).orderBy(along(order)).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.withColumns({f"_in_{into}": total(v).over(inside) for into, v in totals.items()})
    joined = summed.join(before, same(here, "_of_"))
    both = lambda into: F.least(f"_in_{into}", f"_before_{into}") if least else F.col(f"_in_{into}") + F.coalesce(f"_before_{into}", F.lit(0))
    return joined.select(*df.columns, *(both(into).alias(into) for into in totals))
