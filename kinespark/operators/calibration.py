"""Isotonic calibration on Spark: the fit as a lower hull of running sums, its knots as a table, applied by ranges of the score.

The best non-decreasing fit of labels by score has as values the slopes of the greatest convex line below the running sums of
the labels. Hulls of ranges of the score are found side by side, and hulls of neighbouring ranges are joined, FAN at a time,
until one is left. What a task holds is a range of distinct scores, or the corners of FAN hulls.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinespark.functions.ranges import place, range_cuts, running
from kinespark.functions.steps import written

FAN = 16
_CORNERS = "range long, w double, s double, x double, next double, first double"


def corners(w: list[float], s: list[float]) -> list[int]:
    """Places of the corners of the lower hull of points in ascending order of w."""
    kept: list[int] = []
    for k in range(len(w)):
        while len(kept) > 1:
            a, b = kept[-2:]
            if (s[b] - s[a]) * (w[k] - w[b]) < (s[k] - s[b]) * (w[b] - w[a]):
                break
            kept.pop()
        kept.append(k)
    return kept


def knots(df: DataFrame, score: Column, label: Column) -> DataFrame:
    """(x, v): the ends of the stretches of equal value of the fit, in which and between which it is linear."""
    points = df.select(score.cast("double").alias("x"), label.cast("double").alias("y")).filter("x IS NOT NULL AND NOT isnan(x) AND y IS NOT NULL")
    points = written(points.groupBy("x").agg(F.count("*").cast("double").alias("n"), F.sum("y").alias("t")), "score-points")
    cuts = range_cuts(points, "x")[0]
    summed = running(points, [], "x", {"w": "n", "s": "t"}, cuts).select(place(cuts, F.col("x")).cast("long").alias("range"), "x", "w", "s")

    def hull(group: pa.Table) -> pa.Table:
        group = group.sort_by("x")
        x, w, s = (group.column(c).to_pylist() for c in ("x", "w", "s"))
        kept = corners(w, s)
        after = [*x[1:], None]
        n = len(kept)
        return pa.table([pa.array([group.column("range")[0].as_py()] * n, pa.int64()), *(pa.array([c[k] for k in kept], pa.float64()) for c in (w, s, x, after)), pa.array([x[0]] * n)], names=["range", "w", "s", "x", "next", "first"])

    def join(group: pa.Table, over: bool) -> tuple[list, ...]:
        """The corners of neighbouring hulls in order; a range's last corner gets the first score of the range after it."""
        rows = sorted(zip(*(group.column(c).to_pylist() for c in ("w", "s", "x", "next", "first")), strict=True))
        w, s, x, after = ([r[k] for r in rows] for k in range(4))
        first = [r[4] for r in rows]
        for k in range(len(rows) - 1):
            if after[k] is None:
                after[k] = first[k + 1]
        if over:  # the line begins at the origin
            w, s, x, after = [0.0, *w], [0.0, *s], [None, *x], [first[0], *after]
        kept = corners(w, s)
        return tuple([c[k] for k in kept] for c in (w, s, x, after)), first[0]

    def merge(group: pa.Table) -> pa.Table:
        (w, s, x, after), first = join(group, False)
        return pa.table([pa.array([group.column("range")[0].as_py()] * len(w), pa.int64()), *(pa.array(c, pa.float64()) for c in (w, s, x, after)), pa.array([first] * len(w))], names=["range", "w", "s", "x", "next", "first"])

    def close(group: pa.Table) -> pa.Table:
        (w, s, x, after), _ = join(group, True)
        v = np.diff(s) / np.diff(w)
        return pa.table([pa.array([c for pair in zip(after[:-1], x[1:], strict=True) for c in pair], pa.float64()), pa.array(np.repeat(v, 2))], names=["x", "v"])

    hulls, n = summed.groupBy("range").applyInArrow(hull, _CORNERS), len(cuts) + 1
    while n > FAN:
        hulls, n = hulls.withColumn("range", F.floor(F.col("range") / FAN)).groupBy("range").applyInArrow(merge, _CORNERS), -(-n // FAN)
    return written(hulls.withColumn("range", F.lit(0)).groupBy("range").applyInArrow(close, "x double, v double").distinct(), "score-knots")


def interpolated(df: DataFrame, score: Column, fit: DataFrame, into: str, cuts: Sequence[float] | None = None) -> DataFrame:
    """df and into: linear between the knots (x, v), constant beyond them; null without a score or knots.

    Rows and knots meet in ranges, cut by the knots' quantiles where no cuts are given; few knots make few ranges, so
    cuts of the rows are better. Each range also knows the knots next to it. The next knot is the last one of the
    descending order: a frame up to a partition's end is gone through again for every row.
    """
    if cuts is None:
        cuts = range_cuts(fit, "x")[0]
    point = F.struct("x", "v")
    known = fit.select(place(cuts, F.col("x")).alias("_range"), "x", "v")
    whole = df.sparkSession.range(len(cuts) + 1).select(F.col("id").cast("int").alias("_range"))
    each = whole.join(known.groupBy("_range").agg(F.min(point).alias("_least"), F.max(point).alias("_most")), "_range", "left")
    # a row a range, at most as many as there are cuts
    up, down = (Window.partitionBy(F.lit(0)).orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc("_range"), F.desc("_range")))
    ends = each.select("_range", F.last("_most", True).over(up).alias("_before"), F.last("_least", True).over(down).alias("_after"))
    value = score.cast("double")
    rows = df.withColumn("_x", F.when(~F.isnan(value), value)).withColumn("_range", place(cuts, F.col("_x"))).withColumn("_knot", F.lit(None).cast("struct<x:double,v:double>"))
    there = known.select(F.col("x").alias("_x"), "_range", point.alias("_knot"))
    up, down = (Window.partitionBy("_range").orderBy(o).rangeBetween(Window.unboundedPreceding, 0) for o in (F.asc("_x"), F.desc("_x")))
    met = rows.withColumn("_row", F.lit(True)).unionByName(there, allowMissingColumns=True)
    met = met.withColumn("_low", F.last("_knot", True).over(up)).withColumn("_high", F.last("_knot", True).over(down))
    met = met.filter("_row").join(F.broadcast(ends), "_range").withColumn("_low", F.coalesce("_low", "_before")).withColumn("_high", F.coalesce("_high", "_after"))
    lx, lv, hx, hv = (F.col(c) for c in ("_low.x", "_low.v", "_high.x", "_high.v"))
    made = F.when(F.col("_x").isNull(), None).when(lx.isNull(), hv).when(hx.isNull() | (hx == lx), lv).otherwise(lv + (hv - lv) * (F.col("_x") - lx) / (hx - lx))
    return met.withColumn(into, made).select(*df.columns, into)


def isotonic(df: DataFrame, fit: Column, targets: Mapping[str, Column], suffix: str = "_calibrated") -> DataFrame:
    """df with each score column calibrated on the rows that fit, made to sum to 1 over the columns where there are several."""
    out = df
    every = range_cuts(df.select(*(F.col(n).cast("double") for n in targets)), *targets)
    for (name, target), cuts in zip(targets.items(), every, strict=True):
        out = interpolated(out, F.col(name), knots(df.filter(fit), F.col(name), target.cast("double")), name + suffix, cuts)
    if len(targets) == 1:
        return out
    total = sum((F.col(n + suffix) for n in targets), F.lit(0.0))
    return out.withColumns({n + suffix: F.when(total > 0, F.col(n + suffix) / total).otherwise(F.col(n + suffix)) for n in targets})
