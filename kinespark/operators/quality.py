"""Data-quality operators on sample tables: gaps of counters and clocks, missing values, domains, lengths.

Every operator takes the columns it works on by name. Windows are by trial, so each trial is ordered by itself.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A counter of 16 bits may wrap: from at least WRAP_HIGH to at most WRAP_LOW. Fixed values.
WRAP_HIGH, WRAP_LOW = 60000, 1000


def finite(c: Column) -> Column:
    """NaN and infinities as null: aggregates then skip them."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def counter_gaps(df: DataFrame, keys: Sequence[str], order: Sequence[str], counter: str) -> DataFrame:
    """Steps of the counter other than 1 that are no wrap: (keys, idx, prev, next, diff)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    steps = df.select(*keys, (F.row_number().over(w) - 1).alias("idx"), F.lag(counter).over(w).cast("long").alias("prev"), F.col(counter).cast("long").alias("next"))
    steps = steps.withColumn("diff", F.col("next") - F.col("prev"))
    wrap = (F.col("prev") >= WRAP_HIGH) & (F.col("next") <= WRAP_LOW)
    return steps.filter((F.col("diff") != 1) & ~wrap)


def gap_summary(gaps: DataFrame, keys: Sequence[str]) -> DataFrame:
    return gaps.groupBy(*keys).agg(F.count("*").alias("n_gaps"), F.max("diff").alias("max_gap"), F.array_join(F.array_sort(F.collect_list("idx")), ",").alias("at"))


def repair_gaps(df: DataFrame, keys: Sequence[str], order: Sequence[str], counter: str, value: str, max_gap: int) -> DataFrame:
    """Fill gaps of at most max_gap steps by straight lines, up to the first larger gap of a trial: (keys, place, counter, value, filled).

    Rows stay in their order, so a counter that wraps goes on. Of consecutive rows with one counter the first stays. The repair
    ends at a larger gap or a step back that is no wrap; rows from there on stay as they are. place is the row's number and,
    for a filled row, a fraction more.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    x = df.select(*keys, *[c for c in order if c not in keys], F.col(counter).cast("long").alias("_c"), F.col(value).cast("double").alias("_v"))
    x = x.withColumn("_at", (F.row_number().over(w) - 1).cast("long")).withColumn("_before", F.lag("_c").over(w)).withColumn("_step", F.col("_c") - F.col("_before"))
    wrap = (F.col("_step") < 0) & (F.col("_before") >= WRAP_HIGH) & (F.col("_c") <= WRAP_LOW)
    ends = F.coalesce((F.col("_step") > max_gap) | ((F.col("_step") < 0) & ~wrap), F.lit(False)).cast("int")
    x = x.withColumn("_ended", F.max(ends).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.filter((F.col("_ended") == 1) | F.col("_step").isNull() | (F.col("_step") != 0))
    # a row brings the rows that are missing before it; the kept row before it is the first of its counter
    x = x.withColumn("_from", F.lag("_v").over(w)).withColumn("_place", F.lag("_at").over(w))
    missing = F.when((F.col("_ended") == 0) & (F.col("_step") > 1), F.sequence(F.lit(1).cast("long"), F.col("_step") - 1)).otherwise(F.array().cast("array<long>"))
    spread = x.withColumn("_k", F.explode(F.concat(F.array(F.lit(0).cast("long")), missing)))
    share = F.col("_k") / F.col("_step")
    own = F.col("_k") == 0
    return spread.select(
        *keys, F.when(own, F.col("_at").cast("double")).otherwise(F.col("_place") + share).alias("place"), F.when(own, F.col("_c")).otherwise(F.col("_before") + F.col("_k")).alias("counter"),
        F.when(own, F.col("_v")).otherwise((1 - share) * F.col("_from") + share * F.col("_v")).alias("value"), (~own).alias("filled"),
    )


def truncate_at_gap(df: DataFrame, keys: Sequence[str], order: Sequence[str], counter: str, max_gap: int) -> DataFrame:
    """Rows before a trial's first gap of more than max_gap."""
    w = Window.partitionBy(*keys).orderBy(*order)
    large = (F.col(counter) - F.lag(counter).over(w) > max_gap).cast("int")
    marked = df.withColumn("_large", F.coalesce(large, F.lit(0)))
    return marked.withColumn("_after", F.max("_large").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("_after = 0").drop("_large", "_after")


def clock_check(df: DataFrame, keys: Sequence[str], order: Sequence[str], seconds: Column, limit: float) -> DataFrame:
    """One row a trial: status, how many steps exceed the limit or go back, and the place of the first."""
    w = Window.partitionBy(*keys).orderBy(*order)
    steps = df.select(*keys, (F.row_number().over(w) - 1).alias("idx"), seconds.alias("s"), F.lag(seconds).over(w).alias("before"))
    bad = (F.col("s") - F.col("before") > limit) | (F.col("s") < F.col("before"))
    return steps.groupBy(*keys).agg(F.count_if(bad).alias("n_bad"), F.min(F.when(bad, F.col("idx"))).alias("first_bad")).withColumn("status", F.when(F.col("n_bad") > 0, "fail").otherwise("pass"))


def interpolate(df: DataFrame, keys: Sequence[str], position: str, value: str, into: str) -> DataFrame:
    """Missing values by straight lines inside a trial; edges take the nearest known value."""
    before = Window.partitionBy(*keys).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*keys).orderBy(F.desc(position)).rowsBetween(Window.unboundedPreceding, 0)
    at = F.when(F.col(value).isNotNull(), F.col(position))
    out = df.withColumn("_a", F.last(value, True).over(before)).withColumn("_ia", F.last(at, True).over(before)).withColumn("_b", F.last(value, True).over(after)).withColumn("_ib", F.last(at, True).over(after))
    line = F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col(position) - F.col("_ia")) / (F.col("_ib") - F.col("_ia"))
    return out.withColumn(into, F.when(F.col(value).isNotNull(), F.col(value)).otherwise(F.coalesce(line, "_a", "_b"))).drop("_a", "_ia", "_b", "_ib")


def fill_back_then_forward(df: DataFrame, keys: Sequence[str], position: str, value: str, into: str) -> DataFrame:
    before = Window.partitionBy(*keys).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*keys).orderBy(F.desc(position)).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(into, F.coalesce(F.last(value, True).over(after), F.last(value, True).over(before))).filter(F.col(into).isNotNull())


def missing_fractions(df: DataFrame, columns: Sequence[str], threshold: float) -> DataFrame:
    """(feature, fraction, above) of the columns, in one pass."""
    one = df.agg(*(F.avg(F.when(F.col(c).isNull(), 1.0).otherwise(0.0)).alias(c) for c in columns))
    return one.unpivot([], list(columns), "feature", "fraction").withColumn("above", F.col("fraction") > threshold)


def missing_by_group(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """(group, feature, fraction) for each group and, as "all", for all rows."""
    long = df.unpivot([group], [F.col(c).cast("double").alias(c) for c in columns], "feature", "value")
    return long.rollup("feature", group).agg(F.avg(F.when(F.col("value").isNull(), 1.0).otherwise(0.0)).alias("fraction"), F.grouping(group).alias("g")).filter("feature is not null").select(F.when(F.col("g") == 1, "all").otherwise(F.col(group).cast("string")).alias("scope"), "feature", "fraction")


def drop_segments(df: DataFrame, keys: Sequence[str], bad: Column, most: float) -> DataFrame:
    """Rows of the segments whose share of bad rows is at most `most`."""
    keep = df.groupBy(*keys).agg(F.avg(bad.cast("int")).alias("_share")).filter(F.col("_share") <= most).select(*keys)
    return df.join(keep, list(keys), "left_semi")


def length_check(df: DataFrame, trial: str, part: str, rows: int, fraction: float) -> DataFrame:
    """(trial, spread, allowed, status): the parts' lengths differ by at most max(rows, fraction of their median)."""
    sizes = df.groupBy(trial, part).agg(F.count("*").alias("n"))
    stats = sizes.groupBy(trial).agg((F.max("n") - F.min("n")).alias("spread"), F.greatest(F.lit(float(rows)), F.expr("percentile(n, 0.5)") * fraction).alias("allowed"))
    return stats.withColumn("status", F.when(F.col("spread") <= F.col("allowed"), "pass").otherwise("fail"))


def domain_check(df: DataFrame, keys: Sequence[str], label: str, allowed: Sequence[str]) -> DataFrame:
    """(keys, unknown, n_null, status): labels outside the allowed ones, joined by commas."""
    seen = df.groupBy(*keys).agg(F.array_sort(F.array_except(F.collect_set(label), F.array(*map(F.lit, allowed)))).alias("u"), F.count_if(F.col(label).isNull()).alias("n_null"))
    return seen.select(*keys, F.array_join("u", ",").alias("unknown"), "n_null", F.when((F.size("u") > 0) | (F.col("n_null") > 0), "fail").otherwise("pass").alias("status"))


def missing_parts(df: DataFrame, keys: Sequence[str], part: str, required: Sequence[str]) -> DataFrame:
    """(keys, present, missing, complete) against the required parts."""
    have = df.groupBy(*keys).agg(F.collect_set(part).alias("h"))
    lost = F.array_except(F.array(*map(F.lit, sorted(required))), "h")
    return have.select(*keys, F.array_join(F.array_sort("h"), " ").alias("present"), F.array_join(lost, " ").alias("missing"), (F.size(lost) == 0).alias("complete"))


def assert_no_targets(columns: Sequence[str], forbidden: Sequence[str]) -> None:
    """Refuse feature tables that hold a label or a proxy of one."""
    if found := sorted({c for c in columns for f in forbidden if c.lower() == f or c.lower().startswith(f"{f}_")}):
        raise ValueError(f"target columns among the features: {', '.join(found)}")


def assert_schema(df: DataFrame, columns: Sequence[str]) -> None:
    if list(df.columns) != list(columns):
        raise ValueError(f"columns differ from those of training: missing {sorted(set(columns) - set(df.columns))}, new {sorted(set(df.columns) - set(columns))}")


def assert_disjoint(splits: DataFrame, ident: str, role: str) -> None:
    """No id has two roles."""
    if not splits.groupBy(ident).agg(F.count_distinct(role).alias("n")).filter("n > 1").isEmpty():
        raise ValueError(f"an {ident} is in two splits")


def gate(report: DataFrame, most: int = 10) -> None:
    """Raise with the first failures of a report (trial, check, status)."""
    if failed := report.filter("status = 'fail'").select("trial", "check").distinct().orderBy("trial", "check").limit(most).collect():
        raise ValueError("failed checks: " + "; ".join(f"{r.trial}/{r.check}" for r in failed))


def threshold_guard(df: DataFrame, keys: Sequence[str], score: str, fit: Column, held: Column, share: float) -> DataFrame:
    """(keys, threshold, stable): a percentile of the rows that fit, and whether it stays when held-out scores change."""
    cut = lambda c: F.percentile(F.when(fit, c), share)
    both = df.groupBy(*keys).agg(cut(F.col(score)).alias("threshold"), cut(F.when(held, F.col(score) * 1000 + 1).otherwise(F.col(score))).alias("_other"))
    return both.withColumn("stable", F.col("threshold").eqNullSafe(F.col("_other"))).drop("_other")


def assert_upload(df: DataFrame, name: str, most_columns: int = 100, most_rows: int = 100_000) -> None:
    """Refuse an uploaded table that is empty, too wide, too long or has columns of odd names. Counting stops at the limit."""
    if bad := [c for c in df.columns if not re.fullmatch(r"[A-Za-z0-9_.\- ]{1,64}", c.strip())]:
        raise ValueError(f"{name}: columns of odd names: {bad[:3]}")
    if len(df.columns) > most_columns:
        raise ValueError(f"{name}: more than {most_columns} columns")
    n = df.limit(most_rows + 1).count()
    if not 0 < n <= most_rows:
        raise ValueError(f"{name}: {'no' if not n else f'more than {most_rows}'} rows")
