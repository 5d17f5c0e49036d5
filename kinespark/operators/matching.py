"""Detected events against true ones: one-to-one matching within a tolerance, and its summaries."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from kinespark.functions import quantiles
from kinespark.functions.steps import written


def match_events(detected: DataFrame, truth: DataFrame, keys: Sequence[str], at: str, tolerance: int) -> DataFrame:
    """(keys, tp, fp, fn, n_detected, n_truth, error) by greedy matching: each true event, in order, takes the nearest free detected one.

    Events that are further apart than the tolerance from all before them begin a new cluster, and no match crosses clusters.
    All events are sorted in ranges of (keys, time) and read as a stream, cluster by cluster. The first and the last cluster
    of a range may go on in its neighbours; these alone are dealt out again, by keys. error is the sum of the matches'
    distances; events without a time belong nowhere.
    """
    names = list(keys)
    both = detected.select(*names, F.col(at).cast("long").alias("_at"), F.lit(False).alias("_true")).unionByName(truth.select(*names, F.col(at).cast("long").alias("_at"), F.lit(True).alias("_true"))).filter("_at IS NOT NULL")
    kinds = ", ".join(f"{k} {detected.schema[k].dataType.simpleString()}" for k in names)
    counts = ("tp", "n_detected", "n_truth", "error")
    schema = f"{kinds}, _at long, _true boolean, " + ", ".join(f"{c} long" for c in counts)

    def reading(whole: bool):
        """Counts a trial of the clusters that lie inside the range; events of others as they came, unless the range is whole."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, cluster, sums, edge = None, [], [0, 0, 0, 0], not whole
            for batch in batches:
                rows = []
                trials = zip(*(batch.column(k).to_pylist() for k in names), strict=True)
                for trial, time, true in zip(trials, batch.column("_at").to_pylist(), batch.column("_true").to_pylist(), strict=True):
                    if cluster and (trial != key or time - cluster[-1][0] > tolerance):
                        if edge:
                            rows += [(*key, *event, None, None, None, None) for event in cluster]
                            edge = False
                        else:
                            sums = [a + b for a, b in zip(sums, greedy(cluster, tolerance), strict=True)]
                        cluster = []
                    if trial != key:
                        if key is not None and any(sums):
                            rows.append((*key, None, None, *sums))
                        key, sums = trial, [0, 0, 0, 0]
                    cluster.append((time, true))
                yield rows_of(rows)
            rows = []
            if cluster and whole:
                sums = [a + b for a, b in zip(sums, greedy(cluster, tolerance), strict=True)]
            elif cluster:
                rows = [(*key, *event, None, None, None, None) for event in cluster]
            if key is not None and any(sums):
                rows.append((*key, None, None, *sums))
            yield rows_of(rows)

        return run

    types = to_arrow_schema(StructType.fromDDL(schema))

    def rows_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, types, strict=True)], schema=types)

    order = [*names, "_at", "_true"]
    read = written(both.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(reading(False), schema), "event-matches")
    again = read.filter("_at IS NOT NULL").select(*order).repartition(*names).sortWithinPartitions(*order).mapInArrow(reading(True), schema)
    whole = read.filter("_at IS NULL").unionByName(again).groupBy(*names).agg(*(F.sum(c).alias(c) for c in counts))
    return whole.select(*names, "tp", (F.col("n_detected") - F.col("tp")).alias("fp"), (F.col("n_truth") - F.col("tp")).alias("fn"), "n_detected", "n_truth", "error")


def greedy(cluster: list[tuple[int, bool]], tolerance: int) -> tuple[int, int, int, int]:
    """(matches, detected, true, sum of distances) of a cluster of (time, true) in order of time; of equally near ones the earlier is taken."""
    free = [t for t, true in cluster if not true]
    n_true = len(cluster) - len(free)
    if not free or not n_true:
        return 0, len(free), n_true, 0
    used, n, error = [False] * len(free), 0, 0
    for t, true in cluster:
        if true:
            near = [(abs(free[k] - t), k) for k in range(bisect_left(free, t - tolerance), bisect_right(free, t + tolerance)) if not used[k]]
            if near:
                distance, k = min(near)
                used[k], n, error = True, n + 1, error + distance
    return n, len(free), n_true, error


def f_scores(counts: DataFrame) -> DataFrame:
    """counts with precision, recall and f1; null where there is nothing to divide by."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    both = lambda a, b: F.when(a + b > 0, 2 * a * b / (a + b))
    return counts.withColumn("precision", F.try_divide(tp, tp + fp)).withColumn("recall", F.try_divide(tp, tp + fn)).withColumn("f1", both(F.col("precision"), F.col("recall")))


def detection_summary(matches: DataFrame, sets: Sequence[Sequence[str]], trial: str) -> DataFrame:
    """Sums and scores for each of the grouping sets; a key that a set leaves out reads "both" (or "all" for the first set's)."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    parts = []
    for s in sets:
        g = matches.groupBy(*s).agg(F.count_distinct(trial).alias("n_trials"), *(F.sum(c).alias(c) for c in ("tp", "fp", "fn", "n_detected", "n_truth", "error")))
        parts.append(g.select(*((F.col(k).cast("string") if k in s else F.lit("both")).alias(k) for k in keys), *(c for c in g.columns if c not in s)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return f_scores(out).withColumn("mean_error", F.try_divide("error", "tp")).drop("error")


def tuned_percentile(scores: DataFrame, cohort: str, percentile: str, f1: str) -> DataFrame:
    """(cohort, percentile, mean_f1): the one with the best mean, the lowest on ties; trials without a score don't count."""
    means = scores.filter(F.col(f1).isNotNull()).groupBy(cohort, percentile).agg(F.round(F.avg(f1), 12).alias("m"))
    best = F.max(F.struct("m", (-F.col(percentile)).alias("p")))
    return means.groupBy(cohort).agg(best.alias("b")).select(cohort, (-F.col("b.p")).alias(percentile), F.col("b.m").alias("mean_f1"))


def above_percentile(df: DataFrame, keys: Sequence[str], value: str, percentiles: Sequence[float]) -> DataFrame:
    """df's rows once for each percentile of their trial that they reach, with percentile."""
    cuts = quantiles.percentiles(df, keys, F.col(value), [p / 100 for p in percentiles], "_cuts")
    cuts = cuts.select(*keys, F.explode(F.arrays_zip(F.array(*map(F.lit, percentiles)).alias("p"), F.col("_cuts").alias("cut"))).alias("_c"))
    return df.join(cuts, list(keys)).filter(F.col(value) >= F.col("_c.cut")).withColumn("percentile", F.col("_c.p")).drop("_c")


def positional(left: DataFrame, right: DataFrame, keys: Sequence[str], idx: str) -> DataFrame:
    """Rows of two recordings at the same place, up to the shorter one's end: an equi-join of keys and index."""
    return left.join(right, [*keys, idx])


def share_of(part: Column, whole: Column) -> Column:
    return F.try_divide(part, whole)
