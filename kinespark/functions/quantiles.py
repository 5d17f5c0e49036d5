"""Percentiles of trials, rounded as the SQL's quantile_cont rounds them, so that values at a cut fall on the same side."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def between(low: pa.Array, high: pa.Array, share: pa.Array) -> pa.Array:
    """low * (1 - share) + high * share, the first product and the sum rounded once."""
    rows = zip(low.to_pylist(), high.to_pylist(), share.to_pylist(), strict=True)
    return pa.array([None if a is None else a if s == 0 else math.fma(a, 1 - s, b * s) for a, b, s in rows], pa.float64())


def percentiles(df: DataFrame, keys: Sequence[str], value: Column, shares: Sequence[float], into: str) -> DataFrame:
    """(keys, into): the values at the shares (0 to 1) of each trial's sorted known values, straight between two of them.

    Spark's percentile() weighs its two neighbours with other roundings: it can differ in the last place, and then drops or
    keeps a value that equals a cut but for its last place.
    """
    trial = Window.partitionBy(*keys)
    known = df.select(*keys, value.cast("double").alias("_v")).filter("_v IS NOT NULL")
    x = known.withColumn("_r", F.row_number().over(trial.orderBy("_v")) - 1).withColumn("_n", F.count("*").over(trial))
    at = [(F.col("_n") - 1) * F.lit(float(s)) for s in shares]
    ends = [F.max(F.when(F.col("_r") == side(a), F.col("_v"))).alias(f"_{name}{k}") for k, a in enumerate(at) for name, side in (("low", F.floor), ("high", F.ceil))]
    cut = F.arrow_udf(between, "double")
    found = x.groupBy(*keys).agg(F.max("_n").alias("_n"), *ends)
    return found.select(*keys, F.array(*(cut(F.col(f"_low{k}"), F.col(f"_high{k}"), a - F.floor(a)) for k, a in enumerate(at))).alias(into))
