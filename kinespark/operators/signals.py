"""Signal operators by trial: segments, windows, time-domain features (native) and NumPy kernels for filters and spectra.

Native operators are windows and aggregates partitioned by trial. Kernels run as grouped functions on blocks of bounded
size: resampling on blocks with the filter's reach on their sides, spectra on runs of segments, entropies on cells of two
blocks. Only by_trial() takes a whole trial as a group. Filters, peaks and orientation have modules of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinespark.functions.groups import streamed, streamed_together


def indexed(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """df with idx: each row's place in its trial, from 0; nulls come last, as in the SQL."""
    return df.withColumn("idx", F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.col(c).asc_nulls_last() for c in order))) - 1)


def exclude_turns(df: DataFrame, bounds: DataFrame, key: str, min_rows: int) -> DataFrame:
    """Rows before a turn's start and from its end on, where both sides have min_rows; new_idx counts the kept rows.

    status: ok, invalid_bounds, segment_too_short or no_turn; rows of trials that aren't ok are all kept.
    """
    n = df.groupBy(key).agg(F.count("*").alias("n"))
    known = n.join(bounds, key, "left").withColumn(
        "status",
        F.when(F.col("start").isNull() | F.col("end").isNull(), "no_turn").when((F.col("start") < 0) | (F.col("end") <= F.col("start")) | (F.col("end") > F.col("n")), "invalid_bounds")
        .when((F.col("start") < min_rows) | (F.col("n") - F.col("end") < min_rows), "segment_too_short").otherwise("ok"),
    )
    kept = df.join(known, key).filter((F.col("status") != "ok") | (F.col("idx") < F.col("start")) | (F.col("idx") >= F.col("end")))
    return kept.withColumn("new_idx", F.row_number().over(Window.partitionBy(key).orderBy("idx")) - 1)


def windows(df: DataFrame, keys: Sequence[str], idx: str, length: int, step: int) -> DataFrame:
    """df once for each window of its trial that covers the row, with window_start; only whole windows."""
    n = F.count("*").over(Window.partitionBy(*keys))
    first = F.greatest(F.lit(0), F.ceil((F.col(idx) - length + 1) / step)).cast("long")
    last = F.least(F.floor(F.col(idx) / step), F.floor((F.col("_n") - length) / step)).cast("long")
    spread = df.withColumn("_n", n).filter(F.col("_n") >= length).withColumn("_f", first).withColumn("_l", last).filter("_l >= _f")
    return spread.withColumn("_w", F.explode(F.sequence("_f", "_l"))).withColumn("window_start", F.col("_w") * step).drop("_n", "_f", "_l", "_w")


def time_features(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """RMS, range, standard deviation, mean and largest absolute jerk of each trial."""
    w = Window.partitionBy(*keys).orderBy(*order)
    x = df.withColumn("_jerk", F.abs(F.col(value) - F.lag(value).over(w)))
    return x.groupBy(*keys).agg(
        F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"), (F.max(value) - F.min(value)).alias("range"), F.stddev_pop(value).alias("sd"),
        F.avg("_jerk").alias("mean_jerk"), F.max("_jerk").alias("max_jerk"),
    )


def participant_trend(df: DataFrame, participant: str, order: Sequence[str], feature: str) -> DataFrame:
    """Mean, deviation, range and slope over the trials with a finite value; trials are numbered after the others are gone.

    The slope is null for fewer than two trials.
    """
    w = Window.partitionBy(participant).orderBy(*order)
    x = df.filter(F.col(feature).isNotNull() & ~F.isnan(feature) & (F.abs(F.col(feature)) < float("inf"))).withColumn("_k", F.row_number().over(w) - 1)
    out = x.groupBy(participant).agg(F.avg(feature).alias("mean"), F.stddev_pop(feature).alias("sd"), (F.max(feature) - F.min(feature)).alias("range"), F.regr_slope(feature, "_k").alias("slope"), F.count("*").alias("n"))
    return out.withColumn("trend", F.when(F.col("n") >= 2, F.coalesce("slope", F.lit(0.0)))).drop("slope")


def stride_times(events: DataFrame, keys: Sequence[str], at: str, least: int = 3) -> DataFrame:
    """Steps between a side's consecutive events: mean, deviation, coefficient of variation and rate; at least `least` events."""
    w = Window.partitionBy(*keys).orderBy(at)
    d = events.withColumn("_d", F.col(at) - F.lag(at).over(w)).groupBy(*keys).agg(F.count("*").alias("n"), F.avg("_d").alias("mean"), F.stddev_pop("_d").alias("sd"))
    return d.filter(F.col("n") >= least).withColumn("cv", F.when(F.col("mean") != 0, 100 * F.col("sd") / F.col("mean"))).withColumn("rate", F.when(F.col("mean") != 0, 60 / F.col("mean")))


def next_event(df: DataFrame, keys: Sequence[str], order: Sequence[str], kind: str, of: str, then: str, at: Column, into: str) -> DataFrame:
    """Rows of kind `of` with the place of the next row of kind `then` in their trial: a forward as-of join as one window."""
    w = Window.partitionBy(*keys).orderBy(*map(F.desc, order)).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(into, F.last(F.when(F.col(kind) == then, at), True).over(w)).filter(F.col(kind) == of)


def rolling_cv(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, length: int) -> DataFrame:
    """Mean over full windows of the coefficient of variation, the whole trial's where it has fewer rows than a window."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(0, length - 1)
    cv = lambda mean, sd: F.when(mean != 0, 100 * sd / F.abs(mean))
    x = df.withColumn("_cv", F.when(F.count(value).over(w) == length, cv(F.avg(value).over(w), F.stddev_pop(value).over(w))))
    return x.groupBy(*keys).agg(F.coalesce(F.avg("_cv"), cv(F.avg(value), F.stddev_pop(value))).alias("rolling_cv"))


def symmetry_index(left: Column, right: Column) -> Column:
    """100 |l - r| over half their sum; 0 where both are 0."""
    return F.when(left + right == 0, 0.0).otherwise(100 * F.abs(left - right) / (0.5 * (left + right)))


def block_rms(df: DataFrame, keys: Sequence[str], idx: str, value: str, block: int) -> DataFrame:
    """Mean and deviation of the RMS of whole blocks of rows."""
    b = df.groupBy(*keys, F.floor(F.col(idx) / block).alias("_b")).agg(F.count("*").alias("_n"), F.sqrt(F.avg(F.col(value) * F.col(value))).alias("_r")).filter(F.col("_n") == block)
    return b.groupBy(*keys).agg(F.avg("_r").alias("block_rms_mean"), F.stddev_pop("_r").alias("block_rms_sd"))


def swing_lengths(df: DataFrame, keys: Sequence[str], idx: str, value: str, dt: float) -> DataFrame:
    """Acceleration integrated twice over each segment; the speed is brought back to 0 at its end by a linear drift."""
    w = Window.partitionBy(*keys).orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    x = df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(idx)) - 1).withColumn("_n", F.count("*").over(whole)).withColumn("_v", F.sum(F.col(value) * dt).over(w)).withColumn("_end", F.sum(F.col(value) * dt).over(whole))
    x = x.withColumn("_v", F.col("_v") - F.when(F.col("_n") > 1, F.col("_end") * F.col("_k") / (F.col("_n") - 1)).otherwise(0.0))
    return x.groupBy(*keys).agg(F.abs(F.sum(F.col("_v") * dt)).alias("length"))


def band_power(psd: DataFrame, keys: Sequence[str], low: float, high: float) -> DataFrame:
    """Trapezoid area of (freq, power) over low <= freq < high."""
    w = Window.partitionBy(*keys).orderBy("freq")
    x = psd.filter((F.col("freq") >= low) & (F.col("freq") < high)).withColumn("_a", (F.col("freq") - F.lag("freq").over(w)) * (F.col("power") + F.lag("power").over(w)) / 2)
    return x.groupBy(*keys).agg(F.coalesce(F.sum("_a"), F.lit(0.0)).alias("band_power"))


def band_powers(psd: DataFrame, keys: Sequence[str], bands: Mapping[str, tuple[float, float]]) -> DataFrame:
    """(keys, a column for each band): band_power() of several bands in one pass, 0 where a trial has no two bins in a band."""
    w = Window.partitionBy(*keys).orderBy("freq")
    x = psd.withColumns({"_before": F.lag("freq").over(w), "_area": (F.col("freq") - F.lag("freq").over(w)) * (F.col("power") + F.lag("power").over(w)) / 2})
    area = lambda low, high: F.sum(F.when((F.col("_before") >= low) & (F.col("freq") < high), F.col("_area")))
    return x.groupBy(*keys).agg(*(F.coalesce(area(*band), F.lit(0.0)).alias(name) for name, band in bands.items()))


def spectrum_shape(psd: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Dominant frequency (the lowest on ties), centroid and entropy of a spectrum."""
    x = psd.withColumn("_p", F.try_divide("power", F.sum("power").over(Window.partitionBy(*keys))))
    return x.groupBy(*keys).agg(
        F.max_by("freq", F.struct("power", -F.col("freq"))).alias("dominant"), F.try_divide(F.sum(F.col("freq") * F.col("power")), F.sum("power")).alias("centroid"),
        (-F.sum(F.when(F.col("_p") > 0, F.col("_p") * F.log("_p")).otherwise(0.0))).alias("entropy"),
    )


def by_trial(df: DataFrame, keys: Sequence[str], order: str, value: str, kernel: Callable[[np.ndarray], dict], schema: str) -> DataFrame:
    """A NumPy kernel on each trial's values in order; its dict of scalars or equal-length arrays becomes rows."""
    names = list(keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        made = kernel(pdf[value].to_numpy(float))
        n = max((len(v) for v in made.values() if np.ndim(v)), default=1)
        out = {k: [pdf[k].iloc[0]] * n for k in names} | {k: v if np.ndim(v) else [v] * n for k, v in made.items()}
        return pd.DataFrame(out)

    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in names)
    return df.select(*names, order, value).groupBy(*names).applyInPandas(run, f"{kinds}, {schema}")


#: Rows of a block, and the warm-up rows on each side of it: many time constants of the slowest filter used here.
BLOCK, WARM_UP = 1 << 16, 1 << 13


def by_blocks(df: DataFrame, keys: Sequence[str], idx: str, value: str, kernel: Callable[[np.ndarray], dict], schema: str, block: int = BLOCK, warm_up: int = WARM_UP, up: int = 1, down: int = 1) -> DataFrame:
    """(keys, idx, kernel's columns) of a kernel that gives up rows for down rows, block by block.

    A block is computed with warm_up rows before and after it, whose results go. A trial of up to a block's rows is one block,
    so it is computed whole.
    """
    names = list(keys)
    at = F.floor(F.col(idx) / block)
    inside = F.col(idx) - at * block
    copies = F.array_distinct(F.array(at, F.when(inside < warm_up, F.greatest(at - 1, F.lit(0))).otherwise(at), F.when(inside >= block - warm_up, at + 1).otherwise(at)))
    rows = df.select(*names, F.col(idx).cast("long").alias("_idx"), F.col(value).cast("double").alias("_value"), F.explode(copies).alias("_block"))

    def run(part: Mapping[str, np.ndarray]) -> dict[str, np.ndarray]:
        first, start = int(part["_idx"][0]), int(part["_nth"][0]) * block
        own = int(((part["_idx"] >= start) & (part["_idx"] < start + block)).sum())
        if not own:  # a block that has warm-up rows alone
            return {"idx": np.zeros(0, np.int64)} | {c: np.zeros(0) for c in columns}
        made = kernel(part["_value"])
        # results of the block's own rows: a block begins at a whole number of steps
        low = (start - first) * up // down
        n = -(-own * up // down)
        return {"idx": start * up // down + np.arange(n)} | {k: v[low : low + n] for k, v in made.items()}

    columns = [c.strip().split(" ")[0] for c in schema.split(",")]
    return streamed(rows.withColumn("_nth", F.col("_block")), [*names, "_block"], ["_idx"], run, f"idx long, {schema}").drop("_block")


def welch_psd(df: DataFrame, keys: Sequence[str], idx: str, value: str, fs: float, segment: int = 256, run_of: int = 64, n: Column | None = None) -> DataFrame:
    """(keys, freq, power) as welch() gives for each trial; a group is a run of a trial's segments. n: the trial's rows, where they are known."""
    names = list(keys)
    # counted by a window: a join with counts would compute df twice
    n = F.count("*").over(Window.partitionBy(*names)) if n is None else n
    x = df.select(*names, F.col(idx).cast("long").alias("_idx"), F.col(value).cast("double").alias("_value"), n.alias("_n"))
    x = x.withColumn("_seg", F.greatest(F.lit(2), F.least(F.lit(segment), F.floor(F.col("_n") / 2)))).withColumn("_step", F.greatest(F.lit(1), F.col("_seg") - F.floor(F.col("_seg") / 2))).filter(F.col("_n") >= F.col("_seg"))
    first = F.greatest(F.lit(0), F.ceil((F.col("_idx") - F.col("_seg") + 1) / F.col("_step")))
    last = F.least(F.floor(F.col("_idx") / F.col("_step")), F.floor((F.col("_n") - F.col("_seg")) / F.col("_step")))
    x = x.withColumn("_first", F.floor(first / run_of)).withColumn("_last", F.floor(last / run_of)).filter(first <= last)
    x = x.withColumn("_run", F.explode(F.sequence("_first", "_last"))).select(*names, "_idx", "_value", "_n", "_seg", "_step", "_run")

    def run(rows: Mapping[str, np.ndarray], bounds: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        at = bounds[:-1]
        size, step, k, whole = (rows[c][at].astype(np.int64) for c in ("_seg", "_step", "_nth", "_n"))
        here = np.minimum((k + 1) * run_of, (whole - size) // step + 1) - k * run_of  # segments of each group
        begin = at + k * run_of * step - rows["_idx"][at].astype(np.int64)
        bins = size // 2 + 1
        out = np.cumsum(bins) - bins
        freq, total = np.empty(bins.sum()), np.empty(bins.sum())
        # groups with segments of one size go through one transform
        for n in np.unique(size):
            some = np.flatnonzero(size == n)
            firsts = np.cumsum(here[some]) - here[some]
            starts = np.repeat(begin[some] - firsts * step[some], here[some]) + np.arange(here[some].sum()) * np.repeat(step[some], here[some])
            hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
            parts = rows["_value"][starts[:, None] + np.arange(n)]
            power = np.abs(np.fft.rfft((parts - parts.mean(1, keepdims=True)) * hann)) ** 2 / (fs * (hann**2).sum())
            power[:, 1 : -1 if n % 2 == 0 else None] *= 2
            to = out[some, None] + np.arange(n // 2 + 1)
            freq[to], total[to] = np.fft.rfftfreq(n, 1 / fs), np.add.reduceat(power, firsts, axis=0)
        return {"freq": freq, "_sum": total, "_parts": np.repeat(here, bins)}, bins

    sums = streamed_together(x.withColumn("_nth", F.col("_run")), [*names, "_run"], ["_idx"], run, "freq double, _sum double, _parts long")
    return sums.groupBy(*names, "freq").agg((F.sum("_sum") / F.sum("_parts")).alias("power"))


def orientation_summary(df: DataFrame, keys: Sequence[str], order: Sequence[str], tilt: str, pitch: str, roll: str, fs: float) -> DataFrame:
    """Mean, deviation and range of the tilt, deviations of pitch and roll in degrees, and the mean speed of the tilt."""
    w = Window.partitionBy(*keys).orderBy(*order)
    x = df.withColumn("_rate", F.abs(F.degrees(F.col(tilt)) - F.degrees(F.lag(tilt).over(w))) * fs)
    d = F.degrees(F.col(tilt))
    return x.groupBy(*keys).agg(F.avg(d).alias("tilt_mean"), F.stddev_pop(d).alias("tilt_sd"), (F.max(d) - F.min(d)).alias("tilt_range"), F.stddev_pop(F.degrees(F.col(pitch))).alias("pitch_sd"), F.stddev_pop(F.degrees(F.col(roll))).alias("roll_sd"), F.avg("_rate").alias("sway"))


def rms_asymmetry(left: DataFrame, right: DataFrame, keys: Sequence[str], idx: str, value: str) -> DataFrame:
    """(keys, asymmetry, symmetry_index) of two sides' RMS over the places that both have."""
    both = left.select(*keys, idx, F.col(value).alias("_l")).join(right.select(*keys, idx, F.col(value).alias("_r")), [*keys, idx])
    g = both.groupBy(*keys).agg(F.sqrt(F.avg(F.col("_l") ** 2)).alias("l"), F.sqrt(F.avg(F.col("_r") ** 2)).alias("r"))
    gap, total = F.abs(F.col("l") - F.col("r")), F.col("l") + F.col("r")
    return g.select(*keys, (gap / (total + 1e-10)).alias("asymmetry"), (100 * gap / (0.5 * total + 1e-10)).alias("symmetry_index"))


def range_of_motion(df: DataFrame, keys: Sequence[str], segment: str, idx: str, rate: str, dt: float, least: int = 4) -> DataFrame:
    """(keys, rom, n): mean over segments of the integrated angle's peak-to-peak in degrees, its end brought back to 0 by a linear drift."""
    here = [*keys, segment]
    w = Window.partitionBy(*here).orderBy(idx)
    x = df.withColumn("_k", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*here))).filter(F.col("_n") >= least)
    x = x.withColumn("_angle", F.sum(F.col(rate) * dt).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_end", F.sum(F.col(rate) * dt).over(Window.partitionBy(*here)))
    x = x.withColumn("_angle", F.degrees(F.col("_angle") - F.col("_end") * F.col("_k") / (F.col("_n") - 1)))
    return x.groupBy(*here).agg((F.max("_angle") - F.min("_angle")).alias("_rom")).groupBy(*keys).agg(F.avg("_rom").alias("rom"), F.count("*").alias("n"))


def harmonic_ratio(psd: DataFrame, keys: Sequence[str], below: float, orders: int = 6) -> DataFrame:
    """(keys, dominant, ratio): power at the even multiples of the dominant frequency over that at the odd ones, each at its
    nearest bin (the lower on ties); null without a positive frequency or power."""
    top = psd.groupBy(*keys).agg(F.max_by("freq", F.struct("power", -F.col("freq"))).alias("dominant"))
    each = top.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(orders)))).filter((F.col("dominant") > 0) & (F.col("dominant") * F.col("k") < below))
    near = psd.join(each, list(keys)).groupBy(*keys, "k").agg(F.min_by("power", F.struct(F.abs(F.col("freq") - F.col("dominant") * F.col("k")), "freq")).alias("p"))
    sums = near.groupBy(*keys).agg(F.sum(F.when(F.col("k") % 2 == 0, F.col("p")).otherwise(0.0)).alias("even"), F.sum(F.when(F.col("k") % 2 == 1, F.col("p")).otherwise(0.0)).alias("odd"))
    return top.join(sums, list(keys), "left").select(*keys, "dominant", F.when((F.col("even") > 0) | (F.col("odd") > 0), F.col("even") / (F.col("odd") + 1e-10)).alias("ratio"))


def freezing_series(df: DataFrame, keys: Sequence[str], idx: str, value: str, fs: float, length: int, hop: int, locomotion: tuple[float, float], freezing: tuple[float, float]) -> DataFrame:
    """(keys, idx, freezing_index) of every sample: the ratio of two bands' powers in the window that began last before it.

    A window's spectrum is one Hann segment without its mean, by sums of cosines and sines over its rows.
    """
    x = windows(df.select(*keys, F.col(idx).alias("idx"), F.col(value).cast("double").alias("_v")), keys, "idx", length, hop)
    here = [*keys, "window_start"]
    mean = x.groupBy(*here).agg(F.avg("_v").alias("_mean"))
    at = F.col("idx") - F.col("window_start")
    x = x.join(mean, here).withColumn("_y", (F.col("_v") - F.col("_mean")) * (0.5 - 0.5 * F.cos(2 * np.pi * at / length)))
    bins = [k for k in range(1, length // 2 + 1) if any(lo <= k * fs / length < hi for lo, hi in (locomotion, freezing))]
    angle = F.lit(2 * np.pi) * F.col("_k") * at / length
    power = x.withColumn("_k", F.explode(F.array(*map(F.lit, bins)))).groupBy(*here, "_k").agg((F.sum(F.col("_y") * F.cos(angle)) ** 2 + F.sum(F.col("_y") * F.sin(angle)) ** 2).alias("power"))
    power = power.select(*here, (F.col("_k") * fs / length).alias("freq"), "power")
    low, high = (band_power(power, here, *band).withColumnRenamed("band_power", name) for band, name in ((locomotion, "_low"), (freezing, "_high")))
    ratio = low.join(high, here).select(*here, F.when(F.col("_low") > 0, F.col("_high") / F.col("_low")).alias("freezing_index"))
    samples = df.select(*keys, F.col(idx).alias("idx")).join(df.groupBy(*keys).agg(F.count("*").alias("_n")), list(keys)).filter(F.col("_n") >= length)
    last = F.least(F.floor(F.col("idx") / hop), F.floor((F.col("_n") - length) / hop)) * hop
    return samples.withColumn("window_start", last.cast("long")).join(ratio, here, "left").select(*keys, "idx", "freezing_index")


#: Rows of a task whose work is many times its rows. Partitions of a size in bytes would have too many.
TASK_ROWS = 10_000


def spread_trials(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """df by trials in partitions of about TASK_ROWS rows, so that tasks stay as they are when the table grows.

    One more than the session's number at least: Spark leaves out a shuffle into as many partitions as its input's.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) + 1
    return df.repartition(max(least, -(-df.count() // TASK_ROWS)), *names)


def mutual_information(df: DataFrame, keys: Sequence[str], idx: str, value: str, most: int = 50, least_bins: int = 16) -> DataFrame:
    """(keys, lag, ami): mutual information of a trial with itself lag rows later, from a histogram of the pairs.

    Lags go to the smaller of `most` and a tenth of the rows (2 at least); a trial needs more than lag + 20 rows and two values.
    A task counts the pairs of TASK_ROWS rows, or of one trial.
    """
    names = list(keys)
    w = Window.partitionBy(*names).orderBy(idx)
    stats = df.groupBy(*names).agg(F.count("*").alias("_n"), F.min(value).alias("_low"), F.max(value).alias("_high")).filter("_high > _low")
    df = spread_trials(df.select(*names, idx, value), names)
    later = F.array(*(F.struct(F.lit(k).alias("lag"), F.lead(value, k).over(w).alias("b")) for k in range(1, most + 1)))
    x = df.withColumn("_later", later).join(stats, names).select(*names, "_n", "_low", "_high", F.col(value).alias("_a"), F.explode("_later").alias("_l"))
    x = x.filter(F.col("_l.b").isNotNull() & (F.col("_l.lag") <= F.least(F.lit(most), F.greatest(F.lit(2), F.floor(F.col("_n") / 10)))) & (F.col("_n") > F.col("_l.lag") + 20))
    bins = F.greatest(F.lit(least_bins), F.floor(F.sqrt(F.col("_n") - F.col("_l.lag"))))
    at = lambda c: F.least(F.floor((c - F.col("_low")) / (F.col("_high") - F.col("_low")) * bins), bins - 1)
    c = x.groupBy(*names, F.col("_l.lag").alias("lag"), at(F.col("_a")).alias("_x"), at(F.col("_l.b")).alias("_y"), (F.col("_n") - F.col("_l.lag")).cast("double").alias("_m")).agg(F.count("*").alias("_c"))
    part = lambda *k: F.sum("_c").over(Window.partitionBy(*names, "lag", *k))
    c = c.withColumn("_px", part("_x")).withColumn("_py", part("_y"))
    return c.groupBy(*names, "lag").agg(F.sum(F.col("_c") / F.col("_m") * F.log(F.col("_c") * F.col("_m") / (F.col("_px") * F.col("_py")))).alias("ami"))


def embedding_delay(ami: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, delay): the first lag whose mutual information is below both neighbours', else the lag of the smallest."""
    w = Window.partitionBy(*keys).orderBy("lag")
    x = ami.withColumn("ami", F.round("ami", 9)).withColumn("_low", (F.col("ami") < F.lag("ami").over(w)) & (F.col("ami") < F.lead("ami").over(w)))
    return x.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("_low"), F.col("lag"))), F.min_by("lag", F.struct("ami", "lag"))).alias("delay"))


def dfa_exponent(df: DataFrame, keys: Sequence[str], idx: str, value: str, scales: int = 12) -> DataFrame:
    """(keys, dfa): slope of log fluctuation against log scale, as dfa() gives, by aggregates over (scale, block)."""
    names = list(keys)
    stats = df.groupBy(*names).agg(F.count("*").alias("_n"), F.avg(value).alias("_mean"))
    w = Window.partitionBy(*names).orderBy(idx)
    x = df.join(stats, names).withColumn("_k", F.row_number().over(w) - 1).withColumn("_y", F.sum(F.col(value) - F.col("_mean")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    top = F.greatest(F.lit(5), F.floor(F.col("_n") / 4)).cast("double")
    sizes = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(scales - 1)), lambda i: F.floor(4 * F.pow(top / 4, i / float(scales - 1)) + 1e-9)))
    x = x.withColumn("_scale", F.explode(sizes)).withColumn("_blocks", F.floor(F.col("_n") / F.col("_scale"))).filter((F.col("_blocks") >= 2) & (F.col("_k") < F.col("_blocks") * F.col("_scale")))
    x = x.withColumn("_t", F.col("_k") % F.col("_scale")).groupBy(*names, "_scale", F.floor(F.col("_k") / F.col("_scale")).alias("_b")).agg((F.regr_syy("_y", "_t") - F.regr_sxy("_y", "_t") ** 2 / F.regr_sxx("_y", "_t")).alias("_rest"))
    f = x.groupBy(*names, "_scale").agg((0.5 * F.log(F.sum("_rest") / (F.count("*") * F.col("_scale")))).alias("_f"))
    return f.groupBy(*names).agg(F.when(F.count("*") > 1, F.regr_slope("_f", F.log(F.col("_scale").cast("double")))).alias("dfa"))


def entropies(df: DataFrame, keys: Sequence[str], idx: str, value: str, m: int = 2, r: float = 0.2, block: int = 2048) -> DataFrame:
    """(keys, sample_entropy, approximate_entropy) with Chebyshev distance and a tolerance of r deviations.

    Templates are dealt to blocks in order, and each pair of blocks is a cell: a bounded group that returns each template's
    matches. The work is quadratic in a trial's rows, as the definition is.
    """
    names = list(keys)
    w = Window.partitionBy(*names).orderBy(idx)
    stats = df.groupBy(*names).agg(F.count("*").alias("_n"), (r * F.stddev_pop(value)).alias("_tol"))
    x = df.join(stats, names).withColumn("_k", (F.row_number().over(w) - 1).cast("long"))
    parts = F.array(F.col(value).cast("double"), *(F.lead(value, j).over(w).cast("double") for j in range(1, m + 1)))
    x = x.select(*names, "_k", "_n", "_tol", parts.alias("_x")).filter((F.col("_k") <= F.col("_n") - m) & (F.col("_tol") > 0) & (F.col("_n") >= m + 2))
    blocks = F.ceil((F.col("_n") - m + 1) / block)
    own = F.floor(F.col("_k") / block)
    every = F.sequence(F.lit(0).cast("long"), (blocks - 1).cast("long"))
    mine = x.select("*", own.alias("_i"), F.explode(every).alias("_j"), F.lit(True).alias("_asks"))
    theirs = x.select("*", F.explode(every).alias("_i"), own.alias("_j"), F.lit(False).alias("_asks"))

    def run(cell: Mapping[str, np.ndarray]) -> dict[str, np.ndarray]:
        asks = cell["_asks"].astype(bool)
        x, y, tol, n = cell["_x"][asks], cell["_x"][~asks], float(cell["_tol"][0]), int(cell["_n"][0])
        counts = np.zeros((len(x), 4), np.int64)
        ka, kb = cell["_k"][asks], cell["_k"][~asks]
        inner = kb <= n - m - 1  # templates that go on
        for at in range(0, len(x), 256):
            d = np.abs(x[at : at + 256, None] - y[None])
            short, whole = d[:, :, :m].max(2) <= tol, d.max(2) <= tol
            goes, other = ka[at : at + 256, None] <= n - m - 1, ka[at : at + 256, None] != kb
            counts[at : at + 256] = np.stack([(short & goes & inner & other).sum(1), (whole & goes & inner & other).sum(1), short.sum(1), (whole & goes & inner).sum(1)], 1)
        return {"_at": ka, "_of": np.full(len(x), n)} | {f"_c{j}": counts[:, j] for j in range(4)}

    cells = streamed(mine.unionByName(theirs), [*names, "_i", "_j"], ["_asks", "_k"], run, "_at long, _of long, " + ", ".join(f"_c{j} long" for j in range(4)))
    cells = cells.withColumnsRenamed({"_at": "_k", "_of": "_n"})
    each = cells.groupBy(*names, "_k", "_n").agg(*(F.sum(f"_c{j}").alias(f"_c{j}") for j in range(4)))
    goes = F.col("_k") <= F.col("_n") - m - 1
    g = each.groupBy(*names).agg(
        F.sum("_c0").alias("_b"), F.sum("_c1").alias("_a"), F.avg(F.log(F.col("_c2") / (F.col("_n") - m + 1))).alias("_phi"), F.avg(F.when(goes, F.log(F.col("_c3") / (F.col("_n") - m)))).alias("_phi1"),
    )
    return g.select(*names, F.when((F.col("_a") > 0) & (F.col("_b") > 0), -F.log(F.col("_a") / F.col("_b"))).alias("sample_entropy"), (F.col("_phi") - F.col("_phi1")).alias("approximate_entropy"))


def welch(x: np.ndarray, fs: float, segment: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Power spectral density: Hann windows of min(segment, n / 2) samples, half overlapping, each without its mean."""
    n = max(2, min(segment, len(x) // 2))
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    parts = np.stack([x[k : k + n] for k in range(0, len(x) - n + 1, max(1, n - n // 2))])
    power = np.abs(np.fft.rfft((parts - parts.mean(1, keepdims=True)) * hann)) ** 2 / (fs * (hann**2).sum())
    power[:, 1 : -1 if n % 2 == 0 else None] *= 2
    return np.fft.rfftfreq(n, 1 / fs), power.mean(0)


@cache
def _sinc(up: int, down: int, beta: float) -> np.ndarray:
    """The Kaiser-windowed sinc of resample(): 2 * 10 * max(up, down) + 1 taps."""
    most = max(up, down)
    half = 10 * most
    h = np.sinc(np.arange(-half, half + 1) / most) / most * np.kaiser(2 * half + 1, beta)
    return h * (up / h.sum())


def resample(x: np.ndarray, up: int, down: int, beta: float = 5.0) -> np.ndarray:
    """Polyphase resampling: zeros between samples, a Kaiser-windowed sinc, every down-th sample. The zeros are passed over."""
    h = _sinc(up, down, beta)
    half = len(h) // 2
    n = -(-len(x) * up // down)
    out = np.empty(n)
    for a in range(0, n, 1 << 14):
        at = np.arange(a, min(a + (1 << 14), n)) * down  # places among the stuffed samples
        near = -((half - at) // up)[:, None] + np.arange(2 * half // up + 1)
        tap = half + at[:, None] - near * up
        inside = (near >= 0) & (near < len(x)) & (tap >= 0)
        out[a : a + len(at)] = (np.where(inside, x[np.where(inside, near, 0)], 0.0) * h[np.where(inside, tap, 0)]).sum(1)
    return out


def sample_entropy(x: np.ndarray, m: int = 2, r: float = 0.2) -> float:
    """-log of the share of matches of length m that go on matching; Chebyshev distance, tolerance r deviations."""
    tolerance, n = r * x.std(), len(x) - m
    if n < 2 or tolerance == 0:
        return float("nan")

    def matches(length: int) -> int:
        parts = np.lib.stride_tricks.sliding_window_view(x, length)[:n]
        return sum(int((np.abs(parts[k + 1 :] - parts[k]).max(1) <= tolerance).sum()) for k in range(n - 1))

    a, b = matches(m + 1), matches(m)
    return float(-np.log(a / b)) if a and b else float("nan")


def dfa(x: np.ndarray) -> float:
    """Slope of log fluctuation against log scale of the detrended running sum."""
    y = np.cumsum(x - x.mean())
    scales = np.unique(np.geomspace(4, max(5, len(x) // 4), 12).astype(int))
    points = []
    for s in scales:
        k = len(y) // s
        if k < 2:
            continue
        parts, t = y[: k * s].reshape(k, s), np.arange(s)
        slope = ((parts - parts.mean(1, keepdims=True)) * (t - t.mean())).sum(1) / ((t - t.mean()) ** 2).sum()
        rest = parts - parts.mean(1, keepdims=True) - slope[:, None] * (t - t.mean())
        points.append((np.log(s), 0.5 * np.log((rest**2).mean())))
    return float(np.polyfit(*zip(*points, strict=True), 1)[0]) if len(points) > 1 else float("nan")


#: Distances that lyapunov() holds at once.
DISTANCES = 1 << 20


def lyapunov(x: np.ndarray, delay: int, dim: int, steps: int) -> float:
    """Largest exponent: mean log divergence of nearest neighbours (apart in time by more than delay * dim) against time.

    Points without a neighbour so far apart are left out.
    """
    n = len(x) - (dim - 1) * delay
    if n < 2 * steps + 2:
        return float("nan")
    parts = np.stack([x[k * delay : k * delay + n] for k in range(dim)], 1)
    base = n - steps
    near, least, times = np.empty(base, np.int64), np.empty(base), np.arange(base)
    # a block of rows at a time: memory grows with the signal, not with its square
    rows = max(1, DISTANCES // base)
    for at in range(0, base, rows):
        d = np.abs(parts[at : min(at + rows, base), None] - parts[None, :base]).max(2)
        d[np.abs(times[at : at + rows, None] - times) <= delay * dim] = np.inf
        near[at : at + rows], least[at : at + rows] = d.argmin(1), d.min(1)
    met = np.flatnonzero(np.isfinite(least))
    curve = []
    for s in range(steps):
        gap = np.linalg.norm(parts[met + s] - parts[near[met] + s], axis=1)
        curve.append(np.log(gap[gap > 0]).mean() if (gap > 0).any() else np.nan)
    good = np.isfinite(curve)
    return float(np.polyfit(np.arange(steps)[good], np.array(curve)[good], 1)[0]) if good.sum() > 1 else float("nan")


def false_neighbours(x: np.ndarray, delay: int, dim: int, ratio: float = 10.0, scale: float = 2.0) -> float:
    """Share of nearest neighbours (apart in time by more than the delay) that one more dimension drives apart; 1 for fewer than 20."""
    n = len(x) - dim * delay
    if n < 20:
        return 1.0
    parts = np.stack([x[k * delay : k * delay + n] for k in range(dim + 1)], 1)
    inner, last, times = parts[:, :dim], parts[:, dim], np.arange(n)
    spread = np.linalg.norm(inner - inner.mean(0), axis=1).mean()
    false = total = 0
    rows = max(1, DISTANCES // n)
    for at in range(0, n, rows):
        d = np.sqrt(((inner[at : at + rows, None] - inner[None]) ** 2).sum(2))
        d[np.abs(times[at : at + rows, None] - times) <= max(delay, 1)] = np.inf
        near = d.argmin(1)
        least = d[np.arange(len(d)), near]
        good = np.isfinite(least) & (least > 0)
        gap = np.abs(last[at : at + rows] - last[near])[good]
        total += int(good.sum())
        false += int(((gap / least[good] > ratio) | (gap > scale * spread) & (spread > 0)).sum())
    return false / total if total else 1.0


def embedding_dimension(x: np.ndarray, delay: int, low: int = 2, high: int = 10, share: float = 0.1) -> int:
    """The smallest dimension with fewer false neighbours than the share, or the largest tried."""
    return next((m for m in range(low, high + 1) if false_neighbours(x, delay, m) < share), high)


#: The low-pass analysis filter of the Daubechies wavelet with four vanishing moments. Fixed values.
WAVELET = np.array([-0.010597401784997278, 0.032883011666982945, 0.030841381835986965, -0.18703481171888114, -0.02798376941698385, 0.6308807679295904, 0.7148465705525415, 0.23037781330885523])


def wavelet_energies(x: np.ndarray, most: int = 4) -> dict[str, np.ndarray]:
    """Energy and share of each band, the approximation first, and the entropy of the shares; nothing below 32 samples."""
    n = len(WAVELET)
    levels = min(most, int(np.floor(np.log2(len(x) / (n - 1))))) if len(x) >= 32 else 0
    if levels < 1:
        return {"band": np.zeros(0, object), "energy": np.zeros(0), "share": np.zeros(0), "entropy": np.zeros(0)}
    high = WAVELET[::-1] * np.where(np.arange(n) % 2, 1.0, -1.0)
    details = []
    for _ in range(levels):
        wide = np.pad(x, n - 1, "symmetric")
        details.append(float((np.convolve(wide, high, "valid")[1::2] ** 2).sum()))
        x = np.convolve(wide, WAVELET, "valid")[1::2]
    energy = np.array([float((x**2).sum()), *details[::-1]])
    share = energy / (energy.sum() + 1e-10)
    return {"band": np.array([f"a{levels}", *(f"d{k}" for k in range(levels, 0, -1))], object), "energy": energy, "share": share, "entropy": np.full(levels + 1, -(share * np.log2(share + 1e-12)).sum())}


def kernel_bank(seed: int, n: int, length: int) -> list[tuple[np.ndarray, float, int]]:
    """Random kernels: zero-mean weights of 7, 9 or 11 taps, a bias, a dilation that fits the window."""
    r = np.random.default_rng(seed)
    bank = []
    for _ in range(n):
        taps = int(r.choice((7, 9, 11)))
        weights = r.normal(size=taps)
        bank.append((weights - weights.mean(), float(r.uniform(-1, 1)), int(2 ** r.uniform(0, np.log2(max(1, (length - 1) / (taps - 1)))))))
    return bank


def kernel_features(x: np.ndarray, bank: Sequence[tuple[np.ndarray, float, int]]) -> np.ndarray:
    """By row of windows: largest response and share of positive responses of each kernel."""
    out = []
    for weights, bias, dilation in bank:
        n = x.shape[1] - (len(weights) - 1) * dilation
        response = sum(w * x[:, k * dilation : k * dilation + n] for k, w in enumerate(weights)) + bias
        out += [response.max(1), (response > 0).mean(1)]
    return np.stack(out, 1)
