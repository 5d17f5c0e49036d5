"""Structured Streaming operators on sample streams; each works on batch tables too."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kinespark.operators import policy
from kinespark.operators.quality import WRAP_HIGH, WRAP_LOW, finite
from kinespark.operators.signals import time_features


def window_features(df: DataFrame, key: str, ts: str, value: str, length: str, step: str, late: str = "1 hour") -> DataFrame:
    """Features of sliding event-time windows; rows later than the watermark are dropped."""
    w = df.withWatermark(ts, late) if df.isStreaming else df
    return w.groupBy(key, F.window(ts, length, step)).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), (F.max(value) - F.min(value)).alias("range"))


def sessions(df: DataFrame, key: str, ts: str, gap: str, late: str = "1 hour") -> DataFrame:
    """Trials as sessions: a gap of inactivity ends one."""
    w = df.withWatermark(ts, late) if df.isStreaming else df
    return w.groupBy(key, F.session_window(ts, gap)).agg(F.count("*").alias("n")).withColumnRenamed("session_window", "session")


def gap_stream(df: DataFrame, key: str, order: str, counter: str) -> DataFrame:
    """(key, prev, next): counter steps other than 1 across micro-batches. State is the last counter; idle keys expire.

    A micro-batch's rows go by the order column, since a counter that wraps does not order them.
    """

    def run(ident, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, found = (state.get[0] if state.exists else None), []
        for _, v in sorted(row for pdf in batches for row in zip(pdf[order].tolist(), pdf[counter].tolist(), strict=True)):
            if last is not None and v != last + 1 and not (last >= WRAP_HIGH and v <= WRAP_LOW):
                found.append((ident[0], last, v))
            last = v
        state.update((int(last),))
        state.setTimeoutDuration(3_600_000)
        yield pd.DataFrame(found, columns=[key, "prev", "next"])

    return df.select(key, order, counter).groupBy(key).applyInPandasWithState(run, f"{key} long, prev long, next long", "last long", "append", "ProcessingTimeTimeout")


def ordered_gap_stream(df: DataFrame, key: str, ts: str, counter: str, late: str = "10 minutes", ttl_minutes: int = 60) -> DataFrame:
    """(key, prev, next): counter steps other than 1 in event time, whichever micro-batches the rows come in.

    A row waits in its key's state until the watermark has passed its time, so a row that is late, but not later than `late`,
    takes its place before the steps around it are judged; later ones are left out. State is the last counter and the rows of
    the last `late`; a key without rows for ttl_minutes of event time is forgotten. Rows of one time go by counter.
    """

    def steps(ident, last: int | None, rows: list[tuple[int, int]]) -> tuple[int | None, list[tuple]]:
        found = []
        for _, v in rows:
            if last is not None and v != last + 1 and not (last >= WRAP_HIGH and v <= WRAP_LOW):
                found.append((ident[0], last, v))
            last = v
        return last, found

    def run(ident, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        last, done, times, counters = state.get if state.exists else (None, -1, [], [])
        waiting = list(zip(times, counters, strict=True))
        for pdf in batches:
            known = pdf.dropna()
            new = zip((known["_ms"]).astype("int64").tolist(), known[counter].astype("int64").tolist(), strict=True)
            waiting += [row for row in new if row[0] > done]
        ready, rest = sorted(r for r in waiting if r[0] <= now), [r for r in waiting if r[0] > now]
        last, found = steps(ident, last, ready)
        if state.hasTimedOut and not rest and not ready:
            state.remove()
        else:
            done = max([done, now, *(t for t, _ in ready)]) if ready or now > done else done
            state.update((last, done, [t for t, _ in rest], [c for _, c in rest]))
            state.setTimeoutTimestamp(min(t for t, _ in rest) + 1 if rest else max(done, now) + ttl_minutes * 60_000)
        yield pd.DataFrame(found, columns=[key, "prev", "next"])

    rows = df.withWatermark(ts, late).select(key, ts, F.unix_millis(F.col(ts).cast("timestamp")).alias("_ms"), counter)
    return rows.groupBy(key).applyInPandasWithState(run, f"{key} long, prev long, next long", "last long, done long, times array<long>, counters array<long>", "append", "EventTimeTimeout")


def freezing_windows(df: DataFrame, key: str, ts: str, value: str, length: str, fs: float, locomotion: tuple[float, float], freezing: tuple[float, float], late: str = "1 hour", least: int = 8) -> DataFrame:
    """(key, window, freezing_index) of event-time windows with at least `least` samples: a window's samples are one Hann segment.

    A window's length bounds the samples of a group.
    """
    w = df.withWatermark(ts, late) if df.isStreaming else df
    rows = w.groupBy(key, F.window(ts, length)).agg(F.sort_array(F.collect_list(F.struct(F.col(ts).alias("t"), F.col(value).cast("double").alias("v")))).alias("_x"))

    @F.pandas_udf("double")
    def ratio(values: pd.Series) -> pd.Series:
        found = []
        for x in values:
            x = np.asarray(x, float)
            hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(len(x)) / len(x))
            power, freq = np.abs(np.fft.rfft((x - x.mean()) * hann)) ** 2, np.fft.rfftfreq(len(x), 1 / fs)
            low, high = (power[(freq >= a) & (freq < b)].sum() for a, b in (locomotion, freezing))
            found.append(high / low if low > 0 else None)
        return pd.Series(found, dtype="float64")

    kept = rows.filter(F.size("_x") >= least).select(key, "window", F.transform("_x", lambda p: p["v"]).alias("_v"))
    return kept.select(key, "window", F.nanvl(ratio("_v"), F.lit(None).cast("double")).alias("freezing_index"))


def trial_scores(df: DataFrame, trial: str, order: Sequence[str], value: str, least: int = 10) -> DataFrame:
    """(trial, risk, band, votes) of each trial: finite samples, time features, a logistic score, its band, votes of three rules."""
    clean = df.withColumn(value, finite(F.col(value))).filter(F.col(value).isNotNull())
    long = clean.groupBy(trial).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).select(trial)
    f = time_features(clean.join(long, trial), [trial], order, value)
    risk = 1 / (1 + F.exp(-(F.col("rms") - 80) / 20))
    votes = sum(((F.col(c) > limit).cast("int") for c, limit in (("rms", 80), ("range", 200), ("sd", 40))), F.lit(0))
    return f.select(trial, risk.alias("risk"), policy.risk_band(risk, 0.6).alias("band"), votes.alias("votes"))


def score_stream(df: DataFrame, scored: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Scores every micro-batch of whole trials into a folder of its own: a batch that is run again replaces its results."""

    def write(batch: DataFrame, number: int) -> None:
        scored(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
