"""Convolution features of windows with fixed kernels: nine taps, six of weight -1 and three of weight 2, dilated.

Every choice of the three places is a kernel, and a response is three times the sum of the samples at these places less the
sum of all nine, so kernels of one dilation share their sums. A feature is the share of a window in which a kernel's response
is above a bias; biases are quantiles of the responses of a bounded sample of windows, so they suit the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

TAPS, HEAVY = 9, 3
PLACES = tuple(combinations(range(TAPS), HEAVY))
#: Windows from which biases are taken, chosen by the smallest hashes of their ids.
SAMPLE = 256
#: Windows whose features are held at once.
AT_ONCE = 64


@dataclass(frozen=True)
class Bank:
    """Biases (kernels, biases of a kernel) by dilation."""

    biases: dict[int, np.ndarray]

    @property
    def size(self) -> int:
        return sum(b.size for b in self.biases.values())


def dilations(length: int, a_kernel: int) -> dict[int, int]:
    """Dilations up to which nine taps fit the window, spread by powers, and how many biases each gets of a kernel's."""
    most = np.log2(max(1, (length - 1) / (TAPS - 1)))
    steps, counts = np.unique(np.floor(2.0 ** np.linspace(0, most, min(a_kernel, 32))).astype(int), return_counts=True)
    shares = np.floor(counts * a_kernel / counts.sum()).astype(int)
    shares[: a_kernel - shares.sum()] += 1
    return {int(d): int(n) for d, n in zip(steps, shares, strict=True) if n}


def responses(x: np.ndarray, dilation: int) -> Iterator[np.ndarray]:
    """Each kernel's responses to windows (rows, samples), zeros beyond the ends."""
    reach = TAPS // 2 * dilation
    padded = np.pad(x, ((0, 0), (reach, reach)))
    shifts = [padded[:, k * dilation : k * dilation + x.shape[1]] for k in range(TAPS)]
    every = -sum(shifts)
    for places in PLACES:
        yield every + 3 * sum(shifts[k] for k in places)


def fit_bank(rows: DataFrame, ident: str, window: str, features: int = 10_000) -> Bank:
    """A bank of about so many features (a whole number a kernel), with biases from at most SAMPLE windows."""
    sample = rows.filter(F.col(window).isNotNull()).orderBy(F.xxhash64(ident), ident).limit(SAMPLE).select(F.col(window).cast("array<double>").alias("x")).collect()
    if not sample:
        raise ValueError("no windows to take biases from")
    x = np.array([r.x for r in sample])
    made = {}
    for dilation, n in dilations(x.shape[1], max(1, features // len(PLACES))).items():
        made[dilation] = np.stack([np.quantile(r, (np.arange(n) + 1) / (n + 1)) for r in responses(x, dilation)])
    return Bank(made)


def shares(x: np.ndarray, bank: Bank) -> np.ndarray:
    """(rows, features): the share of each window in which a response is above its bias."""
    out = []
    for dilation, biases in bank.biases.items():
        for r, b in zip(responses(x, dilation), biases, strict=True):
            # sorted responses answer all biases of a kernel at once
            ordered = np.sort(r, axis=1)
            out.append(np.stack([1 - np.searchsorted(row, b, "right") / x.shape[1] for row in ordered]))
    return np.concatenate(out, 1)


def kernel_shares(rows: DataFrame, window: str, bank: Bank, into: str = "features") -> DataFrame:
    """rows and into: the features of each window; null for a null window.

    A row of features is some hundred times its window, so rows go out AT_ONCE at a time, however many come in together.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                windows = part.column("_window")
                known = windows.is_valid()
                held = windows.filter(known)
                x = held.flatten().to_numpy(zero_copy_only=False).reshape(len(held), -1)
                features = shares(x, bank) if len(held) else np.zeros((0, bank.size))
                ends = np.r_[0, np.cumsum(known.to_numpy(zero_copy_only=False) * bank.size)]
                listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(features.ravel()), mask=pc.invert(known))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), listed], names=[*kept, into])

    kept = [c for c in rows.columns if c != into]
    schema = StructType([*(rows.schema[c] for c in kept), StructField(into, ArrayType(DoubleType()))])
    return rows.select(*kept, F.col(window).cast("array<double>").alias("_window")).mapInArrow(made, schema)


def pooled(rows: DataFrame, key: str, features: str) -> DataFrame:
    """(key, n, feature, mean, sd, low, high) of each feature over a trial's windows."""
    long = rows.select(key, F.posexplode(features).alias("feature", "v"))
    return long.groupBy(key, "feature").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"), F.min("v").alias("low"), F.max("v").alias("high"))

