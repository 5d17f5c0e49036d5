"""Orientation of a sensor from its rates, gravity and, where there is one, the magnetic field.

Rows are dealt out by trial, sorted in each task and read as one stream; the only thing kept between rows is the quaternion
of the trial at hand, so a trial of any length is computed without a restart and in constant memory.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Quaternion = tuple[float, float, float, float]


def turned(q: Quaternion, gyr: Sequence[float], acc: Sequence[float], mag: Sequence[float] | None, dt: float, beta: float) -> Quaternion:
    """The next quaternion (w x y z): the rates' turn, less beta along the gradient of what gravity and field contradict.

    Without a turn, or with a missing rate, it stays; without acceleration only the rates count, without a field it is left out.
    """
    gx, gy, gz = gyr
    if not gx * gx + gy * gy + gz * gz > 0:
        return q
    w, x, y, z = q
    dw, dx, dy, dz = 0.5 * (-x * gx - y * gy - z * gz), 0.5 * (w * gx + y * gz - z * gy), 0.5 * (w * gy - x * gz + z * gx), 0.5 * (w * gz + x * gy - y * gx)
    size = sqrt(acc[0] ** 2 + acc[1] ** 2 + acc[2] ** 2)
    if size > 0:
        f1 = 2 * (x * z - w * y) - acc[0] / size
        f2 = 2 * (w * x + y * z) - acc[1] / size
        f3 = 2 * (0.5 - x * x - y * y) - acc[2] / size
        # the gradient of half the squares of f, by w, x, y, z
        sw, sx, sy, sz = -2 * y * f1 + 2 * x * f2, 2 * z * f1 + 2 * w * f2 - 4 * x * f3, -2 * w * f1 + 2 * z * f2 - 4 * y * f3, 2 * x * f1 + 2 * y * f2
        field = sqrt(mag[0] ** 2 + mag[1] ** 2 + mag[2] ** 2) if mag is not None else 0.0
        if field > 0:
            m1, m2, m3 = mag[0] / field, mag[1] / field, mag[2] / field
            # the field in the world's frame has a level part bx and an upright part bz
            h1 = m1 * (1 - 2 * (y * y + z * z)) + 2 * m2 * (x * y - w * z) + 2 * m3 * (x * z + w * y)
            h2 = 2 * m1 * (x * y + w * z) + m2 * (1 - 2 * (x * x + z * z)) + 2 * m3 * (y * z - w * x)
            bz = 2 * m1 * (x * z - w * y) + 2 * m2 * (y * z + w * x) + m3 * (1 - 2 * (x * x + y * y))
            bx = sqrt(h1 * h1 + h2 * h2)
            f4 = 2 * bx * (0.5 - y * y - z * z) + 2 * bz * (x * z - w * y) - m1
            f5 = 2 * bx * (x * y - w * z) + 2 * bz * (w * x + y * z) - m2
            f6 = 2 * bx * (w * y + x * z) + 2 * bz * (0.5 - x * x - y * y) - m3
            sw += -2 * bz * y * f4 + (-2 * bx * z + 2 * bz * x) * f5 + 2 * bx * y * f6
            sx += 2 * bz * z * f4 + (2 * bx * y + 2 * bz * w) * f5 + (2 * bx * z - 4 * bz * x) * f6
            sy += (-4 * bx * y - 2 * bz * w) * f4 + (2 * bx * x + 2 * bz * z) * f5 + (2 * bx * w - 4 * bz * y) * f6
            sz += (-4 * bx * z + 2 * bz * x) * f4 + (-2 * bx * w + 2 * bz * y) * f5 + 2 * bx * x * f6
        slope = sqrt(sw * sw + sx * sx + sy * sy + sz * sz)
        if slope > 0:
            dw, dx, dy, dz = dw - beta * sw / slope, dx - beta * sx / slope, dy - beta * sy / slope, dz - beta * sz / slope
    w, x, y, z = w + dw * dt, x + dx * dt, y + dy * dt, z + dz * dt
    size = sqrt(w * w + x * x + y * y + z * z)
    return w / size, x / size, y / size, z / size


def quaternions(acc: np.ndarray, gyr: np.ndarray, mag: np.ndarray | None, dt: float, beta: float = 0.1) -> np.ndarray:
    """A whole trial's quaternions; the first row is level."""
    q, out = (1.0, 0.0, 0.0, 0.0), np.empty((len(acc), 4))
    for k, (a, g) in enumerate(zip(acc.tolist(), gyr.tolist(), strict=True)):
        if k:
            q = turned(q, g, a, None if mag is None else mag[k].tolist(), dt, beta)
        out[k] = q
    return out


def orientation(df: DataFrame, keys: Sequence[str], idx: str, acc: Sequence[str], gyr: Sequence[str], dt: float, mag: Sequence[str] | None = None, beta: float = 0.1) -> DataFrame:
    """(keys, idx, quat_w, quat_x, quat_y, quat_z, roll, pitch, tilt) of every row, in radians. Rates are in radians a second.

    A null or non-finite rate, acceleration or field counts as missing for that row.
    """
    names, given = list(keys), [*acc, *gyr, *(mag or [])]
    zero = lambda c: F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c).cast("double")).otherwise(0.0)
    rows = df.select(*names, F.col(idx).cast("long").alias("idx"), *(zero(c).alias(f"_{k}") for k, c in enumerate(given)))
    rows = rows.repartition(*names).sortWithinPartitions(*names, "idx")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trial, q = None, (1.0, 0.0, 0.0, 0.0)
        for batch in batches:
            columns = [batch.column(f"_{k}").to_pylist() for k in range(len(given))]
            trials = list(zip(*(batch.column(k).to_pylist() for k in names), strict=True))
            out = []
            for key, row in zip(trials, zip(*columns, strict=True), strict=True):
                if key != trial:
                    trial, q = key, (1.0, 0.0, 0.0, 0.0)
                else:
                    q = turned(q, row[3:6], row[:3], row[6:] or None, dt, beta)
                out.append(q)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in [*names, "idx"]), *(pa.array(c, pa.float64()) for c in (zip(*out, strict=True) if out else [[]] * 4))], names=[*names, "idx", "quat_w", "quat_x", "quat_y", "quat_z"])

    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in names)
    made = rows.mapInArrow(run, f"{kinds}, idx long, quat_w double, quat_x double, quat_y double, quat_z double")
    w, x, y, z = (F.col(f"quat_{c}") for c in "wxyz")
    across, over, up = 2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)
    sine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * (w * y - z * x)))
    return made.withColumns({"roll": F.atan2(over, up), "pitch": F.asin(sine), "tilt": F.atan2(F.sqrt(across * across + over * over), F.greatest(up, F.lit(1e-9)))})
