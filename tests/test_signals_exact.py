"""Filters, peaks and orientation: known answers, and trials in blocks against whole ones."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from kinespark.operators import filters, fusion, peaks, signals


def frame(spark, trials):
    rows = [(k, i, *map(float, np.atleast_1d(v))) for k, x in trials.items() for i, v in enumerate(x)]
    width = len(rows[0]) - 2
    return spark.createDataFrame(rows, "k string, i long, " + ", ".join(f"v{c} double" for c in range(width))).repartition(5)


def by_trial(rows, *columns):
    found = {}
    for r in sorted(rows, key=lambda r: (r.k, r.idx)):
        found.setdefault(r.k, []).append([r[c] for c in columns])
    return {k: np.array(v) for k, v in found.items()}


def test_responses_of_the_designs():
    """Magnitudes of the 4th-order band-pass of 0.5 to 20 Hz, and of the other kinds at their edges and beyond."""
    band = filters.butterworth(4, 0.5, 20, 100)
    assert np.allclose(np.abs(filters.response(band, np.array([0.3, 0.5, 3, 18, 20, 25]), 100)), [0.1216, 0.7071, 1.0, 0.8702, 0.7071, 0.2582], atol=1e-4)
    for order in (1, 2, 3, 5):
        low, high = filters.butterworth(order, None, 10, 100), filters.butterworth(order, 10, None, 100)
        f = np.array([2.0, 10.0, 31.0])
        ratio = np.tan(np.pi * f / 100) / np.tan(np.pi * 10 / 100)
        assert np.allclose(np.abs(filters.response(low, f, 100)), 1 / np.sqrt(1 + ratio ** (2 * order)))
        assert np.allclose(np.abs(filters.response(high, f, 100)), 1 / np.sqrt(1 + ratio ** (-2 * order)))
        assert np.allclose(np.abs(filters.response(filters.butterworth(order, 2, 10, 100), np.array([2.0, 10.0]), 100)), 0.5**0.5)
    for bad in ((0, 1, 2), (2, None, None), (2, 5, 4), (2, None, 50)):
        with pytest.raises(ValueError):
            filters.butterworth(bad[0], bad[1], bad[2], 100)


def test_cascade_equals_its_difference_equations():
    x = np.random.default_rng(1).normal(size=(333, 2))
    sections = filters.butterworth(3, 0.5, 20, 100)
    cascade = filters.Cascade(sections)
    want = x
    for b0, b1, b2, a1, a2 in sections:
        y = np.zeros_like(want)
        for k in range(len(want)):
            y[k] = b0 * want[k] + (b1 * want[k - 1] - a1 * y[k - 1] if k else 0) + (b2 * want[k - 2] - a2 * y[k - 2] if k > 1 else 0)
        want = y
    got, state = cascade.run(x, np.zeros((6, 2)))
    assert np.allclose(got, want, atol=1e-10)
    first, middle = cascade.run(x[:100], np.zeros((6, 2)))
    rest, end = cascade.run(x[100:], middle)
    assert np.allclose(np.concatenate([first, rest]), got, atol=1e-10) and np.allclose(end, state, atol=1e-10)
    assert np.allclose(cascade.run(np.full((50, 1), 4.0), cascade.steady[:, None] * 4)[0], cascade.run(np.full((9000, 1), 4.0), np.zeros((6, 1)))[0][-1], atol=1e-6)


@pytest.mark.parametrize("edges", [(4, 0.5, 20), (4, None, 20), (2, None, 0.1), (3, 0.5, None)])
def test_blocks_are_filtered_as_the_whole(spark, edges):
    """Several blocks, a last block shorter than the padding, one block, one block exactly, and hardly any rows."""
    rng = np.random.default_rng(2)
    trials = {"several": 100 + np.cumsum(rng.normal(size=(2071, 2)), 0), "tail": rng.normal(size=(1005, 2)) + 9.81, "one": rng.normal(size=(150, 2)), "exact": rng.normal(size=(200, 2)), "few": rng.normal(size=(5, 2))}
    sections = filters.butterworth(*edges, 100)
    got = by_trial(filters.zero_phase(frame(spark, trials), ["k"], "i", ["v0", "v1"], sections, ["y0", "y1"], block=200).collect(), "idx", "v0", "y0", "y1")
    for k, x in trials.items():
        want = filters.Cascade(sections).both_ways(x)
        assert (got[k][:, 0] == np.arange(len(x))).all() and (got[k][:, 1] == x[:, 0]).all()
        assert np.abs(got[k][:, 2:] - want).max() < 1e-9 * max(1, np.abs(x).max())
    assert (got["few"][:, 2:] == trials["few"]).all()


def peaks_by_hand(x, distance, height=-np.inf):
    n, i, found, kept = len(x), 1, [], []
    while i < n - 1:
        j = i
        while j < n - 1 and x[j + 1] == x[i]:
            j += 1
        if j < n - 1 and x[i - 1] < x[i] > x[j + 1] and x[i] >= height:
            found.append((i + j) // 2)
        i = j + 1
    for k in sorted(found, key=lambda k: (-x[k], k)):
        if all(abs(k - other) >= distance for other in kept):
            kept.append(k)
    rows = []
    for k in sorted(kept):
        low = []
        for way in (-1, 1):
            at, least = k, x[k]
            while 0 <= at < n and x[at] <= x[k]:
                least, at = min(least, x[at]), at + way
            low.append(least)
        rows.append((k, float(x[k]), float(x[k] - max(low))))
    return rows


def test_peaks_by_definition():
    assert [p[0] for p in peaks_by_hand([0, 1, 2, 2, 3, 1], 1)] == [4] == peaks.whole_peaks(np.array([0, 1, 2, 2, 3, 1.0]), 1)[0].tolist()
    rng = np.random.default_rng(3)
    for _ in range(300):
        x, distance = rng.integers(0, rng.integers(2, 9), rng.integers(1, 60)).astype(float), int(rng.integers(1, 8))
        assert list(zip(*(c.tolist() for c in peaks.whole_peaks(x, distance)), strict=True)) == peaks_by_hand(x, distance)


@pytest.mark.parametrize("distance", [1, 3, 9])
def test_peaks_of_blocks_equal_the_whole(spark, distance):
    """Plateaus longer than blocks, bases far away, rising and falling staircases, chains of neighbours over many blocks."""
    rng = np.random.default_rng(4)
    stairs = np.repeat(np.arange(40.0), 3) + np.tile([0, 1.5, 0], 40)
    trials = {
        "noise": np.cumsum(rng.normal(size=900)), "steps": rng.integers(0, 4, 700).astype(float), "plateaus": np.repeat(rng.integers(0, 5, 25).astype(float), rng.integers(1, 60, 25)),
        "rising": stairs, "falling": stairs[::-1].copy(), "flat": np.ones(300), "chain": np.tile([0.0, 1.0], 200) * np.linspace(1, 2, 400), "short": rng.normal(size=15), "one": np.ones(1),
    }
    df = frame(spark, trials)
    got = by_trial(peaks.peaks(df, ["k"], "i", F.col("v0"), distance, block=16).collect(), "idx", "height", "prominence")
    for k, x in trials.items():
        assert [tuple(r) for r in got.get(k, [])] == [(float(i), v, p) for i, v, p in peaks_by_hand(x, distance)], k
    high = by_trial(peaks.peaks(df, ["k"], "i", F.col("v0"), distance, percentile=60, block=16).collect(), "idx")
    for k, x in trials.items():
        assert [r[0] for r in high.get(k, [])] == [i for i, *_ in peaks_by_hand(x, distance, np.percentile(x, 60))], k


def test_prominence_keeps_strikes_of_any_size(spark):
    """Impulses every second, deep or shallow, on a level line: all are found by prominence; a floor drops the shallow ones."""
    line = {}
    for k, depth in (("deep", 8.0), ("shallow", 2.5)):
        x = np.full(2000, -9.8)
        for s in np.arange(50, 1800, 100):
            x[s : s + 5] -= depth
        line[k] = -x + np.arange(2000) % 3 * 0.01
    found = peaks.peaks(frame(spark, line), ["k"], "i", F.col("v0"), 50)
    near = lambda rows, k: sum(any(abs(r.idx - s) <= 5 for r in rows if r.k == k) for s in range(50, 1800, 100))
    rows = peaks.by_prominence(found, ["k"], 20).collect()
    assert near(rows, "deep") == near(rows, "shallow") == 18
    assert {r.k for r in peaks.by_prominence(found, ["k"], 0, floor=5).collect()} == {"deep"}
    own = peaks.by_prominence(found.withColumn("c", F.col("k")), ["k", "c"], 100, cohort="c", by_cohort={"deep": 0.0}).groupBy("k").count().collect()
    assert {r.k: r["count"] for r in own}["deep"] == found.filter("k = 'deep'").count()


def by_matrices(acc, gyr, mag, dt, beta):
    """The gradient step with its matrices written out."""
    q, out = np.array([1.0, 0, 0, 0]), [np.array([1.0, 0, 0, 0])]
    for a, g, m in zip(acc[1:], gyr[1:], mag[1:] if mag is not None else [None] * (len(acc) - 1), strict=True):
        w, x, y, z = q
        if np.linalg.norm(g) > 0:
            rate = 0.5 * np.array([[-x, -y, -z], [w, -z, y], [z, w, -x], [-y, x, w]]) @ g
            if np.linalg.norm(a) > 0:
                a = a / np.linalg.norm(a)
                f = [2 * (x * z - w * y) - a[0], 2 * (w * x + y * z) - a[1], 2 * (0.5 - x * x - y * y) - a[2]]
                jac = [[-2 * y, 2 * z, -2 * w, 2 * x], [2 * x, 2 * w, 2 * z, 2 * y], [0, -4 * x, -4 * y, 0]]
                if m is not None and np.linalg.norm(m) > 0:
                    m = m / np.linalg.norm(m)
                    turn = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])
                    h = turn @ m
                    b = np.array([np.hypot(h[0], h[1]), 0, h[2]])
                    f += list(turn.T @ b - m)
                    step = 1e-6
                    at = lambda p: np.array([2 * b[0] * (0.5 - p[2] ** 2 - p[3] ** 2) + 2 * b[2] * (p[1] * p[3] - p[0] * p[2]), 2 * b[0] * (p[1] * p[2] - p[0] * p[3]) + 2 * b[2] * (p[0] * p[1] + p[2] * p[3]), 2 * b[0] * (p[0] * p[2] + p[1] * p[3]) + 2 * b[2] * (0.5 - p[1] ** 2 - p[2] ** 2)])
                    jac += [list(r) for r in np.stack([(at(q + step * e) - at(q - step * e)) / (2 * step) for e in np.eye(4)], 1)]
                slope = np.array(jac).T @ np.array(f)
                if np.linalg.norm(slope) > 0:
                    rate = rate - beta * slope / np.linalg.norm(slope)
            q = q + rate * dt
            q = q / np.linalg.norm(q)
        out.append(q)
    return np.array(out)


@pytest.mark.parametrize("field", [False, True])
def test_orientation_is_one_unbroken_run(spark, field):
    """Trials longer than an Arrow batch go on over batches; rows without a turn or acceleration, and missing values."""
    rng = np.random.default_rng(6)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        trials = {}
        for k, n in (("a", 1500), ("b", 400), ("c", 1)):
            x = np.c_[rng.normal(size=(n, 3)) + [0, 0, 9.81], rng.normal(size=(n, 3)), rng.normal(size=(n, 3)) + [20, 0, -40]]
            x[n // 3, 3:6], x[n // 2, :3], x[n // 4, 6:] = 0, 0, 0
            trials[k] = x
        df = frame(spark, trials)
        a, g, m = ["v0", "v1", "v2"], ["v3", "v4", "v5"], ["v6", "v7", "v8"]
        got = by_trial(fusion.orientation(df, ["k"], "i", a, g, 0.01, mag=m if field else None).collect(), "quat_w", "quat_x", "quat_y", "quat_z", "roll", "pitch", "tilt")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k, x in trials.items():
        want = by_matrices(x[:, :3], x[:, 3:6], x[:, 6:] if field else None, 0.01, 0.1)
        assert np.abs(got[k][:, :4] - want).max() < (1e-6 if field else 1e-12)
        assert (got[k][:, :4] == fusion.quaternions(x[:, :3], x[:, 3:6], x[:, 6:] if field else None, 0.01)).all()
        w, i, j, l = want.T
        assert np.allclose(np.cos(got[k][:, 6]), 1 - 2 * (i * i + j * j), atol=1e-5)
    gap = df.filter("k = 'b'").withColumn("v4", F.when(F.col("i") != 200, F.col("v4"))).withColumn("v3", F.when(F.col("i") != 201, F.col("v3")).otherwise(float("nan")))
    assert fusion.orientation(gap, ["k"], "i", a, g, 0.01).filter("isnan(quat_w) OR quat_w IS NULL").count() == 0


def test_still_sensor_turns_to_gravity():
    """A sensor that lies on its side, hardly turning, ends with its gravity upright: pitch and roll agree with the acceleration."""
    acc, gyr = np.tile([0.0, 6.0, 8.0], (4000, 1)), np.full((4000, 3), 1e-9)
    w, x, y, z = fusion.quaternions(acc, gyr, None, 0.01)[-1]
    assert np.allclose([2 * (x * z - w * y), 2 * (w * x + y * z), 1 - 2 * (x * x + y * y)], [0, 0.6, 0.8], atol=2e-3)


def test_pairs_of_lags_are_counted_in_small_tasks(spark, monkeypatch):
    """Partitions of a size in bytes are few, and the pairs are fifty times their rows."""
    monkeypatch.setattr(signals, "TASK_ROWS", 500, raising=False)
    df = spark.range(8000).selectExpr("id % 80 AS k", "id AS i", "sin(id * id) AS v").withColumn("i", F.row_number().over(Window.partitionBy("k").orderBy("i")) - 1)
    made = signals.mutual_information(df, ["k"], "i", "v")
    made.write.format("noop").mode("overwrite").save()
    assert made.rdd.getNumPartitions() >= 16 and made.select("k").distinct().count() == 80


def test_short_trials_go_side_by_side(spark):
    """Trials of many lengths in one product give what each gives alone; unknown values stay unknown. A call a trial took more than its work."""
    rng = np.random.default_rng(8)
    for edges in ((4, 0.5, 20, 100), (2, None, 0.3, 100), (3, 5, None, 100)):
        cascade = filters.Cascade(filters.butterworth(*edges))
        sizes = np.r_[rng.integers(1, 400, 60), cascade.pad, cascade.pad + 1, 2000]
        bounds = np.r_[0, np.cumsum(sizes)]
        x = rng.normal(size=(bounds[-1], 2))
        x[bounds[5]] = np.nan
        want = np.concatenate([cascade.both_ways(x[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
        assert np.allclose(cascade.both_ways_together(x, bounds), want, atol=1e-9, equal_nan=True)
    df = frame(spark, {"a": np.sin(np.arange(90)), "b": np.cos(np.arange(70))}).withColumn("v0", F.when(F.col("i") != 3, F.col("v0")))
    made = filters.zero_phase(df, ["k"], "i", ["v0"], filters.butterworth(2, None, 10, 100), ["y"])
    assert made.filter("v0 is null").count() == 2 and made.count() == 160
    for plan in (made, peaks.peaks(df, ["k"], "i", F.col("v0"), 5)):
        assert "FlatMapGroups" not in plan._jdf.queryExecution().optimizedPlan().toString()
