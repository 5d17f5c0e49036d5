"""Isotonic fits in ranges against pooling by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinespark.operators import calibration as cal


def pooled(x, y):
    """Values at the distinct scores, by pooling neighbours that fall."""
    xs = sorted(set(x))
    blocks = []
    for v in xs:
        here = [b for a, b in zip(x, y, strict=True) if a == v]
        blocks.append([sum(here), len(here), 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return xs, [t / n for t, n, k in blocks for _ in range(k)]


@pytest.mark.parametrize("kind", ["noise", "ties", "rising", "falling", "one class", "one score"])
def test_fit_equals_pooling(spark, monkeypatch, kind):
    """Many small ranges joined in pairs; between and beyond the scores of the fit as well."""
    monkeypatch.setattr(cal, "FAN", 2)
    rng = np.random.default_rng(4)
    n = 400
    x = {"ties": rng.integers(0, 12, n) / 12, "one score": np.full(n, 0.5)}.get(kind, rng.random(n))
    y = {"rising": x, "falling": -x, "one class": np.ones(n)}.get(kind, (rng.random(n) < x).astype(float))
    asked = np.r_[x[:50], rng.random(200) * 1.4 - 0.2]
    rows = [(k, float(a), float(b), True) for k, (a, b) in enumerate(zip(x, y, strict=True))] + [(n + k, float(a), None, False) for k, a in enumerate(asked)] + [(-1, None, 1.0, True), (-2, float("nan"), 1.0, True)]
    df = spark.createDataFrame(rows, "id long, s double, y double, fit boolean").repartition(6)
    got = {r.id: r.s_calibrated for r in cal.isotonic(df, F.col("fit"), {"s": F.col("y")}).collect()}
    xs, values = pooled(x.tolist(), y.tolist())
    assert len(got) == len(rows) and got[-1] is None and got[-2] is None
    for k, a in enumerate([*x, *asked]):
        assert got[k] == pytest.approx(float(np.interp(a, xs, values)), abs=1e-9)


def test_classes_sum_to_one_and_nothing_to_fit(spark):
    rng = np.random.default_rng(5)
    rows = [(k, float(a), float(1 - a), int(rng.random() < a)) for k, a in enumerate(rng.random(100))]
    df = spark.createDataFrame(rows, "id long, a double, b double, y int")
    made = cal.isotonic(df, F.col("id") % 2 == 0, {"a": F.col("y") == 1, "b": F.col("y") == 0})
    assert made.filter("abs(a_calibrated + b_calibrated - 1) > 1e-9 AND a_calibrated + b_calibrated <> 0").isEmpty() and made.count() == 100
    assert cal.isotonic(df, F.lit(False), {"a": F.col("y") == 1}).filter("a_calibrated IS NOT NULL").isEmpty()


def test_no_frame_is_gone_through_for_every_row(spark):
    """A frame from a row to its partition's end takes the square of a range's rows; few knots used to make one range."""
    rows = [(k, k / 1000, float(k >= 500)) for k in range(1000)]
    df = spark.createDataFrame(rows, "id long, s double, y double")
    made = cal.isotonic(df, F.lit(True), {"s": F.col("y")})
    plan = made._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "unboundedpreceding" in plan and "unboundedfollowing" not in plan
    sizes = [r["count"] for r in df.groupBy(cal.place(cal.range_cuts(df, "s")[0], F.col("s"))).count().collect()]
    assert max(sizes) < 500 and made.filter("s_calibrated <> y").isEmpty()


def test_later_values_come_from_the_descending_order(spark):
    from kinespark.operators import quality, signals

    df = spark.createDataFrame([(1, k, None if k % 3 else float(k), "ab"[k % 2]) for k in range(10)], "u long, at long, v double, kind string")
    made = (quality.interpolate(df, ["u"], "at", "v", "x"), quality.fill_back_then_forward(df, ["u"], "at", "v", "x"), signals.next_event(df, ["u"], ["at"], "kind", "a", "b", F.col("at"), "x"))
    for m in made:
        assert "unboundedfollowing" not in m._jdf.queryExecution().optimizedPlan().toString().lower()
    line, filled, after = ([r.x for r in m.orderBy("at").collect()] for m in made)
    assert line == list(range(10)) and filled == [0, 3, 3, 3, 6, 6, 6, 9, 9, 9] and after == [1, 3, 5, 7, 9]
