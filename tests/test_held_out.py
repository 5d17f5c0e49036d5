"""Leave-one-group-out models against fitting every fold by itself."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinespark.operators import held_out as ho


def fold_by_hand(x, y, own, penalty):
    """Scores of a group's rows by Newton's method on the others', imputed, scaled and weighted by those alone."""
    rest = x[~own]
    with np.errstate(all="ignore"):
        medians = np.array([np.median(c[np.isfinite(c)]) if np.isfinite(c).any() else 0.0 for c in rest.T])
    filled = np.where(np.isfinite(x), x, medians)
    mean, scale = filled[~own].mean(0), filled[~own].std(0)
    z = np.c_[np.ones(len(x)), (filled - mean) / np.where(scale > 1e-12, scale, 1)]
    t = y[~own]
    w = np.where(t == 1, len(t) / (2 * t.sum()), len(t) / (2 * (1 - t).sum()))
    b, hold = np.zeros(z.shape[1]), np.r_[1e-9, np.full(x.shape[1], penalty)]
    for _ in range(60):
        p = 1 / (1 + np.exp(-z[~own] @ b))
        b -= np.linalg.solve((z[~own] * (w * p * (1 - p))[:, None]).T @ z[~own] + np.diag(hold), z[~own].T @ (w * (p - t)) + hold * b)
    return 1 / (1 + np.exp(-z[own] @ b))


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    n, d = 240, 4
    x = rng.normal(size=(n, d)) * [1, 5, 0.2, 1] + [0, 100, 0, 0]
    y = (x[:, 0] + (x[:, 1] - 100) / 5 + rng.normal(size=n) > 0.6).astype(int)
    x[rng.random((n, d)) < 0.15] = np.nan
    group = np.where(rng.random(n) < 0.35, 0, rng.integers(1, 9, n))  # one group has a third of all rows
    x[group == 3, 2] = np.nan
    x[:, 3] = np.where(group == 5, x[:, 3], 7.0)  # constant outside of one group
    rows = [(k, None if g == 8 else int(g), int(c), [None if not np.isfinite(e) else float(e) for e in v]) for k, (g, c, v) in enumerate(zip(group, y, x, strict=True))]
    rows += [(1000, 1, None, rows[0][3]), (1001, 1, 1, None)]
    return spark.createDataFrame(rows, "id long, person long, label int, v array<double>").repartition(5), x, y, group


def test_medians_without_each_group(table):
    df, x, _, group = table
    rows = df.filter("v IS NOT NULL AND label IS NOT NULL").select(F.col("person").alias("g"), "label", F.col("v").alias("x"))
    got = {(r.g, r.k): r.median for r in ho.held_out_medians(rows).collect()}
    for g in range(9):
        for k in range(4):
            rest = x[group != g, k]
            assert got[None if g == 8 else g, k] == pytest.approx(float(np.median(rest[np.isfinite(rest)])), abs=1e-12), (g, k)


def test_scores_equal_folds_fitted_alone(table, monkeypatch):
    monkeypatch.setattr(ho, "FOLDS", 4)
    df, x, y, group = table
    got = {r.id: r.score for r in ho.leave_one_group_out(df, "person", "label", "v").collect()}
    assert len(got) == 242 and got[1001] is None and got[1000] is not None
    for g in range(9):
        own = group == g
        assert [got[k] for k in np.flatnonzero(own)] == pytest.approx(fold_by_hand(x, y, own, 1.0).tolist(), abs=2e-4), g


def test_one_class_or_nothing(table):
    df = table[0]
    assert ho.leave_one_group_out(df.withColumn("label", F.lit(1)), "person", "label", "v").filter("score IS NOT NULL").isEmpty()
    assert ho.leave_one_group_out(df.limit(0), "person", "label", "v").count() == 0
    alone = ho.leave_one_group_out(df.filter("person = 1"), "person", "label", "v")
    assert alone.filter("score IS NOT NULL").isEmpty() and alone.count() == df.filter("person = 1").count()
