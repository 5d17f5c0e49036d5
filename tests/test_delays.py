"""Delay space in cells against the kernels that hold a whole trial."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinespark.operators import delays, signals

TRIALS = {
    "sine": np.sin(np.arange(500) / 7) + np.random.default_rng(1).normal(size=500) / 50,
    "noise": np.random.default_rng(2).normal(size=430),
    "steps": np.random.default_rng(3).integers(0, 4, 300).astype(float),  # many equal first coordinates
    "short": np.random.default_rng(4).normal(size=40), "tiny": np.arange(9.0), "flat": np.ones(60),
}


@pytest.fixture(scope="module")
def trials(spark):
    rows = [(k, i, float(v), 1 + len(k) % 2, 2 + len(k) % 3) for k, x in TRIALS.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "t string, i long, v double, delay long, dim long").repartition(5)


@pytest.mark.parametrize("cell_rows", [32, 4096])
def test_cells_give_what_the_whole_trial_gives(trials, cell_rows):
    """Every trial with a delay and a dimension of its own."""
    shares = {r.t: r.false_share for r in delays.false_neighbours(trials, ["t"], "i", "v", F.col("delay"), F.col("dim"), cell_rows=cell_rows).collect()}
    slopes = {r.t: r.lyapunov for r in delays.divergence(trials, ["t"], "i", "v", F.col("delay"), F.col("dim"), 8, cell_rows=cell_rows).collect()}
    assert set(shares) == set(slopes) == set(TRIALS)
    for k, x in TRIALS.items():
        delay, dim = 1 + len(k) % 2, 2 + len(k) % 3
        assert shares[k] == pytest.approx(signals.false_neighbours(x, delay, dim), abs=1e-9), k
        want = signals.lyapunov(x, delay, dim, 8)
        assert slopes[k] is None if np.isnan(want) else slopes[k] == pytest.approx(want, abs=1e-9), k


def test_dimension_of_each_trial(trials):
    few = trials.filter("t IN ('sine', 'noise', 'tiny')")
    got = {r.t: r.dim for r in delays.embedding_dimension(few, ["t"], "i", "v", F.col("delay"), high=4, cell_rows=128).collect()}
    assert got == {k: signals.embedding_dimension(TRIALS[k], 1 + len(k) % 2, high=4) for k in ("sine", "noise", "tiny")}


def test_short_trials_go_by_in_a_stream(spark, monkeypatch):
    """A call a trial took more than its work; trials have dimensions of their own."""
    calls, plain = [], delays.streamed
    monkeypatch.setattr(delays, "streamed", lambda *a: calls.append(1) or plain(*a))
    rows = [(k, i, [float((i * 7 + j) % 11) for j in range(2 + k % 3)]) for k in range(12) for i in range(30)]
    points = spark.createDataFrame(rows, "k long, i long, q array<double>")
    got = {(r.k, r.i): r.distance for r in delays.nearest(points, ["k"], F.lit(2)).collect()}
    assert calls == [1] and len(got) == len(rows)
    for k, i, q in rows:
        want = min(sum((a - b) ** 2 for a, b in zip(q, w, strict=True)) ** 0.5 for o, j, w in rows if o == k and abs(i - j) > 2)
        assert abs(got[k, i] - want) < 1e-9


def test_short_trials_take_no_rounds_of_jobs(spark, monkeypatch):
    """A job for each dimension and each step took longer than the work; long trials and those with gaps still take them."""
    rng, calls, plain = np.random.default_rng(6), [], delays.nearest
    monkeypatch.setattr(delays, "nearest", lambda *a, **k: calls.append(1) or plain(*a, **k))
    rows = [(k, i, float(v)) for k in range(8) for i, v in enumerate(rng.normal(size=20 + 6 * k).cumsum())]
    given = spark.createDataFrame(rows, "t long, i long, v double").repartition(3)

    def both(df, cell_rows):
        dims = {r.t: r.dim for r in delays.embedding_dimension(df, ["t"], "i", "v", F.lit(1), high=4, cell_rows=cell_rows).collect()}
        slopes = {r.t: r.lyapunov for r in delays.divergence(df, ["t"], "i", "v", F.lit(3), F.lit(4), 8, cell_rows=cell_rows).collect()}
        return dims, slopes

    dims, slopes = both(given, 4096)
    assert not calls and set(dims) == set(slopes) == set(range(8))
    # the last trials of 3 * 4 places apart have points without a neighbour, which are left out
    for cell_rows, df in ((30, given), (4096, given.filter("t <> 7 OR i <> 40"))):
        others = both(df, cell_rows)
        assert calls and set(others[0]) == set(others[1]) == set(dims)
        for k in range(7 if cell_rows == 4096 else 8):
            assert others[0][k] == dims[k], k
            assert others[1][k] == slopes[k] if slopes[k] is None else others[1][k] == pytest.approx(slopes[k], abs=1e-9), k
        calls.clear()
