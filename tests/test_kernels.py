"""Features of fixed kernels against convolutions written out."""

import numpy as np
import pytest

from kinespark.operators import kernels as kn


def test_shares_equal_convolutions(spark):
    rng = np.random.default_rng(1)
    windows = rng.normal(size=(30, 40))
    rows = spark.createDataFrame([(k, k % 3, [float(v) for v in w]) for k, w in enumerate(windows)] + [(99, 0, None)], "id long, y int, w array<double>")
    bank = kn.fit_bank(rows, "id", "w", features=420)
    assert bank.size == 420 and set(bank.biases) == {1, 2, 3, 4} | set(bank.biases) and max(bank.biases) * 8 < 40
    got = {r.id: r.features for r in kn.kernel_shares(rows, "w", bank).collect()}
    assert got[99] is None
    for k, w in enumerate(windows):
        want = []
        for dilation, biases in bank.biases.items():
            padded = np.pad(w, 4 * dilation)
            for places, own in zip(kn.PLACES, biases, strict=True):
                weights = np.full(9, -1.0)
                weights[list(places)] = 2
                response = np.array([sum(weights[j] * padded[t + j * dilation] for j in range(9)) for t in range(40)])
                want += [(response > b).mean() for b in own]
        # a bias may be a response itself, which rounding can put on either side
        assert np.mean(np.abs(np.array(got[k]) - want) > 1e-9) < 0.02 and np.abs(np.array(got[k]) - want).max() < 0.05 + 1e-9
    means = {(r.y, r.feature): (r.n, r.mean, r.high) for r in kn.pooled(kn.kernel_shares(rows.dropna(), "w", bank), "y", "features").collect()}
    mine = np.array([got[k] for k in range(0, 30, 3)])
    assert len(means) == 3 * 420 and means[0, 7] == (10, pytest.approx(mine[:, 7].mean()), pytest.approx(mine[:, 7].max()))


def test_reference_size(spark):
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(k, [float(v) for v in rng.normal(size=64)]) for k in range(20)], "id long, w array<double>")
    bank = kn.fit_bank(rows, "id", "w")
    assert bank.size == 84 * 119
    assert all(len(r.features) == 9996 for r in kn.kernel_shares(rows, "w", bank).collect())
    with pytest.raises(ValueError):
        kn.fit_bank(rows.limit(0), "id", "w")


def test_features_go_out_a_few_windows_at_a_time(spark, monkeypatch):
    """A batch of windows is not a batch of features: these are some hundred times as large."""
    monkeypatch.setattr(kn, "AT_ONCE", 4, raising=False)
    rows = spark.range(50).selectExpr("id", "IF(id % 7 = 0, NULL, transform(sequence(1, 32), k -> sin(k * id))) AS w").coalesce(1)
    bank = kn.fit_bank(rows, "id", "w", features=420)
    made = {r.id: r.features for r in kn.kernel_shares(rows, "w", bank).collect()}
    assert [k for k, f in made.items() if f is None] == list(range(0, 50, 7)) and all(len(f) == bank.size for f in made.values() if f)
    shares = kn.shares

    def few(x, bank):
        assert len(x) <= 4
        return shares(x, bank)

    monkeypatch.setattr(kn, "shares", few)
    assert {r.id: r.features for r in kn.kernel_shares(rows, "w", bank).collect()} == made
