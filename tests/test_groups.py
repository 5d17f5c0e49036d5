"""Groups of a sorted stream against grouped aggregates: groups over batches, null keys, lists."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinespark.functions import groups
from kinespark.operators import signals


@pytest.mark.parametrize("rows", [3, 64, 10_000])
def test_groups_are_whole_and_in_order(spark, rows):
    df = spark.range(2000).selectExpr("IF(id % 37 = 0, NULL, id % 37) AS k", "concat('s', id % 3) AS s", "id AS i", "array(id * 1D, 2D) AS x", "IF(id % 2 = 0, 1, 0) AS w")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        made = groups.streamed(df, ["k", "s"], ["i"], lambda g: {"n": np.array([len(g["i"])]), "t": np.array([g["x"][:, 0].sum()]), "up": np.array([int((np.diff(g["i"]) > 0).all())])}, "n long, t double, up long")
        got = sorted(((r.k or 0), r.s, r.n, r.t, r.up) for r in made.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = df.groupBy("k", "s").agg(F.count("*").alias("n"), F.sum(F.col("x")[0]).alias("t")).collect()
    assert got == sorted(((r.k or 0), r.s, r.n, r.t, 1) for r in want)


def per_trial(df):
    return "InPandas" in df._jdf.queryExecution().optimizedPlan().toString()


def samples(spark):
    return spark.range(4000).selectExpr("id % 40 AS k", "floor(id / 40) AS i", "sin(id * id) AS v")


def test_entropies_call_no_function_a_trial(spark):
    """A call a trial took more than its work."""
    assert not per_trial(signals.entropies(samples(spark), ["k"], "i", "v"))


def test_spectra_call_no_function_a_trial(spark):
    made = signals.welch_psd(samples(spark), ["k"], "i", "v", 100)
    assert not per_trial(made) and made.select("k").distinct().count() == 40


def test_blocks_call_no_function_a_trial(spark):
    made = signals.by_blocks(samples(spark), ["k"], "i", "v", lambda x: {"y": signals.resample(x, 25, 16)}, "y double", up=25, down=16)
    assert not per_trial(made) and made.count() == 40 * 157


def steps_in_python(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")


def test_spectra_compute_their_input_once(spark):
    """A join with counts computed the resampled rows twice."""
    made = signals.by_blocks(samples(spark), ["k"], "i", "v", lambda x: {"value": signals.resample(x, 25, 16)}, "value double", up=25, down=16)
    assert steps_in_python(signals.welch_psd(made, ["k"], "idx", "value", 156.25)) == 2


def test_bands_share_one_spectrum(spark):
    """Each band had a spectrum of its own."""
    from kinespark.plans.registry import queries

    assert steps_in_python(queries()["f16_f18_band_power"](spark, "/root/testdata/sf0.001")) == 1


def test_trials_of_all_lengths_have_their_own_spectra(spark):
    """Trials of several segment sizes in one batch, one of them with a value that is no number."""
    rng = np.random.default_rng(3)
    trials = {k: rng.normal(size=n) for k, n in enumerate([1, 2, 3, 5, 64, 65, 66, 67, 67, 130, 700, 700])}
    trials[7][3] = np.nan
    rows = [(k, i, float(v)) for k, x in trials.items() for i, v in enumerate(x)]
    psd = signals.welch_psd(spark.createDataFrame(rows, "k long, i long, v double"), ["k"], "i", "v", 100, run_of=3).orderBy("k", "freq").collect()
    for k, x in trials.items():
        got = np.array([(r.freq, r.power) for r in psd if r.k == k]).reshape(-1, 2)
        want = np.stack(signals.welch(x, 100), 1) if len(x) > 1 else np.zeros((0, 2))
        assert got.shape == want.shape and np.allclose(got, want, equal_nan=True)


def test_several_bands_at_once_equal_each_band(spark):
    psd = signals.welch_psd(samples(spark), ["k"], "i", "v", 100)
    bands = {"low": (0.5, 3.0), "high": (3.0, 8.0), "none": (3.1, 3.2)}
    made = {r.k: r for r in signals.band_powers(psd, ["k"], bands).collect()}
    assert len(made) == 40 and all(r.none == 0 for r in made.values())
    for name in ("low", "high"):
        for r in signals.band_power(psd, ["k"], *bands[name]).collect():
            assert made[r.k][name] == pytest.approx(r.band_power)


def test_resampling_equals_the_convolution():
    """By phases, it gives what stuffing with zeros and the whole convolution give."""
    rng = np.random.default_rng(4)
    for n, up, down in ((1, 25, 16), (67, 25, 16), (500, 2, 3), (20_000, 3, 1)):
        x, half = rng.normal(size=n), 10 * max(up, down)
        h = np.sinc(np.arange(-half, half + 1) / max(up, down)) / max(up, down) * np.kaiser(2 * half + 1, 5.0)
        stuffed = np.zeros(n * up)
        stuffed[::up] = x
        assert np.allclose(signals.resample(x, up, down), np.convolve(stuffed, h * up / h.sum())[half : half + n * up][::down], atol=1e-12)


def test_known_numbers_of_rows_are_not_counted_again(spark):
    """The resampling check counted the resampled rows, a shuffle of them all."""
    from kinespark.plans.registry import queries

    plan = queries()["g11_resample_check"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 3 and plan.count("count(1)") == 2  # two readings of the events, each counted once
