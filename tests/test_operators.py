"""The library's operators on tiny frames with known answers, and every query against its SQL."""

import math

import duckdb
import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

import __spark_entry__
from kinespark.functions.mathx import chi2_tail, normal_two_sided
from kinespark.operators import filters, metrics, peaks, quality, signals, stats
from kinespark.plans import registry
from kinespark.streaming import streams

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(rows):
    fix = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else round(float(v), 6) + 0.0 if isinstance(v, int | float) and not isinstance(v, bool) or type(v).__name__ == "Decimal" else str(v)[:10] if hasattr(v, "year") else v
    return sorted(str([fix(v) for v in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    want = duck.execute(SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    assert plain(got.select(*names).collect()) == plain(want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_gap_repair_stops_at_the_first_large_gap(spark):
    df = spark.createDataFrame([("t", c, float(c)) for c in (1, 2, 5, 20, 22)], "k string, c long, v double")
    got = sorted((r.counter, r.value, r.filled) for r in quality.repair_gaps(df, ["k"], ["c"], "c", "v", 5).collect())
    assert got == [(1, 1.0, False), (2, 2.0, False), (3, 3.0, True), (4, 4.0, True), (5, 5.0, False), (20, 20.0, False), (22, 22.0, False)]


def test_gap_repair_keeps_the_order_of_a_wrap(spark):
    df = spark.createDataFrame([(k, c, float(k)) for k, c in enumerate((65533, 65533, 65535, 0, 1, 1, 4, 2, 2))], "i long, c long, v double").withColumn("k", F.lit("t"))
    got = quality.repair_gaps(df, ["k"], ["i"], "c", "v", 5).orderBy("place").collect()
    # of the repeated counters the first stays; the step back ends the repair, and what follows is left alone
    assert [(r.counter, r.filled) for r in got] == [(65533, False), (65534, True), (65535, False), (0, False), (1, False), (2, True), (3, True), (4, False), (2, False), (2, False)]
    assert got[1].value == 1.0 and got[5].value == pytest.approx(4 + 2 / 3)


def test_wrap_is_no_gap(spark):
    df = spark.createDataFrame([(0, 65534), (1, 65535), (2, 0), (3, 3)], "i long, c long").withColumn("k", F.lit("t"))
    assert [(r.idx, r["diff"]) for r in quality.counter_gaps(df, ["k"], ["i"], "c").collect()] == [(3, 3)]


@pytest.mark.parametrize(("bounds", "rows", "status"), [((800, 1200), 1600, "ok"), ((200, 250), 2000, "segment_too_short"), ((900, 800), 2000, "invalid_bounds")])
def test_turns(spark, bounds, rows, status):
    df = spark.range(2000).select(F.lit("t").alias("k"), F.col("id").alias("idx"))
    got = signals.exclude_turns(df, spark.createDataFrame([("t", *bounds)], "k string, start long, end long"), "k", 500)
    assert got.count() == rows and got.first().status == status and got.agg(F.max("new_idx")).first()[0] == rows - 1


def test_trend(spark):
    df = spark.createDataFrame([("p", k, float(k)) for k in (1, 2, 3, 4)] + [("q", 1, 5.0), ("r", 1, 1.0), ("r", 2, None), ("r", 3, 3.0)], "p string, k int, x double")
    got = {r.p: r for r in signals.participant_trend(df, "p", ["k"], "x").collect()}
    assert (got["p"].mean, got["p"].range, got["p"].trend) == (2.5, 3.0, 1.0)
    assert got["q"].range == 0 and got["q"].trend is None and got["r"].trend == 2.0


def test_kernels():
    t = np.arange(1000) / 100
    x = 5 + np.sin(2 * np.pi * 3 * t)
    y = filters.Cascade(filters.butterworth(4, 0.5, 20, 100)).both_ways(x[:, None])[:, 0]
    assert abs(y[200:800].mean()) < 0.02 and np.corrcoef(y[200:800], x[200:800])[0, 1] > 0.99
    f, p = signals.welch(x, 100)
    assert abs(f[p.argmax()] - 3) < 0.5
    assert len(peaks.whole_peaks(x, 20, 5.5)[0]) == 30
    assert len(signals.resample(x, 25, 16)) == 1563 and abs(signals.resample(x, 25, 16)[300:1200].mean() - 5) < 0.05
    noise = np.random.default_rng(0).normal(size=2000)
    assert 0.3 < signals.dfa(noise) < 0.7 and 1.2 < signals.dfa(np.cumsum(noise)) < 1.8
    assert signals.sample_entropy(noise[:300]) > signals.sample_entropy(np.sin(t[:300] * 9))


@pytest.fixture(scope="module")
def trials(spark):
    """A trial of several blocks and one shorter than a block."""
    rng = np.random.default_rng(5)
    signals_ = {"long": 5 + np.sin(np.arange(9000) / 7) + rng.normal(size=9000) / 3, "short": rng.normal(size=300)}
    rows = [(k, i, float(v)) for k, x in signals_.items() for i, v in enumerate(x)]
    return signals_, spark.createDataFrame(rows, "k string, i long, v double").repartition(5)


def by_key(rows, *columns):
    found = {}
    for r in sorted(rows, key=lambda r: r[1]):
        found.setdefault(r[0], []).append(tuple(r[c] for c in columns))
    return {k: np.array(v) for k, v in found.items()}


def test_blocks_equal_the_whole_trial(trials):
    whole, df = trials
    made = by_key(signals.by_blocks(df, ["k"], "i", "v", lambda x: {"y": signals.resample(x, 25, 16)}, "y double", block=2048, warm_up=512, up=25, down=16).collect(), "idx", "y")
    for k, x in whole.items():
        want = signals.resample(x, 25, 16)
        assert (made[k][:, 0] == np.arange(len(want))).all() and np.allclose(made[k][:, 1], want, atol=1e-9)


def test_runs_of_segments_equal_the_kernel(trials):
    whole, df = trials
    psd = by_key(signals.welch_psd(df, ["k"], "i", "v", 100, segment=128, run_of=7).collect(), "freq", "power")
    for k, x in whole.items():
        f, p = signals.welch(x, 100, 128)
        order = np.argsort(psd[k][:, 0])
        assert np.allclose(psd[k][order, 0], f) and np.allclose(psd[k][order, 1], p)


def test_entropies_and_dfa_equal_the_kernels(trials):
    whole, df = trials
    part = df.filter("i < 700")
    got = {r.k: r for r in signals.entropies(part, ["k"], "i", "v", block=128).collect()}
    slope = {r.k: r.dfa for r in signals.dfa_exponent(part, ["k"], "i", "v").collect()}
    for k, x in whole.items():
        x = x[:700]
        assert got[k].sample_entropy == pytest.approx(signals.sample_entropy(x), abs=1e-9)
        assert slope[k] == pytest.approx(signals.dfa(x), abs=1e-6)

        def phi(m, x=x):
            parts = np.lib.stride_tricks.sliding_window_view(x, m)
            return np.mean(np.log((np.abs(parts[:, None] - parts).max(2) <= 0.2 * x.std()).mean(1)))

        assert got[k].approximate_entropy == pytest.approx(phi(2) - phi(3), abs=1e-9)


def test_running_totals_by_ranges(spark):
    from kinespark.functions.ranges import running

    rng = np.random.default_rng(1)
    rows = [(None if k % 3 == 0 else "g", float(v), 1) for k, v in enumerate(rng.permutation(2000) / 7)]
    got = running(spark.createDataFrame(rows, "g string, s double, n int"), ["g"], "s", {"upto": "n"}).collect()
    for g in (None, "g"):
        mine = sorted((r.s, r.upto) for r in got if r.g == g)
        assert [u for _, u in mine] == list(range(1, len(mine) + 1))


def test_matching_clusters(spark):
    """Greedy matching within clusters is the greedy matching of the whole trial."""
    from kinespark.operators import matching

    rng = np.random.default_rng(3)
    d, t = np.sort(rng.choice(4000, 300, False)), np.sort(rng.choice(4000, 280, False))
    used, errors = set(), []
    for x in t:
        near = [y for y in d if abs(y - x) <= 6 and y not in used]
        if near:
            best = min(near, key=lambda y: abs(y - x))
            used.add(best)
            errors.append(abs(best - x))
    frame = lambda v: spark.createDataFrame([("t", int(x)) for x in v], "k string, s long")
    r = matching.match_events(frame(d), frame(t), ["k"], "s", 6).first()
    assert (r.tp, r.fp, r.fn, r.error) == (len(errors), 300 - len(errors), 280 - len(errors), sum(errors))


def test_upload_and_threshold_guards(spark):
    quality.assert_upload(spark.createDataFrame([(1,)], "`Acc X` int"), "head")
    for df, why in ((spark.createDataFrame([], "a int"), "no rows"), (spark.createDataFrame([(1,)], "`a;b` int"), "odd names"), (spark.range(20), "more than 10")):
        with pytest.raises(ValueError, match=why):
            quality.assert_upload(df, "head", most_rows=10)


def test_tails(spark):
    got = spark.range(1).select(normal_two_sided(F.lit(1.959964)).alias("p")).first().p
    assert abs(got - 0.05) < 1e-6 and abs(chi2_tail(3.841459, 1) - 0.05) < 1e-6 and abs(chi2_tail(18.307, 10) - 0.05) < 1e-4


def test_mcnemar_exact(spark):
    df = spark.createDataFrame([(True, False)] * 8 + [(False, True)] * 2, "a boolean, b boolean")
    assert abs(stats.mcnemar(df, [], F.col("a"), F.col("b")).first().p - 2 * (1 + 10 + 45) / 1024) < 1e-12


def test_holdout_and_folds(spark):
    people = spark.range(2000).select(F.col("id").alias("p"), (F.col("id") % 4 == 0).alias("sick"))
    roles = stats.subject_holdout(people, "p", ~F.col("sick"))
    quality.assert_disjoint(roles, "p", "role")
    n = {r.role: r["count"] for r in roles.join(people, "p").filter("not sick").groupBy("role").count().collect()}
    assert abs(n["train"] / 1500 - 0.7) < 0.05 and roles.join(people, "p").filter("sick and role <> 'test'").isEmpty()
    folds = stats.group_folds(people.withColumn("y", F.col("sick").cast("int")), "p", "y", 5)
    assert folds.count() == 2000 and folds.groupBy("fold").count().agg(F.max("count") - F.min("count")).first()[0] <= 2


def test_guards(spark):
    with pytest.raises(ValueError, match="target"):
        quality.assert_no_targets(["rms", "risk_label"], ["risk_label"])
    with pytest.raises(ValueError, match="missing"):
        quality.assert_schema(spark.range(1), ["x"])
    report = spark.createDataFrame([("t1", "length", "fail"), ("t2", "length", "pass")], "trial string, check string, status string")
    with pytest.raises(ValueError, match="t1/length"):
        quality.gate(report)


def test_auc_of_one_class_is_null(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.7)], "y int, s double")
    assert metrics.auc(df, [], "y", "s").first().auc is None and metrics.youden(df, [], "y", "s").first().threshold == 0.5


def test_streams_equal_batch(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    e.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in")
    q = streams.window_features(stream, "user_id", "ts", "value", "2 days", "1 day").writeStream.format("memory").queryName("z1").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = streams.window_features(e, "user_id", "ts", "value", "2 days", "1 day")
    pick = ["user_id", F.col("window.start").cast("string"), "n", F.round("mean", 6)]
    assert sorted(map(str, spark.table("z1").select(*pick).collect())) == sorted(map(str, want.select(*pick).collect()))


def test_gap_stream(spark, tmp_path):
    spark.createDataFrame([(1, k, c) for k, c in enumerate((1, 2, 5, 6))] + [(2, k, c) for k, c in enumerate((65534, 65535, 0, 1))], "k long, i long, c long").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k long, i long, c long").parquet(f"{tmp_path}/in")
    q = streams.gap_stream(stream, "k", "i", "c").writeStream.format("memory").queryName("z3").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [tuple(r) for r in spark.table("z3").collect()] == [(1, 2, 5)]


def test_wavelet_and_false_neighbours():
    x = np.random.default_rng(2).normal(size=400)
    got = signals.wavelet_energies(x)
    # the filter is orthonormal: its squares sum to 1, and its even shifts are orthogonal
    low = signals.WAVELET
    assert abs((low**2).sum() - 1) < 1e-12 and abs((low[2:] * low[:-2]).sum()) < 1e-12 and list(got["band"]) == ["a4", "d4", "d3", "d2", "d1"]
    wide = np.r_[x[6::-1], x, x[:-8:-1]]
    first = [sum(low[::-1][j] * (1 if j % 2 else -1) * wide[k - j] for j in range(8)) for k in range(8, len(wide), 2)]
    assert got["energy"][-1] == pytest.approx(sum(v * v for v in first)) and abs(got["energy"].sum() / (x**2).sum() - 1) < 0.1
    slow = np.sin(np.arange(2000) / 40)
    assert signals.wavelet_energies(slow)["share"][0] > 0.99 and not len(signals.wavelet_energies(x[:20])["band"])
    assert signals.false_neighbours(slow + x[0], 10, 2) < 0.1 < signals.false_neighbours(x, 1, 2) and signals.embedding_dimension(slow, 10) == 2


def test_freezing_and_score_streams_equal_batch(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    e.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in")
    how = ("user_id", "ts", "value", "1 day", 20.0, (1.0, 4.0), (4.0, 10.0))
    streams.freezing_windows(stream, *how).writeStream.format("memory").queryName("z2").outputMode("complete").trigger(availableNow=True).start().awaitTermination(120)
    pick = ["user_id", F.col("window.start").cast("string"), F.round("freezing_index", 6)]
    want = streams.freezing_windows(e, *how)
    assert sorted(map(str, spark.table("z2").select(*pick).collect())) == sorted(map(str, want.select(*pick).collect()))
    scored = lambda batch: streams.trial_scores(batch, "user_id", ["ts"], "value")
    streams.score_stream(stream, scored, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination(120)
    rows = ["user_id", F.round("risk", 9), "band", "votes"]
    assert sorted(map(str, spark.read.parquet(f"{tmp_path}/out").select(*rows).collect())) == sorted(map(str, scored(e).select(*rows).collect()))


def test_lyapunov_takes_the_whole_trial(spark):
    """The second half of the trial is another signal; the query gives what brute force gives for both."""
    rng = np.random.default_rng(3)
    x = np.concatenate([np.sin(np.arange(2000) / 9) + rng.normal(size=2000) / 50, rng.normal(size=1000)])
    parts = np.stack([x[k * 2 : k * 2 + 2996] for k in range(3)], 1)
    near = []
    for k in range(2988):
        d = np.abs(parts[:2988] - parts[k]).max(1)
        d[max(0, k - 6) : k + 7] = np.inf
        near.append(int(d.argmin()))
    curve = [np.log(np.linalg.norm(parts[np.arange(2988) + s] - parts[np.array(near) + s], axis=1)).mean() for s in range(8)]
    want = np.polyfit(np.arange(8), curve, 1)[0]
    assert math.isclose(signals.lyapunov(x, 2, 3, 8), want, rel_tol=1e-9) and not math.isclose(signals.lyapunov(x[:2000], 2, 3, 8), want, rel_tol=1e-3)
    # as in the query, whose trials come from events
    from kinespark.plans import signal_plans

    kept = signal_plans.events
    signal_plans.events = lambda spark, sf: spark.createDataFrame([(1, k, float(v)) for k, v in enumerate(x)], "user_id long, idx long, value double")
    try:
        made = __spark_entry__.queries()["f23_f25_nonlinear"](spark, SF).first()
    finally:
        signal_plans.events = kept
    assert math.isclose(made["lyapunov"], want, rel_tol=1e-9)
