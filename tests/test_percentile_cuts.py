"""Cuts at percentiles fall as the SQL's do, where prominences differ in their last place or not at all."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from kinespark.operators import matching, peaks


def trials():
    """Prominences as differences of two-decimal values: many near ties and ties in each trial."""
    rng = np.random.default_rng(7)
    return [(t, "c0", k, 0.0, float(v)) for t in range(400) for high in [rng.integers(100, 20000) / 100] for k, v in enumerate((lambda low: (high + low / 100) - low / 100)(rng.integers(1, 9000, 3 + t % 40)))]


def test_cuts_keep_what_the_sql_keeps(spark):
    rows = trials()
    df = spark.createDataFrame(rows, "u long, cohort string, idx long, height double, prominence double")
    con = duckdb.connect()
    con.execute("CREATE TABLE k (u BIGINT, cohort VARCHAR, idx BIGINT, height DOUBLE, prominence DOUBLE)")
    con.executemany("INSERT INTO k VALUES (?, ?, ?, ?, ?)", rows)
    for percentile in (30, 60, 75):
        want = con.execute(f"SELECT u, idx FROM k JOIN (SELECT u, quantile_cont(prominence, {percentile / 100}) AS cut FROM k GROUP BY 1) USING (u) WHERE prominence >= cut").fetchall()
        for kept in (peaks.by_prominence(df, ["u"], percentile), matching.above_percentile(df, ["u"], "prominence", [percentile])):
            assert {(r.u, r.idx) for r in kept.select("u", "idx").collect()} == set(want)


def test_a_trial_without_values_has_no_cut(spark):
    df = spark.createDataFrame([(1, None), (2, 5.0), (2, None)], "u long, v double")
    assert [(r.u, r.v) for r in matching.above_percentile(df, ["u"], "v", [50.0]).collect()] == [(2, 5.0)]
    assert df.select(F.count("v")).first()[0] == 1


def test_strikes_and_toe_offs_of_coarse_values(spark, tmp_path):
    """Values in tenths: prominences are equal but for the last place."""
    from kinespark.plans import registry

    path, out = f"{tmp_path}/events.parquet", []
    duckdb.execute(f"""COPY (SELECT u * 64 + k AS event_id, TIMESTAMP '2024-01-01' + INTERVAL 1 SECOND * k AS ts, u AS user_id, 'view' AS event_type, (hash(u * 1000 + k) % 60) / 10 + u / 100 AS value, '' AS props
        FROM range(600) t(u), range(64) s(k)) TO '{path}' (FORMAT parquet)""")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{path}'")
    for name in ("g6_heel_strikes", "g7_toe_offs"):
        made = registry.queries()[name](spark, str(tmp_path))
        want = con.execute(f"SELECT {', '.join(made.columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
        out.append(sorted(map(tuple, made.collect())) == sorted(want))
    assert out == [True, True]
