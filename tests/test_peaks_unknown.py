"""Peaks and flags of values that are unknown (null) or no number, and of rows without a time, as the SQL has them."""

import duckdb
from pyspark.sql import functions as F

from kinespark.operators import peaks
from kinespark.plans import registry, signal_plans


def lines(rows):
    """Rows in order; NaN equals itself, 0.0 equals -0.0."""
    return sorted(repr([c + 0.0 if isinstance(c, float) else c for c in r]) for r in rows)


def test_strikes_and_toe_offs_with_unknown_values_and_times(spark, tmp_path):
    out, odd = {}, {"null": ("NULL", "ts"), "nan": ("'nan'::DOUBLE", "ts"), "late": ("value", "CASE WHEN hash(event_id) % 9 = 0 THEN NULL ELSE ts END")}
    for kind, (value, ts) in odd.items():
        (tmp_path / kind).mkdir()
        duckdb.execute(f"""COPY (SELECT event_id, {ts} AS ts, user_id, event_type, CASE WHEN hash(event_id) % 20 = 1 THEN {value} ELSE value END AS value, props FROM (
            SELECT u * 64 + k AS event_id, TIMESTAMP '2024-01-01' + INTERVAL 1 SECOND * k AS ts, u AS user_id, 'view' AS event_type, (hash(u * 1000 + k) % 600) / 10 AS value, '' AS props
            FROM range(60) t(u), range(64) s(k))) TO '{tmp_path / kind}/events.parquet' (FORMAT parquet)""")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path / kind}/events.parquet'")
        for name in ("g6_heel_strikes", "g7_toe_offs"):
            made = registry.queries()[name](spark, str(tmp_path / kind))
            want = con.execute(f"SELECT {', '.join(made.columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
            out[kind, name] = lines(made.collect()) == lines(want)
    assert all(out.values()), out


def test_blocks_give_what_the_whole_trial_does(spark, tmp_path):
    duckdb.execute(f"""COPY (SELECT u AS user_id, k AS idx, CASE hash(u * 777 + k) % 12 WHEN 0 THEN NULL WHEN 1 THEN 'nan'::DOUBLE ELSE (hash(u * 1000 + k) % 50)::DOUBLE END AS v
        FROM range(6) t(u), range(100) s(k) WHERE u < 5) TO '{tmp_path}/x.parquet' (FORMAT parquet)""")
    x = spark.read.parquet(f"{tmp_path}/x.parquet")
    whole, blocks = (lines(peaks.peaks(x, ["user_id"], "idx", F.col("v"), 3, block=b).collect()) for b in (1 << 16, 16))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW x AS SELECT * FROM '{tmp_path}/x.parquet'")
    want = con.execute(f"WITH {signal_plans.peaks_sql('x', 'k', 3)} SELECT user_id, idx, height, prominence FROM k").fetchall()
    assert whole == blocks == lines(want)
