"""Ground-truth events in every layout, and tables before metadata."""

import pytest

from kinespark.sources import scan


def found(df):
    return sorted((r.t, r.side, r.sample_index) for r in df.collect())


def test_event_rows_with_any_side_column(spark):
    for column, left, right in (("Side", "LEFT", "r"), ("foot", "l", "Right"), ("limb", "left_foot", "rf")):
        rows = [("a", 0, "Heel Strike", left, "10"), ("a", 1, "heel_strike", right, "20"), ("a", 2, "toe_off", left, "15"), ("a", 3, "heel", "trunk", "7"), ("a", 4, "heel", left, "10"), ("a", 5, "heel", left, "-1"), ("a", 6, "heel", left, "x"), ("b", 0, "heel", right, "3")]
        df = spark.createDataFrame(rows, f"t string, line long, ` Event` string, {column} string, `Sample Index` string")
        assert found(scan.strikes_of(df, "t", "line")) == [("a", "left", 10), ("a", "right", 20), ("b", "right", 3)]
    no_side = spark.createDataFrame([("a", 0, "heel", 4)], "t string, line long, event string, sample_index int")
    assert found(scan.strikes_of(no_side, "t", "line")) == [("a", "left", 4), ("a", "right", 4)]


def test_columns_of_marks_or_indices(spark):
    """Trial a marks its samples, trial b lists indices in the same columns; nulls count for neither."""
    rows = [("a", 0, 0.0, None), ("a", 1, 1.0, 0.0), ("a", 2, None, 1.0), ("a", 3, 1.0, 0.0), ("b", 0, 17.0, 1.0), ("b", 1, 40.0, 1.0), ("b", 2, 17.0, None)]
    df = spark.createDataFrame(rows, "t string, line long, `Heel Strike Left` double, heel_strike_right double")
    assert found(scan.strikes_of(df, "t", "line")) == [("a", "left", 1), ("a", "left", 3), ("a", "right", 2), ("b", "left", 17), ("b", "left", 40), ("b", "right", 0), ("b", "right", 1)]
    assert scan.strikes_of(df.select("t", "line"), "t", "line").count() == 0


def test_tables_come_before_metadata(spark):
    tables = spark.createDataFrame([("a", 0, "heel", "left", 5), ("c", 0, "toe_off", "left", 9)], "t string, line long, event string, side string, sample_index int")
    meta = spark.createDataFrame([("a", [[1, 2]], [[3, 4]]), ("b", [[10, 12]], [[1], [20, 25]]), ("c", [[1, 2]], None)], "t string, leftGaitEvents array<array<int>>, rightGaitEvents array<array<int>>")
    assert found(scan.ground_truth(tables, meta, "t")) == [("a", "left", 5), ("b", "left", 12), ("b", "right", 25)]
    assert found(scan.ground_truth(None, meta, "t"))[0] == ("a", "left", 2) and found(scan.ground_truth(tables, None, "t")) == [("a", "left", 5)]


@pytest.mark.parametrize("n", [0, 1])
def test_empty_tables(spark, n):
    df = spark.createDataFrame([("a", 0, None, None)][:n], "t string, line long, event string, sample_index int")
    assert scan.strikes_of(df, "t", "line").count() == 0
