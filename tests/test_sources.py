"""Scans of small files in the reference's layouts."""

import json

import pytest
from pyspark.sql import functions as F

from kinespark.sources import scan


def test_inventory(spark, tmp_path):
    for code in ("HE", "LB", "LF", "RF"):
        (tmp_path / f"T1_raw_data_{code}.txt").write_text("1 2\n")
    (tmp_path / "T1_meta.json").write_text("{}")
    (tmp_path / "T2_head_raw.csv").write_text("a\n1\n")
    (tmp_path / "S01R02.txt").write_text("1\n")
    files = scan.listing(spark, str(tmp_path))
    got = {r.trial: r for r in scan.inventory(files).collect()}
    assert got["T1"].complete and got["T2"].sensors == ["head"] and len(got["T2"].missing) == 3 and not got["T2"].complete
    assert {(r.subject, r.run, r.complete) for r in scan.external_inventory(files.union(spark.createDataFrame([("x/S02R01.txt", 0)], files.schema))).collect()} == {(1, 2, True), (2, 1, False)}


def test_sensor_text(spark, tmp_path):
    head = "\t".join(scan.COLUMNS)
    (tmp_path / "a_raw.txt").write_text(head + "\n" + "\n".join("\t".join(map(str, [k, 1, 2, 3, 180, 0, 0, 1, 1, 1])) for k in range(5)))
    (tmp_path / "b_raw.txt").write_text("1 2 3 4 5 6 7 8 9 10\n1 2 x 4 5 6 7 8 9 10\n")
    (tmp_path / "c_raw.txt").write_text("1 2 3 4 5 6 7 8 9 10\n" + head + "\n1 2 3 4 5 6 7 8 9 10\n")  # a header line in mid-file
    (tmp_path / "d_raw.txt").write_text("a b c d e f g h i j\n1 2 3 4 5 6 7 8 9 10\n")  # no header that is known
    rows, bad = scan.numeric_text(spark, str(tmp_path), scan.COLUMNS, "*_raw.txt")
    assert rows.count() == 5 and sorted(r.file[-9] for r in bad.collect()) == ["b", "c", "d"]
    t = scan.sensor_table(rows, "file", "counter", 100.0).orderBy("sample_idx").collect()
    assert t[4].time == pytest.approx(0.04) and t[0].gyr_x == pytest.approx(3.14159265)


def test_metadata_and_events(spark, tmp_path):
    (tmp_path / "T1_meta.json").write_text(json.dumps({"trial_id": "T1", "subject": "P1", "leftGaitEvents": [[10, 20], [50, 60]], "rightGaitEvents": [[30, 40]]}))
    meta = scan.metadata(spark, str(tmp_path))
    assert meta.first().participant_id == "P1"
    e = scan.gait_events(meta)
    assert {(r.side, r.event, r.sample_index) for r in e.collect()} == {("left", "toe_off", 10), ("left", "heel_strike", 20), ("left", "toe_off", 50), ("left", "heel_strike", 60), ("right", "toe_off", 30), ("right", "heel_strike", 40)}
    assert sorted(r.sample_index for r in scan.heel_strikes(e, "trial_id", ["Left", "L"], 60).collect()) == [20]


def test_upload_and_sinks(spark, tmp_path):
    up = scan.upload_columns(spark.createDataFrame([(1, 2.0)], "PacketCounter long, HE_Acc_X double"), "HE")
    assert up.columns == ["time", "acc_x"]
    df = spark.createDataFrame([("t", "head", 0, 1.0), ("t", "head", 1, 2.0)], "trial_id string, sensor string, sample_idx long, acc_x double")
    scan.write_signals(df, f"{tmp_path}/signals")
    assert scan.read_any(spark, f"{tmp_path}/signals").filter(F.col("sensor") == "head").count() == 2
    with pytest.raises(Exception, match="(?i)exists"):
        scan.write_signals(df, f"{tmp_path}/signals")
    assert "acc_x" not in scan.drop_columns(spark, f"{tmp_path}/signals", f"{tmp_path}/new", ["acc_x"]).columns


def test_wide_recordings(spark, tmp_path):
    names = ["ms", *(f"c{k}" for k in range(9)), "annotation"]
    for subject, run, rows in ((1, 2, 3), (1, 1, 2)):
        (tmp_path / f"S0{subject}R0{run}.txt").write_text("".join(f"{k} 1 2 3 4 5 6 7 8 9 {k % 2}\n" for k in range(rows)))
    rows = scan.wide_text(spark, str(tmp_path), names)
    ordered = scan.subject_rows(rows, "subject", ["run"], ["ms"])
    assert [(r.run, int(r.ms), r.row_in_subject) for r in ordered.orderBy("row_in_subject").collect()] == [(1, 0, 0), (1, 1, 1), (2, 0, 2), (2, 1, 3), (2, 2, 4)]
    assert {(r.n_raw, r.n_dropped) for r in scan.recording_stats(rows, "file", "annotation").collect()} == {(3, 2), (2, 1)}
    (tmp_path / "S02R01.txt").write_text("1 2 3\n")
    with pytest.raises(ValueError, match="S02R01"):
        scan.wide_text(spark, str(tmp_path), names)


def test_matrix_and_result_sinks(spark, tmp_path):
    df = spark.createDataFrame([("m1", "p1", 0, 1, 0.5, 9)], "model string, participant_id string, fold int, y_true int, y_score double, extra int")
    scan.write_oof(df, f"{tmp_path}/oof")
    scan.write_oof(df.withColumn("model", F.lit("m2")), f"{tmp_path}/oof")
    assert scan.oof_scores(spark, f"{tmp_path}/oof").columns == ["participant_id", "fold", "y_true", "y_score", "model"]
    df.withColumnRenamed("participant_id", "pid").write.parquet(f"{tmp_path}/old")
    assert "participant_id" in scan.oof_scores(spark, f"{tmp_path}/old").columns
    with pytest.raises(ValueError, match="nothere"):
        scan.feature_matrix(df, ["model"], ["y_score", "nothere"])
    scan.seal(df, f"{tmp_path}/sealed")
    with pytest.raises(Exception, match="(?i)exists"):
        scan.seal(df, f"{tmp_path}/sealed")
    scan.seal(df.limit(0), f"{tmp_path}/sealed", force=True)
    assert scan.write_manifest(df.withColumn("role", F.lit("train")), f"{tmp_path}/manifest").first().n == 1


def test_prepared_upload_and_csv(spark, tmp_path):
    rows = [(k, *(None if k == 3 else str(float(k)) for _ in range(6))) for k in range(12)]
    df = spark.createDataFrame(rows, "Timestamp int, " + ", ".join(f"HE_{c} string" for c in ("Acc_X", "Acc_Y", "Acc_Z", "Gyr_X", "Gyr_Y", "Gyr_Z")))
    made = scan.prepared_upload(df, "HE").orderBy("time").collect()
    assert len(made) == 12 and made[3].acc_x == 3.0
    with pytest.raises(ValueError, match="too few"):
        scan.prepared_upload(df.limit(5), "HE")
    with pytest.raises(ValueError, match="missing"):
        scan.prepared_upload(df.drop("HE_Gyr_Z"), "HE")
    (tmp_path / "a.csv").write_text("Acc X,Gyr X\n" + "".join(f"{k},180\n" for k in range(5)) + "x,1\n")
    timed = scan.sensor_csv(spark, str(tmp_path), 100.0).orderBy("time").collect()
    assert [r.time for r in timed] == [0.0, 0.01, 0.02, 0.03, 0.04] and timed[0].gyr_x == pytest.approx(3.14159265)
    assert scan.sensor_csv(spark, str(tmp_path), 100.0, {"a.csv": 10.0}).agg(F.max("time")).first()[0] == 8.0
