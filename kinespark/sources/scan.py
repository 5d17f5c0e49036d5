"""Scans of raw recordings and their metadata into tables, and sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinespark.operators.quality import interpolate

#: Sensor codes of raw files and their positions, and the canonical columns of a sensor file. Fixed values.
SENSORS = {"HE": "head", "LB": "lower_back", "LF": "left_foot", "RF": "right_foot"}
COLUMNS = ("counter", "acc_x", "acc_y", "acc_z", "gyr_x", "gyr_y", "gyr_z", "mag_x", "mag_y", "mag_z")
#: How the header of a sensor file begins. Fixed value.
HEADER = "PacketCounter"


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) of all files below a folder; contents are not read. Spark lists no empty file: one counts as missing."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")


def inventory(files: DataFrame, required: Sequence[str] = tuple(SENSORS.values())) -> DataFrame:
    """(trial, sensors, missing, has_meta, complete) of files named {trial}_raw_data_{code}.txt, {trial}_{position}_raw.csv and {trial}_meta.json."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    codes = F.create_map(*(F.lit(x) for kv in SENSORS.items() for x in kv))
    f = files.filter("length > 0").select(name.alias("name"))
    text, table, meta = F.regexp_extract("name", r"^(.+)_raw_data_(HE|LB|LF|RF)\.txt$", 1), F.regexp_extract("name", rf"^(.+)_({'|'.join(required)})_raw\.csv$", 1), F.regexp_extract("name", r"^(.+)_meta\.json$", 1)
    f = f.select(
        F.coalesce(*(F.nullif(c, F.lit("")) for c in (text, table, meta))).alias("trial"),
        F.coalesce(F.try_element_at(codes, F.regexp_extract("name", r"_raw_data_(HE|LB|LF|RF)\.txt$", 1)), F.nullif(F.regexp_extract("name", rf"_({'|'.join(required)})_raw\.csv$", 1), F.lit(""))).alias("sensor"),
        (meta != "").alias("meta"),
    ).filter("trial is not null")
    have = f.groupBy("trial").agg(F.array_sort(F.collect_set("sensor")).alias("sensors"), F.max("meta").alias("has_meta"))
    lost = F.array_except(F.array(*map(F.lit, sorted(required))), "sensors")
    return have.select("trial", "sensors", lost.alias("missing"), "has_meta", ((F.size(lost) == 0) & F.col("has_meta")).alias("complete"))


def external_inventory(files: DataFrame) -> DataFrame:
    """(subject, run, path, complete) of files named SxxRyy.txt; complete is false for a length of 0."""
    n = F.regexp_extract("path", r"/S(\d+)R(\d+)\.txt$", 1)
    return files.filter(n != "").select(n.cast("int").alias("subject"), F.regexp_extract("path", r"/S(\d+)R(\d+)\.txt$", 2).cast("int").alias("run"), "path", (F.col("length") > 0).alias("complete"))


def numeric_text(spark: SparkSession, folder: str, columns: Sequence[str], glob: str, header: str | None = HEADER) -> tuple[DataFrame, DataFrame]:
    """Rows (file, line columns as doubles) of white-space separated files, and the files that are rejected.

    Only a file's first line may be a header, that begins with the header's or the first column's name. A file with another
    line that isn't all numbers, or of another width, is rejected whole. Order in a file is kept by its columns, not here.
    """
    lines = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", True).text(folder)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("at"), F.split(F.trim("value"), r"\s+").alias("p")).filter(F.size(F.filter("p", lambda x: x != "")) > 0)
    values = F.transform("p", lambda x: x.try_cast("double"))
    lines = lines.withColumn("v", values).withColumn("odd", (F.size("v") != len(columns)) | F.exists("v", lambda x: x.isNull() | F.isnan(x)))
    first = lines.filter("odd").groupBy("file").agg(F.min("at").alias("at"), F.count("*").alias("n_odd"), F.min_by("p", "at").alias("p"))
    start = lines.groupBy("file").agg(F.min("at").alias("start"))
    names = [columns[0]] if header is None else [columns[0], header]
    headed = (F.col("n_odd") == 1) & (F.col("at") == F.col("start")) & (F.size("p") == len(columns)) & F.col("p")[0].isin(*names)
    bad = first.join(start, "file").filter(~headed).select("file")
    return lines.filter(~F.col("odd")).join(bad, "file", "left_anti").select("file", *(F.col("v")[k].alias(c) for k, c in enumerate(columns))), bad


def sensor_table(df: DataFrame, trial: str, order: str, rate: float) -> DataFrame:
    """Rates from degrees to radians, time rebuilt as index / rate; non-finite values become null."""
    clean = df.withColumns({c: F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), None).otherwise(F.radians(c) if c.startswith("gyr_") else F.col(c)) for c in df.columns if c[:4] in ("acc_", "gyr_", "mag_")})
    idx = F.row_number().over(Window.partitionBy(trial).orderBy(order)) - 1
    return clean.withColumn("sample_idx", idx.cast("long")).withColumn("time", idx / rate)


def metadata(spark: SparkSession, path: str, aliases: Mapping[str, str] = {"subject": "participant_id", "gender": "sex"}) -> DataFrame:
    """Trial metadata JSON, a file a trial; an alias fills its canonical field where that is absent."""
    df = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    for alias, name in aliases.items():
        if alias in df.columns:
            df = df.withColumn(name, F.coalesce(F.col(name), F.col(alias)) if name in df.columns else F.col(alias)).drop(alias)
    return df


def gait_events(meta: DataFrame, trial: str = "trial_id") -> DataFrame:
    """(trial, side, event, sample_index, stride_index) from arrays of [toe_off, heel_strike] pairs."""
    sides = [meta.select(trial, F.lit(s).alias("side"), F.posexplode(f"{s}GaitEvents").alias("stride_index", "pair")) for s in ("left", "right")]
    both = sides[0].unionByName(sides[1])
    return both.select(trial, "side", "stride_index", F.explode(F.array(*(F.struct(F.lit(e).alias("event"), F.get("pair", F.lit(k)).alias("sample_index")) for k, e in enumerate(("toe_off", "heel_strike"))))).alias("e")).select(trial, "side", "e.event", "e.sample_index", "stride_index")


#: Names of a side, and of the column that holds it, the first that is there. Fixed values.
SIDE_NAMES = {"left": ("left", "l", "lf", "left_foot"), "right": ("right", "r", "rf", "right_foot")}
SIDE_COLUMNS = ("side", "foot", "sensor", "limb")


def strikes_of(df: DataFrame, trial: str, position: str) -> DataFrame:
    """(trial, side, sample_index): distinct heel strikes of tables in any of the layouts in use.

    A layout is rows with event and sample_index (for both sides where no column names one), or columns named after a heel and
    a side. Such a column marks samples with 1, by the row's position in its trial, or else holds the indices themselves;
    which of these is told for each trial by whether it has other values than 0 and 1. Column names may be in any case, with
    spaces. Negative indices and values that are no numbers go.
    """
    x = df.toDF(*(c if c in (trial, position) else c.strip().lower().replace(" ", "_") for c in df.columns))
    parts = []
    if {"event", "sample_index"} <= set(x.columns):
        named = next((c for c in SIDE_COLUMNS if c in x.columns), None)
        side = F.lower(F.col(named).cast("string")) if named else None
        sides = F.array(*map(F.lit, SIDE_NAMES)) if named is None else F.array_compact(F.array(*(F.when(side.isin(*names), s) for s, names in SIDE_NAMES.items())))
        rows = x.filter(F.contains(F.lower(F.col("event").cast("string")), F.lit("heel")))
        parts.append(rows.select(trial, F.explode(sides).alias("side"), F.col("sample_index").cast("string").try_cast("double").alias("at")))
    for c in x.columns:
        words = set(c.split("_"))
        for side, names in SIDE_NAMES.items():
            if c not in (trial, position) and "heel" in c and words & set(names):
                v = F.col(c).cast("string").try_cast("double")
                marks = x.groupBy(F.col(trial).alias("_t")).agg((F.count_if(~v.isin(0.0, 1.0)) == 0).alias("_marks"))
                values = x.select(trial, F.col(position).alias("_p"), v.alias("_v")).filter("_v IS NOT NULL").join(marks, F.col(trial).eqNullSafe(F.col("_t")))
                at = F.when(~F.col("_marks"), F.col("_v")).when(F.col("_v") == 1, F.col("_p").cast("double"))
                parts.append(values.select(trial, F.lit(side).alias("side"), at.alias("at")))
    if not parts:
        return df.sparkSession.createDataFrame([], df.select(trial).schema.add("side", "string").add("sample_index", "long"))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.filter("at >= 0").select(trial, "side", F.floor("at").cast("long").alias("sample_index")).distinct()


def ground_truth(tables: DataFrame | None, meta: DataFrame | None, trial: str = "trial_id", position: str = "line") -> DataFrame:
    """(trial, side, sample_index): each trial's heel strikes from its event table, or, where it has none, from its metadata's pairs."""
    own = None if tables is None else strikes_of(tables, trial, position)
    other = None if meta is None else gait_events(meta, trial).filter("event = 'heel_strike' AND sample_index >= 0").select(trial, "side", F.col("sample_index").cast("long").alias("sample_index")).distinct()
    if own is None or other is None:
        return other if own is None else own
    return own.unionByName(other.join(tables.select(trial).distinct(), trial, "left_anti"))


def heel_strikes(events: DataFrame, trial: str, sides: Sequence[str], n_samples: int) -> DataFrame:
    """Distinct heel-strike indices of a side, under any of its names, inside the recording."""
    e = events.filter(F.lower("event").contains("heel") & F.lower("side").isin(*(s.lower() for s in sides)) & F.col("sample_index").between(0, n_samples - 1))
    return e.select(trial, "sample_index").distinct()


def upload_columns(df: DataFrame, prefix: str) -> DataFrame:
    """Prefixed columns (HE_Acc_X) as canonical ones (acc_x); timestamp and packetcounter as time."""
    names = [c.lower().replace(" ", "_") for c in df.columns]
    names = [n.removeprefix(f"{prefix.lower()}_") for n in names]
    return df.toDF(*("time" if n in ("timestamp", "packetcounter") else n for n in names))


def prepared_upload(df: DataFrame, prefix: str, order: str = "time", least: int = 10) -> DataFrame:
    """An uploaded recording under canonical names, as numbers, with gaps filled by lines and edges by the nearest value.

    Six axes are required; rows that stay without a value go, and fewer than `least` rows stop the job.
    """
    x = upload_columns(df, prefix)
    kept = [c for c in ("time", *COLUMNS[1:]) if c in x.columns]
    if lost := [c for c in COLUMNS[1:7] if c not in kept]:
        raise ValueError(f"{prefix}: axes that are missing: {', '.join(lost)}")
    x = x.select(*(F.col(c).cast("string").try_cast("double").alias(c) for c in kept))
    x = x.withColumn("_one", F.lit(1)).withColumn("_at", F.row_number().over(Window.partitionBy("_one").orderBy(order)))  # an upload is one recording
    for c in kept:
        x = interpolate(x, ["_one"], "_at", c, c)
    x = x.drop("_one", "_at").dropna()
    if (n := x.limit(least).count()) < least:
        raise ValueError(f"{prefix}: {n} rows are too few")
    return x


def sensor_csv(spark: SparkSession, path: str, rate: float, durations: Mapping[str, float] | None = None) -> DataFrame:
    """Rows (file, time, axes) of sensor CSV files: lower-case names with underscores, bad rows gone, rates in radians.

    A file without time gets it from its place: evenly over its declared duration (by file name), else place / rate. Places
    are those in the file, so a file is read by one task (multiLine).
    """
    raw = spark.read.option("header", True).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(path)
    raw = raw.toDF(*(c.strip().lower().replace(" ", "_") for c in raw.columns)).withColumn("file", F.col("_metadata.file_path")).withColumn("_line", F.monotonically_increasing_id())
    w = Window.partitionBy("file")
    x = raw.withColumn("_at", F.row_number().over(w.orderBy("_line")) - 1).withColumn("_n", F.count("*").over(w))
    known = F.create_map(*(F.lit(v) for kv in (durations or {"": 0.0}).items() for v in kv))
    seconds = F.try_element_at(known, F.regexp_extract("file", r"([^/]+)$", 1))
    made = F.when((seconds > 0) & (F.col("_n") > 1), F.col("_at") / (F.col("_n") - 1) * seconds).otherwise(F.col("_at") / rate)
    axes = [c for c in COLUMNS[1:] if c in raw.columns]
    time = F.coalesce(F.col("time").try_cast("double"), made) if "time" in raw.columns else made
    numbers = [(F.radians(F.col(c).try_cast("double")) if c.startswith("gyr_") else F.col(c).try_cast("double")).alias(c) for c in axes]
    return x.select("file", time.alias("time"), *numbers).dropna()


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, else CSV with a header, by the path's ending."""
    return spark.read.option("header", True).option("inferSchema", True).csv(path) if path.rstrip("/").endswith(".csv") else spark.read.parquet(path)


def write_signals(df: DataFrame, path: str, trial: str = "trial_id", sensor: str = "sensor") -> None:
    """One table, partitioned by sensor and clustered by trial; an existing one is never overwritten."""
    df.repartition(trial, sensor).sortWithinPartitions(trial, "sample_idx").write.mode("errorifexists").partitionBy(sensor).parquet(path)


def drop_columns(spark: SparkSession, path: str, to: str, columns: Sequence[str]) -> DataFrame:
    """A stored table without some columns, written to a new place."""
    spark.read.parquet(path).drop(*columns).write.mode("errorifexists").parquet(to)
    return spark.read.parquet(to)


def wide_text(spark: SparkSession, folder: str, columns: Sequence[str], glob: str = "S*R*.txt") -> DataFrame:
    """Rows (file, subject, run, line columns) of recordings without a header; a file with another width or a value missing stops the job."""
    rows, bad = numeric_text(spark, folder, columns, glob, header=None)
    if found := [r.file for r in bad.limit(10).collect()]:
        raise ValueError(f"recordings with odd lines: {', '.join(found)}")
    n = lambda k: F.regexp_extract("file", r"/S(\d+)R(\d+)\.txt$", k).cast("int")
    return rows.select("file", n(1).alias("subject"), n(2).alias("run"), *columns)


def recording_stats(rows: DataFrame, file: str, annotation: str, dropped: int = 0) -> DataFrame:
    """(file, n_raw, n_dropped, n_kept): rows of the dropped annotation are calibration and go."""
    gone = F.col(annotation) == dropped
    return rows.groupBy(file).agg(F.count("*").alias("n_raw"), F.count_if(gone).alias("n_dropped"), F.count_if(~gone).alias("n_kept"))


def subject_rows(rows: DataFrame, subject: str, run: Sequence[str], order: Sequence[str]) -> DataFrame:
    """rows with row_in_subject: a subject's recordings one after another, by run and then in their own order."""
    return rows.withColumn("row_in_subject", (F.row_number().over(Window.partitionBy(subject).orderBy(*run, *order)) - 1).cast("long"))


def feature_matrix(df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """The keys and the named features, in order; a name that is missing stops the job."""
    if lost := sorted(set(features) - set(df.columns)):
        raise ValueError(f"features that are not there: {', '.join(lost)}")
    return df.select(*keys, *features)


def oof_scores(spark: SparkSession, path: str, ident: str = "participant_id", score: str = "y_score") -> DataFrame:
    """Out-of-fold tables below path, a folder a model; columns of older layouts get their present names."""
    df = spark.read.parquet(path)
    for old, new in (("pid", ident), ("prob", score), ("y_prob_positive", score)):
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    return df


def write_oof(df: DataFrame, path: str, columns: Sequence[str] = ("participant_id", "fold", "y_true", "y_score")) -> None:
    """Append out-of-fold rows by model, always the same columns in the same order."""
    feature_matrix(df, ["model"], columns).write.mode("append").partitionBy("model").parquet(path)


def seal(df: DataFrame, path: str, force: bool = False) -> None:
    """Write a result once: an existing one is kept unless forced."""
    df.write.mode("overwrite" if force else "errorifexists").parquet(path)


def write_manifest(splits: DataFrame, path: str, role: str = "role") -> DataFrame:
    """Write who has which role and how many; returns the counts."""
    splits.write.mode("errorifexists").option("header", True).csv(f"{path}/participants")
    counts = splits.groupBy(role).agg(F.count("*").alias("n"))
    counts.write.mode("errorifexists").json(f"{path}/counts")
    return counts
