"""Queries of labels, scores and names: customers as participants, market segments as cohorts."""

from pyspark.sql import functions as F

from kinespark.operators import policy as p
from kinespark.plans.evaluation import OOF, oof
from kinespark.plans.register import query, table

TIERS = {"BUILDING": 0, "MACHINERY": 1, "AUTOMOBILE": 1, "FURNITURE": 2, "HOUSEHOLD": 2}
TIER = "CASE c_mktsegment WHEN 'BUILDING' THEN 0 WHEN 'MACHINERY' THEN 1 WHEN 'AUTOMOBILE' THEN 1 WHEN 'FURNITURE' THEN 2 WHEN 'HOUSEHOLD' THEN 2 ELSE 0 END"
R6 = lambda c: F.round(c, 6)


def people(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", "c_name", F.col("c_mktsegment").alias("cohort"), ((F.col("c_acctbal") + 1000) / 12000).alias("share"))


@query(f"SELECT c_custkey, {TIER}::INT AS multiclass_label, ({TIER} >= 2)::INT AS training_label FROM customer")
def p2_label_policy(spark, sf):
    return p.labels(people(spark, sf), "cohort", TIERS, 2).select("c_custkey", "multiclass_label", "training_label")


@query(f"""WITH c AS (SELECT DISTINCT c_mktsegment AS cohort, {TIER} AS tier FROM customer), t AS (SELECT unnest([1, 2])::INT AS threshold)
SELECT threshold, coalesce(string_agg(cohort, ',' ORDER BY cohort) FILTER (WHERE tier >= threshold), '') AS cohorts, count(*) FILTER (WHERE tier >= threshold) AS n, 'tier>=' || threshold AS rule FROM c, t GROUP BY 1""")
def p3_binary_scenarios(spark, sf):
    cohorts = p.labels(people(spark, sf).select("cohort").distinct(), "cohort", TIERS)
    return p.binary_scenarios(cohorts, "cohort", "multiclass_label", [1, 2])


@query("""SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 0.0 WHEN 'MACHINERY' THEN 1.5 WHEN 'FURNITURE' THEN 3.0 END::DOUBLE AS severity
FROM customer WHERE c_mktsegment IN ('BUILDING', 'FURNITURE', 'HOUSEHOLD')""")
def p4_severity_scope(spark, sf):
    scopes = {"neuro": ["BUILDING", "FURNITURE", "HOUSEHOLD"]}
    x = people(spark, sf).filter(p.in_scope(F.col("cohort"), "neuro", scopes))
    return x.select("c_custkey", p.lookup(F.col("cohort"), {"BUILDING": 0.0, "MACHINERY": 1.5, "FURNITURE": 3.0}).cast("double").alias("severity"))


@query("""WITH x AS (SELECT c_custkey, (c_acctbal + 1000) / 12000 AS share FROM customer)
SELECT c_custkey, round(share * CASE WHEN (SELECT median(share) FROM x) <= 1 THEN 100 ELSE 1 END, 6) AS pct FROM x""")
def p5_probability_scale(spark, sf):
    return p.percent_scale(people(spark, sf), "share", "pct").select("c_custkey", R6("pct").alias("pct"))


@query("SELECT event_id, round((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6, 6) AS time, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) / 100.0 AS rebuilt FROM events")
def p7_time_rebuild(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("ms"))
    x = p.rebuilt_time(e, ["user_id"], ["ts", "event_id"], 100.0).withColumnRenamed("time", "rebuilt")
    return p.relative_seconds(x, ["user_id"], "ms").select("event_id", R6("time").alias("time"), "rebuilt")


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'lower_back' ELSE 'head' END AS event_type FROM events WHERE event_type IN ('click', 'view')")
def p9_sensor_mapping(spark, sf):
    return p.rename_parts(table(spark, sf, "events"), "event_type", {"click": "lower_back", "view": "head"}).select("event_id", "event_type")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y_true, l_partkey FROM lineitem")
def p10_binary_annotation(spark, sf):
    x = table(spark, sf, "lineitem").withColumn("annotation", F.when(F.col("l_returnflag") == "R", 2).otherwise(1))
    return x.select("l_orderkey", "l_linenumber", p.binary_annotation(F.col("annotation")).alias("y_true"), "l_partkey")


@query("SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN value ELSE 0 END AS value FROM events")
def p12_mask_inactive(spark, sf):
    return p.mask_inactive(table(spark, sf, "events"), "event_type", ["click", "view"], ["value"]).select("event_id", "value")


PROBS = f"{OOF}, x AS (SELECT doc_id, a, [1 - a, a * 0.6, a * 0.4] AS p FROM oof)"


def three_classes(spark, sf):
    return oof(spark, sf).select("doc_id", "y", "a", F.array(1 - F.col("a"), F.col("a") * 0.6, F.col("a") * 0.4).alias("p"))


@query(f"WITH {PROBS} SELECT doc_id, round(p[3], 6) AS tier2, round(p[2] + p[3], 6) AS tier1, round(p[3], 6) AS tier5 FROM x")
def p13_elevated_probability(spark, sf):
    x = three_classes(spark, sf)
    return x.select("doc_id", R6(p.elevated(F.col("p"), 2)).alias("tier2"), R6(p.elevated(F.col("p"), 1)).alias("tier1"), R6(p.elevated(F.col("p"), 5)).alias("tier5"))


@query(f"""WITH {OOF} SELECT doc_id, CASE WHEN a >= 0.6 THEN 'high' WHEN a >= 0.3 THEN 'moderate' ELSE 'low' END AS band, a >= 0.6 AS above_cutoff,
  CASE WHEN a > 0.8 OR a < 0.2 THEN 'High' WHEN a > 0.6 OR a < 0.4 THEN 'Medium' ELSE 'Low' END AS confidence FROM oof""")
def p14_risk_band(spark, sf):
    a = F.col("a")
    return oof(spark, sf).select("doc_id", p.risk_band(a, 0.6).alias("band"), (a >= 0.6).alias("above_cutoff"), p.confidence(a).alias("confidence"))


NOTES = {"high": "score at or above the cutoff; no diagnosis", "moderate": "borderline score; interpret with caution", "low": "lower score in this run"}


@query(f"WITH {OOF} SELECT doc_id, CASE WHEN a >= 0.6 THEN '{NOTES['high']}' WHEN a >= 0.3 THEN '{NOTES['moderate']}' ELSE '{NOTES['low']}' END AS note FROM oof")
def p15_screening_note(spark, sf):
    return oof(spark, sf).select("doc_id", p.screening_note(F.col("a"), 0.6, NOTES).alias("note"))


@query(f"WITH {OOF}, x AS (SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN round(b * b * b, 5) END AS p FROM oof) SELECT doc_id, CASE WHEN p IS NULL THEN '—' WHEN p < 0.001 THEN '<0.001*' ELSE printf('%.3f', p + 1e-9) || '*' END AS shown FROM x")
def p16_p_value_text(spark, sf):
    b = F.round(F.col("b") * F.col("b") * F.col("b"), 5)
    x = oof(spark, sf).select("doc_id", F.when(F.col("doc_id") % 7 != 0, b).alias("p"))
    return x.select("doc_id", p.p_text(F.when(F.col("p") < 0.001, F.col("p")).otherwise(F.col("p") + 1e-9), "*").alias("shown"))


RAW = "['F', ' female ', 'm', '2', 'unknown', 'nb', 'x', 'left knee', 'RIGHT-side', 'both', 'dominant', '']"
WORDS = ["F", " female ", "m", "2", "unknown", "nb", "x", "left knee", "RIGHT-side", "both", "dominant", ""]


@query(f"""WITH r AS (SELECT c_custkey, ({RAW})[(c_custkey % 12 + 1)::INT] AS raw FROM customer), t AS (SELECT *, lower(trim(raw)) AS t, lower(trim(raw)) IN ('', 'nan', 'none', 'unknown', 'na', 'n/a') AS gone, replace(replace(lower(trim(raw)), '_', ' '), '-', ' ') AS low FROM r)
SELECT c_custkey, CASE WHEN gone THEN NULL WHEN t IN ('f', 'female') THEN 'F' WHEN t IN ('m', '2') THEN 'M' WHEN t = 'nb' THEN 'Other' WHEN t = 'x' THEN 'X' WHEN t = 'left knee' THEN 'Left Knee' WHEN t = 'right-side' THEN 'Right-side' ELSE upper(t[1]) || t[2:] END AS sex,
  CASE WHEN gone THEN NULL WHEN low LIKE '%left%' THEN 'Left' WHEN low LIKE '%right%' THEN 'Right' WHEN low LIKE '%both%' THEN 'Bilateral' WHEN low LIKE '%dominant%' THEN 'Dominant' ELSE upper(t[1]) || t[2:] END AS laterality,
  CASE WHEN t = '' THEN 'missing' WHEN t = 'both' THEN 'bilateral' ELSE t END AS side FROM t""")
def p17_normalisers(spark, sf):
    raw = F.array(*map(F.lit, WORDS))[(F.col("c_custkey") % 12).cast("int")]
    x = table(spark, sf, "customer").select("c_custkey", raw.alias("raw"))
    return x.select("c_custkey", p.sex(F.col("raw")).alias("sex"), p.laterality(F.col("raw")).alias("laterality"), p.side(F.col("raw")).alias("side"))


@query("SELECT s_suppkey, replace(replace(lower(trim(s_name)), ' ', ''), '_', '') AS cohort, coalesce(CASE s_nationkey WHEN 1 THEN 'first' WHEN 2 THEN 'second' END, 'other') AS shown FROM supplier")
def p18_cohort_names(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", p.cohort_key(F.col("s_name")).alias("cohort"), p.lookup(F.col("s_nationkey").cast("int"), {1: "first", 2: "second"}, "other").alias("shown"))


@query(f"WITH {PROBS} SELECT doc_id, round(1 - p[1], 6) AS many, round(a, 6) AS two FROM x")
def p19_positive_score(spark, sf):
    x = three_classes(spark, sf)
    return x.select("doc_id", R6(p.positive_score(F.col("p"), False)).alias("many"), R6(p.positive_score(F.array(1 - F.col("a"), F.col("a")), True)).alias("two"))


@query("SELECT o_orderkey, o_totalprice::DOUBLE AS o_totalprice_mean, 0.0::DOUBLE AS o_totalprice_std, 0.0::DOUBLE AS o_totalprice_range, NULL::DOUBLE AS o_totalprice_trend FROM orders")
def p20_patient_row(spark, sf):
    return p.patient_row(table(spark, sf, "orders"), ["o_orderkey"], ["o_totalprice"])


@query("WITH k AS (SELECT event_type, avg(value) AS m, stddev_pop(value) AS s FROM events GROUP BY 1) SELECT event_id, round((value - m) / (s + 1e-8), 6) AS z FROM events JOIN k USING (event_type)")
def p23_channel_norm(spark, sf):
    return p.z_norm(table(spark, sf, "events"), "event_type", "value", "z").select("event_id", R6("z").alias("z"))


@query("WITH r AS (SELECT min(value) AS lo, max(value) AS hi FROM events WHERE event_type = 'click') SELECT event_id, round(least(greatest((value - lo) / (hi - lo), 0), 1), 6) AS unit FROM events, r")
def p24_min_max_reference(spark, sf):
    return p.min_max(table(spark, sf, "events"), "value", F.col("event_type") == "click", "unit").select("event_id", R6("unit").alias("unit"))


FEATURES = {"head_rms_mean": "l_quantity", "lb_lyapunov_mean": "l_discount", "head_lb_lyapunov_ratio_mean": "l_tax", "left_peak_mean": "l_extendedprice", "cadence_mean": "l_linenumber"}


def wide(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", *(F.col(c).cast("double").alias(n) for n, c in FEATURES.items()))


@query("SELECT l_orderkey, feature, value FROM (SELECT l_orderkey, l_quantity::DOUBLE AS head_rms_mean, l_discount::DOUBLE AS lb_lyapunov_mean, l_tax::DOUBLE AS head_lb_lyapunov_ratio_mean FROM lineitem) UNPIVOT (value FOR feature IN (head_rms_mean, lb_lyapunov_mean, head_lb_lyapunov_ratio_mean))")
def p25_sensor_columns(spark, sf):
    w = wide(spark, sf)
    return w.unpivot(["l_orderkey"], p.columns_of_sensors(w.columns, ["head", "lower_back"]), "feature", "value")


@query("SELECT l_orderkey, l_discount::DOUBLE AS lb_lyapunov_mean FROM lineitem")
def p26_group_columns(spark, sf):
    """Features of the base `lyapunov`; the ratio of two sites isn't among them."""
    w = wide(spark, sf)
    return w.select("l_orderkey", *p.columns_of_bases(w.columns, ["lyapunov"]))


@query("SELECT c_custkey FROM customer WHERE NOT starts_with(c_name, 'Customer#00000001') AND c_mktsegment <> 'MACHINERY'")
def p27_without_external(spark, sf):
    return p.without_external(table(spark, sf, "customer"), "c_name", "Customer#00000001", "c_mktsegment", ["MACHINERY"]).select("c_custkey")


@query("SELECT l_linestatus || '_' || lower(l_returnflag) || 'x' AS model, l_linestatus || ' ' || l_returnflag || 'x' AS display_name, 'classical' AS paradigm, round(avg(l_discount), 6) AS auroc, NULL::DOUBLE AS mcc FROM lineitem GROUP BY 1, 2")
def p29_comparison_rows(spark, sf):
    name = F.concat("l_linestatus", F.lit("_"), F.lower("l_returnflag"), F.lit("x"))
    x = table(spark, sf, "lineitem").groupBy(name.alias("name")).agg(R6(F.avg("l_discount")).alias("auc"))
    return p.comparison_rows(x, "name", {"auroc": ["auroc", "auc"], "mcc": ["mcc"]}, "classical")
