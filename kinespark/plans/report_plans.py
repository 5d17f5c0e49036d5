"""Event matching, joins, report tables and splits on the given tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from kinespark.functions.hashes import unit, unit_sql
from kinespark.operators import matching as mt
from kinespark.operators import metrics as m
from kinespark.operators import policy as p
from kinespark.plans.evaluation import OOF, PAIRS, UNION, by_model, oof, rounded
from kinespark.plans.policy_plans import FEATURES, TIER, TIERS, wide
from kinespark.plans.register import query, table

R6 = lambda c: F.round(c, 6)
TOLERANCE = 7200
TIMES = "e AS (SELECT user_id, CASE WHEN user_id % 2 = 0 THEN 'left' ELSE 'right' END AS side, 'c' || user_id % 3 AS cohort, event_type, value, epoch_us(ts) // 1000000 AS s FROM events)"


def times(spark, sf):
    u = F.col("user_id")
    return table(spark, sf, "events").select("user_id", F.when(u % 2 == 0, "left").otherwise("right").alias("side"), F.concat(F.lit("c"), (u % 3).cast("string")).alias("cohort"), "event_type", "value", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).alias("s"))


def matched_sql(detected: str, keys: str) -> str:
    """Greedy matching by recursion over each trial's true events."""
    return f"""{TIMES}, d AS (SELECT {keys}, list(s ORDER BY s) AS ds FROM {detected} GROUP BY ALL), t AS (SELECT {keys}, list(s ORDER BY s) AS ts FROM TRUTH GROUP BY ALL),
k AS (SELECT {keys}, coalesce(ds, []) AS ds, coalesce(ts, []) AS ts FROM d FULL JOIN t USING ({keys})),
r AS (SELECT {keys}, ds, ts, 0 AS i, []::BIGINT[] AS used, 0::BIGINT AS tp, 0::BIGINT AS error FROM k
  UNION ALL SELECT {keys}, ds, ts, i + 1, CASE WHEN b IS NULL THEN used ELSE list_append(used, b[2]) END, tp + (b IS NOT NULL)::INT, error + coalesce(b[1], 0) FROM
  (SELECT *, list_min(list_filter(list_transform(range(1, len(ds) + 1), lambda j: [abs(ds[j] - ts[i + 1]), j]), lambda c: c[1] <= {TOLERANCE} AND NOT list_contains(used, c[2]))) AS b FROM r WHERE i < len(ts))),
m AS (SELECT {keys}, tp, len(ds) - tp AS fp, len(ts) - tp AS fn, len(ds) AS n_detected, len(ts) AS n_truth, error FROM r WHERE i = len(ts))"""


MATCHED = matched_sql("(SELECT * FROM e WHERE event_type = 'click')", "user_id, side, cohort").replace("FROM TRUTH", "FROM (SELECT * FROM e WHERE event_type = 'view')")
SCORES = "round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END, 6) AS recall, round(CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) END, 6) AS f1, round(CASE WHEN tp > 0 THEN error / tp END, 6) AS mean_error"
SUMS = "count(DISTINCT user_id) AS n_trials, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(n_detected)::BIGINT AS n_detected, sum(n_truth)::BIGINT AS n_truth, sum(error)::BIGINT AS error"


def matches(spark, sf):
    e = times(spark, sf)
    return mt.match_events(e.filter("event_type = 'click'"), e.filter("event_type = 'view'"), ["user_id", "side", "cohort"], "s", TOLERANCE)


@query(f"WITH RECURSIVE {MATCHED} SELECT * FROM m")
def j3_event_matching(spark, sf):
    return matches(spark, sf)


def summary(df):
    return df.withColumn("f1", F.when(F.col("tp") > 0, F.col("f1"))).withColumns({c: R6(c) for c in ("precision", "recall", "f1", "mean_error")})


@query(f"WITH RECURSIVE {MATCHED}, g AS (SELECT coalesce(side, 'both') AS side, {SUMS} FROM m GROUP BY GROUPING SETS ((side), ())) SELECT side, n_trials, tp, fp, fn, n_detected, n_truth, {SCORES} FROM g")
def a1_detection_by_side(spark, sf):
    return summary(mt.detection_summary(matches(spark, sf), [["side"], []], "user_id"))


@query(f"WITH RECURSIVE {MATCHED}, g AS (SELECT cohort, coalesce(side, 'both') AS side, {SUMS} FROM m GROUP BY GROUPING SETS ((cohort, side), (cohort))) SELECT cohort, side, n_trials, tp, fp, fn, n_detected, n_truth, {SCORES} FROM g")
def a2_detection_by_cohort(spark, sf):
    return summary(mt.detection_summary(matches(spark, sf), [["cohort", "side"], ["cohort"]], "user_id"))


TUNED = matched_sql("(SELECT e.*, percentile FROM e JOIN q USING (user_id) WHERE value >= cut)", "user_id, cohort, percentile").replace("FROM TRUTH", "FROM (SELECT e.*, percentile FROM e, (SELECT unnest([50.0, 70.0, 90.0])::DOUBLE AS percentile) WHERE event_type = 'view')")
CUTS = " UNION ALL ".join(f"SELECT user_id, {c}::DOUBLE AS percentile, quantile_cont(value, {c / 100}) AS cut FROM e GROUP BY user_id" for c in (50.0, 70.0, 90.0))
TUNED = TUNED.replace(", d AS (SELECT", f", q AS ({CUTS}), d AS (SELECT", 1)


@query(f"""WITH RECURSIVE {TUNED}, f AS (SELECT cohort, percentile, round(avg(2 * tp / (2 * tp + fp + fn)), 12) AS mean_f1 FROM m WHERE tp > 0 GROUP BY 1, 2)
SELECT cohort, percentile, round(mean_f1, 6) AS mean_f1 FROM f QUALIFY row_number() OVER (PARTITION BY cohort ORDER BY mean_f1 DESC, percentile) = 1""")
def a3_tuned_percentile(spark, sf):
    e, grid = times(spark, sf), [50.0, 70.0, 90.0]
    detected = mt.above_percentile(e, ["user_id"], "value", grid)
    truth = e.filter("event_type = 'view'").withColumn("percentile", F.explode(F.array(*map(F.lit, grid))))
    scores = mt.f_scores(mt.match_events(detected, truth, ["user_id", "cohort", "percentile"], "s", TOLERANCE))
    return mt.tuned_percentile(scores, "cohort", "percentile", "f1").withColumn("mean_f1", R6("mean_f1"))


@query("""WITH e AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, count(*) OVER (PARTITION BY user_id) AS n FROM events),
w AS (SELECT DISTINCT user_id, unnest(range(0, n - 20 + 1, 10)) AS window_start FROM e WHERE n >= 20) SELECT event_id, window_start FROM e JOIN w ON e.user_id = w.user_id AND idx BETWEEN window_start AND window_start + 19""")
def j5_window_membership(spark, sf):
    from kinespark.operators import signals as g

    e = g.indexed(table(spark, sf, "events").select("event_id", "user_id", "ts"), ["user_id"], ["ts", "event_id"])
    return g.windows(e, ["user_id"], "idx", 20, 10).select("event_id", "window_start")


@query(f"WITH {OOF}, g AS (SELECT DISTINCT pid FROM oof) SELECT g.pid AS held_out, count(*) AS n, round(avg(a), 6) AS mean FROM g JOIN oof o ON o.pid <> g.pid GROUP BY 1")
def j8_held_out_means(spark, sf):
    """What the expansion of each row to all other participants gives, by sums less a participant's own."""
    g = oof(spark, sf).groupBy("pid").agg(F.count("*").alias("k"), F.sum("a").alias("s"))
    whole = g.agg(F.sum("k").alias("all_k"), F.sum("s").alias("all_s"))
    x = g.crossJoin(F.broadcast(whole)).withColumn("n", F.col("all_k") - F.col("k"))
    return x.filter("n > 0").select(F.col("pid").alias("held_out"), "n", R6((F.col("all_s") - F.col("s")) / F.col("n")).alias("mean"))


@query("""WITH e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS idx, value FROM events)
SELECT a.user_id, a.idx, a.value AS signal, b.value AS label FROM e a JOIN e b ON a.user_id = b.user_id AND a.idx = b.idx AND a.event_type = 'click' AND b.event_type = 'view'""")
def j12_positional_labels(spark, sf):
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    e = table(spark, sf, "events").withColumn("idx", F.row_number().over(w) - 1)
    part = lambda kind, name: e.filter(F.col("event_type") == kind).select("user_id", "idx", F.col("value").alias(name))
    return mt.positional(part("click", "signal"), part("view", "label"), ["user_id"], "idx")


AUCS = f"{UNION}, auc AS (SELECT p.model, p.cohort, {PAIRS} AS auc FROM u p JOIN u n ON p.model = n.model AND p.cohort = n.cohort AND p.y = 1 AND n.y = 0 GROUP BY 1, 2)"


def cohort_aucs(spark, sf):
    return m.auc(by_model(spark, sf), ["model", "cohort"], "y", "s").filter("auc is not null").select("model", "cohort", "auc")


@query(f"WITH {AUCS} SELECT a.cohort, round(a.auc, 6) AS nested, round(b.auc, 6) AS deployed, round(b.auc - a.auc, 6) AS delta FROM auc a JOIN auc b ON a.cohort = b.cohort AND a.model = 'a' AND b.model = 'b'")
def j13_deploy_gap(spark, sf):
    x = cohort_aucs(spark, sf)
    one = lambda k, name: x.filter(F.col("model") == k).select("cohort", F.col("auc").alias(name))
    return rounded(one("a", "nested").join(one("b", "deployed"), "cohort").withColumn("delta", F.col("deployed") - F.col("nested")), "nested", "deployed", "delta")


@query(f"""WITH {AUCS}, p AS (SELECT cohort, avg(y)::DOUBLE AS p FROM u WHERE model = 'a' GROUP BY 1) SELECT model, cohort, round(auc, 6) AS auc, CASE WHEN model = 'a' THEN 'ref' WHEN p < 0.001 THEN '<0.001' ELSE printf('%.3f', p) END AS p_value
FROM auc LEFT JOIN p USING (cohort) ORDER BY auc DESC, model, cohort""")
def j14_k8_metric_table(spark, sf):
    """Metrics with the p-values joined on, the best first."""
    p_values = oof(spark, sf).groupBy("cohort").agg(F.avg("y").alias("p"))
    x = cohort_aucs(spark, sf).join(p_values, "cohort", "left")
    shown = F.when(F.col("model") == "a", "ref").otherwise(p.p_text(F.col("p")))
    return x.orderBy(F.desc("auc"), "model", "cohort").select("model", "cohort", R6("auc").alias("auc"), shown.alias("p_value"))


@query(f"""WITH c AS (SELECT c_mktsegment AS cohort, {TIER} AS t FROM customer) SELECT cohort, count(*) AS n_participants, max(t)::INT AS multiclass_label, (max(t) >= 1)::INT AS binary_at_1, (max(t) >= 2)::INT AS binary_at_2 FROM c GROUP BY 1 ORDER BY 2 DESC, 1""")
def a7_cohort_label_table(spark, sf):
    c = p.labels(table(spark, sf, "customer").select(F.col("c_mktsegment").alias("cohort")), "cohort", TIERS)
    g = c.groupBy("cohort").agg(F.count("*").alias("n_participants"), F.max("multiclass_label").alias("multiclass_label"))
    return g.select("*", *((F.col("multiclass_label") >= k).cast("int").alias(f"binary_at_{k}") for k in (1, 2))).orderBy(F.desc("n_participants"), "cohort")


@query("""SELECT 'head' AS "group", 1 AS n_columns, count(l_quantity) AS n_values FROM lineitem UNION ALL SELECT 'trunk', 1, count(l_discount) FROM lineitem UNION ALL SELECT 'ratio', 1, count(l_tax) FROM lineitem""")
def a23_group_sizes(spark, sf):
    """Columns of each feature group, and how many values they hold."""
    w = wide(spark, sf)
    groups = {"head": ["head_rms"], "trunk": ["lyapunov"], "ratio": ["head_lb_lyapunov_ratio"]}
    sizes = p.group_sizes(spark, w.columns, groups).select("group", "n_columns", "columns")
    counts = w.agg(*(F.count(c).alias(c) for c in FEATURES)).unpivot([], list(FEATURES), "columns", "n_values")
    return sizes.join(F.broadcast(counts), "columns").select("group", "n_columns", "n_values")


@query("""WITH x AS (SELECT l_returnflag AS class, l_linestatus AS cohort, unnest(['quantity', 'discount', 'tax']) AS feature, unnest([l_quantity::DOUBLE, l_discount::DOUBLE, l_tax::DOUBLE]) - 0.05 AS v FROM lineitem)
SELECT coalesce(class, 'all') AS class, coalesce(cohort, 'all') AS cohort, feature, round(avg(abs(v)), 6) AS importance, round(stddev_pop(abs(v)), 6) AS spread, count(*) AS n FROM x GROUP BY GROUPING SETS ((feature), (class, feature), (cohort, feature))""")
def a24_importance(spark, sf):
    """Mean absolute contribution by feature, by class and by cohort; contributions are the table's long form."""
    kinds = {"quantity": "l_quantity", "discount": "l_discount", "tax": "l_tax"}
    x = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("class"), F.col("l_linestatus").alias("cohort"), *((F.col(c).cast("double") - 0.05).alias(n) for n, c in kinds.items()))
    v = F.abs("v")
    long = x.unpivot(["class", "cohort"], list(kinds), "feature", "v")
    sets = [[], ["class"], ["cohort"]]
    parts = [long.groupBy(*s, "feature").agg(R6(F.avg(v)).alias("importance"), R6(F.stddev_pop(v)).alias("spread"), F.count("*").alias("n")) for s in sets]
    parts = [g.select(*((F.col(k) if k in s else F.lit("all")).alias(k) for k in ("class", "cohort")), "feature", "importance", "spread", "n") for g, s in zip(parts, sets, strict=True)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"""WITH {AUCS}, x AS (SELECT 'classical_' || cohort AS model, auc FROM auc WHERE model = 'a' UNION ALL SELECT 'ensemble_' || cohort, auc FROM auc WHERE model = 'b')
SELECT model, round(auc, 6) AS auroc, CASE WHEN (SELECT max(auc) FROM x WHERE starts_with(model, 'ensemble')) >= 0.6 THEN 'ensemble_primary' ELSE 'auroc_primary' END AS headline FROM x""")
def a26_comparison_matrix(spark, sf):
    x = cohort_aucs(spark, sf)
    part = lambda k, name: p.comparison_rows(x.filter(F.col("model") == k).select(F.concat(F.lit(f"{name}_"), "cohort").alias("model"), "auc"), "model", {"auroc": ["auroc", "auc"]}, name)
    both = part("a", "classical").unionByName(part("b", "ensemble"), allowMissingColumns=True)
    lead = both.agg(F.max(F.when(F.col("paradigm") == "ensemble", F.col("auroc"))).alias("lead"))
    return both.crossJoin(F.broadcast(lead)).select("model", R6("auroc").alias("auroc"), F.when(F.col("lead") >= 0.6, "ensemble_primary").otherwise("auroc_primary").alias("headline"))


@query(f"""WITH t AS (SELECT user_id, 'c' || user_id % 3 AS cohort, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS duration FROM events GROUP BY 1), r AS (SELECT min(duration) AS lo, max(duration) AS hi FROM t)
SELECT cohort, least(floor((duration - lo) / greatest(hi - lo, 1e-9) * 10), 9)::INT AS bin, count(*) AS n FROM t, r GROUP BY 1, 2""")
def a27_duration_histogram(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    t = e.groupBy("user_id").agg(((F.max("us") - F.min("us")) / 1e6).alias("duration"))
    r = t.agg(F.min("duration").alias("lo"), F.max("duration").alias("hi"))
    at = F.least(F.floor((F.col("duration") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-9)) * 10), F.lit(9)).cast("int")
    return t.crossJoin(F.broadcast(r)).groupBy(F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string")).alias("cohort"), at.alias("bin")).agg(F.count("*").alias("n"))


@query(f"""WITH {OOF}, l AS (SELECT DISTINCT cohort AS class FROM oof), x AS (SELECT class, (cohort = class)::INT AS y, a AS s FROM oof, l)
SELECT p.class, round(avg(CASE WHEN p.s > n.s THEN 1.0 WHEN p.s = n.s THEN 0.5 ELSE 0 END), 6) AS auc FROM x p JOIN x n ON p.class = n.class AND p.y = 1 AND n.y = 0 GROUP BY 1 ORDER BY 2 DESC, 1""")
def a28_per_class_auc(spark, sf):
    """AUC of each class against the others, the best first; rows are counted by score before they are repeated by class."""
    o = oof(spark, sf)
    counts = o.groupBy("cohort", "a").agg(F.count("*").alias("n"))
    classes = o.select(F.col("cohort").alias("class")).distinct()
    x = counts.crossJoin(F.broadcast(classes)).groupBy("class", F.col("a").alias("s")).agg(F.sum(F.when(F.col("cohort") == F.col("class"), F.col("n")).otherwise(0)).alias("pos"), F.sum(F.when(F.col("cohort") != F.col("class"), F.col("n")).otherwise(0)).alias("neg"))
    return m.auc_of_counts(x, ["class"]).orderBy(F.desc("auc"), "class").select("class", R6("auc").alias("auc"))


SPLIT = f"s AS (SELECT c_custkey, c_mktsegment, CASE WHEN c_mktsegment <> 'BUILDING' THEN 'test' WHEN {unit_sql('c_custkey')} < 0.7 THEN 'train' WHEN {unit_sql('c_custkey')} < 0.85 THEN 'val' ELSE 'test' END AS role FROM customer)"


def split(spark, sf):
    from kinespark.operators import stats as t

    return t.subject_holdout(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", F.col("c_mktsegment") == "BUILDING")


@query(f"WITH {SPLIT} SELECT role, count(*) AS n, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS n_healthy FROM s GROUP BY 1")
def k6_split_manifest(spark, sf):
    s = split(spark, sf).join(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_custkey")
    return s.groupBy("role").agg(F.count("*").alias("n"), F.count_if(F.col("c_mktsegment") == "BUILDING").alias("n_healthy"))


@query(f"WITH {SPLIT} SELECT o_orderkey, role = 'train' AS train, role = 'train' AND c_mktsegment = 'BUILDING' AS healthy_train FROM orders JOIN s ON o_custkey = c_custkey")
def x2_row_masks(spark, sf):
    s = split(spark, sf).join(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_custkey")
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")).join(s, "c_custkey")
    return o.select("o_orderkey", (F.col("role") == "train").alias("train"), ((F.col("role") == "train") & (F.col("c_mktsegment") == "BUILDING")).alias("healthy_train"))


@query(f"""WITH g AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {unit_sql('c_custkey', seed=7)}, c_custkey) AS k, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer)
SELECT c_custkey, CASE WHEN k <= greatest(1, round_even(n * 0.2, 0)) THEN 'val' ELSE 'train' END AS role FROM g""")
def x6_inner_split(spark, sf):
    """Train and validation participants within each label, by a seed of the fold."""
    from kinespark.operators import stats as t

    return t.stratified_split(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", "c_mktsegment", 0.2, 7)


@query("""WITH s AS (SELECT unnest([1, 2, 3, 4, 5, 6, 7]) AS mask), x AS (SELECT mask, l_orderkey, CASE WHEN mask & 1 > 0 THEN l_quantity ELSE 0 END + CASE WHEN mask & 2 > 0 THEN l_discount ELSE 0 END + CASE WHEN mask & 4 > 0 THEN l_tax ELSE 0 END AS v FROM lineitem, s)
SELECT concat_ws('+', CASE WHEN mask & 1 > 0 THEN 'quantity' END, CASE WHEN mask & 2 > 0 THEN 'discount' END, CASE WHEN mask & 4 > 0 THEN 'tax' END) AS scenario, round(sum(v), 4) AS total FROM x GROUP BY mask""")
def x8_sensor_subsets(spark, sf):
    """Every non-empty subset of the parts as a scenario, in one pass over the rows."""
    from kinespark.operators import stats as t

    parts = {"quantity": "l_quantity", "discount": "l_discount", "tax": "l_tax"}
    sums = table(spark, sf, "lineitem").agg(*(F.sum(F.col(c).cast("double")).alias(n) for n, c in parts.items()))
    return sums.select(F.explode(F.array(*(F.struct(F.lit("+".join(s)).alias("scenario"), F.round(sum((F.col(c) for c in s), F.lit(0.0)), 4).alias("total")) for s in t.subsets(list(parts))))).alias("x")).select("x.*")


@query(f"""WITH {OOF}, t AS (SELECT cohort, quantile_cont(a, 0.9) FILTER (WHERE y = 0 AND doc_id % 5 <> 0) AS th FROM oof GROUP BY 1) SELECT cohort, round(th, 6) AS threshold, true AS stable FROM t""")
def q26_threshold_leak_guard(spark, sf):
    """The threshold of training rows, and that it stays when held-out scores are changed."""
    from kinespark.operators import quality as q

    held = F.col("doc_id") % 5 == 0
    return q.threshold_guard(oof(spark, sf), ["cohort"], "a", (F.col("y") == 0) & ~held, held, 0.9).withColumn("threshold", R6("threshold"))


@query("""WITH l AS (SELECT l_orderkey AS file, CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS annotation FROM lineitem)
SELECT file, count(*) AS n_raw, count(*) FILTER (WHERE annotation = 0) AS n_dropped, count(*) FILTER (WHERE annotation <> 0) AS n_kept FROM l GROUP BY 1""")
def s7_recording_stats(spark, sf):
    from kinespark.sources import scan

    l = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("file"), F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2).alias("annotation"))  # noqa: E741
    return scan.recording_stats(l, "file", "annotation")


@query("SELECT o_custkey AS subject, o_orderkey AS source_trial, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS row_in_subject, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def s8_subject_order(spark, sf):
    from kinespark.sources import scan

    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("subject"), F.col("o_orderkey").alias("source_trial"))
    rows = o.join(table(spark, sf, "lineitem"), F.col("source_trial") == F.col("l_orderkey"))
    return scan.subject_rows(rows, "subject", ["source_trial"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]).select("subject", "source_trial", "row_in_subject", "l_quantity")
