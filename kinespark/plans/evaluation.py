"""Evaluation queries. The out-of-fold table is labels with documents: source as participant, language as cohort.

Scores come from md5 of the id and lean to the label: a is continuous, b has three decimals and so ties."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from kinespark.functions.ranges import range_cuts
from kinespark.operators import metrics as m
from kinespark.plans.register import query, table

UNIFORM = "('0x' || substr(md5('{}' || doc_id::VARCHAR), 1, 12))::BIGINT / 281474976710656.0::DOUBLE"
OOF = f"oof AS (SELECT doc_id, d.source AS pid, d.lang AS cohort, l.toxic AS y, l.quality AS quality, 0.75 * {UNIFORM.format('a')} + 0.25 * l.toxic AS a, round(0.8 * {UNIFORM.format('b')} + 0.2 * l.toxic, 3) AS b FROM labels l JOIN documents d USING (doc_id))"
R6 = lambda c: F.round(c, 6)
UNION = f"{OOF}, u AS (SELECT 'a' AS model, doc_id, pid, cohort, y, a AS s FROM oof UNION ALL SELECT 'b', doc_id, pid, cohort, y, b FROM oof)"


def uniform(salt):
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), F.col("doc_id").cast("string"))), 1, 12), 16, 10).cast("double") / float(1 << 48)


def oof(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("source").alias("pid"), F.col("lang").alias("cohort"))
    joined = table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("y"), "quality").join(d, "doc_id")
    return joined.withColumn("a", 0.75 * uniform("a") + 0.25 * F.col("y")).withColumn("b", F.round(0.8 * uniform("b") + 0.2 * F.col("y"), 3))


def by_model(spark, sf):
    o = oof(spark, sf)
    return o.select("doc_id", "pid", "cohort", "y", F.explode(F.array(F.struct(F.lit("a").alias("model"), F.col("a").alias("s")), F.struct(F.lit("b").alias("model"), F.col("b").alias("s")))).alias("m")).select("m.model", "doc_id", "pid", "cohort", "y", "m.s")


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


PAIRS = "avg(CASE WHEN p.s > n.s THEN 1.0 WHEN p.s = n.s THEN 0.5 ELSE 0 END)"


@query(f"WITH {OOF} SELECT doc_id, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS rank FROM oof")
def w1_mid_rank(spark, sf):
    return m.mid_ranks(oof(spark, sf).select("doc_id", "a"), [], "a", "rank").select("doc_id", "rank")


@query(f"WITH {UNION} SELECT p.model, round({PAIRS}, 6) AS auc FROM u p JOIN u n ON p.model = n.model AND p.y = 1 AND n.y = 0 GROUP BY 1")
def w2_auc(spark, sf):
    return rounded(m.auc(by_model(spark, sf), ["model"], "y", "s").select("model", "auc"), "auc")


@query(f"""WITH {OOF}, c AS (SELECT a AS threshold, sum(y) AS p, sum(1 - y) AS n FROM oof GROUP BY 1)
SELECT threshold, round(sum(p) OVER w / sum(p) OVER (), 6) AS tpr, round(sum(n) OVER w / sum(n) OVER (), 6) AS fpr FROM c WINDOW w AS (ORDER BY threshold DESC)""")
def w3_roc_curve(spark, sf):
    return rounded(m.roc_points(oof(spark, sf), [], "y", "a").select("threshold", "tpr", "fpr"), "tpr", "fpr")


@query(f"""WITH {UNION}, c AS (SELECT model, s, sum(y) AS p, count(*) AS n FROM u GROUP BY 1, 2),
d AS (SELECT model, p, sum(p) OVER w AS tp, sum(n) OVER w AS k, sum(p) OVER (PARTITION BY model) AS all_p FROM c WINDOW w AS (PARTITION BY model ORDER BY s DESC))
SELECT model, round(sum(p / all_p * tp / k), 6) AS ap FROM d GROUP BY 1""")
def w4_average_precision(spark, sf):
    return rounded(m.average_precision(by_model(spark, sf), ["model"], "y", "s"), "ap")


YOUDEN = f"""{UNION}, c AS (SELECT model, s, sum(y) AS p, sum(1 - y) AS n FROM u GROUP BY 1, 2),
r AS (SELECT model, s, round(sum(p) OVER w / sum(p) OVER (PARTITION BY model) - sum(n) OVER w / sum(n) OVER (PARTITION BY model), 12) AS j FROM c WINDOW w AS (PARTITION BY model ORDER BY s DESC)),
t AS (SELECT model, s AS threshold, j FROM r QUALIFY row_number() OVER (PARTITION BY model ORDER BY j DESC, s DESC) = 1)"""


@query(f"WITH {YOUDEN} SELECT model, round(threshold, 6) AS threshold, round(j, 6) AS j FROM t")
def w5_youden(spark, sf):
    return rounded(m.youden(by_model(spark, sf), ["model"], "y", "s"), "threshold", "j")


@query(f"WITH {OOF} SELECT cohort, round(CASE WHEN count(*) FILTER (WHERE y = 0) >= 10 THEN quantile_cont(a, 0.95) FILTER (WHERE y = 0) ELSE 0.5 END, 6) AS threshold FROM oof GROUP BY 1")
def w6_w7_percentile_threshold(spark, sf):
    healthy = F.expr("percentile(case when y = 0 then a end, 0.95)")
    return oof(spark, sf).groupBy("cohort").agg(F.round(F.when(F.count_if(F.col("y") == 0) >= 10, healthy).otherwise(0.5), 6).alias("threshold"))


@query(f"""WITH {OOF}, r AS (SELECT doc_id, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb, count(*) OVER () AS n FROM oof)
SELECT doc_id, round(0.5 * (ra / n + rb / n), 6) AS fused FROM r""")
def w8_rank_fusion(spark, sf):
    o = oof(spark, sf).select("doc_id", "a", "b")
    cuts = range_cuts(o, "a", "b")
    ranked = m.mid_ranks(m.mid_ranks(o, [], "a", "ra", cuts[0]), [], "b", "rb", cuts[1])
    n = o.agg(F.count("*").alias("n"))
    return ranked.crossJoin(F.broadcast(n)).select("doc_id", F.round(0.5 * (F.col("ra") / F.col("n") + F.col("rb") / F.col("n")), 6).alias("fused"))


@query(f"""WITH {OOF}, r AS (SELECT min(a) FILTER (WHERE y = 0) AS la, max(a) FILTER (WHERE y = 0) AS ha, min(b) FILTER (WHERE y = 0) AS lb, max(b) FILTER (WHERE y = 0) AS hb FROM oof)
SELECT doc_id, round(0.7 * least(greatest((a - la) / (ha - la), 0), 1) + 0.3 * least(greatest((b - lb) / (hb - lb), 0), 1), 6) AS fused FROM oof, r""")
def w9_minmax_fusion(spark, sf):
    o = oof(spark, sf)
    ref = o.filter("y = 0").agg(*(f(c).alias(f"{n}{c}") for c in ("a", "b") for f, n in ((F.min, "l"), (F.max, "h"))))

    def unit(c):
        span = F.col(f"h{c}") - F.col(f"l{c}")
        return F.when(span == 0, 0.0).otherwise(F.least(F.greatest((F.col(c) - F.col(f"l{c}")) / span, F.lit(0.0)), F.lit(1.0)))

    return o.crossJoin(F.broadcast(ref)).select("doc_id", F.round(0.7 * unit("a") + 0.3 * unit("b"), 6).alias("fused"))


P = f"{OOF}, t AS (SELECT pid, avg(y)::DOUBLE AS p FROM oof GROUP BY 1)"


def p_values(spark, sf):
    return oof(spark, sf).groupBy("pid").agg(F.avg("y").alias("p"))


@query(f"""WITH {P}, r AS (SELECT pid, p, p * count(*) OVER () / (count(*) OVER (ORDER BY p)) AS q FROM t)
SELECT pid, round(least(min(q) OVER (ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1), 6) AS q FROM r""")
def w10_benjamini_hochberg(spark, sf):
    return m.benjamini_hochberg(p_values(spark, sf), "p", "q").select("pid", F.round("q", 6).alias("q"))


@query(f"""WITH {P}, r AS (SELECT pid, p, (count(*) OVER () - row_number() OVER (ORDER BY p, pid) + 1) * p AS h FROM t)
SELECT pid, round(least(max(h) OVER (ORDER BY p, pid), 1), 6) AS adjusted FROM r""")
def w11_holm(spark, sf):
    return m.holm(p_values(spark, sf), "p", "adjusted").select("pid", F.round("adjusted", 6).alias("adjusted"))


@query(f"""WITH {UNION}, f AS (SELECT pid, model, avg(s) AS v FROM u GROUP BY 1, 2), r AS (SELECT model, rank() OVER (PARTITION BY pid ORDER BY round(v, 9) DESC) + (count(*) OVER (PARTITION BY pid, round(v, 9)) - 1) / 2.0 AS rk FROM f)
SELECT model, round(avg(rk), 6) AS mean_rank FROM r GROUP BY 1""")
def w12_model_ranks(spark, sf):
    f = by_model(spark, sf).groupBy("pid", "model").agg((-F.round(F.avg("s"), 9)).alias("v"))
    return m.mid_ranks(f, ["pid"], "v", "rk", []).groupBy("model").agg(F.round(F.avg("rk"), 6).alias("mean_rank"))


@query("SELECT source AS feature, sum(n_chars)::BIGINT AS importance FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def w13_top_features(spark, sf):
    return table(spark, sf, "documents").groupBy(F.col("source").alias("feature")).agg(F.sum("n_chars").alias("importance")).orderBy(F.desc("importance"), "feature").limit(5)


NAMED = "contains(feature, '_de') OR contains(feature, '_fr')"


@query(f"""WITH f AS (SELECT source || '_' || lang AS feature, sum(n_chars)::BIGINT AS importance FROM documents GROUP BY 1), a AS (SELECT *, {NAMED} AS named, row_number() OVER (ORDER BY importance DESC, feature) AS alone, row_number() OVER (PARTITION BY {NAMED} ORDER BY importance DESC, feature) AS k FROM f),
p AS (SELECT *, row_number() OVER (ORDER BY NOT (named AND k <= 3), importance DESC, feature) AS place FROM a) SELECT feature, importance, place, alone > 6 AS forced FROM p WHERE place <= 6""")
def w13_required_features(spark, sf):
    """Six features by importance, three of them at most for the families that must be there."""
    f = table(spark, sf, "documents").groupBy(F.concat_ws("_", "source", "lang").alias("feature")).agg(F.sum("n_chars").alias("importance"))
    return m.top_features(f, "feature", "importance", 6, ["_DE", "_fr"], 3)


@query(f"WITH {UNION}, x AS (SELECT cohort, model, round(avg(s), 12) AS v FROM u GROUP BY 1, 2) SELECT cohort, arg_max(model, (v, model)) AS best FROM x GROUP BY 1")
def w14_best_model(spark, sf):
    return by_model(spark, sf).groupBy("cohort", "model").agg(F.round(F.avg("s"), 12).alias("v")).groupBy("cohort").agg(F.max_by("model", F.struct("v", "model")).alias("best"))


@query("SELECT lang, count(*) AS n FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def w15_mode(spark, sf):
    return table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(1)


@query(f"""WITH {OOF}, g AS (SELECT DISTINCT pid FROM oof)
SELECT g.pid, round(avg(CASE WHEN p.a > n.a THEN 1.0 WHEN p.a = n.a THEN 0.5 ELSE 0 END), 6) AS auc FROM g JOIN oof p ON p.pid <> g.pid AND p.y = 1 JOIN oof n ON n.pid <> g.pid AND n.y = 0 GROUP BY 1""")
def w16_leave_one_out_auc(spark, sf):
    return rounded(m.leave_one_out_auc(oof(spark, sf), "pid", "y", "a"), "auc")


C = "count(*) FILTER (WHERE y = 1 AND a >= 0.5) AS tp, count(*) FILTER (WHERE y = 0 AND a >= 0.5) AS fp, count(*) FILTER (WHERE y = 0 AND a < 0.5) AS tn, count(*) FILTER (WHERE y = 1 AND a < 0.5) AS fn"


@query(f"WITH {OOF}, g AS (SELECT y, (a >= 0.5)::INT AS yhat, count(*) AS n FROM oof GROUP BY 1, 2) SELECT y, yhat, n, round(n / sum(n) OVER (PARTITION BY y), 6) AS share FROM g")
def a9_confusion(spark, sf):
    g = oof(spark, sf).groupBy("y", (F.col("a") >= 0.5).cast("int").alias("yhat")).agg(F.count("*").alias("n"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("y")), 6))


@query(f"""WITH {OOF}, c AS (SELECT cohort, {C} FROM oof GROUP BY 1)
SELECT *, round(tp / (tp + fn + 1e-10), 6) AS sensitivity, round(tn / (tn + fp + 1e-10), 6) AS specificity, round(tp / (tp + fp + 1e-10), 6) AS ppv, round(tn / (tn + fn + 1e-10), 6) AS npv, round((tp + tn) / (tp + fp + tn + fn + 1e-10), 6) AS accuracy FROM c""")
def a10_binary_rates(spark, sf):
    return rounded(m.rates(oof(spark, sf).groupBy("cohort").agg(*m.binary_counts("y", F.col("a") >= 0.5))), "sensitivity", "specificity", "ppv", "npv", "accuracy")


@query(f"""WITH {OOF}, x AS (SELECT cohort AS y, CASE WHEN a < 0.5 THEN cohort ELSE 'en' END AS h FROM oof), k AS (SELECT DISTINCT y AS k FROM x),
c AS (SELECT k, count(*) FILTER (WHERE y = k AND h = k) AS tp, count(*) FILTER (WHERE y <> k AND h = k) AS fp, count(*) FILTER (WHERE y = k AND h <> k) AS fn FROM x, k GROUP BY 1)
SELECT k AS class, tp + fn AS support, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def a11_class_report(spark, sf):
    x = oof(spark, sf).select(F.col("cohort").alias("y"), F.when(F.col("a") < 0.5, F.col("cohort")).otherwise("en").alias("h"))
    n = x.groupBy("y", "h").agg(F.count("*").alias("n"))
    hit = F.col("y") == F.col("h")
    own = n.groupBy(F.col("y").alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("tp"))
    said = n.groupBy(F.col("h").alias("class")).agg(F.sum("n").alias("said"))
    r = own.join(said, "class", "left")
    return r.select("class", "support", F.round(F.col("tp") / F.col("said"), 6).alias("precision"), F.round(F.col("tp") / F.col("support"), 6).alias("recall"), F.round(2 * F.col("tp") / (F.col("said") + F.col("support")), 6).alias("f1"))


@query(f"""WITH {OOF}, c AS (SELECT cohort, {C.replace(' AS tp', '::DOUBLE AS tp').replace(' AS fp', '::DOUBLE AS fp').replace(' AS tn', '::DOUBLE AS tn').replace(' AS fn', '::DOUBLE AS fn')} FROM oof GROUP BY 1)
SELECT cohort, round(((tp + fn) * coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) + (tn + fp) * coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0)) / (tp + fp + tn + fn), 6) AS weighted_f1,
  round((coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2, 6) AS balanced_accuracy, coalesce(round((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 6), 0) AS mcc,
  round(((tp + tn) / (tp + fp + tn + fn) - ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (tp + fp + tn + fn) ** 2) / (1 - ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (tp + fp + tn + fn) ** 2), 6) AS kappa FROM c""")
def a12_discriminative(spark, sf):
    r = m.discriminative(oof(spark, sf).groupBy("cohort").agg(*m.binary_counts("y", F.col("a") >= 0.5)))
    return rounded(r.select("cohort", "weighted_f1", "balanced_accuracy", "mcc", "kappa"), "weighted_f1", "balanced_accuracy", "mcc", "kappa")


@query(f"""WITH {UNION}, n AS (SELECT model, pid, count(*) AS n, sum(y) AS p FROM u GROUP BY 1, 2), x AS (SELECT p.model, p.pid, {PAIRS} AS auc FROM u p JOIN u n ON p.model = n.model AND p.pid = n.pid AND p.y = 1 AND n.y = 0 GROUP BY 1, 2)
SELECT n.model, n.pid, n.n, CASE WHEN n.n >= 25 THEN round(auc, 6) END AS auc, CASE WHEN n.n < 25 THEN 'suppressed_small_n' WHEN auc IS NULL THEN 'single_class' ELSE 'ok' END AS status FROM n LEFT JOIN x USING (model, pid)""")
def a13_suppressed_metrics(spark, sf):
    r = m.auc(by_model(spark, sf), ["model", "pid"], "y", "s").withColumn("n", F.col("n_pos") + F.col("n_neg"))
    return r.select("model", "pid", "n", F.when(F.col("n") >= 25, F.round("auc", 6)).alias("auc"), F.when(F.col("n") < 25, "suppressed_small_n").when(F.col("auc").isNull(), "single_class").otherwise("ok").alias("status"))


@query(f"""WITH {OOF}, t AS (SELECT * FROM (VALUES ('fixed', 0.5), ('low', 0.25), ('high', 0.75)) v(rule, th))
SELECT rule, th AS threshold, round(count(*) FILTER (WHERE y = 1 AND a >= th) / (count(*) FILTER (WHERE y = 1) + 1e-10), 6) AS sensitivity, round(count(*) FILTER (WHERE y = 0 AND a < th) / (count(*) FILTER (WHERE y = 0) + 1e-10), 6) AS specificity FROM oof, t GROUP BY 1, 2""")
def a14_threshold_comparison(spark, sf):
    rules = F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(t).alias("threshold")) for n, t in (("fixed", 0.5), ("low", 0.25), ("high", 0.75))))
    x = oof(spark, sf).select("y", "a", F.explode(rules).alias("r")).select("y", "a", "r.*")
    return rounded(m.rates(x.groupBy("rule", "threshold").agg(*m.binary_counts("y", F.col("a") >= F.col("threshold")))).select("rule", "threshold", "sensitivity", "specificity"), "sensitivity", "specificity")


@query(f"""WITH {OOF}, k AS (SELECT DISTINCT cohort AS k FROM oof WHERE cohort <> 'en'), x AS (SELECT k, (cohort = k)::INT AS y, a AS s FROM oof, k WHERE cohort = k OR cohort = 'en')
SELECT p.k AS cohort, round({PAIRS}, 6) AS auc FROM x p JOIN x n ON p.k = n.k AND p.y = 1 AND n.y = 0 GROUP BY 1""")
def a15_cohort_vs_healthy(spark, sf):
    o = oof(spark, sf).select("cohort", "a")
    # the healthy cohort's counts by distinct score, not its rows, are repeated for each other cohort
    c = o.groupBy("cohort", F.col("a").alias("s")).agg(F.count("*").alias("n"))
    others = c.filter("cohort <> 'en'")
    kinds = others.select(F.col("cohort").alias("k")).distinct()
    neg = c.filter("cohort = 'en'").crossJoin(F.broadcast(kinds)).select("k", "s", F.lit(0).cast("long").alias("pos"), F.col("n").alias("neg"))
    both = neg.unionByName(others.select(F.col("cohort").alias("k"), "s", F.col("n").alias("pos"), F.lit(0).cast("long").alias("neg"))).groupBy("k", "s").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    w = Window.partitionBy("k").orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    u = both.withColumn("below", F.sum("neg").over(w) - F.col("neg") / 2).groupBy("k").agg((F.sum(F.col("pos") * F.col("below")) / (F.sum("pos") * F.sum("neg"))).alias("auc"))
    return u.select(F.col("k").alias("cohort"), F.round("auc", 6).alias("auc"))


@query(f"""WITH {OOF} SELECT cohort, count(*) AS n, count(DISTINCT pid) AS participants, round(avg(a), 6) AS mean, round(quantile_cont(a, 0.5), 6) AS median, round(stddev_pop(a), 6) AS sd, round(100 * avg((a >= 0.5)::INT), 6) AS flagged FROM oof GROUP BY 1""")
def a16_cohort_scores(spark, sf):
    return oof(spark, sf).groupBy("cohort").agg(F.count("*").alias("n"), F.count_distinct("pid").alias("participants"), R6(F.avg("a")).alias("mean"), R6(F.expr("percentile(a, 0.5)")).alias("median"), R6(F.stddev_pop("a")).alias("sd"), R6(100 * F.avg((F.col("a") >= 0.5).cast("int"))).alias("flagged"))


@query(f"""WITH {UNION}, r AS (SELECT model, cohort, avg((s >= 0.9)::INT) AS rate, row_number() OVER (PARTITION BY model ORDER BY avg((s >= 0.9)::INT) DESC, cohort) AS k FROM u GROUP BY 1, 2) SELECT model, cohort, round(rate, 6) AS rate, k FROM r WHERE k <= 2""")
def a17_anomaly_rates(spark, sf):
    r = by_model(spark, sf).groupBy("model", "cohort").agg(F.avg((F.col("s") >= 0.9).cast("int")).alias("rate"))
    return r.withColumn("k", F.row_number().over(Window.partitionBy("model").orderBy(F.desc("rate"), "cohort"))).filter("k <= 2").withColumn("rate", F.round("rate", 6))


@query(f"""WITH {OOF}, b AS (SELECT greatest(ceil(a * 10), 1)::INT AS bin, count(*) AS n, avg(a) AS p, avg(y) AS r FROM oof GROUP BY 1) SELECT bin, n, round(p, 6) AS mean_p, round(r, 6) AS rate, round(abs(p - r), 6) AS gap FROM b""")
def a18_reliability(spark, sf):
    return rounded(m.reliability(oof(spark, sf), "y", "a"), "mean_p", "rate", "gap")


@query(f"WITH {UNION} SELECT model, round(avg((s - y) ** 2), 6) AS brier, round(avg(s), 6) AS mean_p, round(avg(y), 6) AS prevalence FROM u GROUP BY 1")
def a19_brier(spark, sf):
    return by_model(spark, sf).groupBy("model").agg(R6(F.avg((F.col("s") - F.col("y")) ** 2)).alias("brier"), R6(F.avg("s")).alias("mean_p"), R6(F.avg("y")).alias("prevalence"))


@query(f"WITH {UNION} SELECT model, pid, round(avg(s), 6) AS mean FROM u GROUP BY 1, 2")
def a20_participant_means(spark, sf):
    return by_model(spark, sf).groupBy("model", "pid").agg(R6(F.avg("s")).alias("mean"))


@query(f"WITH {OOF} SELECT CASE WHEN a >= 0.7 THEN 'high' WHEN a >= 0.4 THEN 'moderate' ELSE 'low' END AS band, count(*) AS n FROM oof GROUP BY 1")
def a21_risk_bands(spark, sf):
    band = F.when(F.col("a") >= 0.7, "high").when(F.col("a") >= 0.4, "moderate").otherwise("low")
    return oof(spark, sf).groupBy(band.alias("band")).agg(F.count("*").alias("n"))


@query(f"""WITH {OOF}, x AS (SELECT 'all' AS scope, a, b FROM oof UNION ALL SELECT cohort, a, b FROM oof)
SELECT scope, round(avg(abs(a - b)), 6) AS mae, round(avg((a - b) ** 2), 6) AS mse, round(1 - sum((a - b) ** 2) / (sum(a * a) - sum(a) ** 2 / count(*)), 6) AS r2 FROM x GROUP BY 1""")
def a22_regression(spark, sf):
    o = oof(spark, sf).rollup("cohort").agg(F.avg(F.abs(F.col("a") - F.col("b"))).alias("mae"), F.avg((F.col("a") - F.col("b")) ** 2).alias("mse"), F.sum((F.col("a") - F.col("b")) ** 2).alias("sse"), F.var_pop("a").alias("v"), F.count("*").alias("n"))
    return o.select(F.coalesce("cohort", F.lit("all")).alias("scope"), R6("mae").alias("mae"), R6("mse").alias("mse"), R6(1 - F.col("sse") / (F.col("v") * F.col("n"))).alias("r2"))


@query("""WITH t AS (SELECT c_mktsegment AS cohort, o_custkey AS pid, count(*) AS n, min_by(c_acctbal, o_orderkey) AS age, mode(o_orderstatus ORDER BY o_orderstatus) AS sex FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT coalesce(cohort, 'Total') AS cohort, count(*) AS participants, sum(n)::BIGINT AS trials, round(avg(age), 6) AS age_mean, round(stddev_samp(age), 6) AS age_sd FROM t GROUP BY GROUPING SETS ((cohort), ())""")
def a4_a5_demographics(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    t = o.groupBy(F.col("c_mktsegment").alias("cohort"), "o_custkey").agg(F.count("*").alias("n"), F.min_by("c_acctbal", "o_orderkey").alias("age"))
    return t.rollup("cohort").agg(F.count("*").alias("participants"), F.sum("n").alias("trials"), R6(F.avg("age")).alias("age_mean"), R6(F.stddev_samp("age")).alias("age_sd")).withColumn("cohort", F.coalesce("cohort", F.lit("Total")))


@query(f"WITH {OOF} SELECT cohort, y, count(*) AS n, count(DISTINCT pid) AS participants FROM oof GROUP BY GROUPING SETS ((cohort, y), (cohort), (y))")
def a6_class_distribution(spark, sf):
    o = oof(spark, sf)
    o.createOrReplaceTempView("_oof_distribution")
    return spark.sql("SELECT cohort, y, count(*) AS n, count(DISTINCT pid) AS participants FROM _oof_distribution GROUP BY GROUPING SETS ((cohort, y), (cohort), (y))")


@query(f"WITH {OOF}, c AS (SELECT y, count(*) AS n FROM oof GROUP BY 1) SELECT y, n, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS weight FROM c")
def a8_class_weights(spark, sf):
    c = oof(spark, sf).groupBy("y").agg(F.count("*").alias("n"))
    whole = Window.partitionBy()
    return c.withColumn("weight", F.round(F.sum("n").over(whole) / (F.count("*").over(whole) * F.col("n")), 6))


@query(f"WITH {OOF} SELECT doc_id, (a >= 0.5)::INT + (b >= 0.5)::INT + (a + b >= 1)::INT AS votes, (a >= 0.5)::INT + (b >= 0.5)::INT + (a + b >= 1)::INT >= 2 AS flagged FROM oof")
def a25_method_vote(spark, sf):
    votes = (F.col("a") >= 0.5).cast("int") + (F.col("b") >= 0.5).cast("int") + (F.col("a") + F.col("b") >= 1).cast("int")
    return oof(spark, sf).select("doc_id", votes.alias("votes"), (votes >= 2).alias("flagged"))


@query(f"""WITH {UNION}, x AS (SELECT p.model, {PAIRS} AS auc FROM u p JOIN u n ON p.model = n.model AND p.y = 1 AND n.y = 0 GROUP BY 1) SELECT max(auc) FILTER (WHERE model = 'b') IS NOT NULL AS has_ensemble, round(max(auc) FILTER (WHERE model = 'b') - max(auc) FILTER (WHERE model <> 'b'), 6) AS gain FROM x""")
def a29_ensemble_gain(spark, sf):
    x = m.auc(by_model(spark, sf), ["model"], "y", "s")
    best = lambda c: F.max(F.when(c, F.col("auc")))
    return x.agg(best(F.col("model") == "b").isNotNull().alias("has_ensemble"), F.round(best(F.col("model") == "b") - best(F.col("model") != "b"), 6).alias("gain"))


@query(f"""WITH {UNION}, r AS (SELECT model, min(s) AS lo, max(s) AS hi FROM u GROUP BY 1)
SELECT model, cohort, least(floor((s - lo) / (hi - lo) * 10), 9)::INT AS bin, count(*) AS n FROM u JOIN r USING (model) GROUP BY 1, 2, 3""")
def a30_feature_histogram(spark, sf):
    u = by_model(spark, sf)
    r = u.groupBy("model").agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    at = F.least(F.floor((F.col("s") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 10), F.lit(9)).cast("int")
    return u.join(r, "model").groupBy("model", "cohort", at.alias("bin")).agg(F.count("*").alias("n"))
