"""Queries that compare models on the out-of-fold table, and anomaly scores by fold."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from kinespark.functions.hashes import unit, unit_sql
from kinespark.operators import calibration as cal
from kinespark.operators import comparison as c
from kinespark.operators import metrics as m
from kinespark.operators import policy as p
from kinespark.operators import stats as t
from kinespark.plans.evaluation import OOF, oof, rounded
from kinespark.plans.register import query, table
from kinespark.plans.report_plans import AUCS, cohort_aucs

R6 = lambda c: F.round(c, 6)
#: Three scores: the two of the table and their mean.
THREE = f"{OOF}, o3 AS (SELECT *, (a + b) / 2 AS m FROM oof), v AS (SELECT model, y, pid, doc_id, s FROM o3 UNPIVOT (s FOR model IN (a, b, m)))"


def three(spark, sf):
    return oof(spark, sf).withColumn("m", (F.col("a") + F.col("b")) / 2)


WIN = "CASE WHEN p.s > n.s THEN 1.0 WHEN p.s = n.s THEN 0.5 ELSE 0 END"
PARTS = f"""{THREE}, w AS (SELECT p.model, p.doc_id, 1 AS y, avg({WIN}) AS x FROM v p JOIN v n ON p.model = n.model AND p.y = 1 AND n.y = 0 GROUP BY 1, 2
UNION ALL SELECT n.model, n.doc_id, 0, avg({WIN}) FROM v p JOIN v n ON p.model = n.model AND p.y = 1 AND n.y = 0 GROUP BY 1, 2),
d AS (SELECT f.model AS model_a, g.model AS model_b, f.y, f.x AS fx, g.x AS gx FROM w f JOIN w g ON f.doc_id = g.doc_id AND f.model < g.model),
z AS (SELECT model_a, model_b, avg(fx) FILTER (WHERE y = 1) AS auc_a, avg(gx) FILTER (WHERE y = 1) AS auc_b, (avg(fx) FILTER (WHERE y = 1) - avg(gx) FILTER (WHERE y = 1)) / sqrt(var_samp(fx - gx) FILTER (WHERE y = 1) / count(*) FILTER (WHERE y = 1) + var_samp(fx - gx) FILTER (WHERE y = 0) / count(*) FILTER (WHERE y = 0)) AS z FROM d GROUP BY 1, 2)"""
RANK = "rank() OVER (PARTITION BY {by} ORDER BY {v}) + (count(*) OVER (PARTITION BY {by}, {v}) - 1) / 2.0"


@query(f"WITH {PARTS} SELECT model_a, model_b, round(auc_a, 6) AS auc_a, round(auc_b, 6) AS auc_b, round(z, 5) AS z, rank() OVER (ORDER BY round(abs(z), 9) DESC) AS place FROM z")
def t6_pairwise_significance(spark, sf):
    """All pairs of models; place is the order of their p-values, the strongest first."""
    x = c.pairwise_delong(three(spark, sf), "y", ["a", "b", "m"])
    place = F.rank().over(Window.orderBy(F.desc(F.round(F.abs("z"), 9))))
    return x.withColumn("place", place).select("model_a", "model_b", R6("auc_a").alias("auc_a"), R6("auc_b").alias("auc_b"), F.round("z", 5).alias("z"), "place")


def poisson_sql(u: str) -> str:
    total, share, parts = 0.0, 0.36787944117144233, []
    for k in range(1, 9):
        total += share
        parts.append(f"({u} >= {total!r})::INT")
        share /= k
    return "(" + " + ".join(parts) + ")"


def replicates_sql(models: str) -> str:
    """AUC by replicate and model, from wins by pairs of participants and their weights."""
    return f"""{THREE}, k AS (SELECT DISTINCT pid FROM oof), h AS (SELECT pid, unnest(range(1, 201)) AS replicate FROM k), g AS (SELECT pid, replicate, {poisson_sql(unit_sql('pid', 'replicate'))} AS w FROM h),
x AS (SELECT p.model, p.pid AS pp, n.pid AS np, sum({WIN}) AS wins, count(*) AS pairs FROM v p JOIN v n ON p.model = n.model AND p.y = 1 AND n.y = 0 AND p.model IN ({models}) GROUP BY 1, 2, 3),
r AS (SELECT x.model, a.replicate, sum(a.w * b.w * wins) / sum(a.w * b.w * pairs) AS auc FROM x JOIN g a ON x.pp IS NOT DISTINCT FROM a.pid JOIN g b ON x.np IS NOT DISTINCT FROM b.pid AND a.replicate = b.replicate WHERE a.w * b.w > 0 GROUP BY 1, 2)"""


@query(f"WITH {replicates_sql(chr(39) + 'a' + chr(39) + ', ' + chr(39) + 'b' + chr(39))} SELECT model AS score, count(*) AS n, round(quantile_cont(auc, 0.025), 6) AS low, round(quantile_cont(auc, 0.975), 6) AS high FROM r GROUP BY 1")
def t2_t3_bootstrap_auc(spark, sf):
    r = t.bootstrap_auc(oof(spark, sf), "pid", "y", ["a", "b"], 200)
    return rounded(r.groupBy("score").agg(F.count("*").alias("n"), F.expr("percentile(auc, 0.025)").alias("low"), F.expr("percentile(auc, 0.975)").alias("high")), "low", "high")


DELTA = "round(avg({d}), 6) AS delta, round(least(1, 2 * least(avg(({d} <= 0)::INT), avg(({d} >= 0)::INT))), 6) AS p"


@query(f"""WITH {replicates_sql(chr(39) + 'a' + chr(39) + ', ' + chr(39) + 'b' + chr(39))}, w AS (SELECT model, round(auc, 9) AS x FROM r), q AS (SELECT model, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS k FROM w),
n AS (SELECT count(*) FILTER (WHERE model = 'a')::DOUBLE AS a, count(*) FILTER (WHERE model = 'b')::DOUBLE AS b, count(*)::DOUBLE AS n, sum(k) FILTER (WHERE model = 'a') AS s FROM q), t AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT count(*)::DOUBLE AS c FROM w GROUP BY x)),
u AS (SELECT a, b, s - a * (a + 1) / 2 AS u, a * b / 12 * (n + 1 - ties / (n * (n - 1))) AS var FROM n, t) SELECT a::BIGINT AS n_a, b::BIGINT AS n_b, round(u, 3) AS u, round(sign(u - a * b / 2) * greatest(abs(u - a * b / 2) - 0.5, 0) / sqrt(var), 6) AS z FROM u""")
def t5_rank_sum(spark, sf):
    """Mann-Whitney's test of two models' bootstrap AUCs."""
    r = t.bootstrap_auc(oof(spark, sf), "pid", "y", ["a", "b"], 200).withColumn("auc", F.round("auc", 9))
    return t.rank_sum(r, F.col("score") == "a", "auc").select("n_a", "n_b", F.round("u", 3).alias("u"), F.round("z", 6).alias("z"))


@query(f"WITH {replicates_sql(chr(39) + 'a' + chr(39) + ', ' + chr(39) + 'b' + chr(39))}, q AS (SELECT a.auc - b.auc AS d FROM r a JOIN r b ON a.replicate = b.replicate AND a.model = 'a' AND b.model = 'b') SELECT {DELTA.format(d='d')} FROM q")
def t4_paired_bootstrap(spark, sf):
    r = t.bootstrap_auc(oof(spark, sf), "pid", "y", ["a", "b"], 200).groupBy("replicate").pivot("score", ["a", "b"]).agg(F.first("auc"))
    d = F.col("a") - F.col("b")
    return rounded(r.agg(F.avg(d).alias("delta"), F.least(F.lit(1.0), 2 * F.least(F.avg((d <= 0).cast("int")), F.avg((d >= 0).cast("int")))).alias("p")), "delta", "p")


@query(f"""WITH {replicates_sql("'a', 'b', 'm'")}, f AS (SELECT model FROM (SELECT p.model, avg({WIN}) AS auc FROM v p JOIN v n ON p.model = n.model AND p.y = 1 AND n.y = 0 AND p.model IN ('a', 'b') GROUP BY 1) ORDER BY auc DESC, model DESC LIMIT 1),
q AS (SELECT (SELECT model FROM f) AS reference, a.auc - b.auc AS d FROM r a JOIN r b ON a.replicate = b.replicate AND a.model = 'm' AND b.model = (SELECT model FROM f)) SELECT 'm' AS model, reference, {DELTA.format(d='d')} FROM q GROUP BY reference""")
def t7_family_comparison(spark, sf):
    return rounded(c.family_gain(three(spark, sf), "pid", "y", ["m"], ["a", "b"], 200), "delta", "p")


JACK = f"""{THREE}, k AS (SELECT DISTINCT pid FROM oof), j AS (SELECT k.pid, p.model, avg({WIN}) AS auc FROM k JOIN v p ON p.pid <> k.pid AND p.y = 1 JOIN v n ON n.model = p.model AND n.pid <> k.pid AND n.y = 0 GROUP BY 1, 2)"""


@query(f"""WITH {JACK}, r AS (SELECT pid, model, {RANK.format(by='pid', v='round(-auc, 9)')} AS r FROM j)
SELECT model, round(avg(r), 6) AS mean_rank, count(*) AS blocks, round(2.343 * sqrt(3 * 4 / (6.0 * count(*))), 6) AS cd FROM r GROUP BY 1""")
def t11_critical_difference(spark, sf):
    j = c.jackknife_aucs(three(spark, sf), "pid", "y", ["a", "b", "m"]).withColumn("auc", F.round("auc", 9))
    return rounded(c.critical_difference(j, "pid", "model", "auc"), "mean_rank", "cd")


WILCOXON = f"""{JACK}, d AS (SELECT o.model, round(f.auc - o.auc, 9) AS d FROM j f JOIN j o ON f.pid = o.pid AND f.model = 'm' AND o.model <> 'm'), s AS (SELECT model, avg(d) AS delta FROM d GROUP BY 1),
r AS (SELECT model, d, {RANK.format(by='model', v='abs(d)')} AS r FROM d WHERE d <> 0), q AS (SELECT model, count(*) AS n, least(sum(CASE WHEN d > 0 THEN r ELSE 0 END), sum(CASE WHEN d < 0 THEN r ELSE 0 END)) AS w FROM r GROUP BY 1),
e AS (SELECT model, sum(k ** 3 - k) AS ties FROM (SELECT model, abs(d), count(*) AS k FROM r GROUP BY 1, 2) GROUP BY 1)"""


@query(f"WITH {WILCOXON} SELECT model, n, w, round((w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48), 6) AS z, round(delta, 6) AS delta FROM q JOIN e USING (model) JOIN s USING (model)")
def t12_wilcoxon_reference(spark, sf):
    j = c.jackknife_aucs(three(spark, sf), "pid", "y", ["a", "b", "m"]).withColumn("auc", F.round("auc", 9))
    j = j.withColumn("auc", F.round("auc", 9))
    return rounded(c.wilcoxon_against(j, "pid", "model", "auc", "m"), "z", "delta").select("model", "n", "w", "z", "delta")


@query(f"""WITH {JACK}, d AS (SELECT f.model AS model_a, o.model AS model_b, round(f.auc - o.auc, 9) AS d FROM j f JOIN j o ON f.pid = o.pid AND f.model < o.model), s AS (SELECT model_a, model_b, avg(d) AS delta FROM d GROUP BY 1, 2),
r AS (SELECT model_a, model_b, d, {RANK.format(by='model_a, model_b', v='abs(d)')} AS r FROM d WHERE d <> 0), q AS (SELECT model_a, model_b, count(*) AS n, least(sum(CASE WHEN d > 0 THEN r ELSE 0 END), sum(CASE WHEN d < 0 THEN r ELSE 0 END)) AS w FROM r GROUP BY 1, 2),
e AS (SELECT model_a, model_b, sum(k ** 3 - k) AS ties FROM (SELECT model_a, model_b, abs(d), count(*) AS k FROM r GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT model_a, model_b, n, w, round((w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48), 6) AS z, round(delta, 6) AS delta FROM q JOIN e USING (model_a, model_b) JOIN s USING (model_a, model_b)""")
def t12_wilcoxon_pairs(spark, sf):
    """All pairs of models by their leave-one-out AUCs."""
    j = c.jackknife_aucs(three(spark, sf), "pid", "y", ["a", "b", "m"]).withColumn("auc", F.round("auc", 9))
    pairs = c.wilcoxon_pairs(j, "pid", "model", "auc").withColumn("delta", F.round("delta", 12))
    return rounded(pairs, "z", "delta").select("model_a", "model_b", "n", "w", "z", "delta")


@query(f"""WITH {JACK}, r AS (SELECT pid, model, round(auc, 9) AS auc, {RANK.format(by='pid', v='round(-auc, 9)')} AS r FROM j), s AS (SELECT sum(q * q) AS rr, max(n) AS n FROM (SELECT model, sum(r) AS q, count(*) AS n FROM r GROUP BY 1)), g AS (SELECT sum(k ** 3 - k) AS ties FROM (SELECT count(*) AS k FROM r GROUP BY pid, auc))
SELECT n::DOUBLE AS blocks, 3.0::DOUBLE AS treatments, round((12 / (n * 3 * 4) * rr - 3 * n * 4) / (1 - ties / (n * 24)), 6) AS chi2, (SELECT model FROM r GROUP BY 1 ORDER BY avg(r), model LIMIT 1) AS best FROM s, g""")
def t13_benchmark(spark, sf):
    """From scores to the verdict: jackknife AUCs, Friedman's test over them, and the best mean rank."""
    j = c.jackknife_aucs(three(spark, sf), "pid", "y", ["a", "b", "m"]).withColumn("auc", F.round("auc", 9))
    best = c.critical_difference(j, "pid", "model", "auc").agg(F.min_by("model", F.struct(R6("mean_rank"), "model")).alias("best"))
    return t.friedman(j, "pid", "model", "auc").withColumn("chi2", R6("chi2")).crossJoin(F.broadcast(best))


HALVES = f"{OOF}, o AS (SELECT *, {unit_sql('doc_id')} < 0.5 AS fit FROM oof)"


def halves(spark, sf):
    return oof(spark, sf).withColumn("fit", unit("doc_id") < 0.5)


@query(f"""WITH {HALVES}, s AS (SELECT a, avg(y)::DOUBLE AS y, count(*) AS n, row_number() OVER (ORDER BY a) AS i FROM o WHERE fit GROUP BY a), c AS (SELECT *, sum(y * n) OVER (ORDER BY i) AS sy, sum(n) OVER (ORDER BY i) AS sn FROM s),
e AS (SELECT f.i AS f, l.i AS l, (l.sy - f.sy + f.y * f.n) / (l.sn - f.sn + f.n) AS mean FROM c f JOIN c l ON f.i <= l.i), b AS (SELECT f, l AS i, min(mean) OVER (PARTITION BY f ORDER BY l DESC) AS least FROM e),
k AS (SELECT a, max(least) AS v FROM b JOIN s USING (i) GROUP BY i, a), t AS (SELECT doc_id, a AS x FROM o),
j AS (SELECT doc_id, x, lo.a AS la, lo.v AS lv, hi.a AS ha, hi.v AS hv FROM t ASOF LEFT JOIN k lo ON t.x >= lo.a ASOF LEFT JOIN k hi ON t.x <= hi.a)
SELECT doc_id, round(CASE WHEN la IS NULL THEN hv WHEN ha IS NULL OR ha = la THEN lv ELSE lv + (hv - lv) * (x - la) / (ha - la) END, 5) AS calibrated FROM j""")
def t16_isotonic_calibration(spark, sf):
    x = halves(spark, sf).withColumn("a0", 1 - F.col("a"))
    made = cal.isotonic(x, F.col("fit"), {"a": F.col("y") == 1, "a0": F.col("y") == 0})
    return made.select("doc_id", F.round("a_calibrated", 5).alias("calibrated"))


@query(f"""WITH {HALVES}, f AS (SELECT 1 - CASE WHEN y = 1 THEN a ELSE 1 - a END AS s, count(*) OVER () AS n, row_number() OVER (ORDER BY 1 - CASE WHEN y = 1 THEN a ELSE 1 - a END) AS k FROM o WHERE fit),
q AS (SELECT s AS q_hat, n FROM f WHERE k = ceil(round(least(ceil((n + 1) * 0.9) / n, 1) * (n - 1), 9)) + 1)
SELECT max(n) AS n_fit, count(*) AS n_check, round(max(q_hat), 6) AS q_hat, round(avg((1 - CASE WHEN y = 1 THEN a ELSE 1 - a END <= q_hat)::INT), 6) AS coverage, round(avg(greatest((1 - a >= 1 - q_hat)::INT + (a >= 1 - q_hat)::INT, 1)), 6) AS mean_size FROM o, q WHERE NOT fit""")
def t19_fit_check_split(spark, sf):
    """Half of the rows, by hash, gives the conformal threshold; the other half tells how often it holds."""
    x = halves(spark, sf).withColumn("s", 1 - F.when(F.col("y") == 1, F.col("a")).otherwise(1 - F.col("a"))).withColumn("all", F.lit(1))
    q = t.conformal_threshold(x.filter("fit"), ["all"], F.col("s"), 0.1).select(F.col("n").alias("n_fit"), "q_hat")
    size = F.greatest((1 - F.col("a") >= 1 - F.col("q_hat")).cast("int") + (F.col("a") >= 1 - F.col("q_hat")).cast("int"), F.lit(1))
    return x.filter("not fit").crossJoin(F.broadcast(q)).agg(F.max("n_fit").alias("n_fit"), F.count("*").alias("n_check"), R6(F.max("q_hat")).alias("q_hat"), R6(F.avg((F.col("s") <= F.col("q_hat")).cast("int"))).alias("coverage"), R6(F.avg(size)).alias("mean_size"))


@query(f"WITH {AUCS} SELECT g.cohort, round(u.auc - g.auc, 6) AS delta, round(100 * (u.auc - g.auc) / g.auc, 5) AS inflation_pct FROM auc g JOIN auc u ON g.cohort = u.cohort AND g.model = 'a' AND u.model = 'b'")
def t20_protocol_gap(spark, sf):
    x = cohort_aucs(spark, sf).groupBy("cohort").pivot("model", ["a", "b"]).agg(F.first("auc"))
    return c.protocol_gap(x.filter("a is not null and b is not null"), "cohort", "a", "b").select("cohort", R6("delta").alias("delta"), F.round("inflation_pct", 5).alias("inflation_pct"))


@query(f"""WITH {OOF}, s AS (SELECT a AS threshold, sum(y) AS p, sum(1 - y) AS n FROM oof GROUP BY 1), j AS (SELECT threshold, round(sum(p) OVER w / sum(p) OVER () - sum(n) OVER w / sum(n) OVER (), 12) AS j FROM s WINDOW w AS (ORDER BY threshold DESC)),
r AS (SELECT * FROM (SELECT 'evaluation' AS rule, threshold FROM j ORDER BY j DESC, threshold DESC LIMIT 1) UNION ALL SELECT 'primary', 0.4 UNION ALL SELECT 'fixed_0.5', 0.5)
SELECT rule, round(threshold, 6) AS threshold, round(count(*) FILTER (WHERE y = 1 AND a >= threshold) / (count(*) FILTER (WHERE y = 1) + 1e-10), 6) AS sensitivity, round(count(*) FILTER (WHERE y = 0 AND a < threshold) / (count(*) FILTER (WHERE y = 0) + 1e-10), 6) AS specificity FROM oof, r GROUP BY rule, threshold""")
def t21_cutoffs(spark, sf):
    return rounded(c.cutoffs(oof(spark, sf), "y", "a", 0.4), "threshold", "sensitivity", "specificity").select("rule", "threshold", "sensitivity", "specificity")


@query(f"""WITH {OOF}, f AS (SELECT *, {unit_sql('pid')} AS u FROM oof), k AS (SELECT *, floor(u * 4)::INT AS fold FROM f), g AS (SELECT DISTINCT fold FROM k), s AS (SELECT g.fold, a, sum(y) AS p, sum(1 - y) AS n FROM g JOIN k o ON o.fold <> g.fold GROUP BY 1, 2),
j AS (SELECT fold, a, round(sum(p) OVER w / sum(p) OVER (PARTITION BY fold) - sum(n) OVER w / sum(n) OVER (PARTITION BY fold), 12) AS j FROM s WINDOW w AS (PARTITION BY fold ORDER BY a DESC))
SELECT fold, round(a, 6) AS threshold FROM j QUALIFY row_number() OVER (PARTITION BY fold ORDER BY j DESC, a DESC) = 1""")
def m21_inner_thresholds(spark, sf):
    """Each outer fold's threshold from the rows of the other folds alone."""
    x = oof(spark, sf).withColumn("inner_fold", F.floor(unit("pid") * 4).cast("int"))
    outer = x.select(F.col("inner_fold").alias("fold")).distinct()
    inner = x.join(F.broadcast(outer), F.col("inner_fold") != F.col("fold"))
    return m.youden(inner, ["fold"], "y", "a").select("fold", R6("threshold").alias("threshold"))


@query(f"""WITH {OOF}, r AS (SELECT min(a) FILTER (WHERE y = 0) AS la, max(a) FILTER (WHERE y = 0) AS ha, min(b) FILTER (WHERE y = 0) AS lb, max(b) FILTER (WHERE y = 0) AS hb FROM oof),
e AS (SELECT doc_id, y, (least(greatest((a - la) / (ha - la), 0), 1) + least(greatest((b - lb) / (hb - lb), 0), 1)) / 2 AS s FROM oof, r), h AS (SELECT quantile_cont(s, 0.9) FILTER (WHERE y = 0) AS th FROM e)
SELECT doc_id, round(s, 6) AS score, (round(s, 9) >= round(th, 9))::INT AS flagged FROM e, h""")
def m11_anomaly_ensemble(spark, sf):
    """Mean of the scores as shares of the healthy rows' range, flagged from the healthy rows' 90th percentile on."""
    x = oof(spark, sf)
    for s in ("a", "b"):
        x = p.min_max(x, s, F.col("y") == 0, f"unit_{s}")
    x = x.withColumn("s", (F.col("unit_a") + F.col("unit_b")) / 2)
    cut = x.agg(F.percentile(F.when(F.col("y") == 0, F.col("s")), 0.9).alias("th"))
    return x.crossJoin(F.broadcast(cut)).select("doc_id", R6("s").alias("score"), (F.round("s", 9) >= F.round("th", 9)).cast("int").alias("flagged"))


@query(f"WITH {OOF} SELECT doc_id, round(a * 100, 4) AS risk_percent, CASE WHEN a >= 0.6 THEN 'high' WHEN a >= 0.3 THEN 'moderate' ELSE 'low' END AS band, a >= 0.6 AS above FROM oof")
def m19_batch_prediction(spark, sf):
    x = oof(spark, sf).withColumn("p", F.array(1 - F.col("a"), F.col("a")))
    score = p.elevated(F.col("p"), 1)
    return x.select("doc_id", F.round(score * 100, 4).alias("risk_percent"), p.risk_band(score, 0.6).alias("band"), (score >= 0.6).alias("above"))
