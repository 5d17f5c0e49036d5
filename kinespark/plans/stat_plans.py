"""Statistical tests, splits, joins, sinks' logic and set operations on the given tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from kinespark.functions.hashes import unit_sql
from kinespark.functions.mathx import ERFC
from kinespark.operators import metrics as m
from kinespark.operators import stats as t
from kinespark.plans.evaluation import OOF, UNION, by_model, oof
from kinespark.plans.register import query, table

R6 = lambda c: F.round(c, 6)


@query(f"""WITH {OOF}, v AS (SELECT p.doc_id, 1 AS y, avg(CASE WHEN p.a > n.a THEN 1.0 WHEN p.a = n.a THEN 0.5 ELSE 0 END) AS va, avg(CASE WHEN p.b > n.b THEN 1.0 WHEN p.b = n.b THEN 0.5 ELSE 0 END) AS vb FROM oof p JOIN oof n ON p.y = 1 AND n.y = 0 GROUP BY 1
UNION ALL SELECT n.doc_id, 0, avg(CASE WHEN p.a > n.a THEN 1.0 WHEN p.a = n.a THEN 0.5 ELSE 0 END), avg(CASE WHEN p.b > n.b THEN 1.0 WHEN p.b = n.b THEN 0.5 ELSE 0 END) FROM oof p JOIN oof n ON p.y = 1 AND n.y = 0 GROUP BY 1)
SELECT round(avg(va) FILTER (WHERE y = 1), 6) AS auc_a, round(avg(vb) FILTER (WHERE y = 1), 6) AS auc_b,
  round((avg(va) FILTER (WHERE y = 1) - avg(vb) FILTER (WHERE y = 1)) / sqrt(var_samp(va - vb) FILTER (WHERE y = 1) / count(*) FILTER (WHERE y = 1) + var_samp(va - vb) FILTER (WHERE y = 0) / count(*) FILTER (WHERE y = 0)), 6) AS z FROM v""")
def t1_delong(spark, sf):
    return t.delong(oof(spark, sf), "y", "a", "b").select(R6("auc_a").alias("auc_a"), R6("auc_b").alias("auc_b"), R6("z").alias("z"))


@query(f"""WITH {OOF}, d AS (SELECT round(a - b, 9) AS d FROM oof WHERE round(a - b, 9) <> 0), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS r FROM d)
SELECT count(*) AS n, least(sum(CASE WHEN d > 0 THEN r ELSE 0 END), sum(CASE WHEN d < 0 THEN r ELSE 0 END)) AS w FROM r""")
def t5_signed_rank(spark, sf):
    return t.signed_rank(oof(spark, sf), F.round(F.col("a") - F.col("b"), 9))


MC = "(a >= 0.5) = (y = 1)"


@query(f"WITH {OOF} SELECT cohort, count(*) FILTER (WHERE ra AND NOT rb) AS only_a, count(*) FILTER (WHERE NOT ra AND rb) AS only_b FROM (SELECT cohort, (a >= 0.5) = (y = 1) AS ra, (b >= 0.5) = (y = 1) AS rb FROM oof) GROUP BY 1")
def t8_mcnemar_counts(spark, sf):
    right = lambda c: (F.col(c) >= 0.5) == (F.col("y") == 1)
    return t.mcnemar(oof(spark, sf), ["cohort"], right("a"), right("b")).drop("p")


POLYNOMIAL = " + ".join(f"({k}) * t ** {i}" for i, k in enumerate(ERFC))


@query(f"""WITH {OOF}, r AS (SELECT cohort, (a >= 0.5) = (y = 1) AS ra, (b >= 0.5) = (y = 1) AS rb FROM oof), c AS (SELECT cohort, count(*) FILTER (WHERE ra AND NOT rb) AS only_a, count(*) FILTER (WHERE NOT ra AND rb) AS only_b FROM r GROUP BY 1),
n AS (SELECT *, only_a + only_b AS n, least(only_a, only_b) AS k, greatest(abs(only_a - only_b) - 1, 0) / sqrt(greatest(only_a + only_b, 1)) / sqrt(2) AS x FROM c), e AS (SELECT *, 1 / (1 + 0.5 * x) AS t FROM n),
p AS (SELECT cohort, only_a, only_b, CASE WHEN n = 0 THEN 1 WHEN n <= 25 THEN least(1, 2 * list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + n * ln(0.5))))) ELSE t * exp(-x * x + {POLYNOMIAL}) END AS p FROM e),
q AS (SELECT *, p * count(*) OVER () / (count(*) OVER (ORDER BY round(p, 9))) AS q FROM p)
SELECT cohort, only_a, only_b, round(p, 6) AS p, round(least(min(q) OVER (ORDER BY round(p, 9) DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1), 6) AS q FROM q""")
def t9_mcnemar_fdr(spark, sf):
    right = lambda c: (F.col(c) >= 0.5) == (F.col("y") == 1)
    tested = t.mcnemar(oof(spark, sf), ["cohort"], right("a"), right("b")).withColumn("p", F.round("p", 9))
    return m.benjamini_hochberg(tested, "p", "q").withColumns({"p": F.round("p", 6), "q": F.round("q", 6)})


@query(f"""WITH {UNION}, f AS (SELECT pid, cohort, round(avg(s), 9) AS v FROM u GROUP BY 1, 2), k AS (SELECT pid FROM f GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT cohort) FROM f)),
r AS (SELECT pid, cohort, v, rank() OVER (PARTITION BY pid ORDER BY v) + (count(*) OVER (PARTITION BY pid, v) - 1) / 2.0 AS r FROM f JOIN k USING (pid)),
s AS (SELECT count(*) AS k, max(n) AS n, sum(r * r) AS rr FROM (SELECT cohort, sum(r) AS r, count(*) AS n FROM r GROUP BY 1)), g AS (SELECT sum(t ** 3 - t) AS ties FROM (SELECT count(*) AS t FROM r GROUP BY pid, v))
SELECT n::DOUBLE AS blocks, k::DOUBLE AS treatments, round((12 / (n * k * (k + 1)) * rr - 3 * n * (k + 1)) / (1 - ties / (n * (k ** 3 - k))), 6) AS chi2 FROM s, g""")
def t10_friedman(spark, sf):
    f = by_model(spark, sf).groupBy("pid", "cohort").agg(F.round(F.avg("s"), 9).alias("v"))
    kinds = f.agg(F.count_distinct("cohort").alias("kinds"))
    whole = f.groupBy("pid").agg(F.count("*").alias("n")).crossJoin(F.broadcast(kinds)).filter("n = kinds").select("pid")
    return t.friedman(f.join(whole, "pid"), "pid", "cohort", "v").withColumn("chi2", F.round("chi2", 6))


@query(f"""WITH {OOF}, r AS (SELECT cohort, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS r FROM oof), g AS (SELECT cohort, sum(r) AS r, count(*) AS n FROM r GROUP BY 1),
s AS (SELECT count(*) AS groups, sum(n)::BIGINT AS n, sum(r * r / n) AS s FROM g), k AS (SELECT sum(t ** 3 - t) AS ties FROM (SELECT count(*) AS t FROM oof GROUP BY a))
SELECT groups, n, round((12.0 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - ties / (n::DOUBLE ** 3 - n)), 6) AS h FROM s, k""")
def t14_kruskal(spark, sf):
    return t.kruskal(oof(spark, sf), "cohort", "a").withColumn("h", F.round("h", 6))


@query(f"""WITH {OOF}, r AS (SELECT cohort, rank() OVER (PARTITION BY cohort ORDER BY a) + (count(*) OVER (PARTITION BY cohort, a) - 1) / 2.0 AS x, rank() OVER (PARTITION BY cohort ORDER BY b) + (count(*) OVER (PARTITION BY cohort, b) - 1) / 2.0 AS y FROM oof)
SELECT cohort, count(*) AS n, round(corr(x, y), 6) AS rho FROM r GROUP BY 1""")
def t15_spearman(spark, sf):
    return t.spearman(oof(spark, sf).select("cohort", "a", "b"), ["cohort"], "a", "b").withColumn("rho", F.round("rho", 6))


@query(f"""WITH {OOF}, x AS (SELECT cohort, abs(y - a) AS s, count(*) OVER (PARTITION BY cohort) AS n, row_number() OVER (PARTITION BY cohort ORDER BY abs(y - a)) AS k FROM oof)
SELECT cohort, n, round(s, 6) AS q_hat FROM x WHERE k = ceil(round(least(ceil((n + 1) * 0.9) / n, 1) * (n - 1), 9)) + 1""")
def t17_conformal(spark, sf):
    return t.conformal_threshold(oof(spark, sf), ["cohort"], F.abs(F.col("y") - F.col("a")), 0.1).withColumn("q_hat", F.round("q_hat", 6))


@query(f"""WITH {OOF}, s AS (SELECT cohort, y, 1 - a >= 0.4 AS has0, a >= 0.4 AS has1, a FROM oof)
SELECT cohort, round(avg(CASE WHEN (y = 0 AND (has0 OR (NOT has1 AND a < 0.5))) OR (y = 1 AND (has1 OR (NOT has0 AND a >= 0.5))) THEN 1.0 ELSE 0 END), 6) AS coverage, round(avg(greatest(has0::INT + has1::INT, 1)), 6) AS mean_size FROM s GROUP BY 1""")
def t18_prediction_sets(spark, sf):
    prob = F.array(1 - F.col("a"), F.col("a"))
    classes = F.filter(F.array(F.lit(0), F.lit(1)), lambda k: F.get(prob, k) >= 0.4)
    likeliest = F.array((F.col("a") >= 0.5).cast("int"))
    x = oof(spark, sf).withColumn("set", F.when(F.size(classes) > 0, classes).otherwise(likeliest))
    return x.groupBy("cohort").agg(R6(F.avg(F.array_contains("set", F.col("y")).cast("int"))).alias("coverage"), R6(F.avg(F.size("set"))).alias("mean_size"))


@query(f"SELECT c_custkey, CASE WHEN c_mktsegment <> 'BUILDING' THEN 'test' WHEN {unit_sql('c_custkey')} < 0.7 THEN 'train' WHEN {unit_sql('c_custkey')} < 0.85 THEN 'val' ELSE 'test' END AS role FROM customer")
def x1_subject_holdout(spark, sf):
    people = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return t.subject_holdout(people, "c_custkey", F.col("c_mktsegment") == "BUILDING")


@query(f"""WITH {OOF}, g AS (SELECT DISTINCT pid FROM oof), f AS (SELECT g.pid AS held_out, count(*) AS n_train, count(*) FILTER (WHERE y = 0) AS n_healthy, count(DISTINCT y) AS classes FROM g JOIN oof o ON o.pid <> g.pid GROUP BY 1)
SELECT held_out, n_train, CASE WHEN n_healthy < 5 OR classes < 2 THEN 'skipped' ELSE 'ok' END AS status FROM f""")
def x3_leave_one_group_out(spark, sf):
    g = oof(spark, sf).groupBy("pid").agg(F.count("*").alias("n"), F.count_if(F.col("y") == 0).alias("h"))
    whole = Window.partitionBy()
    train, healthy = F.sum("n").over(whole) - F.col("n"), F.sum("h").over(whole) - F.col("h")
    return g.select(F.col("pid").alias("held_out"), train.alias("n_train"), F.when((healthy < 5) | (healthy == train) | (healthy == 0), "skipped").otherwise("ok").alias("status"))


@query(f"WITH {OOF}, g AS (SELECT pid, y, count(*) AS n FROM oof GROUP BY 1, 2), l AS (SELECT pid, y FROM g QUALIFY row_number() OVER (PARTITION BY pid ORDER BY n DESC, y) = 1) SELECT pid, (row_number() OVER (PARTITION BY y ORDER BY {unit_sql('pid')}, pid) - 1) % 5 AS fold FROM l")
def x4_group_folds(spark, sf):
    return t.group_folds(oof(spark, sf), "pid", "y", 5)


@query(f"WITH {OOF}, c AS (SELECT cohort, count(*) AS n, count(DISTINCT y) AS k FROM oof GROUP BY 1) SELECT a.cohort AS source, b.cohort AS target, a.n AS n_source, b.n AS n_target, CASE WHEN a.k < 2 OR b.k < 2 THEN 'single_class' ELSE 'ok' END AS status FROM c a JOIN c b ON a.cohort <> b.cohort")
def x5_j10_cohort_transfer(spark, sf):
    c = oof(spark, sf).groupBy("cohort").agg(F.count("*").alias("n"), F.count_distinct("y").alias("k"))
    a, b = c.select(F.col("cohort").alias("source"), F.col("n").alias("n_source"), F.col("k").alias("ka")), c.select(F.col("cohort").alias("target"), F.col("n").alias("n_target"), F.col("k").alias("kb"))
    return a.join(b, F.col("source") != F.col("target")).select("source", "target", "n_source", "n_target", F.when((F.col("ka") < 2) | (F.col("kb") < 2), "single_class").otherwise("ok").alias("status"))


@query(f"""WITH n AS (SELECT c_mktsegment, count(*) AS n, count(*) * 40 / (SELECT count(*) FROM customer)::DOUBLE AS exact FROM customer GROUP BY 1), b AS (SELECT *, greatest(floor(exact), 1) AS base FROM n),
t AS (SELECT *, base + (row_number() OVER (ORDER BY exact - floor(exact) DESC, c_mktsegment) <= 40 - sum(base) OVER ())::INT AS take FROM b)
SELECT c_custkey, c_mktsegment FROM (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {unit_sql('c_custkey')}, c_custkey) AS k FROM customer) JOIN t USING (c_mktsegment) WHERE k <= take""")
def x7_proportional_sample(spark, sf):
    return t.proportional_sample(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", "c_mktsegment", 40)


@query(f"WITH {UNION} SELECT a.doc_id, a.s AS s_a, b.s AS s_b FROM u a JOIN u b ON a.doc_id = b.doc_id AND a.model < b.model")
def j6_j9_model_pairs(spark, sf):
    u = by_model(spark, sf)
    a, b = u.select("doc_id", F.col("model").alias("ma"), F.col("s").alias("s_a")), u.select("doc_id", F.col("model").alias("mb"), F.col("s").alias("s_b"))
    return a.join(b, "doc_id").filter("ma < mb").select("doc_id", "s_a", "s_b")


@query(f"WITH {UNION} SELECT pid FROM (SELECT pid, model FROM u WHERE y = 1 GROUP BY 1, 2) GROUP BY 1 HAVING count(*) = 2")
def j7_fold_intersection(spark, sf):
    return by_model(spark, sf).filter("y = 1").groupBy("pid").agg(F.count_distinct("model").alias("n")).filter("n = 2").select("pid")


@query("SELECT o_orderkey, c_mktsegment, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def j1_j2_dimension_lookup(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("o_orderkey", "c_mktsegment", "n_name")


@query("""WITH e AS (SELECT user_id, event_type, epoch_us(ts) // 1000000 AS s, event_id FROM events)
SELECT d.event_id AS detected, t.event_id AS truth, abs(d.s - t.s) AS gap FROM e d JOIN e t ON d.user_id = t.user_id AND d.event_type = 'click' AND t.event_type = 'view' AND abs(d.s - t.s) <= 3600""")
def j3_event_candidates(spark, sf):
    """Pairs within the tolerance: buckets of its width make the range join an equi-join with three buckets."""
    e = table(spark, sf, "events").select("user_id", "event_type", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).alias("s"), "event_id")
    d = e.filter("event_type = 'click'").select("user_id", F.col("s").alias("ds"), F.col("event_id").alias("detected"), F.floor(F.col("s") / 3601).alias("b"))
    t_ = e.filter("event_type = 'view'").select("user_id", F.col("s").alias("ts_"), F.col("event_id").alias("truth"), F.explode(F.array(*(F.floor(F.col("s") / 3601) + k for k in (-1, 0, 1)))).alias("b"))
    return d.join(t_, ["user_id", "b"]).withColumn("gap", F.abs(F.col("ds") - F.col("ts_"))).filter("gap <= 3600").select("detected", "truth", "gap")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def j11_k2_resume_anti_join(spark, sf):
    done = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf, "orders").join(done, "o_custkey", "left_anti").select("o_orderkey")


@query("SELECT * FROM (SELECT c_custkey AS id, 'old' AS origin FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) UNION ALL SELECT DISTINCT o_custkey, 'new' FROM orders")
def k3_metadata_merge(spark, sf):
    new = table(spark, sf, "orders").select(F.col("o_custkey").alias("id")).distinct()
    old = table(spark, sf, "customer").select(F.col("c_custkey").alias("id")).join(new, "id", "left_anti")
    return old.withColumn("origin", F.lit("old")).unionByName(new.withColumn("origin", F.lit("new")))


@query("SELECT c_custkey AS id, c_acctbal AS balance, NULL::DOUBLE AS price FROM customer UNION ALL SELECT o_orderkey, NULL, o_totalprice FROM orders")
def k4_e1_union_columns(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    return a.unionByName(table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price")), allowMissingColumns=True)


@query("SELECT c_custkey AS id FROM customer INTERSECT SELECT o_custkey FROM orders")
def e2_intersect(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id")).intersect(table(spark, sf, "orders").select("o_custkey"))


@query("SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders")
def e3_except(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id")).subtract(table(spark, sf, "orders").select("o_custkey"))


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def e4_first_per_key(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf, "orders").withColumn("k", F.row_number().over(w)).filter("k = 1").select("o_custkey", "o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def e5_e6_top_n(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query("SELECT c_custkey, coalesce(CASE upper(c_mktsegment) WHEN 'BUILDING' THEN 'healthy' WHEN 'MACHINERY' THEN 'neuro' END, CASE WHEN c_name LIKE '%1' THEN 'path' END, 'unknown') AS cohort FROM customer")
def p1_cohort_resolution(spark, sf):
    known = F.create_map(F.lit("BUILDING"), F.lit("healthy"), F.lit("MACHINERY"), F.lit("neuro"))
    return table(spark, sf, "customer").select("c_custkey", F.coalesce(F.try_element_at(known, F.upper("c_mktsegment")), F.when(F.col("c_name").endswith("1"), "path"), F.lit("unknown")).alias("cohort"))


@query("SELECT l_orderkey, l_linenumber, round(sqrt(l_quantity ** 2 + l_discount ** 2 + l_tax ** 2), 6) AS resultant, round(radians(l_quantity), 6) AS radians FROM lineitem")
def p6_resultant(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", R6(F.sqrt(F.col("l_quantity") ** 2 + F.col("l_discount") ** 2 + F.col("l_tax") ** 2)).alias("resultant"), R6(F.radians("l_quantity")).alias("radians"))


@query("SELECT l_orderkey, l_linenumber, axis, v FROM (SELECT l_orderkey, l_linenumber, l_quantity AS quantity, l_discount AS discount, l_tax AS tax FROM lineitem) UNPIVOT (v FOR axis IN (quantity, discount, tax))")
def p8_wide_to_long(spark, sf):
    x = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    return x.unpivot(["l_orderkey", "l_linenumber"], ["quantity", "discount", "tax"], "axis", "v")


@query("""WITH q AS (SELECT l_orderkey, l_linenumber, cos(l_tax) AS w, sin(l_tax) * 0.6 AS x, sin(l_tax) * 0.8 AS y FROM lineitem)
SELECT l_orderkey, l_linenumber, round(atan2(2 * w * x, 1 - 2 * x * x), 6) AS roll, round(asin(greatest(least(2 * w * y, 1), -1)), 6) AS pitch FROM q""")
def p11_quaternion_angles(spark, sf):
    w, x, y = F.cos("l_tax"), F.sin("l_tax") * 0.6, F.sin("l_tax") * 0.8
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", R6(F.atan2(2 * w * x, 1 - 2 * x * x)).alias("roll"), R6(F.asin(F.greatest(F.least(2 * w * y, F.lit(1.0)), F.lit(-1.0)))).alias("pitch"))


@query("WITH s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice END AS v FROM orders), k AS (SELECT quantile_cont(v, 0.5) AS med, avg(v) AS mean, stddev_pop(v) AS sd FROM s) SELECT o_orderkey, round((coalesce(v, med) - mean) / sd, 6) AS z FROM s, k")
def p21_p22_impute_scale(spark, sf):
    s = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice")).alias("v"))
    k = s.agg(F.expr("percentile(v, 0.5)").alias("med"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"))
    return s.crossJoin(F.broadcast(k)).select("o_orderkey", R6((F.coalesce("v", "med") - F.col("mean")) / F.col("sd")).alias("z"))


@query("""WITH n AS (SELECT o_custkey, count(*) AS m FROM orders GROUP BY 1), i AS (SELECT o_custkey, m, unnest(range(0, 2 * m)) AS i FROM n)
SELECT o_custkey, i, CASE WHEN m = 1 THEN 0 ELSE round_even(i * (m - 1) / (2 * m - 1)::DOUBLE, 0)::BIGINT END AS nearest FROM i""")
def p28_nearest_index(spark, sf):
    n = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("m"))
    i = n.withColumn("i", F.explode(F.sequence(F.lit(0), 2 * F.col("m") - 1)))
    return i.select("o_custkey", "i", F.when(F.col("m") == 1, 0).otherwise(F.bround(F.col("i") * (F.col("m") - 1) / (2 * F.col("m") - 1))).cast("long").alias("nearest"))


@query("SELECT user_id, time_bucket(INTERVAL '1 day', ts)::DATE AS day, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def z1_window_features(spark, sf):
    """The batch form of the streamed window features (kinespark.streaming.streams.window_features)."""
    from kinespark.streaming.streams import window_features

    w = window_features(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", "value", "1 day", "1 day")
    return w.select("user_id", F.to_date("window.start").alias("day"), "n", R6("mean").alias("mean"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '6 hours' THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, epoch_us(min(ts)) AS started, count(*) AS n FROM s GROUP BY user_id, k""")
def z5_sessions(spark, sf):
    from kinespark.streaming.streams import sessions

    s = sessions(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", "6 hours")
    return s.select("user_id", F.unix_micros("session.start").alias("started"), "n")
