"""Model-based queries over the embeddings: ids divisible by 20 as queries, class 0 as the healthy rows."""

from pyspark.sql import functions as F

from kinespark.functions.hashes import unit, unit_sql
from kinespark.operators import held_out as ho
from kinespark.operators import metrics
from kinespark.operators import models as md
from kinespark.operators import neighbours as nb
from kinespark.plans.register import query, table

PAIRS = "p AS (SELECT a.vec_id AS query, b.vec_id AS neighbour, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2))) AS distance FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND a.vec_id % 20 = 0), n AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(distance, 9), neighbour) AS rank FROM p QUALIFY rank <= 5)"


def asked(spark, sf):
    e = table(spark, sf, "embeddings")
    return nb.neighbours(e.filter("vec_id % 20 = 0"), e, "vec_id", "embedding", 5)


@query(f"WITH {PAIRS} SELECT query, neighbour, round(distance, 5) AS distance, rank FROM n")
def j15_nearest_neighbours(spark, sf):
    return asked(spark, sf).withColumn("distance", F.round("distance", 5))


@query(f"""WITH {PAIRS}, v AS (SELECT query, label, round(sum(1 / (distance + 1e-12)), 9) AS w FROM n JOIN embeddings ON neighbour = vec_id GROUP BY 1, 2)
SELECT query, label FROM v QUALIFY row_number() OVER (PARTITION BY query ORDER BY w DESC, label) = 1""")
def m3_knn_classifier(spark, sf):
    return md.knn_vote(asked(spark, sf), table(spark, sf, "embeddings"), "vec_id", "label")


@query()
def m9_isolation_forest(spark, sf):
    e = table(spark, sf, "embeddings")
    return md.isolation_scores(e.filter("label = 0"), e, "vec_id", "embedding")


EVERY = PAIRS.replace(" AND a.vec_id % 20 = 0", "").replace("rank <= 5", "rank <= 10")


@query(f"""WITH {EVERY}, k AS (SELECT query, max(distance) AS reach FROM n GROUP BY 1), l AS (SELECT n.query, 1 / (avg(greatest(distance, reach)) + 1e-10) AS lrd FROM n JOIN k ON k.query = n.neighbour GROUP BY 1)
SELECT n.query AS id, round(avg(o.lrd) / any_value(l.lrd), 5) AS lof FROM n JOIN l o ON o.query = n.neighbour JOIN l ON l.query = n.query GROUP BY 1""")
def m10_local_outlier_factor(spark, sf):
    e = table(spark, sf, "embeddings")
    return md.local_outlier_factor(nb.neighbours(e, e, "vec_id", "embedding", 10)).withColumn("lof", F.round("lof", 5))


#: Vectors with class 0 against the rest, and four folds by md5 of the id.
FOLDED = f"f AS (SELECT vec_id, (label = 0)::INT AS y, label, floor({unit_sql('vec_id')} * 4)::INT AS fold, embedding FROM embeddings), x AS (SELECT vec_id, y, label, fold, unnest(range(0, 64)) AS d, unnest(embedding)::DOUBLE AS v FROM f), folds AS (SELECT DISTINCT fold FROM f)"
HALVES = {"first": (0, 32), "second": (32, 64), "all": None}
CENTROIDS = f"""{FOLDED}, c AS (SELECT g.fold, y, d, avg(v) AS m FROM folds g JOIN x ON x.fold <> g.fold GROUP BY 1, 2, 3), p AS (SELECT unnest(['first', 'second', 'all']) AS part, unnest([0, 32, 0]) AS a, unnest([32, 64, 64]) AS b),
e AS (SELECT x.vec_id, x.y, x.fold, part, sqrt(sum((v - m) ** 2) FILTER (WHERE c.y = 0)) AS far, sqrt(sum((v - m) ** 2) FILTER (WHERE c.y = 1)) AS near FROM x JOIN c ON c.fold = x.fold AND c.d = x.d JOIN p ON x.d >= a AND x.d < b GROUP BY 1, 2, 3, 4), s AS (SELECT vec_id, y, fold, part, far / (far + near) AS score FROM e)"""
WINS = "avg(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END)"


def folded(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", (F.col("label") == 0).cast("int").alias("y"), "label", F.floor(unit("vec_id") * 4).cast("int").alias("fold"), "embedding")


def centroids(spark, sf):
    return md.centroid_scores(folded(spark, sf), "vec_id", "embedding", "y", "fold", HALVES)


@query(f"WITH {CENTROIDS} SELECT vec_id, round(avg(score), 6) AS vote, avg(score) >= 0.5 AS flagged FROM s WHERE part <> 'all' GROUP BY 1")
def m6_soft_voting(spark, sf):
    """The mean of two models' out-of-fold scores, one on each half of the dimensions."""
    g = centroids(spark, sf).filter("part <> 'all'").groupBy("vec_id").agg(F.avg("score").alias("vote"))
    return g.select("vec_id", F.round("vote", 6).alias("vote"), (F.col("vote") >= 0.5).alias("flagged"))


PROTOCOLS = f"""z AS (SELECT vec_id, vec_id % 20 AS participant, (label = 0)::INT AS y, embedding FROM embeddings), k AS (SELECT unnest([1, 2, 3]) AS seed),
f AS (SELECT 'grouped' AS protocol, seed, vec_id, floor({unit_sql('participant', 'seed')} * 4)::INT AS fold FROM z, k UNION ALL SELECT 'ungrouped', seed, vec_id, floor({unit_sql('vec_id', 'seed')} * 4)::INT FROM z, k),
x AS (SELECT protocol, seed, vec_id, y, fold, unnest(range(1, 65)) AS d, unnest(embedding::DOUBLE[]) AS v FROM z JOIN f USING (vec_id)), t AS (SELECT protocol, seed, fold, y, d, sum(v) AS s, count(*) AS n FROM x GROUP BY ALL),
c AS (SELECT a.protocol, a.seed, a.fold, b.y, b.d, sum(b.s) / sum(b.n) AS m FROM (SELECT DISTINCT protocol, seed, fold FROM t) a JOIN t b ON a.protocol = b.protocol AND a.seed = b.seed AND a.fold <> b.fold GROUP BY ALL),
e AS (SELECT x.protocol, x.seed, vec_id, x.y, sqrt(sum((v - m) ** 2) FILTER (WHERE c.y = 0)) AS far, sqrt(sum((v - m) ** 2) FILTER (WHERE c.y = 1)) AS near FROM x JOIN c ON c.protocol = x.protocol AND c.seed = x.seed AND c.fold = x.fold AND c.d = x.d GROUP BY ALL),
s AS (SELECT protocol, seed, y, round(far / (far + near), 9) AS score FROM e), r AS (SELECT p.protocol, p.seed, {WINS} AS auc FROM s p JOIN s n ON p.protocol = n.protocol AND p.seed = n.seed AND p.y = 1 AND n.y = 0 GROUP BY 1, 2),
g AS (SELECT count(DISTINCT seed) AS n_seeds, avg(auc) FILTER (WHERE protocol = 'grouped') AS a, stddev_samp(auc) FILTER (WHERE protocol = 'grouped') AS sa, avg(auc) FILTER (WHERE protocol = 'ungrouped') AS b, stddev_samp(auc) FILTER (WHERE protocol = 'ungrouped') AS sb FROM r)"""


@query(f"WITH {PROTOCOLS} SELECT n_seeds, round(a, 5) AS grouped, round(sa, 5) AS grouped_sd, round(b, 5) AS ungrouped, round(sb, 5) AS ungrouped_sd, round(b - a, 5) AS delta, round(100 * (b - a) / a, 4) AS inflation_pct FROM g")
def t20_split_protocols(spark, sf):
    """Both protocols run: participants kept in one fold against rows dealt one by one, over three seeds."""
    e = table(spark, sf, "embeddings").select("vec_id", (F.col("vec_id") % 20).alias("participant"), (F.col("label") == 0).cast("int").alias("y"), "embedding")
    scores = md.protocol_scores(e, "vec_id", "participant", "embedding", "y", 4, [1, 2, 3]).withColumn("score", F.round("score", 9))
    made = md.protocol_gaps(scores, "y")
    return made.select("n_seeds", *(F.round(c, 4 if c == "inflation_pct" else 5).alias(c) for c in made.columns[1:]))


@query()
def m6_stacking(spark, sf):
    """A logistic model over the two models' out-of-fold scores, itself scored out of fold."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    x = centroids(spark, sf).filter("part <> 'all'").groupBy("vec_id", "y", "fold").pivot("part", ["first", "second"]).agg(F.first("score"))
    x = VectorAssembler(inputCols=["first", "second"], outputCol="features").transform(x)
    out = None
    for fold in range(4):
        model = LogisticRegression(labelCol="y", maxIter=10).fit(x.filter(F.col("fold") != fold))
        part = model.transform(x.filter(F.col("fold") == fold)).select("vec_id", "y", vector_to_array("probability")[1].alias("score"))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"WITH {CENTROIDS} SELECT p.part AS scenario, round({WINS}, 6) AS auc FROM s p JOIN s n ON p.part = n.part AND p.y = 1 AND n.y = 0 GROUP BY 1")
def m14_ablation(spark, sf):
    """The out-of-fold AUC of each scenario of dimensions."""
    return metrics.auc(centroids(spark, sf), ["part"], "y", "score").select(F.col("part").alias("scenario"), F.round("auc", 6).alias("auc"))


ANOMALY = f"""{FOLDED}, c AS (SELECT g.fold, d, avg(v) AS m, stddev_pop(v) AS sd FROM folds g JOIN x ON x.fold <> g.fold AND x.y = 0 GROUP BY 1, 2),
own AS (SELECT vec_id, y, label, x.fold, sqrt(avg(((v - m) / (sd + 1e-8)) ** 2)) AS score FROM x JOIN c ON c.fold = x.fold AND c.d = x.d GROUP BY 1, 2, 3, 4), tr AS (SELECT c.fold, vec_id, sqrt(avg(((v - m) / (sd + 1e-8)) ** 2)) AS score FROM x JOIN c ON c.fold <> x.fold AND c.d = x.d AND y = 0 GROUP BY 1, 2),
t AS (SELECT fold, quantile_cont(score, 0.95) AS th FROM tr GROUP BY 1)"""


@query(f"WITH {ANOMALY} SELECT fold, round(max(th), 6) AS threshold, count(*) AS n, round(avg((score >= th)::INT) FILTER (WHERE y = 1), 6) AS sensitivity, round(avg((score < th)::INT) FILTER (WHERE y = 0), 6) AS specificity FROM own JOIN t USING (fold) GROUP BY 1")
def m12_anomaly_folds(spark, sf):
    """Normal ranges fitted without each fold's rows, thresholds of the fitting rows, rates on the held-out ones."""
    scores, cuts = md.anomaly_folds(folded(spark, sf), "vec_id", "embedding", "y", "fold")
    g = scores.groupBy("fold").agg(F.count("*").alias("n"), F.avg(F.when(F.col("y") == 1, F.col("flagged").cast("int"))).alias("sensitivity"), F.avg(F.when(F.col("y") == 0, (~F.col("flagged")).cast("int"))).alias("specificity"))
    return g.join(cuts, "fold").select("fold", F.round("threshold", 6).alias("threshold"), "n", F.round("sensitivity", 6).alias("sensitivity"), F.round("specificity", 6).alias("specificity"))


@query(f"""WITH {FOLDED}, c AS (SELECT d, avg(v) AS m, stddev_pop(v) AS sd FROM x WHERE fold < 2 AND y = 0 GROUP BY 1), s AS (SELECT vec_id, label % 3 AS subject, y, sqrt(avg(((v - m) / (sd + 1e-8)) ** 2)) AS score FROM x JOIN c USING (d) WHERE fold >= 2 GROUP BY 1, 2, 3),
a AS (SELECT coalesce(subject::VARCHAR, 'all') AS subject, y, score FROM (SELECT subject, y, score FROM s UNION ALL SELECT NULL, y, score FROM s)) SELECT p.subject, round({WINS}, 6) AS auc FROM a p JOIN a n ON p.subject = n.subject AND p.y = 1 AND n.y = 0 GROUP BY 1""")
def m13_transfer_scores(spark, sf):
    """A normal range of the source's healthy rows (folds 0 and 1) scores the target's rows (folds 2 and 3), by subject and pooled."""
    f = folded(spark, sf)
    range_ = md.without_fold(f.withColumn("side", F.when(F.col("fold") < 2, "source").otherwise("target")), "embedding", "side", [], F.col("y") == 0).filter("side = 'target'").select("mean", "sd")
    x = f.filter("fold >= 2").crossJoin(F.broadcast(range_)).withColumn("v", F.col("embedding").cast("array<double>"))
    z = F.zip_with(F.zip_with("v", "mean", lambda a, b: a - b), "sd", lambda d, s: (d / (s + 1e-8)) * (d / (s + 1e-8)))
    x = x.withColumn("score", F.sqrt(F.aggregate(z, F.lit(0.0), lambda t, q: t + q) / F.size("v")))
    x = x.withColumn("subject", F.explode(F.array((F.col("label") % 3).cast("string"), F.lit("all"))))
    return metrics.auc(x, ["subject"], "y", "score").filter("auc is not null").select("subject", F.round("auc", 6).alias("auc"))


@query(f"""WITH {FOLDED}, m AS (SELECT vec_id, label AS y, fold, avg(v) AS x FROM x GROUP BY 1, 2, 3), l AS (SELECT g.fold, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM folds g JOIN m ON m.fold <> g.fold GROUP BY 1), r AS (SELECT y, a + b * x AS p FROM m JOIN l USING (fold))
SELECT round(avg(abs(y - p)), 6) AS mae, round(1 - sum((y - p) ** 2) / (sum(y * y) - sum(y) ** 2 / count(*)), 6) AS r2 FROM r""")
def m15_severity_regression(spark, sf):
    """Severity by a line over a reduced feature, out of fold."""
    mean = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda s, v: s + v) / F.size("embedding")
    x = md.held_out_lines(folded(spark, sf).select("fold", F.col("label").cast("double").alias("y"), mean.alias("x")), "fold", "x", "y")
    e = F.col("y") - F.col("predicted")
    return x.agg(F.round(F.avg(F.abs(e)), 6).alias("mae"), F.round(1 - F.sum(e * e) / (F.var_pop("y") * F.count("*")), 6).alias("r2"))


@query(f"""WITH o AS (SELECT vec_id, embedding FROM embeddings WHERE label = 0), p AS (SELECT a.vec_id AS query, b.vec_id AS neighbour, a.embedding AS va, b.embedding AS vb, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2))) AS distance FROM o a JOIN o b ON a.vec_id <> b.vec_id),
n AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(distance, 9), neighbour) AS rank, {unit_sql('query', "'w'")} AS w FROM p)
SELECT query AS vec_id, neighbour, round(w, 6) AS weight, round(list_sum(list_transform(list_zip(va, vb), lambda z: z[1]::DOUBLE + w * (z[2]::DOUBLE - z[1]::DOUBLE))), 4) AS total FROM n WHERE rank = floor({unit_sql('query')} * 5)::INT + 1""")
def m17_oversampling(spark, sf):
    """New rows of the minority class between a row and one of its five nearest of the class."""
    x = md.oversampled(table(spark, sf, "embeddings").filter("label = 0").select("vec_id", "embedding"), "vec_id", "embedding")
    return x.select("vec_id", "neighbour", F.round("weight", 6).alias("weight"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v), 4).alias("total"))


PARTS4 = {f"p{k}": (16 * k, 16 * k + 16) for k in range(4)}


@query(f"""WITH {FOLDED}, c AS (SELECT g.fold, y, d, avg(v) AS m FROM folds g JOIN x ON x.fold <> g.fold GROUP BY 1, 2, 3), u AS (SELECT vec_id, {unit_sql('vec_id')} AS u FROM f), b AS (SELECT vec_id, u, (floor(u * 1e6) % 16)::INT AS b FROM u),
o AS (SELECT vec_id, coalesce(lead(vec_id) OVER (PARTITION BY b ORDER BY u, vec_id), first_value(vec_id) OVER (PARTITION BY b ORDER BY u, vec_id)) AS other FROM b), q AS (SELECT unnest(['none', 'p0', 'p1', 'p2', 'p3']) AS shuffled, unnest([64, 0, 16, 32, 48]) AS a),
h AS (SELECT x.vec_id, x.y, x.fold, x.d, shuffled, CASE WHEN x.d >= a AND x.d < a + 16 THEN z.v ELSE x.v END AS v FROM x JOIN o USING (vec_id) JOIN x z ON z.vec_id = o.other AND z.d = x.d CROSS JOIN q),
e AS (SELECT h.vec_id, h.y, shuffled, sqrt(sum((v - m) ** 2) FILTER (WHERE c.y = 0)) AS far, sqrt(sum((v - m) ** 2) FILTER (WHERE c.y = 1)) AS near FROM h JOIN c ON c.fold = h.fold AND c.d = h.d GROUP BY 1, 2, 3), s AS (SELECT vec_id, y, shuffled, far / (far + near) AS score FROM e),
r AS (SELECT p.shuffled, {WINS} AS auc FROM s p JOIN s n ON p.shuffled = n.shuffled AND p.y = 1 AND n.y = 0 GROUP BY 1) SELECT shuffled, round((SELECT auc FROM r WHERE shuffled = 'none') - auc, 6) AS importance FROM r WHERE shuffled <> 'none'""")
def m18_part_importance(spark, sf):
    return md.part_importance(folded(spark, sf), "vec_id", "embedding", "y", "fold", PARTS4).withColumn("importance", F.round("importance", 6))


@query()
def m7_m8_elimination(spark, sf):
    """The parts that stay of four, and the AUC before and after."""
    f = folded(spark, sf)
    kept = md.eliminate(f, "vec_id", "embedding", "y", "fold", PARTS4, 2)
    less = f
    for name in sorted(set(PARTS4) - set(kept)):
        less = less.withColumn("embedding", md.blanked(F.col("embedding"), PARTS4[name]))
    auc = lambda rows, name: metrics.auc(md.centroid_scores(rows, "vec_id", "embedding", "y", "fold", {"all": None}), [], "y", "score").select(F.lit(name).alias("columns"), "auc")
    return auc(f, "all").unionByName(auc(less, "+".join(kept)))


@query(f"""WITH {CENTROIDS}, g AS (SELECT o.fold, p.part, {WINS} AS auc FROM folds o JOIN s p ON p.fold <> o.fold AND p.y = 1 AND p.part <> 'all' JOIN s n ON n.fold <> o.fold AND n.part = p.part AND n.y = 0 GROUP BY 1, 2), best AS (SELECT fold, part FROM g QUALIFY row_number() OVER (PARTITION BY fold ORDER BY round(auc, 9) DESC, part DESC) = 1),
h AS (SELECT s.fold, y, score, CASE WHEN s.part = 'all' THEN 'fixed' ELSE 'nested' END AS protocol FROM s JOIN best USING (fold) WHERE s.part IN ('all', best.part)), a AS (SELECT p.fold, p.protocol, {WINS} AS auc FROM h p JOIN h n ON p.fold = n.fold AND p.protocol = n.protocol AND p.y = 1 AND n.y = 0 GROUP BY 1, 2)
SELECT x.fold, round(x.auc, 6) AS fixed, round(z.auc, 6) AS nested, round(x.auc - z.auc, 6) AS delta FROM a x JOIN a z ON x.fold = z.fold AND x.protocol = 'fixed' AND z.protocol = 'nested'""")
def m22_fixed_against_nested(spark, sf):
    """Held-out AUC of all dimensions and of the half that does best on the other folds' rows."""
    s = centroids(spark, sf)
    outer = s.select(F.col("fold").alias("outer")).distinct()
    inner = s.filter("part <> 'all'").join(F.broadcast(outer), F.col("fold") != F.col("outer"))
    best = metrics.auc(inner, ["outer", "part"], "y", "score").groupBy("outer").agg(F.max_by("part", F.struct(F.round("auc", 9), "part")).alias("best"))
    x = s.join(F.broadcast(best), F.col("fold") == F.col("outer")).filter((F.col("part") == "all") | (F.col("part") == F.col("best")))
    x = x.withColumn("protocol", F.when(F.col("part") == "all", "fixed").otherwise("nested"))
    a = metrics.auc(x, ["fold", "protocol"], "y", "score").groupBy("fold").pivot("protocol", ["fixed", "nested"]).agg(F.first("auc"))
    return a.filter("fixed is not null").select("fold", F.round("fixed", 6).alias("fixed"), F.round("nested", 6).alias("nested"), F.round(F.col("fixed") - F.col("nested"), 6).alias("delta"))


def vectors(spark, sf):
    from pyspark.ml.functions import array_to_vector

    return folded(spark, sf).select("vec_id", F.col("y").cast("double").alias("y"), "fold", array_to_vector(F.col("embedding").cast("array<double>")).alias("raw"))


def gapped(spark, sf, wide=64):
    """Vectors of twenty participants; every thirteenth figure is missing."""
    e = table(spark, sf, "embeddings").select("vec_id", (F.col("vec_id") % 20).alias("participant"), (F.col("label") == 0).cast("int").alias("y"), F.slice("embedding", 1, wide).cast("array<double>").alias("x"))
    return e.withColumn("x", F.transform("x", lambda v, k: F.when((F.col("vec_id") + k) % 13 != 0, v)))


@query()
def m1_leave_one_subject_out(spark, sf):
    """Each row's score by a class-weighted model of all other participants, imputed and scaled by those alone."""
    return ho.leave_one_group_out(gapped(spark, sf, 16), "participant", "y", "x").select("vec_id", "participant", "y", F.round("score", 3).alias("score"))


@query()
def m2_estimators(spark, sf):
    """Out-of-fold AUC of a linear model, a forest, boosting and a neural net, classes weighted, behind imputed and scaled features, two folds."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
    from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    names = [f"x{k}" for k in range(64)]
    wide = gapped(spark, sf).withColumn("half", F.col("participant") % 2)
    n = wide.groupBy("half", "y").agg(F.count("*").alias("n"))
    # a class's weight in the other half, where the model is fitted
    share = n.join(n.groupBy("half").agg(F.sum("n").alias("all")), "half").select(F.col("half").alias("in_half"), F.col("y").alias("of"), (F.col("all") / (2 * F.col("n"))).alias("weight"))
    x = wide.join(F.broadcast(share), (F.col("half") == F.col("in_half")) & (F.col("y") == F.col("of"))).select("vec_id", F.col("y").cast("double").alias("y"), "half", "weight", *(F.col("x")[k].alias(c) for k, c in enumerate(names)))
    common, weighted, out = {"labelCol": "y", "featuresCol": "features"}, {"weightCol": "weight"}, None
    models = {
        "logistic": LogisticRegression(regParam=0.01, elasticNetParam=0.5, maxIter=10, **common, **weighted), "forest": RandomForestClassifier(numTrees=10, maxDepth=4, seed=1, **common, **weighted),
        "boosting": GBTClassifier(maxIter=4, maxDepth=3, seed=1, **common, **weighted), "net": MultilayerPerceptronClassifier(layers=[64, 8, 2], maxIter=10, seed=1, **common),
    }
    ready = [Imputer(strategy="median", inputCols=names, outputCols=names), VectorAssembler(inputCols=names, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True)]
    for half in (0, 1):
        known = x.filter(F.col("half") != half)
        scale = Pipeline(stages=ready).fit(known)
        fitted, held = scale.transform(known), scale.transform(x.filter(F.col("half") == half))
        for name, model in models.items():
            part = model.fit(fitted).transform(held).select(F.lit(name).alias("model"), F.col("y").cast("int").alias("y"), vector_to_array("probability")[1].alias("score"))
            out = part if out is None else out.unionByName(part)
    return metrics.auc(out, ["model"], "y", "score").select("model", "n_pos", "n_neg", "auc")


@query()
def m4_m5_nested_search(spark, sf):
    """Each outer half's AUC of a model whose penalty a search over the other half's folds chose."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    x, rows = vectors(spark, sf).withColumnRenamed("raw", "features").withColumn("half", F.col("fold") % 2).withColumn("inner", F.floor(F.col("fold") / 2).cast("int")), []
    model = LogisticRegression(labelCol="y", maxIter=8)
    grid = ParamGridBuilder().addGrid(model.regParam, [0.01, 1.0]).build()
    judge = BinaryClassificationEvaluator(labelCol="y")
    for half in (0, 1):
        search = CrossValidator(estimator=model, estimatorParamMaps=grid, evaluator=judge, foldCol="inner", numFolds=2).fit(x.filter(F.col("half") != half))
        rows.append((half, float(search.bestModel.getRegParam()), float(judge.evaluate(search.transform(x.filter(F.col("half") == half))))))
    return spark.createDataFrame(rows, "half int, penalty double, auc double")


@query()
def m20_kernel_logistic(spark, sf):
    """Random-kernel features into a ridge logistic model, out of fold."""
    import numpy as np
    import pandas as pd
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    from kinespark.operators import signals as g

    bank = g.kernel_bank(7, 50, 64)

    def run(batches):
        for pdf in batches:
            if len(pdf):
                made = g.kernel_features(np.stack(pdf["embedding"].to_numpy()).astype(float), bank)
                yield pd.DataFrame({"vec_id": pdf["vec_id"], "y": pdf["y"].astype(float), "fold": pdf["fold"], "f": list(made)})

    x = folded(spark, sf).mapInPandas(run, "vec_id long, y double, fold int, f array<double>").withColumn("features", array_to_vector("f"))
    out = None
    for half in (0, 1):
        model = LogisticRegression(labelCol="y", regParam=0.1, maxIter=10).fit(x.filter(F.col("fold") % 2 != half))
        part = model.transform(x.filter(F.col("fold") % 2 == half)).select("vec_id", "y", vector_to_array("probability")[1].alias("score"))
        out = part if out is None else out.unionByName(part)
    return out


@query()
def m16_pca(spark, sf):
    """Projection on two components fitted on class 0."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    e = table(spark, sf, "embeddings").select("vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("x"))
    model = PCA(k=2, inputCol="x", outputCol="y").fit(e.filter("label = 0"))
    return model.transform(e).select("vec_id", vector_to_array("y").alias("y")).select("vec_id", F.col("y")[0].alias("first"), F.col("y")[1].alias("second"))


@query()
def m1_m2_grouped_logistic(spark, sf):
    """Out-of-fold scores of a logistic model, labels dealt to five group-safe folds by a hash of the id."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    e = table(spark, sf, "embeddings").select("vec_id", (F.col("label") == 0).cast("double").alias("y"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features"), F.pmod(F.xxhash64("vec_id"), F.lit(5)).alias("fold"))
    parts = []
    for fold in range(5):
        model = LogisticRegression(labelCol="y", regParam=0.01, maxIter=20).fit(e.filter(F.col("fold") != fold))
        parts.append(model.transform(e.filter(F.col("fold") == fold)).select("vec_id", "fold", "y", vector_to_array("probability")[1].alias("score")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
