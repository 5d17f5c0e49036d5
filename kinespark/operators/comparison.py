"""Comparing models on the same rows: pairwise tests with corrections, critical differences, cut-offs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinespark.functions.mathx import normal_two_sided
from kinespark.functions.steps import written
from kinespark.operators import metrics as m
from kinespark.operators import stats as t

#: Critical values of the studentised range at 0.05 by number of treatments, over the root of two. Fixed values.
NEMENYI = {2: 1.960, 3: 2.343, 4: 2.569, 5: 2.728, 6: 2.850, 7: 2.949, 8: 3.031, 9: 3.102, 10: 3.164, 11: 3.219, 12: 3.269, 13: 3.313, 14: 3.354, 15: 3.391}


def pairwise_delong(df: DataFrame, y: str, scores: Sequence[str]) -> DataFrame:
    """(model_a, model_b, auc_a, auc_b, z, p, q) for each pair of score columns; q over all pairs."""
    return m.benjamini_hochberg(t.delong_pairs(df, y, list(scores)), "p", "q")


def family_gain(df: DataFrame, group: str, y: str, family: Sequence[str], others: Sequence[str], replicates: int) -> DataFrame:
    """(model, reference, delta, p) of each of a family against the best of the others, by the same bootstrap of groups."""
    auc = lambda s: m.auc(df, [], y, s).select(F.lit(s).alias("model"), "auc")
    means = auc(others[0])
    for s in others[1:]:
        means = means.unionByName(auc(s))
    best = means.agg(F.max_by("model", F.struct("auc", "model")).alias("reference"))
    drawn = t.bootstrap_auc(df, group, y, [*family, *others], replicates).join(F.broadcast(best))
    reference = drawn.filter(F.col("score") == F.col("reference")).select("replicate", F.col("auc").alias("r"))
    d = F.col("auc") - F.col("r")
    pairs = drawn.filter(F.col("score").isin(*family)).join(reference, "replicate")
    return pairs.groupBy(F.col("score").alias("model"), "reference").agg(F.avg(d).alias("delta"), F.least(F.lit(1.0), 2 * F.least(F.avg((d <= 0).cast("int")), F.avg((d >= 0).cast("int")))).alias("p"))


def critical_difference(df: DataFrame, block: str, treatment: str, value: str) -> DataFrame:
    """(treatment, mean_rank, blocks, cd) over complete blocks, rank 1 for the largest value."""
    ranked = m.mid_ranks(df.withColumn("_v", -F.col(value)), [block], "_v", "rank", [])
    ranks = ranked.groupBy(treatment).agg(F.avg("rank").alias("mean_rank"), F.count("*").alias("blocks"))
    k = F.count("*").over(Window.partitionBy())  # a row a treatment
    table = F.create_map(*(F.lit(x) for kv in NEMENYI.items() for x in kv))
    q = F.coalesce(F.try_element_at(table, k.cast("int")), 3.31 + 0.05 * (k - 13))
    return ranks.withColumn("cd", F.when(k >= 2, q * F.sqrt(k * (k + 1) / (6.0 * F.col("blocks")))))


def wilcoxon_against(df: DataFrame, block: str, treatment: str, value: str, reference: str) -> DataFrame:
    """(treatment, n, w, z, p, p_holm, delta) of the signed-rank test of each treatment against the reference, block by block.

    p is normal with the correction for ties; zeros are dropped; no difference at all gives 1.
    """
    own = df.filter(F.col(treatment) == reference).select(block, F.col(value).alias("_r"))
    d = df.filter(F.col(treatment) != reference).join(own, block).select(treatment, F.round(F.col("_r") - F.col(value), 12).alias("_d"))
    return m.holm(signed_rank_tests(d, [treatment]), "p", "p_holm")


def wilcoxon_pairs(df: DataFrame, block: str, treatment: str, value: str, alpha: float = 0.05) -> DataFrame:
    """(model_a, model_b, n, w, z, p, p_holm, delta, differs) of the signed-rank test of every pair of treatments, a before b by name."""
    one = df.select(block, F.col(treatment).alias("model_a"), F.col(value).alias("_a"))
    other = df.select(F.col(block).alias("_block"), F.col(treatment).alias("model_b"), F.col(value).alias("_b"))
    d = one.join(other, (F.col(block) == F.col("_block")) & (F.col("model_a") < F.col("model_b"))).select("model_a", "model_b", F.round(F.col("_a") - F.col("_b"), 12).alias("_d"))
    return m.holm(signed_rank_tests(d, ["model_a", "model_b"]), "p", "p_holm").withColumn("differs", F.col("p_holm") < alpha)


def difference_matrix(pairs: DataFrame, models: Sequence[str]) -> DataFrame:
    """(model, models): a row and a column a model, true where the pair differs; false on the diagonal."""
    both = pairs.select(F.col("model_a").alias("model"), F.col("model_b").alias("other"), "differs").unionByName(pairs.select(F.col("model_b").alias("model"), F.col("model_a").alias("other"), "differs"))
    return both.groupBy("model").pivot("other", list(models)).agg(F.first("differs")).fillna(False, list(models))


def signed_rank_tests(differences: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n, w, z, p, delta) of the signed-rank test of each key's differences (keys, _d)."""
    names = list(keys)
    d = written(differences, "differences")
    means = d.groupBy(*names).agg(F.avg("_d").alias("delta"))
    ranked = m.mid_ranks(d.filter("_d <> 0").withColumn("_m", F.abs("_d")), names, "_m", "rank")
    ties = ranked.groupBy(*names, "_m").agg(F.count("*").alias("k")).groupBy(*names).agg(F.sum(F.pow("k", F.lit(3)) - F.col("k")).alias("ties"))
    sums = ranked.groupBy(*names).agg(F.count("*").alias("n"), F.sum(F.when(F.col("_d") > 0, F.col("rank")).otherwise(0.0)).alias("up"), F.sum(F.when(F.col("_d") < 0, F.col("rank")).otherwise(0.0)).alias("down"))
    n, w = F.col("n").cast("double"), F.least("up", "down")
    variance = n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48
    z = F.when(variance > 0, (w - n * (n + 1) / 4) / F.sqrt(variance))
    return means.join(sums.join(ties, names), names, "left").select(*names, F.coalesce("n", F.lit(0)).alias("n"), w.alias("w"), z.alias("z"), F.coalesce(normal_two_sided(z), F.lit(1.0)).alias("p"), "delta")


def jackknife_aucs(df: DataFrame, group: str, y: str, scores: Sequence[str]) -> DataFrame:
    """(group, model, auc) without each group's rows, of the groups that have one for all models; written, as tests read it again and again."""
    parts = [m.leave_one_out_auc(df, group, y, s).select(group, F.lit(s).alias("model"), "auc") for s in scores]
    whole = parts[0]
    for x in parts[1:]:
        whole = whole.unionByName(x)
    whole = written(whole.filter("auc is not null"), "jackknife")
    return whole.join(whole.groupBy(group).agg(F.count("*").alias("_n")).filter(F.col("_n") == len(scores)).select(group), group)


def cutoffs(df: DataFrame, y: str, score: str, primary: float, at: Sequence[float] = (0.5,)) -> DataFrame:
    """(rule, threshold, rates): at the primary cut-off, at the rows' own best one, and at fixed ones."""
    best = m.youden(df, [], y, score).select(F.lit("evaluation").alias("rule"), "threshold")
    fixed = df.sparkSession.createDataFrame([("primary", float(primary)), *((f"fixed_{x}", float(x)) for x in at)], "rule string, threshold double")
    rules = best.unionByName(fixed)
    counts = df.select(y, score).crossJoin(F.broadcast(rules)).groupBy("rule", "threshold").agg(*m.binary_counts(y, F.col(score) >= F.col("threshold")))
    return m.rates(counts)


def protocol_gap(df: DataFrame, model: str, grouped: str, ungrouped: str) -> DataFrame:
    """(model, delta, inflation_pct): how much the AUC rises where groups may be split over folds."""
    return df.select(model, (F.col(ungrouped) - F.col(grouped)).alias("delta"), (100 * F.try_divide(F.col(ungrouped) - F.col(grouped), F.col(grouped))).alias("inflation_pct"))
