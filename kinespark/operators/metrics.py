"""Ranking metrics and report tables over out-of-fold score tables.

Scores are first counted by distinct value; running totals over these go by ranges of the score (functions.ranges), so
that neither many distinct scores nor few keys (model, fold, cohort) make one task do all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinespark.functions.ranges import range_cuts, running, same
from kinespark.functions.steps import written

#: Added to the denominators of rates, as the published tables do. Fixed value.
EPS = 1e-10


def score_counts(df: DataFrame, keys: Sequence[str], y: str, score: str) -> DataFrame:
    """(keys, s, pos, neg) by distinct score."""
    return df.filter(F.col(score).isNotNull()).groupBy(*keys, F.col(score).alias("s")).agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg"))


def auc(df: DataFrame, keys: Sequence[str], y: str, score: str) -> DataFrame:
    """(keys, n_pos, n_neg, auc): wins of positives over negatives, ties half; null for one class alone."""
    return auc_of_counts(score_counts(df, keys, y, score), keys)


def auc_of_counts(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same from (keys, s, pos, neg) by distinct score."""
    c = running(counts, keys, "s", {"upto": "neg"})
    u = c.groupBy(*keys).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum(F.col("pos") * (F.col("upto") - F.col("neg") / 2)).alias("u"))
    return u.withColumn("auc", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("u") / (F.col("n_pos") * F.col("n_neg")))).drop("u")


def mid_ranks(df: DataFrame, keys: Sequence[str], value: str, into: str, cuts: Sequence[float] | None = None) -> DataFrame:
    """df with the average rank of value among its keys' rows; rows without a value have no rank and go.

    cuts are those of functions.ranges.running.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    ranks = running(counts, keys, value, {"_upto": "_n"}, cuts)
    ranks = ranks.select(*(F.col(k).alias(f"_rank_{k}") for k in (*keys, value)), (F.col("_upto") - (F.col("_n") - 1) / 2).alias(into))
    return df.join(ranks, same([*keys, value], "_rank_")).select(*df.columns, into)


def roc_points(df: DataFrame, keys: Sequence[str], y: str, score: str) -> DataFrame:
    """(keys, threshold, tpr, fpr, tp, fp, step) for score >= threshold at each distinct score; step is what it adds to tpr."""
    c = running(score_counts(df, keys, y, score), keys, "s", {"pos_upto": "pos", "neg_upto": "neg"})
    whole = c.groupBy(*(F.col(k).alias(f"_all_{k}") for k in keys)).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    c = c.join(whole, same(keys, "_all_")) if keys else c.crossJoin(F.broadcast(whole))
    c = c.withColumn("tp", F.col("n_pos") - F.col("pos_upto") + F.col("pos")).withColumn("fp", F.col("n_neg") - F.col("neg_upto") + F.col("neg"))
    return c.select(*keys, F.col("s").alias("threshold"), F.try_divide("tp", "n_pos").alias("tpr"), F.try_divide("fp", "n_neg").alias("fpr"), "tp", "fp", F.try_divide("pos", "n_pos").alias("step"))


def average_precision(df: DataFrame, keys: Sequence[str], y: str, score: str) -> DataFrame:
    p = roc_points(df, keys, y, score)
    return p.withColumn("part", F.col("step") * F.col("tp") / (F.col("tp") + F.col("fp"))).groupBy(*keys).agg(F.sum("part").alias("ap"))


def youden(df: DataFrame, keys: Sequence[str], y: str, score: str) -> DataFrame:
    """(keys, threshold, j): the highest score with the largest TPR - FPR, within 0 to 1; 0.5 for one class alone."""
    p = roc_points(df, keys, y, score).withColumn("j", F.round(F.col("tpr") - F.col("fpr"), 12))
    best = p.groupBy(*keys).agg(F.max(F.struct("j", "threshold")).alias("m"), F.max("tp").alias("n_pos"), F.max("fp").alias("n_neg"))
    inside = F.least(F.greatest(F.when(F.col("m.j") > 0, F.col("m.threshold")).otherwise(F.lit(1.0)), F.lit(0.0)), F.lit(1.0))
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    return best.select(*keys, F.when(both, inside).otherwise(0.5).alias("threshold"), F.when(both, F.greatest("m.j", F.lit(0.0))).alias("j"))


def top_features(df: DataFrame, feature: str, importance: str, most: int, required: Sequence[str] = (), most_required: int | None = None) -> DataFrame:
    """(feature, importance, place, forced): at most `most` features by importance, ties by name.

    Features whose lower-case name holds one of the required texts come first, up to most_required (half of `most`) of them;
    the others fill what is left. forced marks those that importance alone would not have taken.
    """
    limit = max(1, most // 2) if most_required is None else most_required
    order = [F.col(importance).desc_nulls_last(), F.col(feature)]
    named = F.lit(False)
    for part in required:
        named = named | F.contains(F.lower(feature), F.lit(part.lower()))
    # of each kind only the best `most` can be taken, so the rank is over a bounded table
    kinds = df.select(feature, importance, F.coalesce(named, F.lit(False)).alias("_named"))
    best = kinds.filter("_named").orderBy(*order).limit(most).unionByName(kinds.filter("NOT _named").orderBy(*order).limit(most))
    one = Window.partitionBy(F.lit(0))
    ranked = best.withColumn("_alone", F.row_number().over(one.orderBy(*order))).withColumn("_k", F.row_number().over(Window.partitionBy("_named").orderBy(*order)))
    first = F.col("_named") & (F.col("_k") <= limit)
    placed = ranked.withColumn("place", F.row_number().over(one.orderBy((~first).cast("int"), *order))).filter(F.col("place") <= most)
    return placed.select(feature, importance, "place", (F.col("_alone") > most).alias("forced"))


def binary_counts(y: str, positive: Column) -> list[Column]:
    return [
        F.count_if((F.col(y) == 1) & positive).alias("tp"), F.count_if((F.col(y) == 0) & positive).alias("fp"),
        F.count_if((F.col(y) == 0) & ~positive).alias("tn"), F.count_if((F.col(y) == 1) & ~positive).alias("fn"),
    ]


def rates(counts: DataFrame) -> DataFrame:
    """counts with sensitivity, specificity, ppv, npv and accuracy."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return counts.withColumns({
        "sensitivity": tp / (tp + fn + EPS), "specificity": tn / (tn + fp + EPS), "ppv": tp / (tp + fp + EPS), "npv": tn / (tn + fn + EPS),
        "accuracy": (tp + tn) / (tp + fp + tn + fn + EPS),
    })


def discriminative(counts: DataFrame) -> DataFrame:
    """counts with weighted F1, balanced accuracy, Matthews' coefficient and Cohen's kappa; 0 where a margin is empty."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    n = tp + fp + tn + fn
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    f1, f0 = safe(2 * tp, 2 * tp + fp + fn), safe(2 * tn, 2 * tn + fp + fn)
    chance = ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (n * n)
    return counts.withColumns({
        "weighted_f1": ((tp + fn) * f1 + (tn + fp) * f0) / n, "balanced_accuracy": (safe(tp, tp + fn) + safe(tn, tn + fp)) / 2,
        "mcc": safe(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))), "kappa": safe((tp + tn) / n - chance, 1 - chance),
    })


def reliability(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """(bin, n, mean_p, rate, gap): bins closed on the right, the first on both sides."""
    at = F.greatest(F.ceil(F.col(p) * bins), F.lit(1)).cast("int")
    return df.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("rate")).withColumn("gap", F.abs(F.col("mean_p") - F.col("rate")))


def leave_one_out_auc(df: DataFrame, group: str, y: str, score: str) -> DataFrame:
    """(group, auc) without each group's rows, by algebra: all wins less those that touch the group.

    Wins of a group's positives over all negatives, of all positives over its negatives, less those within it; each from
    counts by distinct score, so no row is repeated for the groups it stays in.
    """
    by = df.filter(F.col(score).isNotNull()).groupBy(group, F.col(score).alias("s")).agg(F.count_if(F.col(y) == 1).alias("gp"), F.count_if(F.col(y) == 0).alias("gn"))
    by = written(by, "loo-counts")
    cuts = range_cuts(by, "s")[0]
    all_ = running(by.groupBy("s").agg(F.sum("gp").alias("p"), F.sum("gn").alias("n")), [], "s", {"p_upto": "p", "n_upto": "n"}, cuts)
    whole = all_.agg(F.sum("p").alias("all_p"))
    ranked = all_.crossJoin(F.broadcast(whole)).withColumn("neg_below", F.col("n_upto") - F.col("n") / 2).withColumn("pos_above", F.col("all_p") - F.col("p_upto") + F.col("p") / 2)
    own = running(by, [group], "s", {"gn_upto": "gn"}, cuts).withColumn("own_below", F.col("gn_upto") - F.col("gn") / 2)
    joined = own.join(ranked.select("s", "neg_below", "pos_above"), "s")
    touch = joined.groupBy(group).agg(F.sum(F.col("gp") * F.col("neg_below") + F.col("gn") * F.col("pos_above") - F.col("gp") * F.col("own_below")).alias("u_g"), F.sum("gp").alias("gp"), F.sum("gn").alias("gn"))
    total = ranked.agg(F.sum(F.col("p") * F.col("neg_below")).alias("u"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    m, n = F.col("p") - F.col("gp"), F.col("n") - F.col("gn")
    return touch.crossJoin(F.broadcast(total)).select(group, F.when((m > 0) & (n > 0), (F.col("u") - F.col("u_g")) / (m * n)).alias("auc"))


def benjamini_hochberg(df: DataFrame, p: str, into: str) -> DataFrame:
    """q-values of a table of tests; null p stays null. Ranks and minima go over distinct p by ranges, so tests may be many.

    The tests are written first: sums of doubles need not come out alike twice, and p is joined with itself.
    """
    df = written(df, "tests")
    known, none = df.filter(F.col(p).isNotNull()), df.filter(F.col(p).isNull()).withColumn(into, F.lit(None).cast("double"))
    counts = written(known.groupBy(F.col(p).alias("_p")).agg(F.count("*").alias("_n")), "test-counts")
    cuts, n = range_cuts(counts, "_p")[0], F.broadcast(counts.agg(F.sum("_n").alias("_all")))
    ranked = running(counts, [], "_p", {"_k": "_n"}, cuts).crossJoin(n).withColumn("_q", F.col("_p") * F.col("_all") / F.col("_k"))
    least = running(ranked, [], "_p", {"_least": "_q"}, cuts, least=True, backward=True).select("_p", F.least("_least", F.lit(1.0)).alias(into))
    return known.join(least, F.col(p) == F.col("_p")).drop("_p").unionByName(none)


def holm(df: DataFrame, p: str, into: str) -> DataFrame:
    """Holm's adjusted p-values; tests of equal p get the same value. Null p stays null."""
    df = written(df, "tests")
    known, none = df.filter(F.col(p).isNotNull()), df.filter(F.col(p).isNull()).withColumn(into, F.lit(None).cast("double"))
    counts = written(known.groupBy(F.col(p).alias("_p")).agg(F.count("*").alias("_n")), "test-counts")
    cuts, n = range_cuts(counts, "_p")[0], F.broadcast(counts.agg(F.sum("_n").alias("_all")))
    # of equal p the first has the largest factor, and the maximum carries it to the others
    ranked = running(counts, [], "_p", {"_k": "_n"}, cuts).crossJoin(n).withColumn("_h", -(F.col("_all") - (F.col("_k") - F.col("_n"))) * F.col("_p"))
    most = running(ranked, [], "_p", {"_least": "_h"}, cuts, least=True).select("_p", F.least(-F.col("_least"), F.lit(1.0)).alias(into))
    return known.join(most, F.col(p) == F.col("_p")).drop("_p").unionByName(none)
