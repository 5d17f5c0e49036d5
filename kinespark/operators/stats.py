"""Statistical tests, resampling and group-safe splits over out-of-fold tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinespark.functions.hashes import unit
from kinespark.functions.mathx import normal_two_sided
from kinespark.functions.ranges import range_cuts, running, same
from kinespark.functions.steps import written
from kinespark.operators.metrics import mid_ranks


def placements(df: DataFrame, y: str, scores: Sequence[str]) -> DataFrame:
    """(y, n, scores): rows counted by their values, each score replaced by its placement among the other class.

    A positive's placement is the share of negatives below it, a negative's the share of positives above it, ties half. Rows
    without one of the scores or the label go.
    """
    names = list(scores)
    whole = df.select(F.col(y).cast("int").alias("y"), *names).dropna()
    rows = written(whole.groupBy("y", *names).agg(F.count("*").alias("n")), "score-rows")
    sizes = F.broadcast(rows.agg(F.sum(F.when(F.col("y") == 1, F.col("n"))).alias("_m"), F.sum(F.when(F.col("y") == 0, F.col("n"))).alias("_k")))
    placed = rows
    for s, cuts in zip(names, range_cuts(rows, *names), strict=True):
        counts = rows.groupBy(F.col(s).alias("_s")).agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("_pos"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("_neg"))
        upto = running(counts, [], "_s", {"_pos_upto": "_pos", "_neg_upto": "_neg"}, cuts).crossJoin(sizes)
        share = upto.select("_s", ((F.col("_neg_upto") - F.col("_neg") / 2) / F.col("_k")).alias("_below"), (1 - (F.col("_pos_upto") - F.col("_pos") / 2) / F.col("_m")).alias("_above"))
        placed = placed.join(share, F.col(s) == F.col("_s")).withColumn(f"_v_{s}", F.when(F.col("y") == 1, F.col("_below")).otherwise(F.col("_above"))).drop("_s", "_below", "_above")
    return placed.select("y", "n", *(F.col(f"_v_{s}").alias(s) for s in names))


def delong_pairs(df: DataFrame, y: str, scores: Sequence[str]) -> DataFrame:
    """(model_a, model_b, auc_a, auc_b, z, p) of DeLong's test for every pair of scores on the same rows, in one pass."""
    v = placements(df, y, scores)
    pairs = [(a, b) for k, a in enumerate(scores) for b in scores[k + 1 :]]
    n = {c: F.when(F.col("y") == c, F.col("n")).otherwise(0) for c in (0, 1)}
    sums = [F.sum(n[c]).alias(f"n{c}") for c in n] + [F.sum(n[1] * F.col(s)).alias(f"s{k}") for k, s in enumerate(scores)]
    for k, (a, b) in enumerate(pairs):
        d = F.col(a) - F.col(b)
        sums += [f(n[c] * x).alias(f"{name}{c}_{k}") for c in n for f, x, name in ((F.sum, d, "d"), (F.sum, d * d, "dd"))]
    spread = lambda c, k: (F.col(f"dd{c}_{k}") - F.col(f"d{c}_{k}") * F.col(f"d{c}_{k}") / F.col(f"n{c}")) / (F.col(f"n{c}") - 1) / F.col(f"n{c}")
    rows = []
    for k, (a, b) in enumerate(pairs):
        auc = [(F.col(f"s{scores.index(s)}") / F.col("n1")) for s in (a, b)]
        both = (F.col("n1") > 1) & (F.col("n0") > 1)
        rows.append(F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), auc[0].alias("auc_a"), auc[1].alias("auc_b"), F.when(both, spread(0, k) + spread(1, k)).alias("var")))
    out = v.agg(*sums).select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    z = F.when(F.col("var") > 1e-18, (F.col("auc_a") - F.col("auc_b")) / F.sqrt("var"))
    return out.select("model_a", "model_b", "auc_a", "auc_b", z.alias("z"), normal_two_sided(z).alias("p"))


def delong(df: DataFrame, y: str, a: str, b: str) -> DataFrame:
    """One row (auc_a, auc_b, z, p): DeLong's test of two scores on the same rows."""
    return delong_pairs(df, y, [a, b]).select("auc_a", "auc_b", "z", "p")


def replicate_weight(group: Column, replicate: Column, seed: int) -> Column:
    """Poisson(1) resampling weight of a group in a replicate, from a hash: the same in every run and partitioning."""
    u = unit(group, replicate, seed=seed)
    bounds, p, total = [], 0.36787944117144233, 0.0
    for k in range(1, 9):
        total += p
        bounds.append(total)
        p /= k
    return sum((F.when(u >= b, 1).otherwise(0) for b in bounds), F.lit(0))


def bootstrap_auc(df: DataFrame, group: str, y: str, scores: Sequence[str], replicates: int, seed: int = 42) -> DataFrame:
    """(replicate, score, auc) with groups (subjects) resampled. Rows are counted by (group, score) before they are repeated."""
    long = df.unpivot([group, y], list(scores), "score", "s").groupBy(group, "score", "s").agg(F.count_if(F.col(y) == 1).alias("p"), F.count_if(F.col(y) == 0).alias("n"))
    weights = long.select(F.col(group).alias("_g")).distinct().withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("w", replicate_weight(F.col("_g"), F.col("replicate"), seed)).filter("w > 0")
    drawn = long.join(weights, F.col(group).eqNullSafe(F.col("_g")))
    c = drawn.groupBy("replicate", "score", "s").agg(F.sum(F.col("w") * F.col("p")).alias("p"), F.sum(F.col("w") * F.col("n")).alias("n"))
    w = Window.partitionBy("replicate", "score").orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    u = c.withColumn("below", F.sum("n").over(w) - F.col("n") / 2).groupBy("replicate", "score").agg(F.sum(F.col("p") * F.col("below")).alias("u"), F.sum("p").alias("m"), F.sum("n").alias("k"))
    return u.filter("m > 0 and k > 0").select("replicate", "score", (F.col("u") / (F.col("m") * F.col("k"))).alias("auc"))


def mcnemar(df: DataFrame, keys: Sequence[str], right_a: Column, right_b: Column) -> DataFrame:
    """(keys, only_a, only_b, p): exact binomial up to 25 discordant rows, else chi-square with continuity correction."""
    c = df.groupBy(*keys).agg(F.count_if(right_a & ~right_b).alias("only_a"), F.count_if(~right_a & right_b).alias("only_b"))
    n, k = F.col("only_a") + F.col("only_b"), F.least("only_a", "only_b")
    log_choose = lambda i: F.aggregate(F.sequence(F.lit(1), i), F.lit(0.0), lambda s, j: s + F.log((n - i + j).cast("double")) - F.log(j.cast("double")))
    tail = F.aggregate(F.sequence(F.lit(0), k.cast("int")), F.lit(0.0), lambda s, i: s + F.when(i == 0, F.pow(F.lit(0.5), n.cast("double"))).otherwise(F.exp(log_choose(i) + n * F.log(F.lit(0.5)))))
    exact = F.least(2 * tail, F.lit(1.0))
    stat = F.pow(F.greatest(F.abs(F.col("only_a") - F.col("only_b")) - 1, F.lit(0)), F.lit(2)) / n
    return c.withColumn("p", F.when(n == 0, 1.0).when(n <= 25, exact).otherwise(normal_two_sided(F.sqrt(stat))))


def kruskal(df: DataFrame, group: str, value: str) -> DataFrame:
    """One row (groups, n, h): Kruskal-Wallis with the correction for ties."""
    cells = written(df.filter(F.col(value).isNotNull()).groupBy(group, F.col(value).alias("_v")).agg(F.count("*").alias("_c")), "rank-counts")
    counts = cells.groupBy("_v").agg(F.sum("_c").alias("t"))
    ranks = running(counts, [], "_v", {"_upto": "t"}, range_cuts(cells, "_v")[0]).select(F.col("_v").alias("_w"), (F.col("_upto") - (F.col("t") - 1) / 2).alias("rank"))
    by = cells.join(ranks, F.col("_v") == F.col("_w")).groupBy(group).agg(F.sum(F.col("_c") * F.col("rank")).alias("r"), F.sum("_c").alias("n"))
    ties = counts.agg(F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("ties"))
    s = by.agg(F.count("*").alias("groups"), F.sum("n").alias("n"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s")).crossJoin(F.broadcast(ties))
    n = F.col("n").cast("double")
    h = F.try_divide(12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1), 1 - F.try_divide("ties", n * n * n - n))
    return s.select("groups", "n", h.alias("h"))


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str, least: int = 3) -> DataFrame:
    """(keys, n, rho): null for fewer than `least` rows or a constant side."""
    cuts = range_cuts(df, x, y)
    r = mid_ranks(mid_ranks(df, keys, x, "_rx", cuts[0]), keys, y, "_ry", cuts[1])
    c = r.groupBy(*keys).agg(F.count("*").alias("n"), F.corr("_rx", "_ry").alias("rho"))
    return c.withColumn("rho", F.when((F.col("n") >= least) & ~F.isnan("rho"), F.col("rho")))


def signed_rank(df: DataFrame, difference: Column) -> DataFrame:
    """One row (n, w): Wilcoxon's smaller signed-rank sum, zeros dropped, ties at mid-ranks."""
    d = df.select(difference.alias("d")).filter("d <> 0").withColumn("m", F.abs("d"))
    r = mid_ranks(d, [], "m", "rank")
    return r.agg(F.count("*").alias("n"), F.least(F.sum(F.when(F.col("d") > 0, F.col("rank")).otherwise(0.0)), F.sum(F.when(F.col("d") < 0, F.col("rank")).otherwise(0.0))).alias("w"))


def rank_sum(df: DataFrame, first: Column, value: str) -> DataFrame:
    """One row (n_a, n_b, u, z, p): Mann-Whitney's U of the rows where first is true against the others, normal with the
    correction for ties and continuity. Null where one side is empty or all values are equal."""
    counts = df.select(first.alias("_a"), F.col(value).alias("_v")).filter("_a IS NOT NULL AND _v IS NOT NULL").groupBy("_v").agg(F.count_if("_a").alias("a"), F.count_if(~F.col("_a")).alias("b"))
    upto = running(counts, [], "_v", {"below": "b"})
    t = (F.col("a") + F.col("b")).cast("double")
    s = upto.agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"), F.sum(F.col("a") * (F.col("below") - F.col("b") / 2)).alias("u"), F.sum(t * t * t - t).alias("ties"))
    n = (F.col("n_a") + F.col("n_b")).cast("double")
    variance = F.try_divide(F.col("n_a") * F.col("n_b"), F.lit(12)) * (n + 1 - F.try_divide("ties", n * (n - 1)))
    off = F.col("u") - F.col("n_a") * F.col("n_b") / 2
    z = F.when(variance > 0, F.signum(off) * F.greatest(F.abs(off) - 0.5, F.lit(0.0)) / F.sqrt(variance))
    return s.select("n_a", "n_b", "u", z.alias("z"), normal_two_sided(z).alias("p"))


def friedman(df: DataFrame, block: str, treatment: str, value: str) -> DataFrame:
    """One row (blocks, treatments, chi2) over complete blocks, with the correction for ties."""
    r = mid_ranks(df, [block], value, "rank", [])  # a block has a row a treatment
    sums = r.groupBy(treatment).agg(F.sum("rank").alias("r"), F.count("*").alias("n")).agg(F.count("*").alias("k"), F.max("n").alias("n"), F.sum(F.col("r") * F.col("r")).alias("rr"))
    ties = r.groupBy(block, value).agg(F.count("*").alias("t")).agg(F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("ties"))
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    chi = F.try_divide(12 / (n * k * (k + 1)) * F.col("rr") - 3 * n * (k + 1), 1 - F.try_divide("ties", n * (k * k * k - k)))
    return sums.crossJoin(F.broadcast(ties)).select(F.col("n").alias("blocks"), F.col("k").alias("treatments"), chi.alias("chi2"))


def conformal_threshold(df: DataFrame, keys: Sequence[str], score: Column, alpha: float) -> DataFrame:
    """(keys, n, q_hat): the ceil((n + 1)(1 - alpha)) / n quantile of nonconformity, the higher of two values."""
    counts = running(df.select(*keys, score.alias("_s")).filter("_s IS NOT NULL").groupBy(*keys, "_s").agg(F.count("*").alias("_c")), keys, "_s", {"_upto": "_c"})
    n = counts.groupBy(*(F.col(k).alias(f"_of_{k}") for k in keys)).agg(F.sum("_c").alias("_n"))
    level = F.least(F.ceil((F.col("_n") + 1) * (1 - alpha)) / F.col("_n"), F.lit(1.0))
    at = F.ceil(F.round(level * (F.col("_n") - 1), 9)) + 1
    return counts.join(n, same(keys, "_of_")).filter(F.col("_upto") >= at).groupBy(*keys, F.col("_n").alias("n")).agg(F.min("_s").alias("q_hat"))


def subject_holdout(people: DataFrame, ident: str, healthy: Column, seed: int = 42, train: float = 0.7, val: float = 0.15) -> DataFrame:
    """(ident, role): healthy people 70 / 15 / 15 by a hash of the id, all others to the test set."""
    u = unit(ident, seed=seed)
    return people.select(ident, F.when(~healthy, "test").when(u < train, "train").when(u < train + val, "val").otherwise("test").alias("role"))


def group_folds(df: DataFrame, group: str, label: str, k: int, seed: int = 42) -> DataFrame:
    """(group, fold): groups dealt to k folds within their most common label, in hash order."""
    major = df.groupBy(group).agg(F.mode(label, True).alias("_label"))
    return major.withColumn("fold", (F.row_number().over(Window.partitionBy("_label").orderBy(unit(group, seed=seed), group)) - 1) % k).drop("_label")


def stratified_split(people: DataFrame, ident: str, label: str, share: float, seed: int) -> DataFrame:
    """(ident, role): of each label's people a share, one at least, to validation, in hash order."""
    w = Window.partitionBy(label)
    k = F.row_number().over(w.orderBy(unit(ident, seed=seed), ident))
    return people.withColumn("_k", k).withColumn("_n", F.count("*").over(w)).select(ident, F.when(F.col("_k") <= F.greatest(F.lit(1), F.bround(F.col("_n") * share)), "val").otherwise("train").alias("role"))


def subsets(parts: Sequence[str]) -> list[tuple[str, ...]]:
    """All non-empty subsets, in the order of their bits."""
    return [tuple(p for k, p in enumerate(parts) if mask >> k & 1) for mask in range(1, 1 << len(parts))]


def proportional_sample(people: DataFrame, ident: str, cohort: str, total: int, seed: int = 42) -> DataFrame:
    """People by cohort in proportion, at least one of each, largest remainders first, in hash order."""
    whole = Window.partitionBy()
    n = people.groupBy(cohort).agg(F.count("*").alias("n")).withColumn("exact", F.col("n") * total / F.sum("n").over(whole))
    n = n.withColumn("base", F.greatest(F.floor("exact"), F.lit(1)))
    n = n.withColumn("extra", (F.row_number().over(Window.orderBy(F.desc(F.col("exact") - F.floor("exact")), cohort)) <= total - F.sum("base").over(whole)).cast("int"))
    k = F.row_number().over(Window.partitionBy(cohort).orderBy(unit(ident, seed=seed), ident))
    return people.join(F.broadcast(n.select(cohort, (F.col("base") + F.col("extra")).alias("take"))), cohort).withColumn("_k", k).filter("_k <= take").select(ident, cohort)
