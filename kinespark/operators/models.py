"""Votes and outlier factors of nearest neighbours, isolation forests, centroids and resampling over vector columns."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinespark.functions.hashes import unit
from kinespark.operators.metrics import auc
from kinespark.operators.neighbours import neighbours

def knn_vote(near: DataFrame, labels: DataFrame, ident: str, label: str) -> DataFrame:
    """(query, label): the label with the largest sum of 1 / distance, the smallest on ties."""
    votes = near.join(labels.select(F.col(ident).alias("neighbour"), F.col(label).alias("l")), "neighbour").groupBy("query", "l").agg(F.round(F.sum(1 / (F.col("distance") + 1e-12)), 9).alias("w"))
    return votes.groupBy("query").agg(F.max_by("l", F.struct("w", -F.col("l"))).alias("label"))


def local_outlier_factor(near: DataFrame) -> DataFrame:
    """(id, lof) from the k nearest neighbours of all rows: how much sparser a row lies than its neighbours."""
    reach = near.groupBy(F.col("query").alias("neighbour")).agg(F.max("distance").alias("k_distance"))
    density = near.join(reach, "neighbour").groupBy("query").agg((1 / (F.avg(F.greatest("distance", "k_distance")) + 1e-10)).alias("lrd"))
    other = density.select(F.col("query").alias("neighbour"), F.col("lrd").alias("their"))
    return near.join(other, "neighbour").groupBy("query").agg(F.avg("their").alias("their")).join(density, "query").select(F.col("query").alias("id"), (F.col("their") / F.col("lrd")).alias("lof"))


def isolation_scores(fit: DataFrame, rows: DataFrame, ident: str, vector: str, trees: int = 100, sample: int = 256, seed: int = 42) -> DataFrame:
    """(id, score): higher for rows that random splits of bounded hashed samples isolate early."""
    share = F.lit(min(1.0, 1.2 * sample / max(1, fit.count())) * (1 << 30))
    # a row is repeated for the trees that draw it alone
    takes = F.filter(F.sequence(F.lit(1), F.lit(trees)), lambda t: F.pmod(F.xxhash64(F.col(ident), t, F.lit(seed)), F.lit(1 << 30)) < share)
    drawn = fit.select(F.explode(takes).alias("tree"), F.col(ident).alias("id"), F.col(vector).alias("v"))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng(seed + int(pdf["tree"].iloc[0]))
        x = np.stack(pdf.sort_values("id")["v"].to_numpy()[:sample]).astype(float)
        nodes: list[tuple] = []

        def build(part: np.ndarray, depth: int) -> int:
            at = len(nodes)
            nodes.append(None)
            low, high = part.min(0), part.max(0)
            wide = np.flatnonzero(high > low)
            if depth >= 8 or len(part) <= 1 or not len(wide):
                nodes[at] = (at, -1, 0.0, -1, -1, depth + path_length(len(part)))
                return at
            f = int(rng.choice(wide))
            cut = float(rng.uniform(low[f], high[f]))
            left = build(part[part[:, f] < cut], depth + 1)
            nodes[at] = (at, f, cut, left, build(part[part[:, f] >= cut], depth + 1), 0.0)
            return at

        build(x, 0)
        return pd.DataFrame(nodes, columns=["node", "feature", "cut", "left", "right", "depth"]).assign(tree=int(pdf["tree"].iloc[0]), n=len(x))

    # trees of at most 2 * sample nodes each: a table of bounded size
    forest = drawn.groupBy("tree").applyInPandas(grow, "node int, feature int, cut double, left int, right int, depth double, tree int, n long").toPandas()
    send = rows.sparkSession.sparkContext.broadcast([t.sort_values("node") for _, t in forest.groupby("tree")])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x, total = np.stack(pdf["v"].to_numpy()).astype(float), np.zeros(len(pdf))
            for t in send.value:
                f, cut, left, right, depth = (t[c].to_numpy() for c in ("feature", "cut", "left", "right", "depth"))
                at = np.zeros(len(x), int)
                while (inner := f[at] >= 0).any():
                    go = x[np.arange(len(x)), np.maximum(f[at], 0)] < cut[at]
                    at = np.where(inner, np.where(go, left[at], right[at]), at)
                total += depth[at]
            yield pd.DataFrame({"id": pdf["id"], "score": 2 ** (-total / len(send.value) / path_length(min(sample, int(send.value[0]["n"].iloc[0]))))})

    return rows.select(F.col(ident).alias("id"), F.col(vector).alias("v")).mapInPandas(score, "id long, score double")


def path_length(n: int) -> float:
    """Mean depth of an unsuccessful search in a random tree of n."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def without_fold(df: DataFrame, vector: str, fold: str, by: Sequence[str], rows: Column | None = None) -> DataFrame:
    """(fold, by, mean, sd): each dimension's mean and deviation over the rows of the other folds, as arrays.

    Sums by fold are made once; a fold's own are taken off the whole. A row a fold and class, so it is a bounded table.
    """
    used = df if rows is None else df.filter(rows)
    long = used.select(fold, *by, F.posexplode(F.col(vector).cast("array<double>")).alias("_d", "_v"))
    sums = long.groupBy(fold, *by, "_d").agg(F.count("*").alias("_n"), F.sum("_v").alias("_s"), F.sum(F.col("_v") ** 2).alias("_q"))
    whole = sums.groupBy(*by, "_d").agg(*(F.sum(c).alias(f"_all{c}") for c in ("_n", "_s", "_q")))
    folds = df.select(fold).distinct()
    each = whole.crossJoin(F.broadcast(folds)).join(sums, [fold, *by, "_d"], "left")
    n, s, q = (F.col(f"_all{c}") - F.coalesce(c, F.lit(0)) for c in ("_n", "_s", "_q"))
    each = each.select(fold, *by, "_d", (s / n).alias("_m"), F.sqrt(F.greatest(q / n - (s / n) ** 2, F.lit(0.0))).alias("_sd"))
    pack = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("_d", c))), lambda x: x[c])
    return each.groupBy(fold, *by).agg(pack("_m").alias("mean"), pack("_sd").alias("sd"))


def squared_distance(a: Column, b: Column, dims: tuple[int, int] | None = None) -> Column:
    """Over the dimensions from the first to before the second, or all."""
    part = (lambda x: x) if dims is None else (lambda x: F.slice(x, dims[0] + 1, dims[1] - dims[0]))
    return F.aggregate(F.zip_with(part(a), part(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def centroid_scores(df: DataFrame, ident: str, vector: str, y: str, fold: str, parts: Mapping[str, tuple[int, int] | None]) -> DataFrame:
    """(ident, y, fold, part, score): out-of-fold scores of a nearest-centroid model on each part of the dimensions.

    The score is the distance to the others' centroid over the sum of both distances.
    """
    centres = without_fold(df, vector, fold, [y])
    pair = centres.groupBy(fold).agg(*(F.first(F.when(F.col(y) == k, F.col("mean")), True).alias(f"_c{k}") for k in (0, 1)))
    v = F.col(vector).cast("array<double>")
    x = df.select(ident, y, fold, v.alias("_v")).join(F.broadcast(pair), fold)
    scores = [F.struct(F.lit(name).alias("part"), F.sqrt(squared_distance(F.col("_v"), F.col("_c0"), dims)).alias("far"), F.sqrt(squared_distance(F.col("_v"), F.col("_c1"), dims)).alias("near")) for name, dims in parts.items()]
    x = x.select(ident, y, fold, F.explode(F.array(*scores)).alias("_s"))
    return x.select(ident, y, fold, "_s.part", (F.col("_s.far") / (F.col("_s.far") + F.col("_s.near"))).alias("score"))


def anomaly_folds(df: DataFrame, ident: str, vector: str, y: str, fold: str, share: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """Scores (ident, y, fold, score, flagged) of held-out rows, and thresholds (fold, threshold), of a normal range fitted on healthy rows.

    A score is the root mean square of the dimensions in deviations of the healthy rows of the other folds; a fold's threshold
    is a percentile of those rows' own scores.
    """
    centres = without_fold(df, vector, fold, [], F.col(y) == 0)
    score = F.sqrt(F.aggregate(F.zip_with(F.zip_with("_v", "mean", lambda a, b: a - b), "sd", lambda d, s: (d / (s + 1e-8)) * (d / (s + 1e-8))), F.lit(0.0), lambda t, z: t + z) / F.size("_v"))
    x = df.select(ident, y, fold, F.col(vector).cast("array<double>").alias("_v"))
    own = x.join(F.broadcast(centres), fold).select(ident, y, fold, score.alias("score"))
    others = x.filter(F.col(y) == 0).withColumnRenamed(fold, "_own").join(F.broadcast(centres), F.col(fold) != F.col("_own"))
    cuts = others.select(fold, score.alias("score")).groupBy(fold).agg(F.percentile("score", share).alias("threshold"))
    return own.join(F.broadcast(cuts), fold).select(ident, y, fold, "score", (F.col("score") >= F.col("threshold")).alias("flagged")), cuts


def shuffled_part(df: DataFrame, ident: str, vector: str, parts: Mapping[str, tuple[int, int]], buckets: int = 16, seed: int = 42) -> DataFrame:
    """df once for each part, with that part of the vector taken from another row: the next in hash order in its bucket, the last from the first."""
    u = unit(ident, seed=seed)
    w = Window.partitionBy("_bucket").orderBy("_u", ident)
    x = df.withColumn("_u", u).withColumn("_bucket", F.floor(F.col("_u") * 1e6) % buckets)
    x = x.withColumn("_other", F.coalesce(F.lead(vector).over(w), F.first(vector).over(Window.partitionBy("_bucket").orderBy("_u", ident).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    size = F.size(vector)
    mixed = [F.struct(F.lit(name).alias("shuffled"), F.concat(F.slice(vector, 1, a), F.slice("_other", a + 1, b - a), F.slice(F.col(vector), F.lit(b + 1), F.greatest(size - b, F.lit(0)))).alias("v")) for name, (a, b) in parts.items()]
    return x.withColumn("_m", F.explode(F.array(*mixed))).select(*(c for c in df.columns if c != vector), F.col("_m.shuffled").alias("shuffled"), F.col("_m.v").alias(vector))


def part_importance(df: DataFrame, ident: str, vector: str, y: str, fold: str, parts: Mapping[str, tuple[int, int]], of: tuple[int, int] | None = None) -> DataFrame:
    """(shuffled, importance): how much the out-of-fold AUC falls when a part of the vector is shuffled. Centroids stay those of the true rows."""
    centres = without_fold(df, vector, fold, [y]).groupBy(fold).agg(*(F.first(F.when(F.col(y) == k, F.col("mean")), True).alias(f"_c{k}") for k in (0, 1)))

    def scored(rows: DataFrame) -> DataFrame:
        v = F.col(vector).cast("array<double>")
        far, near = (F.sqrt(squared_distance(v, F.col(f"_c{k}"), of)) for k in (0, 1))
        return rows.join(F.broadcast(centres), fold).withColumn("score", far / (far + near))

    base = auc(scored(df), [], y, "score").select(F.col("auc").alias("_base"))
    each = auc(scored(shuffled_part(df, ident, vector, parts)), ["shuffled"], y, "score")
    return each.crossJoin(F.broadcast(base)).select("shuffled", (F.col("_base") - F.col("auc")).alias("importance"))


def eliminate(df: DataFrame, ident: str, vector: str, y: str, fold: str, parts: Mapping[str, tuple[int, int]], keep: int) -> list[str]:
    """The parts that stay when the least important is dropped, round by round, until `keep` are left; its dimensions become 0."""
    left, rows = dict(parts), df
    while len(left) > keep:
        ranks = part_importance(rows, ident, vector, y, fold, left).collect()  # a row a part
        worst = min(ranks, key=lambda r: (round(r.importance, 9), r.shuffled)).shuffled
        rows = rows.withColumn(vector, blanked(F.col(vector), left.pop(worst)))
    return sorted(left)


def blanked(vector: Column, part: tuple[int, int]) -> Column:
    """The vector with a part of its dimensions 0."""
    return F.transform(vector, lambda x, k: F.when((k >= part[0]) & (k < part[1]), x * 0).otherwise(x))


def oversampled(df: DataFrame, ident: str, vector: str, k: int = 5, seed: int = 42) -> DataFrame:
    """(ident, neighbour, weight, vector): a new row for each row, part of the way to one of its k nearest rows, by hash."""
    pick = F.floor(unit(F.col("query"), seed=seed) * k).cast("int") + 1
    near = neighbours(df, df, ident, vector, k).filter(F.col("rank") == pick)
    a = df.select(F.col(ident).alias("query"), F.col(vector).cast("array<double>").alias("_a"))
    b = df.select(F.col(ident).alias("neighbour"), F.col(vector).cast("array<double>").alias("_b"))
    x = near.join(a, "query").join(b, "neighbour").withColumn("weight", unit(F.col("query"), F.lit("w"), seed=seed))
    return x.select(F.col("query").alias(ident), "neighbour", "weight", F.zip_with("_a", "_b", lambda p, q: p + F.col("weight") * (q - p)).alias(vector))


def held_out_lines(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """df with predicted: the value of the line through the rows of all other groups, by sums less the group's own."""
    sums = [("n", F.lit(1)), ("sx", F.col(x)), ("sy", F.col(y)), ("sxx", F.col(x) ** 2), ("sxy", F.col(x) * F.col(y))]
    g = df.groupBy(group).agg(*(F.sum(c).alias(f"_{n}") for n, c in sums))
    whole = g.agg(*(F.sum(f"_{n}").alias(f"_all_{n}") for n, _ in sums))
    rest = {n: F.col(f"_all_{n}") - F.col(f"_{n}") for n, _ in sums}
    slope = (rest["n"] * rest["sxy"] - rest["sx"] * rest["sy"]) / (rest["n"] * rest["sxx"] - rest["sx"] ** 2)
    lines = g.crossJoin(F.broadcast(whole)).select(group, slope.alias("_slope"), ((rest["sy"] - slope * rest["sx"]) / rest["n"]).alias("_level"))
    return df.join(lines, group).withColumn("predicted", F.col("_level") + F.col("_slope") * F.col(x)).drop("_slope", "_level")


def protocol_scores(df: DataFrame, ident: str, group: str, vector: str, y: str, folds: int, seeds: Sequence[int]) -> DataFrame:
    """(protocol, seed, ident, y, score): out-of-fold scores where groups stay in one fold ("grouped"), and where rows are dealt one by one ("ungrouped").

    Folds come from hashes of the group or the row with the seed.
    """
    out = None
    for seed in seeds:
        for protocol, by in (("grouped", group), ("ungrouped", ident)):
            dealt = df.withColumn("fold", F.floor(unit(by, F.lit(seed)) * folds).cast("int"))
            part = centroid_scores(dealt, ident, vector, y, "fold", {"all": None}).select(F.lit(protocol).alias("protocol"), F.lit(seed).alias("seed"), ident, y, "score")
            out = part if out is None else out.unionByName(part)
    return out


def protocol_gaps(scores: DataFrame, y: str) -> DataFrame:
    """(n_seeds, grouped, grouped_sd, ungrouped, ungrouped_sd, delta, inflation_pct): AUCs of both protocols over the seeds."""
    a = auc(scores, ["protocol", "seed"], y, "score")
    mean = lambda p: F.avg(F.when(F.col("protocol") == p, F.col("auc")))
    sd = lambda p: F.stddev_samp(F.when(F.col("protocol") == p, F.col("auc")))
    g = a.agg(F.count_distinct("seed").alias("n_seeds"), mean("grouped").alias("grouped"), sd("grouped").alias("grouped_sd"), mean("ungrouped").alias("ungrouped"), sd("ungrouped").alias("ungrouped_sd"))
    delta = F.col("ungrouped") - F.col("grouped")
    return g.withColumns({"delta": delta, "inflation_pct": 100 * F.try_divide(delta, F.col("grouped"))})
