"""Leave-one-group-out scores of a class-weighted ridge logistic model, all folds in one pass of the rows an iteration.

A fold is the rows of all groups but one. What it is fitted with comes from sums: medians for missing values, means, scales,
class weights and second moments of a fold are those of all rows less the held-out group's, so no row is repeated for the
folds it trains. Medians are order statistics at ranks moved by the group's own values. The second moments bound the curvature
of every fold's loss; with them as a metric, accelerated gradient steps need each fold's gradient alone, and one product of
matrices gives those of all folds for a batch of rows.

Folds are fitted FOLDS at a time; what the driver holds is the coefficients and metrics of so many folds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinespark.functions.ranges import range_cuts, running, same
from kinespark.functions.steps import written

FOLDS, PARTS = 128, 64


def missing_as_zero(batch: pa.RecordBatch) -> np.ndarray:
    """Rows of features and of their missing marks side by side."""
    values = batch.column("x")
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(values), -1)
    gone = ~np.isfinite(flat)
    return np.concatenate([np.where(gone, 0.0, flat), gone], 1)


def held_out_medians(rows: DataFrame) -> DataFrame:
    """(g, k, median) of every feature k over the rows of all groups but g; null where none of them has a value."""
    long = rows.select("g", F.posexplode("x").alias("k", "v")).filter("v IS NOT NULL AND NOT isnan(v)")
    own = written(long.groupBy("g", "k", "v").agg(F.count("*").alias("n")), "median-counts")
    cuts = range_cuts(own, "v")[0]
    every = written(running(own.groupBy("k", "v").agg(F.sum("n").alias("all")), ["k"], "v", {"upto": "all"}, cuts), "median-ranks")
    whole = every.groupBy(F.col("k").alias("_w_k")).agg(F.sum("all").alias("whole"))
    # a group's values in order, each with how many rows of all and of the group lie below it
    mine = running(own, ["g", "k"], "v", {"mine": "n"}, cuts).join(every.withColumnsRenamed({"k": "_e_k", "v": "_e_v"}), (F.col("k") == F.col("_e_k")) & (F.col("v") == F.col("_e_v")))
    mine = written(mine.select("g", "k", (F.col("upto") - F.col("all")).alias("below"), (F.col("mine") - F.col("n")).alias("own_below"), "n"), "median-own")
    groups = rows.select("g").distinct()
    sizes = groups.crossJoin(F.broadcast(whole.withColumnRenamed("_w_k", "k"))).join(mine.groupBy(F.col("g").alias("_s_g"), F.col("k").alias("_s_k")).agg(F.sum("n").alias("size")), F.col("g").eqNullSafe(F.col("_s_g")) & (F.col("k") == F.col("_s_k")), "left")
    sizes = sizes.select("g", "k", F.coalesce("size", F.lit(0)).alias("size"), (F.col("whole") - F.coalesce("size", F.lit(0))).alias("rest"))
    middle = F.explode(F.array_distinct(F.array(F.floor((F.col("rest") + 1) / 2), F.ceil((F.col("rest") + 1) / 2))))
    wanted = sizes.filter("rest > 0").withColumn("r", middle)
    # the first of the group's values that has r rows of others below it ends the stretch that holds the r-th of the others
    first = wanted.join(mine.withColumnsRenamed({"g": "_m_g", "k": "_m_k"}), same(["g", "k"], "_m_"), "left").groupBy("g", "k", "r", "size").agg(F.min(F.when(F.col("below") - F.col("own_below") >= F.col("r"), F.col("own_below"))).alias("passed"))
    asked = first.select("g", "k", (F.col("r") + F.coalesce("passed", "size") - 0.5).alias("at"))
    ranked = every.select(F.lit(None).cast(rows.schema["g"].dataType).alias("g"), "k", F.col("upto").cast("double").alias("at"), "v", F.lit(False).alias("ask"))
    ranked = ranked.unionByName(asked.withColumn("v", F.lit(None).cast("double")).withColumn("ask", F.lit(True)))
    return running(ranked, ["k"], "at", {"found": "v"}, least=True, backward=True).filter("ask").groupBy("g", "k").agg(F.avg("found").alias("median"))


def moments(rows: DataFrame) -> DataFrame:
    """(g, y, n, s, u): rows, sums and second moments of features and missing marks of every group and class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list] = {}
        for batch in batches:
            u, groups, y = missing_as_zero(batch), batch.column("g").to_pylist(), batch.column("y").to_numpy()
            for key in set(zip(groups, y.tolist(), strict=True)):
                mine = u[[g == key[0] and c == key[1] for g, c in zip(groups, y.tolist(), strict=True)]]
                old = sums.setdefault(key, [0, 0.0, 0.0])
                sums[key] = [old[0] + len(mine), old[1] + mine.sum(0), old[2] + (mine.T @ mine).ravel()]
            if len(sums) > 256:
                yield rows_of(sums)
                sums = {}
        yield rows_of(sums)

    kind = rows.schema["g"].dataType.simpleString()
    null = rows.select("g").limit(0).toArrow().schema.field("g").type

    def rows_of(sums: dict) -> pa.RecordBatch:
        # one list of all sums, added up place by place in Spark
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], null), pa.array([k[1] for k in sums], pa.int32()), pa.array([[float(v[0]), *v[1], *v[2]] for v in sums.values()], pa.list_(pa.float64()))], names=["g", "y", "all"])

    each = rows.select("g", "y", "x").mapInArrow(run, f"g {kind}, y int, all array<double>").select("g", "y", F.posexplode("all").alias("place", "v"))
    summed = each.groupBy("g", "y", "place").agg(F.sum("v").alias("v"))
    return summed.groupBy("g", "y").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "v"))), lambda e: e["v"]).alias("all"))


class Folds:
    """Coefficients, metrics and standards of some folds."""

    def __init__(self, names: list, held: np.ndarray, whole: np.ndarray, medians: np.ndarray, penalty: float, balanced: bool):
        """held and whole: sums of the held-out group and of all rows, by class."""
        self.names, d = names, medians.shape[1]
        self.take = {g: k for k, g in enumerate(names)}
        rest = whole - held  # folds, classes, sums
        n, s, u = rest[:, :, 0], rest[:, :, 1 : 1 + 2 * d], rest[:, :, 1 + 2 * d :].reshape(len(names), 2, 2 * d, 2 * d)
        fill = np.concatenate([np.repeat(np.eye(d)[None], len(names), 0), medians[:, :, None] * np.eye(d)], 2)  # imputed = fill @ u
        total = n.sum(1)
        self.mean = (fill @ s.sum(1)[:, :, None])[:, :, 0] / total[:, None]
        square = np.einsum("fij,fjk,fik->fi", fill, u.sum(1), fill) / total[:, None]
        scale = np.sqrt(np.maximum(square - self.mean**2, 0))
        self.scale = np.where(scale > 1e-12, scale, 1.0)
        self.weight = np.where(n > 0, total[:, None] / (2 * np.maximum(n, 1)), 0.0) if balanced else np.ones_like(n)
        self.medians, self.penalty = medians, penalty
        # second moments of (1, standardised) under the class weights: the curvature is a quarter of these at most
        wu, ws, wn = (self.weight[:, :, None, None] * u).sum(1), (self.weight[:, :, None] * s).sum(1), (self.weight * n).sum(1)
        first = (fill @ ws[:, :, None])[:, :, 0]
        centred = fill @ wu @ fill.transpose(0, 2, 1) - first[:, :, None] * self.mean[:, None] - self.mean[:, :, None] * first[:, None] + wn[:, None, None] * self.mean[:, :, None] * self.mean[:, None]
        metric = np.zeros((len(names), d + 1, d + 1))
        metric[:, 0, 0] = wn
        metric[:, 0, 1:] = metric[:, 1:, 0] = (first - wn[:, None] * self.mean) / self.scale
        metric[:, 1:, 1:] = centred / self.scale[:, :, None] / self.scale[:, None]
        ridge = np.diag([1e-9, *np.full(d, penalty)])
        self.metric = np.linalg.inv(metric / 4 + ridge)
        self.b = np.zeros((len(names), d + 1))

    def linear(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The coefficients for raw (features, missing marks), and the constants."""
        slope = b[:, 1:] / self.scale
        return np.concatenate([slope, slope * self.medians], 1).T, b[:, 0] - (slope * self.mean).sum(1)

    def gradient(self, b: np.ndarray, moved: np.ndarray, total: np.ndarray) -> np.ndarray:
        """Of the penalised loss, from the sums of residuals times (features, missing marks) and of residuals."""
        d = self.medians.shape[1]
        raw = moved[:, :d] + self.medians * moved[:, d:]
        slopes = (raw - self.mean * total[:, None]) / self.scale
        return np.concatenate([total[:, None], slopes], 1) + np.r_[0.0, np.full(d, self.penalty)] * b


def residual_sums(rows: DataFrame, folds: Folds, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By fold, over its rows: residuals times (features, missing marks), and residuals."""
    slopes, constants = folds.linear(b)
    take, weight = folds.take, folds.weight

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moved = np.zeros((slopes.shape[1], slopes.shape[0] + 1))
        for batch in batches:
            u, y = missing_as_zero(batch), batch.column("y").to_numpy()
            r = (1 / (1 + np.exp(-np.clip(u @ slopes + constants, -40, 40))) - y[:, None]) * weight.T[y]
            own = np.array([take.get(g, -1) for g in batch.column("g").to_pylist()])
            inside = np.flatnonzero(own >= 0)
            r[inside, own[inside]] = 0.0
            moved[:, :-1] += r.T @ u
            moved[:, -1] += r.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(moved.size)), pa.array(moved.ravel())], names=["place", "v"])

    found = rows.select("g", "y", "x").mapInArrow(run, "place long, v double").groupBy("place").agg(F.sum("v").alias("v")).toArrow()
    moved = np.zeros(slopes.shape[1] * (slopes.shape[0] + 1))
    moved[found.column("place").to_numpy()] = found.column("v").to_numpy()
    moved = moved.reshape(slopes.shape[1], -1)
    return moved[:, :-1], moved[:, -1]


def fit(rows: DataFrame, folds: Folds, rounds: int, tolerance: float) -> None:
    """Accelerated gradient steps in the folds' metrics; a fold whose steps turn against each other begins its momentum anew."""
    b, ahead, t = folds.b, folds.b.copy(), np.ones(len(folds.names))
    for _ in range(rounds):
        gradient = folds.gradient(ahead, *residual_sums(rows, folds, ahead))
        after = ahead - np.einsum("fij,fj->fi", folds.metric, gradient)
        turned = ((ahead - after) * (after - b)).sum(1) > 0
        t = np.where(turned, 1.0, t)
        later = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = after + np.where(turned, 0.0, (t - 1) / later)[:, None] * (after - b)
        done = np.abs(after - b).max() < tolerance
        b, t = after, later
        if done:
            break
    folds.b = b


def leave_one_group_out(df: DataFrame, group: str, y: str, features: str, penalty: float = 1.0, balanced: bool = True, rounds: int = 200, tolerance: float = 1e-6) -> DataFrame:
    """df with score: each row's probability of class 1 by the model fitted on all other groups' rows.

    features is an array column of one length; null and non-finite values in it are missing. Rows without a label or features
    train nothing and get no score, nor do the rows of a group whose fold lacks a class; a feature without a value in a
    fold counts as 0 there.
    """
    rows = df.withColumns({"g": F.col(group), "y": F.col(y).cast("int"), "x": F.col(features).cast("array<double>")}).filter("y IN (0, 1) AND x IS NOT NULL").select("g", "y", "x")
    rows = written(rows, "held-out-rows")
    first = rows.first()
    out = df.withColumn("score", F.lit(None).cast("double"))
    if first is None:
        return out
    d = len(first.x)
    sums, medians = written(moments(rows), "held-out-moments"), written(held_out_medians(rows), "held-out-medians")
    whole = np.zeros((2, 1 + 2 * d + 4 * d * d))
    for r in sums.select("y", F.posexplode("all").alias("place", "v")).groupBy("y", "place").agg(F.sum("v").alias("v")).toLocalIterator():
        whole[r.y, r.place] = r.v
    names = [r.g for r in rows.select("g").distinct().orderBy("g").toLocalIterator()]
    kind, scored, folded = df.schema, None, None
    for at in range(0, len(names), FOLDS):
        part = names[at : at + FOLDS]
        within = F.col("g").isin([g for g in part if g is not None]) | (F.col("g").isNull() if None in part else F.lit(False))
        held, middle = np.zeros((len(part), 2, whole.shape[1])), np.zeros((len(part), d))
        place = {g: k for k, g in enumerate(part)}
        for r in sums.filter(within).toLocalIterator():
            held[place[r.g], r.y] = r.all
        for r in medians.filter(within).toLocalIterator():
            middle[place[r.g], r.k] = r.median if r.median is not None else 0.0
        both = ((whole - held)[:, :, 0] > 0).all(1)
        if not both.any():
            continue
        good = [g for g, ok in zip(part, both, strict=True) if ok]
        folds = Folds(good, held[both], whole, middle[both], penalty, balanced)
        fit(rows, folds, rounds, tolerance)
        slopes, constants = folds.linear(folds.b)
        take = folds.take

        def run(batches: Iterator[pa.RecordBatch], slopes=slopes, constants=constants, take=take) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = np.array([take.get(g, -1) for g in batch.column(group).to_pylist()], int)
                values = batch.column("_x")
                known = np.flatnonzero((own >= 0) & values.is_valid().to_numpy(zero_copy_only=False))
                score = np.full(batch.num_rows, np.nan)
                if len(known):
                    u = missing_as_zero(pa.RecordBatch.from_arrays([values.take(pa.array(known))], names=["x"]))
                    score[known] = 1 / (1 + np.exp(-np.clip((u * slopes.T[own[known]]).sum(1) + constants[own[known]], -40, 40)))
                columns = [batch.column(c) for c in kind.names] + [pa.array(score, from_pandas=True)]
                yield pa.RecordBatch.from_arrays(columns, names=[*kind.names, "score"])

        here = F.col(group).isin([g for g in good if g is not None]) | (F.col(group).isNull() if None in good else F.lit(False))
        made = df.filter(here).withColumn("_x", F.col(features).cast("array<double>")).mapInArrow(run, out.schema)
        scored = made if scored is None else scored.unionByName(made)
        folded = here if folded is None else folded | here
    return out if scored is None else scored.unionByName(out.filter(~folded))
