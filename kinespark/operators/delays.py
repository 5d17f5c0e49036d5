"""Delay space: nearest neighbours of a trial's delay vectors, false neighbours, embedding dimension, divergence.

Vectors of a trial are cut into cells by their first coordinate. A point first looks into its own cell; the distance found
there rules out all cells whose first coordinates are further away, and the others are visited. Points of one trial that are
close in time don't count. So no trial is one group: a task holds a cell, and a bounded number of points that visit it. A trial
of up to CELL_ROWS points is one cell. Every trial has its own delay and dimension.

Dimensions and divergence of trials of up to CELL_ROWS rows without gaps are computed on the whole trial, as slices of one sorted
stream: a job for each dimension and step would take longer than the work.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinespark.functions.groups import streamed
from kinespark.functions.ranges import same
from kinespark.functions.steps import written
from kinespark.operators import signals

CELL_ROWS, MOST_RINGS = 4096, 1024
#: Distances computed at once, in figures.
AT_ONCE = 4_000_000


def delay_vectors(df: DataFrame, keys: Sequence[str], idx: str, value: str, delay: Column, size: Column) -> DataFrame:
    """(keys, i, p): the arrays of size values that begin at place i and lie delay apart, where the trial has them all."""
    k = F.explode(F.sequence(F.lit(0).cast("long"), size.cast("long") - 1))
    rows = df.select(*keys, F.col(idx).cast("long").alias("_idx"), F.col(value).cast("double").alias("_v"), delay.cast("long").alias("_delay"), size.cast("long").alias("_size"), k.alias("_k"))
    rows = rows.withColumn("i", F.col("_idx") - F.col("_k") * F.col("_delay")).filter("i >= 0")
    made = rows.groupBy(*keys, "i").agg(F.array_sort(F.collect_list(F.struct("_k", "_v"))).alias("_p"), F.max("_size").alias("_size"))
    return made.filter(F.size("_p") == F.col("_size")).select(*keys, "i", F.transform("_p", lambda e: e["_v"]).alias("p"))


def nearest(points: DataFrame, keys: Sequence[str], apart: Column, largest: bool = False, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(keys, i, j, distance): the nearest other vector of (keys, i, q), more than apart places away; of equal ones the first.

    Distances are Euclidean, or the largest difference of a coordinate. Points without such a vector are left out.
    """
    names = list(keys)
    kinds = ", ".join(f"{k} {points.schema[k].dataType.simpleString()}" for k in names)
    x = points.select(*names, "i", "q", apart.cast("long").alias("apart"), F.element_at("q", 1).alias("c"))
    n = x.groupBy(*names).agg(F.count("*").alias("n"))
    rings = F.least(F.lit(MOST_RINGS), F.ceil(F.col("n") / cell_rows)).cast("int")
    # only trials of several cells need cuts
    cuts = x.join(n.filter(F.col("n") > cell_rows), names).groupBy(*names, "n").agg(F.percentile_approx("c", [k / MOST_RINGS for k in range(1, MOST_RINGS)], 10_000).alias("_all"))
    cuts = cuts.select(*(F.col(k).alias(f"_c_{k}") for k in names), F.transform(F.sequence(F.lit(1), F.greatest(rings - 1, F.lit(1))), lambda k: F.element_at("_all", F.greatest(F.lit(1), F.floor(k * MOST_RINGS / rings)).cast("int"))).alias("cuts"))
    cuts = written(cuts, "delay-cuts")
    ring = lambda c: F.when(F.col("cuts").isNull(), 0).otherwise(F.size(F.filter("cuts", lambda e: e < c)))
    x = x.join(cuts, same(names, "_c_"), "left").drop(*(f"_c_{k}" for k in names)).withColumn("ring", ring(F.col("c"))).drop("cuts")
    x = written(x, "delay-points")
    sizes = x.groupBy(*names, "ring").agg(F.ceil(F.count("*") / (2 * cell_rows)).alias("parts"))
    # equal coordinates can make a ring too large for one cell
    x = x.join(sizes.select(*(F.col(k).alias(f"_s_{k}") for k in (*names, "ring")), "parts"), same([*names, "ring"], "_s_")).drop(*(f"_s_{k}" for k in (*names, "ring")))
    x = written(x.withColumn("part", F.pmod(F.xxhash64("i"), F.col("parts"))).drop("parts"), "delay-cells")

    def best(i: np.ndarray, p: np.ndarray, zone: np.ndarray, j: np.ndarray, q: np.ndarray) -> list[np.ndarray]:
        """i, j and distance of the points i that have a neighbour among j, which ascend."""
        found = ([], [], [])
        step = max(1, AT_ONCE // max(1, q.size))
        for at in range(0, len(p) if len(q) else 0, step):
            difference = p[at : at + step, None] - q[None]
            d = np.abs(difference).max(2) if largest else np.sqrt((difference**2).sum(2))
            d[np.abs(i[at : at + step, None] - j) <= zone[at : at + step, None]] = np.inf
            near = d.argmin(1)
            least = d[np.arange(len(d)), near]
            good = np.isfinite(least)
            for column, made in zip(found, (i[at : at + step][good], j[near[good]], least[good]), strict=True):
                column.append(made)
        return [np.concatenate(c) if c else np.zeros(0, t) for c, t in zip(found, (np.int64, np.int64, float), strict=True)]

    def alone(points: Mapping[str, np.ndarray]) -> dict[str, np.ndarray]:
        q = np.stack(points["q"])
        return dict(zip(("_at", "j", "distance"), best(points["_at"], q, points["apart"], points["_at"], q), strict=True))

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        b = b.sort_by("i")
        p, q = (np.array(t.column("q").to_pylist()) for t in (a, b))
        columns = best(a.column("i").to_numpy(), p, a.column("apart").to_numpy(), b.column("i").to_numpy(), q)
        either = a if a.num_rows else b
        return pa.table([*(pa.array([either.column(k)[0].as_py()] * len(columns[0]), either.column(k).type) for k in names), *(pa.array(c) for c in columns)], names=[*names, "i", "j", "distance"])

    schema, cell = f"{kinds}, i long, j long, distance double", [*names, "ring", "part"]
    # most cells are short trials: slices of a stream, not a call each
    listed = x.select(*cell, F.col("i").alias("_at"), "q", "apart")
    own = streamed(listed, cell, ["_at"], alone, "_at long, j long, distance double").select(*names, F.col("_at").alias("i"), "j", "distance")
    own = written(own, "delay-own")
    if cuts.isEmpty():
        return own
    # the rings within reach of each point of a long trial, but for its own cell
    reached = own.select(*(F.col(k).alias(f"_b_{k}") for k in (*names, "i")), F.col("distance").alias("reach"))
    far = x.join(cuts, same(names, "_c_")).join(reached, same([*names, "i"], "_b_"), "left")
    low = F.when(F.col("reach").isNull(), 0).otherwise(ring(F.col("c") - F.col("reach")))
    high = F.when(F.col("reach").isNull(), F.size("cuts")).otherwise(ring(F.col("c") + F.col("reach")))
    there = far.select(*names, "i", "q", "apart", F.col("ring").alias("own_ring"), F.col("part").alias("own_part"), F.explode(F.sequence(low, high)).alias("ring"))
    there = there.join(sizes.select(*(F.col(k).alias(f"_s_{k}") for k in (*names, "ring")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")), same([*names, "ring"], "_s_"))
    there = there.filter((F.col("ring") != F.col("own_ring")) | (F.col("part") != F.col("own_part"))).select(*names, "i", "q", "apart", "ring", "part")
    # no more than about four cells' worth of points visit a cell at once
    crowds = there.groupBy(*(F.col(k).alias(f"_v_{k}") for k in cell)).agg(F.ceil(F.count("*") / (4 * cell_rows)).alias("crowds"))
    there = written(there.join(crowds, same(cell, "_v_")).withColumn("crowd", F.pmod(F.xxhash64("i"), F.col("crowds"))).select(*names, "i", "q", "apart", "ring", "part", "crowd"), "delay-visits")
    asked = there.select(*(F.col(k).alias(f"_w_{k}") for k in cell), "crowd").distinct()
    hosts = x.join(asked, same(cell, "_w_")).select(*names, "i", "q", "ring", "part", "crowd")
    hosts = hosts.toDF(*hosts.columns)
    visited = there.groupBy(*cell, "crowd").cogroup(hosts.groupBy(*cell, "crowd")).applyInArrow(compare, schema)
    return own.unionByName(visited).groupBy(*names, "i").agg(F.min(F.struct("distance", "j")).alias("m")).select(*names, "i", F.col("m.j").alias("j"), F.col("m.distance").alias("distance"))


def false_neighbours(df: DataFrame, keys: Sequence[str], idx: str, value: str, delay: Column, dim: Column, ratio: float = 10.0, scale: float = 2.0, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(keys, false_share): the share of nearest neighbours, apart in time by more than the delay, that one more dimension drives apart.

    delay and dim are columns that are constant in a trial. 1 for fewer than 20 vectors, and without a neighbour.
    """
    names = list(keys)
    given = df.select(*names, idx, value, delay.alias("delay"), dim.alias("dim"))
    trials = given.groupBy(*names).agg(F.max("delay").alias("delay"), F.max("dim").alias("dim"))
    p = delay_vectors(given, names, idx, value, F.col("delay"), F.col("dim") + 1)
    p = written(p.join(trials.select(*(F.col(k).alias(f"_t_{k}") for k in names), "delay", "dim"), same(names, "_t_")).select(*names, "i", F.slice("p", F.lit(1), F.col("dim").cast("int")).alias("q"), F.element_at("p", -1).alias("last"), "delay"), "delay-vectors")
    count = p.groupBy(*names).agg(F.count("*").alias("n"))
    p = p.join(count.filter("n >= 20").select(*(F.col(k).alias(f"_n_{k}") for k in names)), same(names, "_n_")).select(*names, "i", "q", "last", "delay")
    centre = p.select(*names, F.posexplode("q").alias("k", "v")).groupBy(*names, "k").agg(F.avg("v").alias("v")).groupBy(*(F.col(k).alias(f"_m_{k}") for k in names)).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda e: e["v"]).alias("centre"))
    length = F.sqrt(F.aggregate(F.zip_with("q", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    spread = p.join(centre, same(names, "_m_")).groupBy(*(F.col(k).alias(f"_d_{k}") for k in names)).agg(F.avg(length).alias("spread"))
    near = nearest(p, names, F.greatest(F.col("delay"), F.lit(1)), cell_rows=cell_rows).filter("distance > 0")
    here = p.select(*(F.col(k).alias(f"_h_{k}") for k in (*names, "i")), F.col("last").alias("one"))
    there = p.select(*(F.col(k).alias(f"_o_{k}") for k in names), F.col("i").alias("_o_j"), F.col("last").alias("other"))
    gap = F.abs(F.col("one") - F.col("other"))
    pairs = near.join(here, same([*names, "i"], "_h_")).join(there, same([*names, "j"], "_o_")).join(spread, same(names, "_d_"))
    false = (gap / F.col("distance") > ratio) | ((gap > scale * F.col("spread")) & (F.col("spread") > 0))
    share = pairs.groupBy(*(F.col(k).alias(f"_f_{k}") for k in names)).agg(F.avg(false.cast("int")).alias("share"))
    return trials.select(*names).join(share, same(names, "_f_"), "left").select(*names, F.coalesce("share", F.lit(1.0)).alias("false_share"))


def whole_trials(df: DataFrame, keys: Sequence[str], idx: str, value: str, run: Callable[[np.ndarray, Mapping[str, np.ndarray]], float], cell_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """(keys, made) of the short trials by run, which gets a trial's values and its other columns; and the rows of the others, if any.

    Others have more than cell_rows rows, or values that lack or don't follow each other from place 0 on.
    """
    names = list(keys)
    df = written(df, "delay-trials")
    long = written(df.groupBy(*names).agg(F.count("*").alias("_n")).filter(F.col("_n") > cell_rows).drop("_n"), "delay-long")
    short = df if long.isEmpty() else df.join(long.toDF(*(f"_l_{k}" for k in names)), same(names, "_l_"), "left_anti")

    def each(trial: Mapping[str, np.ndarray]) -> dict[str, np.ndarray]:
        x, at = trial["_v"], trial["_at"]
        plain = np.isfinite(x).all() and (at == np.arange(len(at))).all()
        return {"_plain": np.array([plain]), "made": np.array([run(x, trial) if plain else np.nan], float)}

    rest = [c for c in df.columns if c not in (*names, idx, value)]
    listed = short.select(*names, F.col(idx).cast("long").alias("_at"), F.col(value).cast("double").alias("_v"), *rest)
    made = written(streamed(listed, names, ["_at"], each, "_plain boolean, made double"), "delay-whole")
    others = long.unionByName(made.filter("NOT _plain").select(*names))
    done = made.filter("_plain").select(*names, F.when(~F.isnan("made"), F.col("made")).alias("made"))
    return done, None if others.isEmpty() else df.join(others.toDF(*(f"_l_{k}" for k in names)), same(names, "_l_"), "left_semi")


def embedding_dimension(df: DataFrame, keys: Sequence[str], idx: str, value: str, delay: Column, low: int = 2, high: int = 10, share: float = 0.1, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(keys, dim): the smallest dimension with fewer false neighbours than the share, or the largest tried. Settled trials leave."""
    names = list(keys)
    given = df.select(*names, idx, value, delay.cast("long").alias("delay"))
    done, todo = whole_trials(given, names, idx, value, lambda x, trial: signals.embedding_dimension(x, int(trial["delay"].max()), low, high, share), cell_rows)
    done = done.select(*names, F.col("made").cast("int").alias("dim"))
    if todo is None:
        return done
    todo = written(todo, "delay-trials")
    for m in range(low, high + 1):
        shares = false_neighbours(todo, names, idx, value, F.col("delay"), F.lit(m), cell_rows=cell_rows)
        settled = F.lit(True) if m == high else F.col("false_share") < share
        made = written(shares.select(*names, settled.alias("settled")), "delay-dimensions")
        done = done.unionByName(made.filter("settled").select(*names, F.lit(m).alias("dim")))
        left = made.filter("NOT settled").select(*(F.col(k).alias(f"_l_{k}") for k in names))
        if left.isEmpty():
            break
        todo = written(todo.join(left, same(names, "_l_"), "left_semi"), "delay-trials")
    return done


def divergence(df: DataFrame, keys: Sequence[str], idx: str, value: str, delay: Column, dim: Column, steps: int, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(keys, lyapunov): the slope of the mean log distance of nearest neighbours over the steps after they meet.

    Neighbours are more than delay * dim apart in time; delay and dim are columns that are constant in a trial. Null for
    trials of fewer than 2 * steps + 2 vectors, and where fewer than two steps have a distance.
    """
    names = list(keys)
    given = df.select(*names, idx, value, delay.cast("long").alias("delay"), dim.cast("long").alias("dim"))
    done, given = whole_trials(given, names, idx, value, lambda x, trial: signals.lyapunov(x, int(trial["delay"].max()), int(trial["dim"].max()), steps), cell_rows)
    done = done.withColumnRenamed("made", "lyapunov")
    if given is None:
        return done
    trials = given.groupBy(*names).agg((F.max("delay") * F.max("dim")).alias("apart"))
    p = written(delay_vectors(given, names, idx, value, F.col("delay"), F.col("dim")), "delay-vectors")
    size = p.groupBy(*(F.col(k).alias(f"_n_{k}") for k in names)).agg(F.count("*").alias("n")).filter(F.col("n") >= 2 * steps + 2)
    base = p.join(size, same(names, "_n_")).filter(F.col("i") < F.col("n") - steps)
    base = base.join(trials.select(*(F.col(k).alias(f"_a_{k}") for k in names), "apart"), same(names, "_a_")).select(*names, "i", F.col("p").alias("q"), "apart")
    near = nearest(base, names, F.col("apart"), largest=True, cell_rows=cell_rows)
    later = near.select(*names, F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("s"), "i", "j").select(*names, "s", (F.col("i") + F.col("s")).alias("i"), (F.col("j") + F.col("s")).alias("j"))
    one = p.select(*(F.col(k).alias(f"_h_{k}") for k in (*names, "i")), F.col("p").alias("one"))
    other = p.select(*(F.col(k).alias(f"_o_{k}") for k in names), F.col("i").alias("_o_j"), F.col("p").alias("other"))
    gap = F.sqrt(F.aggregate(F.zip_with("one", "other", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, v: t + v))
    met = later.join(one, same([*names, "i"], "_h_")).join(other, same([*names, "j"], "_o_")).withColumn("gap", gap).filter("gap > 0")
    curve = met.groupBy(*names, "s").agg(F.avg(F.log("gap")).alias("d"))
    slope = curve.groupBy(*(F.col(k).alias(f"_e_{k}") for k in names)).agg(F.when(F.count("*") > 1, F.regr_slope("d", "s")).alias("lyapunov"))
    return done.unionByName(trials.select(*names).join(slope, same(names, "_e_"), "left").select(*names, "lyapunov"))
