"""Signal queries on the given tables: users' events as trials of samples, event types as sensors and gait events."""

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from kinespark.functions import udtfs as tf
from kinespark.functions.hashes import unit, unit_sql
from kinespark.functions.steps import written
from kinespark.operators import delays as dl
from kinespark.operators import filters as fl
from kinespark.operators import fusion as fu
from kinespark.operators import kernels as kn
from kinespark.operators import peaks as pk
from kinespark.operators import signals as g
from kinespark.plans.register import query, table

E = "e AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::BIGINT AS idx, epoch_us(ts) / 1e6 AS s FROM events)"
R6 = lambda c: F.round(c, 6)


def events(spark, sf):
    e = g.indexed(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"])
    return e.withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query(f"""WITH {E}, n AS (SELECT user_id, count(*) AS n, (user_id % 30)::BIGINT AS st, (user_id % 30 + 10)::BIGINT AS en FROM events GROUP BY 1),
k AS (SELECT *, CASE WHEN st < 0 OR en <= st OR en > n THEN 'invalid_bounds' WHEN st < 5 OR n - en < 5 THEN 'segment_too_short' ELSE 'ok' END AS status FROM n)
SELECT user_id, idx, row_number() OVER (PARTITION BY user_id ORDER BY idx) - 1 AS new_idx, status FROM e JOIN k USING (user_id) WHERE status <> 'ok' OR idx < st OR idx >= en""")
def g1_exclude_turns(spark, sf):
    e = events(spark, sf).select("user_id", "idx")
    bounds = e.select("user_id").distinct().select("user_id", (F.col("user_id") % 30).alias("start"), (F.col("user_id") % 30 + 10).alias("end"))
    return g.exclude_turns(e, bounds, "user_id", 5).select("user_id", "idx", "new_idx", "status")


@query("""WITH s AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k, value FROM events),
n AS (SELECT user_id, min(c) AS len FROM (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY 1, 2) GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT event_type) FROM events))
SELECT user_id, k, round(sum(value), 6) AS stacked, count(*) AS channels FROM s JOIN n USING (user_id) WHERE k <= len GROUP BY 1, 2""")
def g12_stack_sensors(spark, sf):
    e = table(spark, sf, "events")
    kinds = e.agg(F.count_distinct("event_type").alias("kinds"))
    n = e.groupBy("user_id", "event_type").agg(F.count("*").alias("c")).groupBy("user_id").agg(F.min("c").alias("len"), F.count("*").alias("have"))
    n = n.crossJoin(F.broadcast(kinds)).filter("have = kinds").select("user_id", "len")
    s = e.withColumn("k", F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")))
    return s.join(n, "user_id").filter("k <= len").groupBy("user_id", "k").agg(R6(F.sum("value")).alias("stacked"), F.count("*").alias("channels"))


@query(f"""WITH {E}, n AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), w AS (SELECT user_id, unnest(range(0, n - 20 + 1, 10)) AS window_start FROM n WHERE n >= 20)
SELECT user_id, window_start, count(*) AS n, round(avg(value), 6) AS mean FROM w JOIN e USING (user_id) WHERE idx >= window_start AND idx < window_start + 20 GROUP BY 1, 2""")
def g13_sliding_windows(spark, sf):
    w = g.windows(events(spark, sf), ["user_id"], "idx", 20, 10)
    return w.groupBy("user_id", "window_start").agg(F.count("*").alias("n"), R6(F.avg("value")).alias("mean"))


U1 = f"""WITH {E}, n AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), w AS (SELECT user_id, unnest(range(0, n - 20 + 1, 10)) AS window_start FROM n WHERE n >= 20)
SELECT user_id, window_start, count(*) AS n, round(avg(value), 6) AS mean, round(arg_max(value, idx), 6) AS last FROM w JOIN e USING (user_id) WHERE idx >= window_start AND idx < window_start + 20 GROUP BY 1, 2"""
MEAN = "size(window) AS n, round(aggregate(window, 0D, (s, v) -> s + v) / size(window), 6) AS mean, round(element_at(window, -1), 6) AS last"


@query(U1)
def u1_sliding_windows(spark, sf):
    """Windows of each trial's array, by LATERAL in SQL."""
    tf.register(spark)
    trials = events(spark, sf).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("r")).select("user_id", F.col("r.value").alias("samples"))
    return spark.sql(f"SELECT user_id, window_start, {MEAN} FROM {{t}}, LATERAL sliding_windows(samples, 20, 10)", t=trials)


@query(U1)
def u1_sliding_windows_of(spark, sf):
    """The same from a table's rows, partitioned and ordered by the function, a trial a stream."""
    tf.register(spark)
    events(spark, sf).select("user_id", "idx", "value").createOrReplaceTempView("u1_samples")
    return spark.sql(f"SELECT user_id, window_start, {MEAN} FROM sliding_windows_of(TABLE(u1_samples), 'user_id', 'idx', 'value', 20, 10)")


WINDOWS = "w AS (SELECT user_id, window_start, avg(value) AS mean FROM e JOIN (SELECT user_id AS u, unnest(range(0, count(*) - {n} + 1, {step})) AS window_start FROM events GROUP BY 1 HAVING count(*) >= {n}) ON user_id = u AND idx BETWEEN window_start AND window_start + {n} - 1 GROUP BY 1, 2)"


@query(f"WITH {E}, {WINDOWS.format(n=10, step=10)} SELECT user_id, window_start, round(mean, 6) AS mean FROM w QUALIFY row_number() OVER (PARTITION BY user_id, window_start // 40 ORDER BY {unit_sql('user_id', 'window_start')}) = 1")
def g14_random_block_windows(spark, sf):
    """One window of 10 of each block of 40 rows, by a hash."""
    w = g.windows(events(spark, sf), ["user_id"], "idx", 10, 10).groupBy("user_id", "window_start").agg(F.avg("value").alias("mean"))
    pick = Window.partitionBy("user_id", F.floor(F.col("window_start") / 40)).orderBy(unit("user_id", "window_start"))
    return w.withColumn("k", F.row_number().over(pick)).filter("k = 1").select("user_id", "window_start", R6("mean").alias("mean"))


@query(f"WITH {E}, {WINDOWS.format(n=20, step=10)} SELECT user_id, window_start, round(mean, 6) AS mean FROM w ORDER BY {unit_sql('user_id', 'window_start')}, user_id, window_start LIMIT 50")
def g15_capped_windows(spark, sf):
    """A sample of 50 windows, by a hash: the limit is what the operator is for."""
    w = g.windows(events(spark, sf), ["user_id"], "idx", 20, 10).groupBy("user_id", "window_start").agg(F.avg("value").alias("mean"))
    return w.orderBy(unit("user_id", "window_start"), "user_id", "window_start").limit(50).select("user_id", "window_start", R6("mean").alias("mean"))


@query(f"WITH {E}, {WINDOWS.format(n=20, step=20)} SELECT c_mktsegment AS cohort, user_id AS participant, window_start, round(mean, 6) AS mean FROM w JOIN customer ON c_custkey = user_id")
def g16_participant_windows(spark, sf):
    w = g.windows(events(spark, sf), ["user_id"], "idx", 20, 20).groupBy("user_id", "window_start").agg(R6(F.avg("value")).alias("mean"))
    people = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("cohort"))
    return w.join(people, "user_id").select("cohort", F.col("user_id").alias("participant"), "window_start", "mean")


@query(f"""WITH {E.replace('SELECT *,', "SELECT * REPLACE (CASE WHEN event_type = 'click' THEN value ELSE 0 END AS value),")}, {WINDOWS.format(n=20, step=10)} SELECT user_id, window_start, round(mean, 6) AS mean FROM w""")
def g17_single_sensor_windows(spark, sf):
    """Windows in which only one sensor's samples are left."""
    from kinespark.operators import policy

    e = policy.mask_inactive(events(spark, sf), "event_type", ["click"], ["value"])
    return g.windows(e, ["user_id"], "idx", 20, 10).groupBy("user_id", "window_start").agg(R6(F.avg("value")).alias("mean"))


@query(f"""WITH {E}, j AS (SELECT *, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY idx)) AS j FROM e)
SELECT user_id, round(sqrt(avg(value * value)), 6) AS rms, round(max(value) - min(value), 6) AS range, round(stddev_pop(value), 6) AS sd, round(avg(j), 6) AS mean_jerk, round(max(j), 6) AS max_jerk FROM j GROUP BY 1""")
def f1_time_features(spark, sf):
    f = g.time_features(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "value")
    return rounded(f, "rms", "range", "sd", "mean_jerk", "max_jerk")


@query("""SELECT user_id, round(sqrt(avg(value * value) FILTER (WHERE event_type = 'view')) / (sqrt(avg(value * value) FILTER (WHERE event_type = 'click')) + 1e-10), 6) AS ratio FROM events GROUP BY 1""")
def f2_sensor_ratio(spark, sf):
    rms = lambda kind: F.sqrt(F.avg(F.when(F.col("event_type") == kind, F.col("value") ** 2)))
    return table(spark, sf, "events").groupBy("user_id").agg(F.round(rms("view") / (rms("click") + 1e-10), 6).alias("ratio"))


@query(f"""WITH {E} SELECT user_id, count(*) AS n, round(max(s) - min(s), 6) AS duration, round(avg(abs(value)), 6) AS mean, round(max(abs(value)), 6) AS peak FROM e WHERE idx >= 10 AND idx < 20 GROUP BY 1""")
def f4_turn_features(spark, sf):
    t = events(spark, sf).filter("idx >= 10 and idx < 20")
    return t.groupBy("user_id").agg(F.count("*").alias("n"), R6(F.max("s") - F.min("s")).alias("duration"), R6(F.avg(F.abs("value"))).alias("mean"), R6(F.max(F.abs("value"))).alias("peak"))


STRIDE = f"""{E}, d AS (SELECT user_id, event_type, idx - lag(idx) OVER (PARTITION BY user_id, event_type ORDER BY idx) AS d FROM e),
t AS (SELECT user_id, event_type, count(*) AS n, avg(d) AS mean, stddev_pop(d) AS sd FROM d GROUP BY 1, 2 HAVING count(*) >= 3)"""


@query(f"WITH {STRIDE} SELECT user_id, event_type, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(100 * sd / mean, 6) AS cv, round(60 / mean, 6) AS rate FROM t")
def f6_stride_times(spark, sf):
    return rounded(g.stride_times(events(spark, sf), ["user_id", "event_type"], "idx"), "mean", "sd", "cv", "rate")


@query(f"""WITH {E}, x AS (SELECT user_id, idx - lag(idx) OVER (PARTITION BY user_id ORDER BY idx) AS d FROM e WHERE event_type IN ('view', 'click'))
SELECT user_id, count(*) AS n, round(avg(d), 6) AS mean, round(stddev_pop(d), 6) AS sd FROM x GROUP BY 1 HAVING count(*) >= 3""")
def f7_step_times(spark, sf):
    x = events(spark, sf).filter("event_type in ('view', 'click')")
    return rounded(g.stride_times(x, ["user_id"], "idx").select("user_id", "n", "mean", "sd"), "mean", "sd")


@query(f"""WITH {E} SELECT user_id, idx, min(CASE WHEN event_type = 'click' THEN idx END) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS toe_off FROM e QUALIFY event_type = 'view'""")
def f8_j4_next_event(spark, sf):
    return g.next_event(events(spark, sf), ["user_id"], ["idx"], "event_type", "view", "click", F.col("idx"), "toe_off").select("user_id", "idx", "toe_off")


@query(f"""WITH {E}, w AS (SELECT user_id, value, CASE WHEN count(*) OVER k = 10 AND avg(value) OVER k <> 0 THEN 100 * stddev_pop(value) OVER k / abs(avg(value) OVER k) END AS cv FROM e WINDOW k AS (PARTITION BY user_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING))
SELECT user_id, round(coalesce(avg(cv), 100 * stddev_pop(value) / abs(avg(value))), 6) AS rolling_cv FROM w GROUP BY 1""")
def f9_rolling_cv(spark, sf):
    return rounded(g.rolling_cv(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "value", 10), "rolling_cv")


@query(f"""WITH {E}, x AS (SELECT user_id, idx // 10 AS seg, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY user_id, idx // 10) AS n, sum(value * 0.01) OVER w AS v, sum(value * 0.01) OVER (PARTITION BY user_id, idx // 10) AS en FROM e WINDOW w AS (PARTITION BY user_id, idx // 10 ORDER BY idx))
SELECT user_id, seg, round(abs(sum((v - CASE WHEN n > 1 THEN en * k / (n - 1) ELSE 0 END) * 0.01)), 6) AS length FROM x GROUP BY 1, 2""")
def f10_step_length(spark, sf):
    x = events(spark, sf).withColumn("seg", F.floor(F.col("idx") / 10))
    return rounded(g.swing_lengths(x, ["user_id", "seg"], "idx", "value", 0.01), "length")


@query("""WITH p AS (SELECT user_id, coalesce(avg(value) FILTER (WHERE event_type = 'view'), 0) AS l, coalesce(avg(value) FILTER (WHERE event_type = 'click'), 0) AS r FROM events GROUP BY 1)
SELECT user_id, round(CASE WHEN l + r = 0 THEN 0 ELSE 100 * abs(l - r) / (0.5 * (l + r)) END, 6) AS symmetry FROM p""")
def f11_symmetry(spark, sf):
    p = table(spark, sf, "events").groupBy("user_id").pivot("event_type", ["view", "click"]).agg(F.avg("value"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return p.select("user_id", R6(g.symmetry_index(zero("view"), zero("click"))).alias("symmetry"))


@query(f"WITH {E}, b AS (SELECT user_id, idx // 16 AS b, sqrt(avg(value * value)) AS r FROM e GROUP BY 1, 2 HAVING count(*) = 16) SELECT user_id, round(avg(r), 6) AS block_rms_mean, round(stddev_pop(r), 6) AS block_rms_sd FROM b GROUP BY 1")
def f12_block_rms(spark, sf):
    return rounded(g.block_rms(events(spark, sf), ["user_id"], "idx", "value", 16), "block_rms_mean", "block_rms_sd")


DAY = "psd AS (SELECT user_id, hour(ts)::DOUBLE AS freq, sum(value * value) AS power FROM events GROUP BY 1, 2)"


def day_spectrum(spark, sf):
    """A spectrum of each user that SQL can make as well: power by hour."""
    return table(spark, sf, "events").groupBy("user_id", F.hour("ts").cast("double").alias("freq")).agg(F.sum(F.col("value") ** 2).alias("power"))


@query(f"""WITH {DAY}, x AS (SELECT *, power / sum(power) OVER (PARTITION BY user_id) AS p FROM psd)
SELECT user_id, arg_max(freq, power) AS dominant, round(sum(freq * power) / sum(power), 6) AS centroid, round(-sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END), 6) AS entropy FROM x GROUP BY 1""")
def f15_spectrum_shape(spark, sf):
    return rounded(g.spectrum_shape(day_spectrum(spark, sf), ["user_id"]), "centroid", "entropy")


@query("""WITH x AS (SELECT o_custkey, o_totalprice AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS k FROM orders WHERE o_orderkey % 11 <> 0)
SELECT o_custkey, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd, round(max(v) - min(v), 6) AS range, round(CASE WHEN count(*) >= 2 THEN regr_slope(v, k) END, 6) AS trend FROM x GROUP BY 1""")
def f29_participant_trend(spark, sf):
    o = table(spark, sf, "orders").withColumn("v", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_totalprice")))
    t = g.participant_trend(o, "o_custkey", ["o_orderdate", "o_orderkey"], "v")
    return t.withColumns({c: F.round(c, 6) for c in ("mean", "sd", "range", "trend")})


def kernel(spark, sf, run, schema):
    return g.by_trial(events(spark, sf), ["user_id"], "idx", "value", run, schema)


def blocks(spark, sf, run, schema, **how):
    return g.by_blocks(events(spark, sf), ["user_id"], "idx", "value", run, schema, **how)


def pulse(sections, n=1024):
    """The filter's answer to a single 1, section after section by its difference equation."""
    x = [1.0] + [0.0] * (n - 1)
    for b0, b1, b2, a1, a2 in sections:
        y = []
        for k in range(n):
            y.append(b0 * x[k] + (b1 * x[k - 1] - a1 * y[k - 1] if k else 0.0) + (b2 * x[k - 2] - a2 * y[k - 2] if k > 1 else 0.0))
        x = y
    return x


def zero_phase_sql(of, sections, name):
    """The same by convolution of lists, for trials of up to about 1,000 rows: name(user_id, idx, v, f) from of(user_id, idx, v)."""
    gain = float(np.prod([(b0 + b1 + b2) / (1 + a1 + a2) for b0, b1, b2, a1, a2 in sections]))
    pad = fl.Cascade(sections).pad
    one_way = lambda u: f"list_transform(range(1, len({u}) + 1), lambda i: {u}[1] * {gain!r} + list_inner_product(h[1:i], list_reverse(list_transform({u}[1:i], lambda v: v - {u}[1]))))"
    return f"""{name}_p AS (SELECT [{', '.join(repr(float(v)) for v in pulse(sections))}]::DOUBLE[] AS h),
{name}_l AS (SELECT user_id, list(v ORDER BY idx) AS x FROM {of} GROUP BY user_id),
{name}_u AS (SELECT *, list_concat(list_concat(list_reverse(list_transform(x[2:{pad + 1}], lambda v: 2 * x[1] - v)), x), list_reverse(list_transform(x[len(x) - {pad}:len(x) - 1], lambda v: 2 * x[len(x)] - v))) AS u FROM {name}_l WHERE len(x) > {pad}),
{name}_f AS (SELECT user_id, x, list_reverse({one_way('u')}) AS y FROM {name}_u, {name}_p),
{name}_b AS (SELECT user_id, x, list_reverse({one_way('y')}) AS y FROM {name}_f, {name}_p),
{name} AS (SELECT user_id, k - 1 AS idx, x[k] AS v, y[k + {pad}] AS f FROM (SELECT *, unnest(range(1, len(x) + 1)) AS k FROM {name}_b)
  UNION ALL SELECT user_id, k - 1, x[k], x[k] FROM (SELECT *, unnest(range(1, len(x) + 1)) AS k FROM {name}_l WHERE len(x) <= {pad}))"""


BAND, LOW, HIGH, GRAVITY = fl.butterworth(4, 0.5, 20, 100), fl.butterworth(4, None, 20, 100), fl.butterworth(4, 0.5, None, 100), fl.butterworth(2, None, 0.1, 100)
V = "v AS (SELECT user_id, idx, value AS v FROM e)"


def both_ways(spark, sf, sections):
    return fl.zero_phase(events(spark, sf), ["user_id"], "idx", ["value"], sections, ["filtered"])


@query(f"WITH {E}, {V}, {zero_phase_sql('v', BAND, 'b')} SELECT user_id, idx, round(f, 6) AS filtered FROM b")
def g2_band_pass(spark, sf):
    return rounded(both_ways(spark, sf, BAND).drop("value"), "filtered")


@query(f"WITH {E}, {V}, {zero_phase_sql('v', LOW, 'b')} SELECT user_id, idx, round(f, 6) AS filtered FROM b")
def g3_low_pass(spark, sf):
    return rounded(both_ways(spark, sf, LOW).drop("value"), "filtered")


@query(f"WITH {E}, {V}, {zero_phase_sql('v', HIGH, 'a')}, w AS (SELECT user_id, idx, f AS v FROM a), {zero_phase_sql('w', LOW, 'b')} SELECT user_id, idx, round(f, 6) AS filtered FROM b")
def g4_two_pass_filter(spark, sf):
    """High-pass and low-pass as two filters, one after the other."""
    high = both_ways(spark, sf, HIGH).select("user_id", "idx", F.col("filtered").alias("high"))
    return rounded(fl.zero_phase(high, ["user_id"], "idx", ["high"], LOW, ["filtered"]).drop("high"), "filtered")


#: Rows from which on gravity is filtered out; shorter trials lose their median.
GRAVITY_ROWS = 50


def without_gravity(df, value):
    """df and free: value less its slow part."""
    slow = fl.zero_phase(df, ["user_id"], "idx", [value], GRAVITY, ["slow"])
    size = df.groupBy("user_id").agg(F.count("*").alias("n"), F.percentile(value, 0.5).alias("median"))
    return slow.join(size, "user_id").withColumn("free", F.col(value) - F.when(F.col("n") >= GRAVITY_ROWS, F.col("slow")).otherwise(F.col("median"))).drop("slow", "n", "median")


def without_gravity_sql(of):
    return f"{zero_phase_sql(of, GRAVITY, 's')}, m AS (SELECT user_id, count(*) AS n, quantile_cont(v, 0.5) AS median FROM {of} GROUP BY 1), free AS (SELECT user_id, idx, s.v, s.v - CASE WHEN n >= {GRAVITY_ROWS} THEN f ELSE median END AS free FROM s JOIN m USING (user_id))"


@query(f"WITH {E}, {V}, {without_gravity_sql('v')} SELECT user_id, idx, round(free, 6) AS free FROM free")
def g5_gravity_removal(spark, sf):
    return rounded(without_gravity(events(spark, sf).select("user_id", "idx", "value"), "value").drop("value"), "free")


def peaks_sql(of, name, distance, height="-1e300"):
    """name(user_id, idx, height, prominence): the peaks of of(user_id, idx, v), at least height."""
    return f"""{name}_n AS (SELECT *, CASE WHEN v = lag(v) OVER (PARTITION BY user_id ORDER BY idx) THEN 0 ELSE 1 END AS new FROM {of}),
{name}_r AS (SELECT user_id, min(idx) AS a, max(idx) AS b, any_value(v) AS v FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY idx) AS run FROM {name}_n) GROUP BY user_id, run),
{name}_c AS (SELECT user_id, (a + b) // 2 AS idx, v FROM (SELECT *, lag(v) OVER w AS lv, lead(v) OVER w AS rv FROM {name}_r WINDOW w AS (PARTITION BY user_id ORDER BY a)) z WHERE v > lv AND v > rv AND v >= {height}),
{name}_k AS (SELECT user_id, unnest(list_reduce(list_prepend([]::BIGINT[], list([idx::BIGINT] ORDER BY v DESC, idx)), lambda kept, p: CASE WHEN len(list_filter(kept, lambda q: abs(q - p[1]) < {distance})) > 0 THEN kept ELSE list_concat(kept, p) END)) AS idx FROM {name}_c GROUP BY user_id),
{name}_h AS (SELECT k.user_id, k.idx, p.v, max(x.idx) FILTER (x.idx < k.idx AND x.v > p.v) AS l, min(x.idx) FILTER (x.idx > k.idx AND x.v > p.v) AS r
  FROM {name}_k k JOIN {of} p ON p.user_id = k.user_id AND p.idx = k.idx JOIN {of} x ON x.user_id = k.user_id GROUP BY ALL),
{name} AS (SELECT h.user_id, h.idx, h.v AS height, h.v - greatest(min(x.v) FILTER (x.idx <= h.idx AND x.idx > coalesce(l, -1)), min(x.v) FILTER (x.idx >= h.idx AND x.idx < coalesce(r, 1e18))) AS prominence
  FROM {name}_h h JOIN {of} x ON x.user_id = h.user_id GROUP BY h.user_id, h.idx, h.v)"""


DISTANCE, PERCENTILE, FLOOR, BY_COHORT = 5, 60, 1.0, {"c0": 30.0, "c2": 75.0}
COHORT = "'c' || (user_id % 4)"
CUT_SQL = f"q AS (SELECT user_id, greatest(CASE {COHORT} {' '.join(f'WHEN {c!r} THEN quantile_cont(prominence, {p / 100})' for c, p in BY_COHORT.items())} ELSE quantile_cont(prominence, {PERCENTILE / 100}) END, {FLOOR}) AS cut FROM k GROUP BY user_id)"


def strikes(df, value):
    """Peaks of value by prominence, with cohorts' own percentiles."""
    found = pk.peaks(df, ["user_id"], "idx", value, DISTANCE).withColumn("cohort", F.concat(F.lit("c"), (F.col("user_id") % 4).cast("string")))
    return pk.by_prominence(found, ["user_id", "cohort"], PERCENTILE, FLOOR, "cohort", BY_COHORT)


@query(f"WITH {E}, x AS (SELECT user_id, idx, -value AS v FROM e), {peaks_sql('x', 'k', DISTANCE)}, {CUT_SQL} SELECT user_id, {COHORT} AS cohort, idx, round(height, 6) AS height, round(prominence, 6) AS prominence FROM k JOIN q USING (user_id) WHERE prominence >= cut")
def g6_heel_strikes(spark, sf):
    """Peaks of the inverted vertical value whose prominence reaches the percentile of the trial's (or cohort's own) and the floor."""
    return rounded(strikes(events(spark, sf), -F.col("value")), "height", "prominence")


@query(f"WITH {E}, x AS (SELECT user_id, idx, value AS v FROM e), c AS (SELECT user_id, quantile_cont(v, {PERCENTILE / 100}) AS cut FROM x GROUP BY 1), {peaks_sql('x', 'k', DISTANCE, '(SELECT cut FROM c WHERE c.user_id = z.user_id)')} SELECT user_id, idx, round(height, 6) AS height FROM k")
def g6_height_peaks(spark, sf):
    """Peaks from the trial's percentile of heights on."""
    return rounded(pk.peaks(events(spark, sf), ["user_id"], "idx", F.col("value"), DISTANCE, PERCENTILE).drop("prominence"), "height")


@query(f"""WITH {E}, x AS (SELECT user_id, idx, -value AS v FROM e), {peaks_sql('x', 'k', DISTANCE)}, {CUT_SQL}, t AS (SELECT user_id, idx, -abs(value) AS v FROM e), {peaks_sql('t', 'o', DISTANCE)}
SELECT e.user_id, e.idx, CASE WHEN k.idx IS NULL THEN 0 ELSE 1 END AS heel_strike, CASE WHEN o.idx IS NULL THEN 0 ELSE 1 END AS toe_off FROM e
LEFT JOIN (SELECT k.* FROM k JOIN q USING (user_id) WHERE prominence >= cut) k ON k.user_id = e.user_id AND k.idx = e.idx LEFT JOIN o ON o.user_id = e.user_id AND o.idx = e.idx""")
def g7_toe_offs(spark, sf):
    """Every row with its flags: strikes, and toe-offs as peaks of the negated resultant."""
    e = events(spark, sf).select("user_id", "idx", "value")
    flagged = pk.flagged(e, strikes(e, -F.col("value")), ["user_id"], "idx", "heel_strike")
    return pk.flagged(flagged, pk.peaks(e, ["user_id"], "idx", -F.abs("value"), DISTANCE), ["user_id"], "idx", "toe_off").drop("value")


def motion(spark, sf):
    """Events as a sensor: acceleration, rates and field out of each value and its neighbours."""
    w = Window.partitionBy("user_id").orderBy("idx")
    x, before, after = F.col("value"), F.coalesce(F.lag("value").over(w), F.col("value")), F.coalesce(F.lead("value").over(w), F.col("value"))
    columns = {"ax": x, "ay": before, "az": F.abs(x) + 1, "gx": (after - before) / 2, "gy": x - before, "gz": after - x, "mx": after, "my": x, "mz": F.lit(20.0)}
    return events(spark, sf).select("user_id", "idx", *(v.alias(k) for k, v in columns.items()))


ACC, GYR, MAG = ["ax", "ay", "az"], ["gx", "gy", "gz"], ["mx", "my", "mz"]


@query()
def g8_orientation(spark, sf):
    """Quaternions and angles by rates and gravity."""
    return fu.orientation(motion(spark, sf), ["user_id"], "idx", ACC, GYR, 0.01)


@query()
def g8_orientation_by_field(spark, sf):
    """The same with the magnetic field."""
    return fu.orientation(motion(spark, sf), ["user_id"], "idx", ACC, GYR, 0.01, mag=MAG)


@query()
def g9_cleaning_chain(spark, sf):
    """Band-pass, orientation, gravity removal of the filtered value, and heel strikes of what is left, row by row."""
    # written, as each step reads the one before several times
    filtered = written(without_gravity(written(both_ways(spark, sf, BAND), "band-passed"), "filtered"), "without-gravity")
    clean = filtered.join(fu.orientation(motion(spark, sf), ["user_id"], "idx", ACC, GYR, 0.01).drop("quat_w", "quat_x", "quat_y", "quat_z"), ["user_id", "idx"])
    return pk.flagged(clean, strikes(filtered, -F.col("free")), ["user_id"], "idx", "heel_strike")


@query()
def g10_resample(spark, sf):
    return blocks(spark, sf, lambda x: {"value": g.resample(x, 25, 16)}, "value double", up=25, down=16)


PSD = """n AS (SELECT user_id, count(*) AS n, greatest(2, least(256, count(*) // 2)) AS seg FROM events GROUP BY 1), t AS (SELECT user_id, seg, unnest(range(0, n - seg + 1, greatest(1, seg - seg // 2))) AS start FROM n WHERE n >= seg),
c AS (SELECT user_id, seg, start, idx - start AS i, value - avg(value) OVER (PARTITION BY user_id, start) AS v FROM t JOIN e USING (user_id) WHERE idx >= start AND idx < start + seg),
h AS (SELECT *, v * (0.5 - 0.5 * cos(2 * pi() * i / seg)) AS y, unnest(range(0, seg // 2 + 1)) AS k FROM c),
p AS (SELECT user_id, seg, start, k, sum(y * cos(2 * pi() * k * i / seg)) ** 2 + sum(y * sin(2 * pi() * k * i / seg)) ** 2 AS p, sum((0.5 - 0.5 * cos(2 * pi() * i / seg)) ** 2) AS hann FROM h GROUP BY 1, 2, 3, 4),
psd AS (SELECT user_id, k * 100.0 / seg AS freq, avg(p / (100 * hann)) * max(CASE WHEN k = 0 OR 2 * k = seg THEN 1 ELSE 2 END) AS power FROM p GROUP BY 1, 2, k)"""


@query(f"WITH {E}, {PSD} SELECT user_id, round(freq, 6) AS freq, round(power, 5) AS power FROM psd")
def f14_welch(spark, sf):
    return welch(spark, sf).select("user_id", R6("freq").alias("freq"), F.round("power", 5).alias("power"))


def welch(spark, sf):
    return g.welch_psd(events(spark, sf), ["user_id"], "idx", "value", 100)


@query()
def g11_resample_check(spark, sf):
    """The band's peak frequency before and after resampling, and whether it stays within half a hertz."""
    def peak(df, fs, name, n):
        psd = g.welch_psd(df, ["user_id"], "idx", "value", fs, n=n).filter(F.col("freq").between(0.5, 20))
        return psd.groupBy("user_id").agg(F.max_by("freq", F.struct("power", -F.col("freq"))).alias(name))

    # the trial's rows go along as a key, so they are not counted again after the resampling
    e = events(spark, sf).withColumn("n", F.count("*").over(Window.partitionBy("user_id")))
    after = g.by_blocks(e, ["user_id", "n"], "idx", "value", lambda x: {"value": g.resample(x, 25, 16)}, "value double", up=25, down=16)
    both = peak(e, 100, "before", F.col("n")).join(peak(after, 156.25, "after", F.ceil(F.col("n") * 25 / 16)), "user_id")
    return both.withColumn("shift", F.abs(F.col("before") - F.col("after"))).withColumn("ok", F.col("shift") <= 0.5)


#: Locomotion and freezing bands in Hz, and the share of the filter's upper edge up to which harmonics count.
LOCOMOTION, FREEZING, HARMONICS = (0.5, 3.0), (3.0, 8.0), 0.8 * 20
SPECTRUM = f"{E}, {PSD}, w AS (SELECT user_id, round(freq, 9) AS freq, round(power, 9) AS power FROM psd)"


def welch_rounded(spark, sf):
    return welch(spark, sf).withColumns({"freq": F.round("freq", 9), "power": F.round("power", 9)})


def band_sql(low, high):
    return f"(SELECT user_id, sum((freq - before) * (power + last) / 2) AS a FROM (SELECT *, lag(freq) OVER (PARTITION BY user_id ORDER BY freq) AS before, lag(power) OVER (PARTITION BY user_id ORDER BY freq) AS last FROM w WHERE freq >= {low} AND freq < {high}) GROUP BY 1)"


@query(f"""WITH {SPECTRUM}, u AS (SELECT DISTINCT user_id FROM w) SELECT u.user_id, round(coalesce(l.a, 0), 5) AS low_power, round(coalesce(h.a, 0), 5) AS high_power, round(CASE WHEN l.a > 0 THEN coalesce(h.a, 0) / l.a END, 5) AS freezing_index
FROM u LEFT JOIN {band_sql(*LOCOMOTION)} l USING (user_id) LEFT JOIN {band_sql(*FREEZING)} h USING (user_id)""")
def f16_f18_band_power(spark, sf):
    """Power of the bands of each trial's Welch spectrum, and their ratio."""
    both = g.band_powers(welch_rounded(spark, sf), ["user_id"], {"l": LOCOMOTION, "h": FREEZING})
    return both.select("user_id", F.round("l", 5).alias("low_power"), F.round("h", 5).alias("high_power"), F.when(F.col("l") > 0, F.round(F.col("h") / F.col("l"), 5)).alias("freezing_index"))


@query(f"""WITH {SPECTRUM}, top AS (SELECT user_id, arg_max(freq, (power, -freq)) AS dominant FROM w GROUP BY 1), k AS (SELECT user_id, dominant, unnest(range(1, 7)) AS k FROM top), q AS (SELECT k.user_id, k.k, arg_min(power, (abs(freq - dominant * k.k), freq)) AS p FROM k JOIN w USING (user_id) WHERE dominant > 0 AND dominant * k.k < {HARMONICS} GROUP BY 1, 2)
SELECT top.user_id, round(dominant, 6) AS dominant, round(CASE WHEN sum(p) > 0 THEN sum(CASE WHEN k % 2 = 0 THEN p ELSE 0 END) / (sum(CASE WHEN k % 2 = 1 THEN p ELSE 0 END) + 1e-10) END, 5) AS ratio FROM top LEFT JOIN q USING (user_id) GROUP BY 1, 2""")
def f17_harmonic_ratio(spark, sf):
    """Even against odd harmonics of each trial's dominant frequency in its Welch spectrum."""
    return g.harmonic_ratio(welch_rounded(spark, sf), ["user_id"], HARMONICS).withColumn("ratio", F.round("ratio", 5)).withColumn("dominant", R6("dominant"))


@query(f"""WITH {E}, t AS (SELECT user_id, count(*) AS n, unnest(range(0, count(*) - 20 + 1, 5)) AS start FROM events GROUP BY 1 HAVING count(*) >= 20), c AS (SELECT user_id, start, idx - start AS i, value - avg(value) OVER (PARTITION BY user_id, start) AS v FROM t JOIN e USING (user_id) WHERE idx BETWEEN start AND start + 19),
h AS (SELECT *, v * (0.5 - 0.5 * cos(2 * pi() * i / 20)) AS y, unnest([1, 2, 3, 4, 5, 6, 7, 8, 9]) AS k FROM c), p AS (SELECT user_id, start, k, sum(y * cos(2 * pi() * k * i / 20)) ** 2 + sum(y * sin(2 * pi() * k * i / 20)) ** 2 AS p FROM h GROUP BY 1, 2, 3),
a AS (SELECT user_id, start, k >= 4 AS hi, (p + lag(p) OVER w) / 2 AS a FROM p WINDOW w AS (PARTITION BY user_id, start, k >= 4 ORDER BY k)), f AS (SELECT user_id, start, sum(a) FILTER (WHERE hi) AS hi, sum(a) FILTER (WHERE NOT hi) AS lo FROM a GROUP BY 1, 2),
n AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1)
SELECT e.user_id, e.idx, round(CASE WHEN lo > 0 THEN hi / lo END, 5) AS freezing_index FROM e JOIN n USING (user_id) JOIN f ON f.user_id = e.user_id AND f.start = least(e.idx // 5, (n - 20) // 5) * 5 WHERE n >= 20""")
def f19_freezing_series(spark, sf):
    """Windows of 20 samples, 5 apart, at 20 Hz: bins of 1 Hz, locomotion below 4 Hz and freezing from there to 10 Hz."""
    x = g.freezing_series(events(spark, sf), ["user_id"], "idx", "value", 20.0, 20, 5, (1.0, 4.0), (4.0, 10.0))
    return x.withColumn("freezing_index", F.round("freezing_index", 5))


ANGLES = "x AS (SELECT user_id, idx, value / 100 AS tilt, value / 150 AS pitch, value / 200 AS roll FROM e)"


def angles(spark, sf):
    return events(spark, sf).select("user_id", "idx", (F.col("value") / 100).alias("tilt"), (F.col("value") / 150).alias("pitch"), (F.col("value") / 200).alias("roll"))


@query(f"""WITH {E}, {ANGLES}, r AS (SELECT *, abs(degrees(tilt) - degrees(lag(tilt) OVER (PARTITION BY user_id ORDER BY idx))) * 100 AS rate FROM x)
SELECT user_id, round(avg(degrees(tilt)), 5) AS tilt_mean, round(stddev_pop(degrees(tilt)), 5) AS tilt_sd, round(max(degrees(tilt)) - min(degrees(tilt)), 5) AS tilt_range, round(stddev_pop(degrees(pitch)), 5) AS pitch_sd, round(stddev_pop(degrees(roll)), 5) AS roll_sd, round(avg(rate), 4) AS sway FROM r GROUP BY 1""")
def f3_orientation_summary(spark, sf):
    s = g.orientation_summary(angles(spark, sf), ["user_id"], ["idx"], "tilt", "pitch", "roll", 100)
    return s.withColumns({c: F.round(c, 4 if c == "sway" else 5) for c in s.columns[1:]})


@query("""WITH e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k, value FROM events), s AS (SELECT a.user_id, sqrt(avg(a.value ** 2)) AS l, sqrt(avg(b.value ** 2)) AS r FROM e a JOIN e b ON a.user_id = b.user_id AND a.k = b.k AND a.event_type = 'click' AND b.event_type = 'view' GROUP BY 1)
SELECT user_id, round(abs(l - r) / (l + r + 1e-10), 6) AS asymmetry, round(100 * abs(l - r) / (0.5 * (l + r) + 1e-10), 5) AS symmetry_index FROM s""")
def f5_rms_asymmetry(spark, sf):
    e = table(spark, sf, "events").withColumn("k", F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")))
    a = g.rms_asymmetry(e.filter("event_type = 'click'"), e.filter("event_type = 'view'"), ["user_id"], "k", "value")
    return a.withColumn("asymmetry", R6("asymmetry")).withColumn("symmetry_index", F.round("symmetry_index", 5))


@query(f"""WITH {E}, s AS (SELECT user_id, idx // 10 AS seg, idx % 10 AS k, value / 100 AS v, count(*) OVER (PARTITION BY user_id, idx // 10) AS n FROM e), c AS (SELECT *, sum(v * 0.01) OVER (PARTITION BY user_id, seg ORDER BY k) AS angle, sum(v * 0.01) OVER (PARTITION BY user_id, seg) AS last FROM s WHERE n >= 4),
r AS (SELECT user_id, seg, max(degrees(angle - last * k / (n - 1))) - min(degrees(angle - last * k / (n - 1))) AS rom FROM c GROUP BY 1, 2) SELECT user_id, round(avg(rom), 6) AS rom, count(*) AS n FROM r GROUP BY 1""")
def f13_range_of_motion(spark, sf):
    e = events(spark, sf).select("user_id", "idx", (F.col("value") / 100).alias("rate"), F.floor(F.col("idx") / 10).alias("segment"))
    return g.range_of_motion(e, ["user_id"], "segment", "idx", "rate", 0.01).withColumn("rom", R6("rom"))


@query(f"""WITH {E}, s AS (SELECT user_id, count(*) AS n, avg(value) AS m, stddev_pop(value) * 0.2 AS tol FROM events GROUP BY 1), t AS (SELECT e.user_id, idx AS k, n, tol, value AS x0, lead(value) OVER w AS x1, lead(value, 2) OVER w AS x2 FROM e JOIN s USING (user_id) WHERE n >= 4 AND tol > 0 WINDOW w AS (PARTITION BY e.user_id ORDER BY idx)),
p AS (SELECT a.user_id, a.k, a.n, a.k <= a.n - 3 AS goes, sum((a.k <> b.k AND a.k <= a.n - 3 AND b.k <= a.n - 3)::INT) AS c0, sum((a.k <> b.k AND a.k <= a.n - 3 AND b.k <= a.n - 3 AND abs(a.x2 - b.x2) <= a.tol)::INT) AS c1, count(*) AS c2, sum((a.k <= a.n - 3 AND b.k <= a.n - 3 AND abs(a.x2 - b.x2) <= a.tol)::INT) AS c3
  FROM t a JOIN t b ON a.user_id = b.user_id AND a.k <= a.n - 2 AND b.k <= b.n - 2 AND abs(a.x0 - b.x0) <= a.tol AND abs(a.x1 - b.x1) <= a.tol GROUP BY 1, 2, 3, 4)
SELECT user_id, round(CASE WHEN sum(c1) > 0 AND sum(c0) > 0 THEN -ln(sum(c1) / sum(c0)) END, 6) AS sample_entropy, round(avg(ln(c2 / (n - 1))) - avg(ln(c3 / (n - 2))) FILTER (WHERE goes), 6) AS approximate_entropy FROM p GROUP BY 1""")
def f24_entropies(spark, sf):
    x = g.entropies(events(spark, sf), ["user_id"], "idx", "value")
    return x.withColumns({c: R6(c) for c in ("sample_entropy", "approximate_entropy")})


@query(f"""WITH {E}, s AS (SELECT user_id, count(*) AS n, avg(value) AS m FROM events GROUP BY 1), y AS (SELECT e.user_id, idx AS k, n, sum(value - m) OVER (PARTITION BY e.user_id ORDER BY idx) AS y FROM e JOIN s USING (user_id)),
c AS (SELECT DISTINCT user_id, n, unnest([floor(4 * pow(greatest(5, n // 4) / 4.0::DOUBLE, i / 11.0::DOUBLE) + 1e-9)::BIGINT for i in range(0, 12)]) AS scale FROM s), b AS (SELECT y.user_id, scale, k // scale AS b, k % scale AS t, y FROM y JOIN c USING (user_id) WHERE c.n // scale >= 2 AND k < (c.n // scale) * scale),
r AS (SELECT user_id, scale, b, regr_syy(y, t) - regr_sxy(y, t) ** 2 / regr_sxx(y, t) AS rest FROM b GROUP BY 1, 2, 3), f AS (SELECT user_id, scale, 0.5 * ln(sum(rest) / (count(*) * scale)) AS f FROM r GROUP BY 1, 2)
SELECT user_id, round(CASE WHEN count(*) > 1 THEN regr_slope(f, ln(scale)) END, 5) AS dfa FROM f GROUP BY 1""")
def f25_dfa(spark, sf):
    return g.dfa_exponent(events(spark, sf), ["user_id"], "idx", "value").withColumn("dfa", F.round("dfa", 5))


@query(f"""WITH {E}, s AS (SELECT user_id, count(*) AS n, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1 HAVING max(value) > min(value)), p AS (SELECT a.user_id, b.idx - a.idx AS lag, n, (n - (b.idx - a.idx))::DOUBLE AS m, greatest(16, floor(sqrt(n - (b.idx - a.idx)))) AS bins, (a.value - lo) / (hi - lo) AS x, (b.value - lo) / (hi - lo) AS y
  FROM e a JOIN e b ON a.user_id = b.user_id AND b.idx BETWEEN a.idx + 1 AND a.idx + 50 JOIN s ON s.user_id = a.user_id WHERE b.idx - a.idx <= least(50, greatest(2, n // 10)) AND n > b.idx - a.idx + 20),
c AS (SELECT user_id, lag, m, least(floor(x * bins), bins - 1) AS x, least(floor(y * bins), bins - 1) AS y, count(*) AS c FROM p GROUP BY 1, 2, 3, 4, 5), q AS (SELECT *, sum(c) OVER (PARTITION BY user_id, lag, x) AS px, sum(c) OVER (PARTITION BY user_id, lag, y) AS py FROM c),
i AS (SELECT user_id, lag, round(sum(c / m * ln(c * m / (px * py))), 9) AS ami FROM q GROUP BY 1, 2), l AS (SELECT *, ami < lag(ami) OVER w AND ami < lead(ami) OVER w AS low FROM i WINDOW w AS (PARTITION BY user_id ORDER BY lag))
SELECT user_id, coalesce(min(lag) FILTER (WHERE low), arg_min(lag, (ami, lag))) AS delay, round(min(ami), 5) AS least FROM l GROUP BY 1""")
def f21_embedding_delay(spark, sf):
    ami = g.mutual_information(events(spark, sf), ["user_id"], "idx", "value")
    least = ami.groupBy("user_id").agg(F.round(F.min("ami"), 5).alias("least"))
    return g.embedding_delay(ami, ["user_id"]).join(least, "user_id")


@query("""WITH w AS (SELECT user_id, ts, time_bucket(INTERVAL '1 day', ts) AS day, value FROM events), i AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY ts, value) - 1 AS i, count(*) OVER (PARTITION BY user_id, day) AS n, value - avg(value) OVER (PARTITION BY user_id, day) AS v FROM w),
h AS (SELECT *, v * (0.5 - 0.5 * cos(2 * pi() * i / n)) AS y, unnest(range(1, n // 2 + 1)) AS k FROM i WHERE n >= 8), p AS (SELECT user_id, day, k * 20.0 / n AS freq, sum(y * cos(2 * pi() * k * i / n)) ** 2 + sum(y * sin(2 * pi() * k * i / n)) ** 2 AS p FROM h GROUP BY user_id, day, k, n)
SELECT user_id, day::DATE AS day, round(CASE WHEN sum(p) FILTER (WHERE freq >= 1 AND freq < 4) > 0 THEN coalesce(sum(p) FILTER (WHERE freq >= 4 AND freq < 10), 0) / sum(p) FILTER (WHERE freq >= 1 AND freq < 4) END, 4) AS freezing_index FROM p GROUP BY 1, 2""")
def z2_freezing_windows(spark, sf):
    """The batch form of the streamed index of event-time windows."""
    from kinespark.streaming.streams import freezing_windows

    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = freezing_windows(e, "user_id", "ts", "value", "1 day", 20.0, (1.0, 4.0), (4.0, 10.0))
    return w.select("user_id", F.to_date("window.start").alias("day"), F.round("freezing_index", 4).alias("freezing_index"))


@query("""WITH t AS (SELECT user_id, sqrt(avg(value * value)) AS rms, max(value) - min(value) AS range, stddev_pop(value) AS sd FROM events WHERE isfinite(value) GROUP BY 1 HAVING count(*) >= 10), p AS (SELECT *, 1 / (1 + exp(-(rms - 80) / 20)) AS p FROM t)
SELECT user_id, round(p, 6) AS risk, CASE WHEN p >= 0.6 THEN 'high' WHEN p >= 0.3 THEN 'moderate' ELSE 'low' END AS band, (rms > 80)::INT + (range > 200)::INT + (sd > 40)::INT AS votes FROM p""")
def z4_trial_scores(spark, sf):
    """The batch form of micro-batch scoring: clean, features, score, band, vote."""
    from kinespark.streaming.streams import trial_scores

    return trial_scores(events(spark, sf), "user_id", ["idx"], "value").withColumn("risk", R6("risk"))


FALSE = f"""{E}, t AS (SELECT user_id, idx AS i, value AS x0, lead(value) OVER w AS x1, lead(value, 2) OVER w AS x2 FROM e WINDOW w AS (PARTITION BY user_id ORDER BY idx)), k AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM t WHERE x2 IS NOT NULL),
s AS (SELECT user_id, avg(sqrt((x0 - m0) ** 2 + (x1 - m1) ** 2)) AS spread FROM k JOIN (SELECT user_id, avg(x0) AS m0, avg(x1) AS m1 FROM k GROUP BY 1) USING (user_id) GROUP BY 1),
p AS (SELECT a.user_id, a.i, min((a.x0 - b.x0) ** 2 + (a.x1 - b.x1) ** 2) AS d, arg_min(abs(a.x2 - b.x2), ((a.x0 - b.x0) ** 2 + (a.x1 - b.x1) ** 2, b.i)) AS gap FROM k a JOIN k b ON a.user_id = b.user_id AND abs(a.i - b.i) > 1 WHERE a.n >= 20 GROUP BY 1, 2)"""


@query(f"""WITH {FALSE}, f AS (SELECT user_id, avg((gap / sqrt(d) > 10 OR gap > 2 * spread)::INT) AS f FROM p JOIN s USING (user_id) WHERE d > 0 GROUP BY 1) SELECT DISTINCT e.user_id, round(coalesce(f, 1), 6) AS false_share FROM e LEFT JOIN f USING (user_id)""")
def f22_false_neighbours(spark, sf):
    """Two dimensions, one row apart."""
    return rounded(dl.false_neighbours(events(spark, sf), ["user_id"], "idx", "value", F.lit(1), F.lit(2)), "false_share")


def with_delay(spark, sf):
    """Samples with their trial's own delay (F21)."""
    e = events(spark, sf).select("user_id", "idx", "value")
    return e.join(g.embedding_delay(g.mutual_information(e, ["user_id"], "idx", "value"), ["user_id"]), "user_id")


@query()
def f22_embedding_dimension(spark, sf):
    """Each trial's smallest dimension with few false neighbours, at its own delay."""
    return dl.embedding_dimension(with_delay(spark, sf), ["user_id"], "idx", "value", F.col("delay"))


@query()
def f23_lyapunov(spark, sf):
    """The exponent at each trial's own delay and dimension."""
    x = with_delay(spark, sf)
    x = x.join(dl.embedding_dimension(x, ["user_id"], "idx", "value", F.col("delay")), "user_id")
    return dl.divergence(x, ["user_id"], "idx", "value", F.col("delay"), F.col("dim"), 8)


@query()
def f20_wavelet_energies(spark, sf):
    return kernel(spark, sf, g.wavelet_energies, "band string, energy double, share double, entropy double")


@query(f"WITH {E}, {PSD}, q AS (SELECT *, power / sum(power) OVER (PARTITION BY user_id) AS p FROM psd) SELECT user_id, round(arg_max(freq, (round(power, 9), -freq)), 6) AS dominant, round(sum(freq * power) / sum(power), 5) AS centroid, round(-sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END), 5) AS entropy FROM q GROUP BY 1")
def f15_welch_shape(spark, sf):
    psd = welch(spark, sf).withColumn("power", F.round("power", 9))
    return g.spectrum_shape(psd, ["user_id"]).select("user_id", R6("dominant").alias("dominant"), F.round("centroid", 5).alias("centroid"), F.round("entropy", 5).alias("entropy"))


@query()
def f23_f25_nonlinear(spark, sf):
    """The families side by side: entropy, scaling exponent, and divergence at a fixed delay and dimension."""
    e = events(spark, sf)
    made = g.entropies(e, ["user_id"], "idx", "value").select("user_id", "sample_entropy").join(g.dfa_exponent(e, ["user_id"], "idx", "value"), "user_id", "full")
    return made.join(dl.divergence(e, ["user_id"], "idx", "value", F.lit(2), F.lit(3), 8), "user_id", "full").select("user_id", "sample_entropy", "dfa", "lyapunov")


@query(f"""WITH {E}, {ANGLES}, j AS (SELECT user_id, value, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY idx)) AS j FROM e), t AS (SELECT user_id, sqrt(avg(value * value)) AS rms, max(value) - min(value) AS range, avg(j) AS mean_jerk FROM j GROUP BY 1), o AS (SELECT user_id, stddev_pop(degrees(tilt)) AS tilt_sd FROM x GROUP BY 1),
b AS (SELECT user_id, avg(r) AS block_rms_mean FROM (SELECT user_id, idx // 10 AS b, sqrt(avg(value * value)) AS r FROM e GROUP BY 1, 2 HAVING count(*) = 10) GROUP BY 1)
SELECT user_id, round(rms, 5) AS rms, round(range, 5) AS range, round(mean_jerk, 5) AS mean_jerk, round(tilt_sd, 5) AS tilt_sd, round(block_rms_mean, 5) AS block_rms_mean FROM t LEFT JOIN o USING (user_id) LEFT JOIN b USING (user_id)""")
def f28_full_extraction(spark, sf):
    """All families of a trial's features in long form, then one row a trial."""
    e = events(spark, sf)
    wanted = ["rms", "range", "mean_jerk", "tilt_sd", "block_rms_mean"]
    families = (g.time_features(e, ["user_id"], ["idx"], "value"), g.orientation_summary(angles(spark, sf), ["user_id"], ["idx"], "tilt", "pitch", "roll", 100), g.block_rms(e, ["user_id"], "idx", "value", 10))
    long = None
    for f in families:
        part = f.unpivot(["user_id"], [c for c in wanted if c in f.columns], "feature", "value")
        long = part if long is None else long.unionByName(part)
    return long.groupBy("user_id").pivot("feature", wanted).agg(F.round(F.first("value"), 5))


@query()
def f26_f27_fixed_kernels(spark, sf):
    """About 10,000 features of fixed kernels for every window, pooled over the windows of a class."""
    e = table(spark, sf, "embeddings")
    made = kn.kernel_shares(e, "embedding", kn.fit_bank(e, "vec_id", "embedding"))
    return kn.pooled(made, "label", "features")


@query()
def f26_f27_kernel_features(spark, sf):
    """Random-kernel features of 64-sample windows, meaned by class. The bank is seeded and small."""
    bank = g.kernel_bank(7, 50, 64)

    def run(batches):
        for pdf in batches:
            x = np.stack(pdf["embedding"].to_numpy()).astype(float) if len(pdf) else np.zeros((0, 64))
            f = g.kernel_features(x, bank) if len(pdf) else np.zeros((0, 100))
            yield pd.DataFrame({"label": pdf["label"], "largest": f[:, ::2].mean(1), "positive": f[:, 1::2].mean(1)})

    e = table(spark, sf, "embeddings").select("label", "embedding")
    return e.mapInPandas(run, "label int, largest double, positive double").groupBy("label").agg(F.avg("largest").alias("largest"), F.avg("positive").alias("positive"))
