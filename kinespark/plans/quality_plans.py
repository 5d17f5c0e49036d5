"""Data-quality queries on the given tables: users as trials, event types as sensors, order lines as packet counters."""

from pyspark.sql import functions as F

from kinespark.operators import quality as q
from kinespark.plans.register import query, table

E = "e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx FROM events)"
L = "(PARTITION BY o_custkey ORDER BY o_orderkey)"


def seconds():
    return F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)


def holed(spark, sf):
    """Events with holes: a value is missing where the id is a multiple of 7."""
    e = table(spark, sf, "events")
    w = F.row_number().over(_by_user())
    return e.select("user_id", "event_type", "ts", "event_id", (w - 1).alias("idx"), F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("v"))


def _by_user():
    from pyspark.sql import Window

    return Window.partitionBy("user_id").orderBy("ts", "event_id")


HOLES = "h AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, CASE WHEN event_id % 7 <> 0 THEN value END AS v FROM events)"


@query(f"""WITH s AS (SELECT o_custkey, row_number() OVER {L} - 1 AS idx, lag(o_orderkey) OVER {L} AS prev, o_orderkey AS "next" FROM orders)
SELECT o_custkey, idx, prev, "next", "next" - prev AS diff FROM s WHERE "next" - prev <> 1 AND NOT (prev >= 60000 AND "next" <= 1000)""")
def q1_counter_gaps(spark, sf):
    return q.counter_gaps(table(spark, sf, "orders"), ["o_custkey"], ["o_orderkey"], "o_orderkey")


@query(f"""WITH s AS (SELECT o_custkey, row_number() OVER {L} - 1 AS idx, o_orderkey - lag(o_orderkey) OVER {L} AS diff, lag(o_orderkey) OVER {L} AS prev, o_orderkey AS nxt FROM orders),
g AS (SELECT * FROM s WHERE diff <> 1 AND NOT (prev >= 60000 AND nxt <= 1000))
SELECT o_custkey, count(*) AS n_gaps, max(diff) AS max_gap, string_agg(idx::VARCHAR, ',' ORDER BY idx) AS at FROM g GROUP BY 1""")
def q2_gap_summary(spark, sf):
    return q.gap_summary(q.counter_gaps(table(spark, sf, "orders"), ["o_custkey"], ["o_orderkey"], "o_orderkey"), ["o_custkey"])


COUNTED = """l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n, l_quantity::DOUBLE AS v, ((CASE WHEN l_orderkey % 4 < 2 THEN 100 ELSE 65533 END + CASE WHEN l_linenumber < 4 THEN l_linenumber // 2 WHEN l_orderkey % 2 = 0 THEN l_linenumber ELSE l_linenumber * 2 END) % 65536)::BIGINT AS c FROM lineitem)"""


def counted(spark, sf):
    """Order lines with a counter that repeats, skips and, in every other order, wraps."""
    steps = F.when(F.col("l_linenumber") < 4, F.floor(F.col("l_linenumber") / 2)).when(F.col("l_orderkey") % 2 == 0, F.col("l_linenumber")).otherwise(F.col("l_linenumber") * 2)
    return table(spark, sf, "lineitem").withColumn("c", (F.when(F.col("l_orderkey") % 4 < 2, 100).otherwise(65533) + steps) % 65536)


@query(f"""WITH {COUNTED}, s AS (SELECT *, row_number() OVER w - 1 AS k, lag(c) OVER w AS b FROM l WINDOW w AS (PARTITION BY l_orderkey ORDER BY n)),
f AS (SELECT l_orderkey, min(k) AS cut FROM s WHERE c - b > 3 OR (c < b AND NOT (b >= 60000 AND c <= 1000)) GROUP BY 1),
kept AS (SELECT s.*, k >= coalesce(cut, 1000000) AS ended FROM s LEFT JOIN f USING (l_orderkey) WHERE k >= coalesce(cut, 1000000) OR b IS NULL OR c <> b),
p AS (SELECT *, lag(v) OVER w AS pv, lag(k) OVER w AS pat FROM kept WINDOW w AS (PARTITION BY l_orderkey ORDER BY k)),
m AS (SELECT *, unnest(range(1, c - b)) AS i FROM p WHERE NOT ended AND c > b + 1)
SELECT l_orderkey, k::DOUBLE AS place, c AS counter, v AS value, false AS filled FROM p
UNION ALL SELECT l_orderkey, pat + i / (c - b), b + i, (1 - i / (c - b)) * pv + i / (c - b) * v, true FROM m""")
def q3_gap_repair(spark, sf):
    return q.repair_gaps(counted(spark, sf), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], "c", "l_quantity", 3)


@query(f"""WITH s AS (SELECT o_custkey, o_orderkey, coalesce(o_orderkey - lag(o_orderkey) OVER {L} > 200, false) AS big FROM orders),
t AS (SELECT *, max(big::INT) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS aft FROM s) SELECT o_custkey, o_orderkey FROM t WHERE aft = 0""")
def q4_truncate_at_gap(spark, sf):
    return q.truncate_at_gap(table(spark, sf, "orders"), ["o_custkey"], ["o_orderkey"], "o_orderkey", 200).select("o_custkey", "o_orderkey")


@query(f"WITH {HOLES} SELECT user_id, round(avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END), 6) AS fraction, CASE WHEN avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END) > 0.15 THEN 'fail' ELSE 'pass' END AS status FROM h GROUP BY 1")
def q5_missing_fraction(spark, sf):
    share = F.avg(F.col("v").isNull().cast("double"))
    return holed(spark, sf).groupBy("user_id").agg(F.round(share, 6).alias("fraction"), F.when(share > 0.15, "fail").otherwise("pass").alias("status"))


@query(f"""WITH s AS (SELECT o_custkey, row_number() OVER {L} - 1 AS idx, o_orderkey - lag(o_orderkey) OVER {L} AS diff FROM orders)
SELECT o_custkey, CASE WHEN count(*) FILTER (WHERE diff > 100 OR diff < 0) > 0 THEN 'fail' ELSE 'pass' END AS status, min(idx) FILTER (WHERE diff > 100 OR diff < 0) AS first_bad FROM s GROUP BY 1""")
def q6_packet_check(spark, sf):
    checked = q.clock_check(table(spark, sf, "orders"), ["o_custkey"], ["o_orderkey"], F.col("o_orderkey"), 100)
    return checked.select("o_custkey", "status", "first_bad")


@query("""WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT user_id, max(n) - min(n) AS spread, round(greatest(5.0, quantile_cont(n, 0.5) * 0.1), 6) AS allowed, CASE WHEN max(n) - min(n) <= greatest(5.0, quantile_cont(n, 0.5) * 0.1) THEN 'pass' ELSE 'fail' END AS status FROM n GROUP BY 1""")
def q7_length_check(spark, sf):
    return q.length_check(table(spark, sf, "events"), "user_id", "event_type", 5, 0.1).withColumn("allowed", F.round("allowed", 6))


@query("""WITH s AS (SELECT user_id, row_number() OVER w - 1 AS idx, epoch_us(ts) / 1e6 AS s, lag(epoch_us(ts) / 1e6) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, count(*) FILTER (WHERE s - b > 86400 OR s < b) AS n_bad, min(idx) FILTER (WHERE s - b > 86400 OR s < b) AS first_bad, CASE WHEN count(*) FILTER (WHERE s - b > 86400 OR s < b) > 0 THEN 'fail' ELSE 'pass' END AS status FROM s GROUP BY 1""")
def q8_clock_check(spark, sf):
    return q.clock_check(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], seconds(), 86400)


@query(f"""WITH {HOLES}, w AS (SELECT *, last_value(v IGNORE NULLS) OVER b AS a, last_value(CASE WHEN v IS NOT NULL THEN idx END IGNORE NULLS) OVER b AS ia,
  first_value(v IGNORE NULLS) OVER f AS z, first_value(CASE WHEN v IS NOT NULL THEN idx END IGNORE NULLS) OVER f AS iz FROM h
  WINDOW b AS (PARTITION BY user_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY user_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT user_id, idx, round(coalesce(v, a + (z - a) * (idx - ia) / (iz - ia), a, z), 6) AS filled FROM w""")
def q9_interpolate(spark, sf):
    return q.interpolate(holed(spark, sf), ["user_id"], "idx", "v", "filled").select("user_id", "idx", F.round("filled", 6).alias("filled"))


@query(f"""WITH {HOLES} SELECT user_id, idx, coalesce(first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
  last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS filled FROM h QUALIFY filled IS NOT NULL""")
def q10_fill(spark, sf):
    return q.fill_back_then_forward(holed(spark, sf), ["user_id"], "idx", "v", "filled").select("user_id", "idx", "filled")


@query(f"WITH {HOLES} SELECT h.event_id FROM h JOIN (SELECT user_id, event_type FROM h GROUP BY 1, 2 HAVING avg((v IS NULL)::INT) <= 0.15) k USING (user_id, event_type)")
def q11_drop_segments(spark, sf):
    return q.drop_segments(holed(spark, sf), ["user_id", "event_type"], F.col("v").isNull(), 0.15).select("event_id")


@query("""SELECT source, count(*) FILTER (WHERE trim(text) = '') AS n_blank, count(*) FILTER (WHERE length(text) <> n_chars) AS n_corrupt, count(*) AS n_rows FROM documents GROUP BY 1""")
def q12_row_checks(spark, sf):
    d = table(spark, sf, "documents")
    return d.groupBy("source").agg(F.count_if(F.trim("text") == "").alias("n_blank"), F.count_if(F.length("text") != F.col("n_chars")).alias("n_corrupt"), F.count("*").alias("n_rows"))


@query("""WITH s AS (SELECT user_id, event_type FROM events GROUP BY 1, 2)
SELECT user_id, coalesce(string_agg(event_type, ',' ORDER BY event_type) FILTER (WHERE event_type NOT IN ('view', 'click')), '') AS unknown, 0::BIGINT AS n_null,
  CASE WHEN count(*) FILTER (WHERE event_type NOT IN ('view', 'click')) > 0 THEN 'fail' ELSE 'pass' END AS status FROM s GROUP BY 1""")
def q13_label_domain(spark, sf):
    return q.domain_check(table(spark, sf, "events"), ["user_id"], "event_type", ["view", "click"])


@query("""WITH a AS (SELECT user_id AS trial, 'missing_values' AS "check", CASE WHEN avg((event_id % 7 = 0)::INT) > 0.15 THEN 'fail' ELSE 'pass' END AS status FROM events GROUP BY 1),
n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2),
b AS (SELECT user_id, 'length', CASE WHEN max(n) - min(n) <= greatest(5.0, quantile_cont(n, 0.5) * 0.1) THEN 'pass' ELSE 'fail' END FROM n GROUP BY 1)
SELECT * FROM a UNION ALL SELECT * FROM b""")
def q14_quality_report(spark, sf):
    values = q5_missing_fraction(spark, sf).select(F.col("user_id").alias("trial"), F.lit("missing_values").alias("check"), "status")
    lengths = q7_length_check(spark, sf).select(F.col("user_id").alias("trial"), F.lit("length").alias("check"), "status")
    return values.unionByName(lengths)


@query("""SELECT user_id, count(*) AS n, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 6) AS duration_s FROM events GROUP BY 1 HAVING count(*) >= 50 AND epoch_us(max(ts)) - epoch_us(min(ts)) >= 5e6""")
def q16_minimum_duration(spark, sf):
    t = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.max(seconds()) - F.min(seconds()), 6).alias("duration_s"))
    return t.filter("n >= 50 and duration_s >= 5")


@query("""WITH s AS (SELECT DISTINCT user_id, date_trunc('day', ts)::DATE AS day, event_type FROM events), g AS (SELECT user_id, day, list_sort(list(event_type)) AS h FROM s GROUP BY 1, 2)
SELECT user_id, day, array_to_string(h, ' ') AS present, array_to_string(list_filter(['cart', 'click', 'purchase', 'view'], lambda x: NOT list_contains(h, x)), ' ') AS missing,
  len(list_filter(['cart', 'click', 'purchase', 'view'], lambda x: NOT list_contains(h, x))) = 0 AS complete FROM g""")
def q17_missing_sensors(spark, sf):
    e = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    return q.missing_parts(e, ["user_id", "day"], "event_type", ["view", "click", "cart", "purchase"])


@query("""WITH t AS (SELECT c_mktsegment AS cohort, o_custkey, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT cohort, count(*) AS n_participants, sum(n)::BIGINT AS n_trials, count(*) FILTER (WHERE n < 2) AS n_single FROM t GROUP BY 1""")
def q18_integrity_audit(spark, sf):
    t = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return t.groupBy(F.col("c_mktsegment").alias("cohort")).agg(F.count("*").alias("n_participants"), F.sum("n").alias("n_trials"), F.count_if(F.col("n") < 2).alias("n_single"))


@query("""WITH s AS (SELECT o_custkey, count(DISTINCT o_orderstatus) AS sides, min_by(o_orderstatus, o_orderkey) AS side FROM orders GROUP BY 1)
SELECT side, count(*) AS n, count(*) FILTER (WHERE sides > 1) AS n_disagree FROM s GROUP BY 1""")
def q19_side_audit(spark, sf):
    s = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count_distinct("o_orderstatus").alias("sides"), F.min_by("o_orderstatus", "o_orderkey").alias("side"))
    return s.groupBy("side").agg(F.count("*").alias("n"), F.count_if(F.col("sides") > 1).alias("n_disagree"))


@query("""WITH f AS (SELECT count(*) AS n, count(CASE WHEN o_orderkey % 3 = 0 THEN 1 END) AS a, count(CASE WHEN o_custkey % 5 <> 0 THEN 1 END) AS b FROM orders)
SELECT 'price' AS feature, round(1 - a / n, 6) AS fraction, 1 - a / n > 0.3 AS above FROM f UNION ALL SELECT 'key', round(1 - b / n, 6), 1 - b / n > 0.3 FROM f""")
def q24_missingness(spark, sf):
    o = table(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice")).alias("price"), F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey").cast("double")).alias("key"))
    return q.missing_fractions(o, ["price", "key"], 0.3).withColumn("fraction", F.round("fraction", 6))


@query("""WITH f AS (SELECT o_orderpriority AS p, CASE WHEN o_orderkey % 3 = 0 THEN 1 END AS price, CASE WHEN o_custkey % 5 <> 0 THEN 1 END AS "key" FROM orders),
l AS (SELECT p, 'price' AS feature, price AS v FROM f UNION ALL SELECT p, 'key', "key" FROM f)
SELECT coalesce(p, 'all') AS scope, feature, round(avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END), 6) AS fraction FROM l GROUP BY GROUPING SETS ((p, feature), (feature))""")
def q25_missing_by_cohort(spark, sf):
    o = table(spark, sf, "orders").select("o_orderpriority", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice")).alias("price"), F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey").cast("double")).alias("key"))
    return q.missing_by_group(o, "o_orderpriority", ["price", "key"]).withColumn("fraction", F.round("fraction", 6))
