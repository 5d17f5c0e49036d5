"""Mixing sources to target weights by weighted fair queueing.

Every document of a source waits in a shuffled queue. A document's virtual finish time is the words its source has sent
up to and including it, divided by the source's target; a source that must repeat queues again behind its last document.
The mix is the documents of all sources in order of finish time until the budget is spent. Sources reach time 1 with
their targets met, so the cut falls near 1 for all of them.

Running totals are made in two steps, so that no source and no order needs one task: totals of buckets (of the shuffle
hash within a source; of finish time over all), then a window inside each bucket. The range of finish time in which the
budget ends is narrowed until it holds few rows. Shuffle order comes from md5 of the id and the text's hash, so reruns agree.
What reaches the driver is a row a source and the totals of FINE ranges: a table of more than MAX_SOURCES sources is refused.

Defined results: a null or empty text has size 0 and is never taken; a null source is a source of its own, the last;
rows alike in id, text and source travel together; a table without words takes nothing. Other columns are kept by mix().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinespark.llm.common import stored

#: Rows that a bucket of a source's queue or of the finish order is meant to hold.
BUCKET_ROWS = 4_000
#: The table of sources is broadcast up to this many, else joined by shuffle.
BROADCAST_SOURCES = 50_000
#: A source column with more values than this is taken for a mistake.
MAX_SOURCES = 1_000_000
#: Ranges of finish time whose totals the driver sees at once.
FINE = 1 << 12


def n_words(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = (1, 2, 3), max_repeat: float = 3.0, share: float = 1.0) -> dict[str | None, float]:
    """Words to take from each source: weights repeat over the sources by code point, null last.

    A source gives at most max_repeat times its size; the excess goes to the others by weight until none is above.
    """
    order = sorted(sizes, key=lambda x: (x[0] is None, (x[0] or "").encode("utf-32-be")))
    weight = {s: weights[k % len(weights)] for k, (s, _) in enumerate(order)}
    size, left, free, target = dict(order), share * sum(n for _, n in order), [s for s, _ in order], {}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > max_repeat * size[s]]
        if not over:
            return target | {s: left * weight[s] / total for s in free}
        for s in over:
            target[s] = float(max_repeat * size[s])
        left -= sum(target[s] for s in over)
        free = [s for s in free if s not in target]
    return target


def running(df: DataFrame, group: str, bucket: str, order: list[Column], value: str, into: str) -> DataFrame:
    """Running total of value by group in the order of bucket and then order, each row included."""
    sums = df.groupBy(group, bucket).agg(F.sum(value).alias("__sum"))
    before = sums.select(group, bucket, (F.sum("__sum").over(Window.partitionBy(group).orderBy(bucket)) - F.col("__sum")).alias("__before"))
    inner = F.sum(value).over(Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("__inner", inner).join(before, [group, bucket]).withColumn(into, F.col("__before") + F.col("__inner")).drop("__before", "__inner")


def row_key(docs: DataFrame, text_col: str, source_col: str) -> Column:
    return F.xxhash64(docs[text_col].cast("string"), docs[source_col].cast("string"))


def schedule(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (1, 2, 3), max_repeat: int = 3, share: float = 1.0) -> DataFrame:
    """(id, row_key, size, twins, source, source_size, target, copies) of the documents.

    copies is how often the mix takes a document. Rows alike in id, text and source are one entry with their number in
    twins, and travel together.
    """
    spark = docs.sparkSession
    thin = docs.select(docs[id_col].alias("__id"), row_key(docs, text_col, source_col).alias("__row"), docs[source_col].cast("string").alias("__source"), n_words(docs[text_col].cast("string")).alias("__size"))
    thin = stored(thin.groupBy("__id", "__row", "__source", "__size").agg(F.count("*").alias("__twins")).withColumn("__words", F.col("__size") * F.col("__twins")), "mix-sizes")
    # what comes to the driver is a row a source
    by_source = [(r["__source"], r["n"], r["rows"]) for r in thin.groupBy("__source").agg(F.sum("__words").alias("n"), F.count("*").alias("rows")).limit(MAX_SOURCES + 1).collect()]
    if len(by_source) > MAX_SOURCES:
        raise ValueError(f"{source_col} has more than {MAX_SOURCES} values")
    target = targets([(s, n) for s, n, _ in by_source], weights, max_repeat, share)
    plan = spark.createDataFrame([(k, s, n, float(target[s]), max(1, -(-r // BUCKET_ROWS))) for k, (s, n, r) in enumerate(by_source)], "__no int, __s string, __source_size long, __target double, __buckets long")
    plan = F.broadcast(plan) if len(by_source) <= BROADCAST_SOURCES else plan
    # a fixed shuffle: order by 60 bits of md5, whose ranges are the buckets
    place = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("__id").cast("string"), F.col("__row").cast("string"))), 1, 15), 16, 10).cast("long")
    known = thin.join(plan, F.col("__source").eqNullSafe(F.col("__s"))).withColumn("__place", place)
    known = known.withColumn("__bucket", F.floor(F.col("__place") / F.lit(float(1 << 60)) * F.col("__buckets"))).drop("__s", "__buckets")
    queued = stored(running(known, "__no", "__bucket", [F.col("__place"), F.col("__id"), F.col("__row")], "__words", "__sent"), "mix-queues")
    turn = F.explode(F.sequence(F.lit(0), F.lit(max_repeat - 1)))
    turns = queued.filter("__words > 0 and __target > 0").withColumn("__turn", turn)
    turns = turns.withColumn("__finish", (F.col("__turn") * F.col("__source_size") + F.col("__sent")) / F.col("__target"))
    budget = round(share * sum(n for _, n, _ in by_source))
    taken = before_cut(turns.select("__id", "__row", "__source", "__turn", "__finish", "__words"), budget)
    copies = taken.groupBy(F.col("__id").alias("__i"), F.col("__row").alias("__r"), F.col("__source").alias("__s")).agg(F.count("*").alias("__taken"))
    same = F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__row") == F.col("__r")) & F.col("__source").eqNullSafe(F.col("__s"))
    done = queued.join(copies, same, "left")
    return done.select(F.col("__id").alias(id_col), F.col("__row").alias("row_key"), F.col("__size").alias("size"), F.col("__twins").alias("twins"), F.col("__source").alias(source_col), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), F.coalesce("__taken", F.lit(0)).cast("long").alias("copies"))


def before_cut(turns: DataFrame, budget: int, fine: int = FINE, few: int = BUCKET_ROWS) -> DataFrame:
    """The turns, in order of finish time, until the budget is spent.

    Totals of ranges of finish time tell in which range the budget ends; that range is cut again until few rows are left or
    all of one time (a source has a time once, so these are no more than the sources). They are ordered exactly.
    """
    bounds = turns.agg(F.min("__finish"), F.max("__finish")).first()
    if bounds[0] is None:
        return turns
    low, high, spent = bounds[0], bounds[1], 0
    inside = turns
    while True:
        width = (high - low) / fine
        step = F.least(F.floor((F.col("__finish") - F.lit(low)) / F.lit(width)), F.lit(fine - 1)) if width > 0 else F.lit(0)
        ranges = inside.groupBy(step.cast("long").alias("k")).agg(F.sum("__words").alias("n"), F.count("*").alias("rows"), F.min("__finish").alias("low"), F.max("__finish").alias("high"))
        cut = None
        for r in sorted(ranges.collect()):
            if spent + r["n"] > budget:
                cut = r
                break
            spent += r["n"]
        if cut is None:
            return turns
        low, high = cut["low"], cut["high"]
        inside = turns.filter(F.col("__finish").between(low, high))
        if cut["rows"] <= few or low == high:
            break
    in_range = Window.orderBy("__finish", F.col("__source").asc_nulls_last(), "__id", "__row", "__turn").rowsBetween(Window.unboundedPreceding, 0)
    last = inside.withColumn("__spent", F.sum("__words").over(in_range) + F.lit(spent)).filter(F.col("__spent") <= budget).drop("__spent")
    return turns.filter(F.col("__finish") < low).unionByName(last)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix itself: rows of docs, each as often as it is taken, with the columns of docs."""
    taken = schedule(docs, id_col, text_col, source_col, **how).filter("copies > 0")
    taken = taken.select(F.col(id_col).alias("__i"), F.col("row_key").alias("__r"), F.sequence(F.lit(1), F.col("copies").cast("int")).alias("__copies"))
    same = docs[id_col].eqNullSafe(taken["__i"]) & (row_key(docs, text_col, source_col) == taken["__r"])
    return docs.join(taken, same).withColumn("__copy", F.explode("__copies")).select(*(docs[c] for c in docs.columns))
