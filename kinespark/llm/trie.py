"""A trie of conversations' prefixes, by van Emde Boas recursion over turns.

Sequences are cut at half the depth: the prefix up to the cut gets a name, and the trie above the cut and the forests below,
one for each name, are built in parallel by the same recursion, until a piece is one turn. A cut's name is the digest of the
name above it and of the turns between, and digests of runs of turns are made of those of their halves. All pieces of one
size are worked on together, so a trie of depth D takes about log2(D) rounds; every turn is named in one of them.

Subtree totals are grafted upward in the opposite order: where totals of forests of depth s are known, those below a cut are
added to the s turns above it, on the path of the cut's smallest member, which doubles the depth.

Every step is a join or an aggregate by (conversation, depth) or by name: a long conversation is spread over all tasks, and
a prefix that a third of all conversations share is added up in the tasks before the shuffle. Ids that end at a node are
joined by ranges of ENDS_RANGE ids and digested from a sorted stream of these, as sha256 must be fed in order, so no list of
members is ever held.

Defined results: turns go by number (null first), then by role and by the digest of role and text, repeated rows are repeated
turns; a null role or text is empty; rows without a conversation id belong to no conversation; texts of any length are
taken whole; other columns are left out, whatever their names; an empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinespark.llm.common import stored, temporary
from kinespark.llm.mixing import n_words

#: Conversation ids of this range, at most as many members, are joined in one text.
ENDS_RANGE = 4096
#: A node with so many children, or more than this part of all nodes, is a heavy parent; these are broadcast (at most HEAVY_PARTS).
HEAVY_CHILDREN, HEAVY_PARTS = 1000, 20_000
_ROOT = b""


def unit(role: Column, text: Column) -> Column:
    return F.unhex(F.sha2(F.encode(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), "utf-8"), 256))


def numbered(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, at, unit, words) of every turn: its number in its conversation from 1 on, its digest, and the words of its text.

    Turns are sorted in ranges of (conversation, turn); a conversation that runs over several ranges goes on from the counts
    of the ranges before, which are no more than the ranges.
    """
    role, text = (F.coalesce(turns[c].cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = turns.filter(turns[conv_col].isNotNull()).select(turns[conv_col].cast("long").alias("conv"), turns[turn_col].cast("long").alias("turn"), role.alias("role"), unit(role, text).alias("unit"), n_words(text).alias("words"), F.monotonically_increasing_id().alias("nr"))
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("unit"), F.col("nr")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column("conv").to_numpy()
            first = np.r_[conv[0] != last, conv[1:] != conv[:-1]]
            starts = np.flatnonzero(first)
            at = np.arange(len(conv)) + 1 - np.repeat(np.r_[[] if first[0] else [-n], starts], np.diff(np.r_[[] if first[0] else [0], starts, len(conv)]).astype(np.int64))
            at = at.astype(np.int64)
            last, n = conv[-1], int(at[-1])
            yield pa.RecordBatch.from_arrays([batch.column("conv"), pa.array(np.full(len(conv), part)), pa.array(at), batch.column("unit"), batch.column("words")], names=["conv", "part", "at", "unit", "words"])

    ranged = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("turn", "role", "nr").mapInArrow(run, "conv long, part long, at long, unit binary, words long"), "trie-turns")
    counts = ranged.groupBy("conv", "part").agg(F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # no more rows than ranges: each range has one conversation at most that began in another
    before = F.broadcast(counts.select("conv", "part", earlier.alias("before")).filter("before > 0"))
    return ranged.join(before, ["conv", "part"], "left").select("conv", (F.col("at") + F.coalesce("before", F.lit(0))).alias("at"), "unit", "words")


def share_heads(turns: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """The turns (conv, depth, unit, words) and lengths (conv, length) of rebuilt conversations.

    Conversation c gets the first h turns of conversation c - c % every (the remainder has the sign of c) in place of its own
    first h; h is crc32(c) % most.
    """
    lengths = stored(turns.groupBy("conv").agg(F.count("*").alias("n")), "trie-lengths")
    h = (F.crc32(F.encode(F.col("conv").cast("string"), "utf-8")) % most).alias("h")
    plan = lengths.select("conv", "n", h, (F.col("conv") - F.col("conv") % every).alias("head"))
    bases = lengths.select(F.col("conv").alias("head"), F.col("n").alias("head_n"))
    plan = stored(plan.join(bases, "head", "left").withColumn("taken", F.least(F.col("h").cast("long"), F.coalesce("head_n", F.lit(0)))), "trie-plan")
    own = turns.join(plan.select("conv", "h", "taken"), "conv").filter("at > h").select("conv", (F.col("at") - F.col("h") + F.col("taken")).alias("depth"), "unit", "words")
    heads = turns.filter(F.col("at") < most).withColumnRenamed("conv", "head")
    heads = heads.join(plan.filter("taken > 0").select("conv", "head", "taken"), "head").filter("at <= taken").select("conv", F.col("at").alias("depth"), "unit", "words")
    return own.unionByName(heads), plan.select("conv", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))


def named(turns: DataFrame, deepest: int) -> DataFrame:
    """(conv, depth, name, words) of every turn: the name of the prefix that ends with it."""
    # digests of the runs of s turns that end at multiples of s
    runs, s = [turns.select("conv", "depth", "unit", "words")], 1
    while 2 * s <= deepest:
        half = runs[-1].withColumn("run", F.floor((F.col("depth") - 1) / (2 * s)))
        both = half.groupBy("conv", "run").agg(F.count("*").alias("n"), F.min_by("unit", "depth").alias("upper"), F.max_by("unit", "depth").alias("lower"), F.max_by("words", "depth").alias("words")).filter("n = 2")
        runs.append(stored(both.select("conv", ((F.col("run") + 1) * (2 * s)).alias("depth"), F.unhex(F.sha2(F.concat("upper", "lower"), 256)).alias("unit"), "words"), "trie-runs"))
        s *= 2
    # cuts from the largest pieces to single turns; the name above a cut at an odd multiple of s is that of the depth s less
    found: DataFrame | None = None
    for k in reversed(range(len(runs))):
        s = 1 << k
        cuts = runs[k].filter(F.col("depth") / s % 2 == 1).withColumn("above", F.col("depth") - s)
        name = lambda above: F.unhex(F.sha2(F.concat(above, F.col("unit")), 256)).alias("name")
        if found is None:
            level = cuts.select("conv", "depth", name(F.lit(_ROOT)), "words")
        else:
            known = found.select(F.col("conv").alias("c"), F.col("depth").alias("above"), F.col("name").alias("upper"))
            under = cuts.filter("above > 0").join(known.withColumnRenamed("above", "a"), (F.col("conv") == F.col("c")) & (F.col("above") == F.col("a"))).select("conv", "depth", name(F.col("upper")), "words")
            level = cuts.filter("above = 0").select("conv", "depth", name(F.lit(_ROOT)), "words").unionByName(under)
        level = stored(level, "trie-names")
        found = level if found is None else found.unionByName(level)
    return found


def grafted(nodes: DataFrame, paths: DataFrame, deepest: int, totals: tuple[str, ...]) -> DataFrame:
    """nodes with each of totals summed over the node's subtree. paths are the names (conv, depth, name) of all turns."""
    s = 1
    while s <= deepest:
        roots = nodes.filter((F.col("depth") > 0) & (F.col("depth") % (2 * s) == s)).select("conv_id", F.explode(F.sequence(F.col("depth") - s, F.col("depth") - 1)).alias("over"), *totals)
        on_path = roots.join(paths.select(F.col("conv").alias("conv_id"), F.col("depth").alias("over"), "name"), ["conv_id", "over"]).select("name", *totals)
        on_path = on_path.unionByName(roots.filter("over = 0").select(F.lit(_ROOT).alias("name"), *totals))
        graft = on_path.groupBy("name").agg(*(F.sum(c).alias(f"{c}_below") for c in totals))
        summed = nodes.join(graft, "name", "left")
        nodes = stored(summed.select(*(c for c in nodes.columns if c not in totals), *((F.col(c) + F.coalesce(f"{c}_below", F.lit(0))).alias(c) for c in totals)), "trie-totals")
        s *= 2
    return nodes


def ends_digest(ends: DataFrame) -> DataFrame:
    """(name, ends_sha256): sha256 of the ids (name, conv) in ascending order, joined by commas."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, None
        for batch in batches:
            done = []
            for key, ids in zip(batch.column("name").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if key != name:
                    if state is not None:
                        done.append((name, state.hexdigest()))
                    name, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([d for _, d in done], pa.string())], names=["name", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([state.hexdigest()])], names=["name", "ends_sha256"])

    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    ranges = ends.groupBy("name", F.floor(F.col("conv") / ENDS_RANGE).alias("range")).agg(ids.alias("ids"))
    return ranges.repartition("name").sortWithinPartitions("name", "range").select("name", "ids").mapInArrow(run, "name binary, ends_sha256 string")


def with_parents(nodes: DataFrame, n_nodes: int) -> DataFrame:
    """nodes and parent_conv_id, the conv_id of the node named parent.

    Parents with many children are few, by their share of the nodes, and are broadcast; the others are joined by shuffle.
    """
    heavy = F.col("n_children") > max(HEAVY_CHILDREN, n_nodes // HEAVY_PARTS)
    of = lambda known, c: known.select(F.col("name").alias("parent"), F.col("conv_id").alias(c))
    some = nodes.join(F.broadcast(of(nodes.filter(heavy), "parent_conv_id")), "parent", "left")
    rest = some.filter("parent_conv_id is null").drop("parent_conv_id").join(of(nodes.filter(~heavy), "parent_conv_id"), "parent", "left")
    return some.filter("parent_conv_id is not null").unionByName(rest)


def prefix_trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """The nodes of the trie of turns (conv, depth, unit, words) of conversations (conv, length), turnless ones too.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): conv_id is the smallest
    member; saved_tokens what a cache of shared prefixes saves in the subtree: words times members but one.
    """
    turns = stored(turns, "trie-rows")
    root = lengths.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.max("length").alias("deepest")).first()
    deepest = root["deepest"] or 0
    spark = turns.sparkSession
    paths = named(turns, deepest)
    nodes = paths.groupBy("name", "depth").agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.any_value("words").alias("words"))
    above = paths.select(F.col("conv").alias("conv_id"), (F.col("depth") + 1).alias("depth"), F.col("name").alias("parent"))
    # the paths hold every prefix of a node's smallest member; those of depth 1 are under the root
    under = nodes.filter("depth > 1").join(above, ["conv_id", "depth"]).select("name", "depth", "conv_id", "n_convs", "words", "parent")
    first = nodes.filter("depth = 1").select("name", "depth", "conv_id", "n_convs", "words", F.lit(_ROOT).alias("parent"))
    tops = spark.createDataFrame([(bytearray(), 0, root["conv_id"], root["n_convs"], 0, None)] if root["n_convs"] else [], "name binary, depth long, conv_id long, n_convs long, words long, parent binary")
    nodes = stored(under.unionByName(first).unionByName(tops), "trie-nodes")
    children = nodes.filter("depth > 0").groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
    counted = nodes.join(children, "name", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    own = counted.select("name", "depth", "conv_id", "n_convs", "parent", "n_children", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    summed = grafted(stored(own, "trie-totals"), paths, deepest, ("n_leaves", "saved_tokens"))
    last = lengths.filter("length > 0").join(paths.select("conv", F.col("depth").alias("length"), "name"), ["conv", "length"]).select("name", "conv")
    ends = ends_digest(last.unionByName(lengths.filter("length = 0").select(F.lit(_ROOT).alias("name"), "conv")))
    full = with_parents(summed, nodes.count()).join(ends, "name", "left")
    return full.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def conversations_trie(turns: DataFrame) -> DataFrame:
    """The trie of conversations rebuilt by share_heads; its steps' tables are deleted, the result's stays."""
    with temporary(turns.sparkSession):
        rebuilt, lengths = share_heads(stored(numbered(turns), "trie-numbered"))
        return stored(prefix_trie(rebuilt, lengths), "trie", keep=True)


ORACLE = r"""
WITH k AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
a AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS unit, turn FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, unit) AS nr, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM a),
n AS (SELECT conv_id, count(*) AS n FROM t GROUP BY 1),
p AS (SELECT conv_id, n, conv_id - conv_id % 20 AS head,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 4 AS h FROM n, k),
q AS (SELECT p.*, least(h, coalesce(b.n, 0)) AS taken FROM p LEFT JOIN n b ON b.conv_id = p.head),
r AS (SELECT q.conv_id, nr AS d, unit, words FROM q JOIN t ON t.conv_id = q.head AND nr <= taken UNION ALL SELECT q.conv_id, nr - h + taken, unit, words FROM q JOIN t ON t.conv_id = q.conv_id AND nr > h),
s AS (SELECT conv_id, d, string_agg(unit, '') OVER (PARTITION BY conv_id ORDER BY d) AS path, words FROM r UNION ALL SELECT conv_id, 0, '', 0 FROM q),
v AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words FROM s GROUP BY path, d),
u AS (SELECT v.*, up.path AS parent FROM v LEFT JOIN s up ON up.conv_id = v.conv_id AND up.d = v.d - 1),
c AS (SELECT parent AS path, count(*) AS n_children FROM u WHERE parent IS NOT NULL GROUP BY 1),
w AS (SELECT u.*, coalesce(n_children, 0) AS n_children FROM u LEFT JOIN c USING (path)),
g AS (SELECT s.path, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum((n_convs - 1) * w.words)::BIGINT AS saved_tokens FROM w JOIN s ON s.conv_id = w.conv_id AND s.d <= w.d GROUP BY 1),
l AS (SELECT conv_id, arg_max(path, d) AS path FROM s GROUP BY 1),
e AS (SELECT path, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256 FROM l GROUP BY 1)
SELECT w.conv_id, w.d::BIGINT AS depth, up.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM w JOIN g USING (path) LEFT JOIN e USING (path) LEFT JOIN v up ON up.path = w.parent"""
