"""Near-duplicate detection by chosen-path set similarity join.

A document is the set of its distinct k-word shingles. Documents with equal sets are one class, represented by one of
them. Each class has SIGNATURE minwise values and a sketch of one bit of each.

Independent trees share out the classes: at a node, a class goes to the children named by its minwise values at positions
that the node chooses (1 / similarity of them on average), so two similar classes share a path with known probability.
In nodes of at most LEAF classes all pairs are held against each other by sketch; candidates are compared on full sets, first
each class's likeliest, then those between components that are still apart.

Larger nodes branch again, DEPTH levels at most, but for those that mostly hold near copies, which branching would only
scatter. What is left is crowded, and compared exhaustively as well, only that pairs which are linked already are passed
over: first each class and the likeliest of PIVOTS members of the node, which makes one main component of most near copies;
then all classes outside the main component against all classes of the node. These are dealt out in cells of bounded size,
and a cell counts the intersections of its full sets by matrix products. It returns the links that join components, fewer
than it has classes, so no table grows with the pairs of a group. Nothing is capped or dropped.

Recall: two classes of the least similarity 0.8 meet in one tree's first node with probability 0.8, and TREES trees miss
them with probability 0.2 ** TREES where nodes stay small or are crowded; each branching costs a factor of about 1. The sketch
test passes such a pair with probability above 0.99999. The work in a crowded node is its classes times those outside its main
component, so it is quadratic where most of a large node's classes resemble each other without being linked; there, a
class that met another in the first tree's node isn't held against it in other trees.

Counts of nodes are pre-aggregated; rows of a large node stay spread over tasks, as they are joined with its pivots by a join
that Spark may split, and are gathered in cells alone. Components are found by passing on smallest ids with pointer jumping.
All tables of a step are written to the shared folder and deleted when the labels are there. Shingles are told apart by
64-bit hashes.

Defined results: null and empty texts and texts without words have the empty set and are linked with nothing; fewer words
than k are one shingle; ids may be null (each null-id row's component is null if no smaller id is linked); rows of an equal id
are one document, that of its smallest text, though each row's set size is its own text's; repeated rows are copies of each
other.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinespark.llm.common import lower_ascii, mixed, n_partitions, packed, ragged, span_hashes, stored, temporary, text_or_empty, text_slices, unpacked_slices, word_spans

SIGNATURE, TREES, LEAF, DEPTH, PIVOTS, DENSE = 64, 12, 32, 4, 64, 0.25
#: Classes and shingles of a block of a crowded node, on average; decide the size of a group alone.
BLOCK_ROWS, BLOCK_SHINGLES = 4096, 1 << 20
#: Bits of 64 that agree in the sketches of a candidate: 4.5 deviations below the mean of 57.6 at similarity 0.8.
AGREE = 47
#: Minwise values of 64 that agree in a pair of the least similarity: 3.5 deviations below the mean of 51.2.
EQUAL = 40
#: Minwise values that agree in a node's near copies; decides alone whether a node branches.
CLOSE = 45
_A = mixed(np.arange(1, SIGNATURE + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
_B = mixed(np.arange(1001, SIGNATURE + 1001, dtype=np.uint64) * np.uint64(0xA5A3564E27F8862B))


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles, repeated ones too, and their n + 1 row bounds."""
    folded = lower_ascii(data)
    starts, lens, rows = word_spans(folded, offsets)
    hashes = span_hashes(folded, starts, lens)
    n = np.diff(rows)
    made = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(made)])
    at = np.arange(bounds[-1]) + np.repeat(rows[:-1] - bounds[:-1], made)
    h = np.zeros(len(at), np.uint64)
    last = np.repeat(rows[1:], made)
    padded = np.append(hashes, np.zeros(k, np.uint64))
    for step in range(k):
        inside = at + step < last
        h = np.where(inside, mixed(h + padded[at + step]), h) if step else mixed(padded[at])
    return h, bounds


def signatures(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """SIGNATURE minwise values by row (rows without shingles: zeros)."""
    n = np.diff(bounds)
    some = np.flatnonzero(n)
    found = np.zeros((len(n), SIGNATURE), np.uint64)
    if not len(some):
        return found
    firsts = bounds[:-1][some]
    # a few rows at a time, so that the hashes stay in the cache
    block = max(1, int(np.searchsorted(firsts, 16384)))
    for a in range(0, len(some), block):
        lo, hi = firsts[a], bounds[some[min(a + block, len(some)) - 1] + 1]
        part, at = h[lo:hi], firsts[a : a + block] - lo
        for j in range(SIGNATURE):
            v = part ^ _B[j]
            v *= _A[j]
            found[some[a : a + block], j] = np.minimum.reduceat(v, at)
    return found


def sketch_bits(signature: np.ndarray) -> np.ndarray:
    """One mixed bit of each of the 64 values, as one integer."""
    bits = (mixed(signature) >> np.uint64(37)) & np.uint64(1)
    return (bits << np.arange(SIGNATURE, dtype=np.uint64)).sum(1, dtype=np.uint64)


def own_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, bool]:
    """(doc_id, text, own) of every row, own where the text stands for the id; and whether ids repeat at all."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    many = stored(rows.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").drop("n"), "dup-repeated")
    if many.isEmpty():
        return rows.withColumn("own", F.lit(True)), False
    least = stored(rows.join(many, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("least")), "dup-least")
    return rows.join(least, "doc_id", "left").select("doc_id", "text", F.coalesce(F.col("text") == F.col("least"), F.lit(True)).alias("own")), True


def describe(rows: DataFrame, k: int) -> DataFrame:
    """(doc_id, own, n_shingles, digest, sketch, signature) of own_texts; digest is null for the empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in text_slices(batches):
            h, bounds = shingles(data, offsets, k)
            values = signatures(h, bounds)
            sizes, digests = [], []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                own = np.unique(h[a:b])
                sizes.append(len(own))
                digests.append(xxhash.xxh3_128_hexdigest(own.tobytes()) if len(own) else None)
            flat = pa.array((values.ravel() >> np.uint64(32)).astype(np.uint32).view(np.int32))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * SIGNATURE, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("own"), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(sketch_bits(values).view(np.int64)), lists], names=["doc_id", "own", "n_shingles", "digest", "sketch", "signature"])

    return rows.select("doc_id", "own", "text").mapInArrow(run, "doc_id long, own boolean, n_shingles long, digest string, sketch long, signature array<int>")


def agreement(a: Column, b: Column) -> Column:
    return F.lit(64) - F.bit_count(a.bitwiseXOR(b))


def equal(a: Column, b: Column) -> Column:
    """How many minwise values agree."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same))


def chosen(node: Column, level: int, similarity: float) -> Column:
    """The positions that a node branches by: one, and a second with the probability that makes 1 / similarity."""
    first = F.pmod(F.xxhash64(node, F.lit(level)), F.lit(SIGNATURE)).cast("int")
    # the second differs from the first, else both children would be the same
    other = F.pmod(first + 1 + F.pmod(F.xxhash64(node, F.lit(level), F.lit(1)), F.lit(SIGNATURE - 1)), F.lit(SIGNATURE)).cast("int")
    two = F.pmod(F.xxhash64(node, F.lit(level), F.lit(2)), F.lit(1 << 20)) < int((1 / similarity - 1) * (1 << 20))
    return F.when(two, F.array(first, other)).otherwise(F.array(first))


def leaf_pairs(rows: DataFrame) -> DataFrame:
    """Candidates (a, b, agree) of all pairs in nodes; the rows' nodes are small, each in one partition and sorted.

    Rows are held against the row 1, 2, ... places on while it is of the same node.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            part = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "doc_id", "sketch")]
            if kept is not None:
                part = [np.concatenate(p) for p in zip(kept, part, strict=True)]
            node, doc, sketch = part
            # the last node may go on in the next batch
            done = int(np.searchsorted(node, node[-1], "left")) if len(node) else 0
            kept = [p[done:] for p in part]
            yield from pairs(node[:done], doc[:done], sketch[:done])
        if kept is not None:
            yield from pairs(*kept)

    def pairs(node: np.ndarray, doc: np.ndarray, sketch: np.ndarray) -> Iterator[pa.RecordBatch]:
        for lag in range(1, len(node)):
            same = np.flatnonzero(node[lag:] == node[:-lag])
            if not len(same):
                break
            agree = 64 - np.bitwise_count((sketch[same] ^ sketch[same + lag]).view(np.uint64)).astype(np.int32)
            good = agree >= AGREE
            if good.any():
                a, b = doc[same[good]], doc[same[good] + lag]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(agree[good])], names=["a", "b", "agree"])

    return rows.sortWithinPartitions("node").select("node", "doc_id", "sketch").mapInArrow(run, "a long, b long, agree int").filter("a <> b")


def large_nodes(rows: DataFrame, leaf: int) -> DataFrame:
    """(node) with more than leaf rows, written: counts are summed in the tasks first."""
    return stored(rows.groupBy("node").agg(F.count("*").alias("n")).filter(F.col("n") > leaf).select("node", F.lit(True).alias("large")), "dup-large")


def split(rows: DataFrame, leaf: int) -> tuple[DataFrame, DataFrame]:
    """Rows of small and of large nodes. The join is one that Spark may split where a node is large."""
    marked = stored(rows.join(large_nodes(rows, leaf), "node", "left"), "dup-nodes")
    return marked.filter("large is null").drop("large"), marked.filter("large").drop("large")


def with_pivots(rows: DataFrame, pivots: int, level: int, similarity: float) -> DataFrame:
    """rows with children, the nodes they go to if their node branches, and near: the pivots of their node that they resemble, the likeliest first, as (agree, pivot).

    Pivots are, of each of so many parts of a node's classes, the one with the smallest hash: a minimum each task makes of
    its rows first. So a node's list has a bounded size, however many rows the node has.
    """
    part = F.pmod(F.xxhash64("doc_id", "node"), F.lit(pivots)).alias("part")
    heads = rows.groupBy("node", part).agg(F.min(F.struct(F.xxhash64("node", "doc_id").alias("o"), "doc_id", "sketch", "signature")).alias("p"))
    listed = heads.groupBy("node").agg(F.collect_list("p").alias("pivots"))
    met = F.filter("pivots", lambda p: (p["doc_id"] != F.col("doc_id")) & (agreement(p["sketch"], F.col("sketch")) >= AGREE))
    met = F.transform(met, lambda p: F.struct(equal(p["signature"], F.col("signature")).alias("agree"), p["doc_id"].alias("pivot")))
    near = F.sort_array(F.filter(met, lambda p: p["agree"] >= EQUAL), asc=False)
    children = F.transform(chosen(F.col("node"), level, similarity), lambda at: F.xxhash64(F.col("node"), at, F.element_at("signature", at + 1)))
    return rows.join(stored(listed, "dup-pivots"), "node").select("tree", "node", "doc_id", "sketch", children.alias("children"), near.alias("near"))


def candidates(classes: DataFrame, similarity: float, trees: int = TREES, leaf: int = LEAF, depth: int = DEPTH, pivots: int = PIVOTS) -> tuple[DataFrame, DataFrame | None]:
    """Pairs (a, b, agree) of classes that share a node and whose sketches agree, each once; and the crowded nodes' rows.

    In a crowded node, pairs are those of each class and its likeliest pivot: settle() looks after what these leave apart.
    """
    tree = F.explode(F.sequence(F.lit(1), F.lit(trees)))
    rows = classes.select("doc_id", "sketch", "signature", tree.alias("tree"))
    position = (F.col("tree") * 5) % SIGNATURE  # 5 and 64 have no common factor: each tree begins at another
    rows = rows.select("tree", F.xxhash64("tree", F.element_at("signature", position + 1)).alias("node"), "doc_id", "sketch")
    found: list[DataFrame] = []
    crowded: DataFrame | None = None
    signed = classes.select("doc_id", "signature")
    for level in range(1, depth + 1):
        small, rows = split(rows, leaf)
        found.append(stored(leaf_pairs(small.repartition(n_partitions(small), "node")), "dup-leaf"))
        if rows.isEmpty():
            break
        held = stored(with_pivots(rows.join(signed, "doc_id"), pivots, level, similarity), "dup-held")
        # where most classes resemble a pivot, branching would only scatter near copies
        dense = held.groupBy("node").agg(F.avg(F.exists("near", lambda p: p["agree"] >= CLOSE).cast("int")).alias("share")).filter(F.col("share") >= (DENSE if level < depth else 0.0))
        dense = stored(dense, "dup-dense")
        here = stored(held.join(dense, "node", "left_semi").select("tree", "node", "doc_id", "sketch", "near"), "dup-crowded")
        crowded = here if crowded is None else crowded.unionByName(here)
        found.append(met_pivots(here))
        rows = held.select("tree", "node", "doc_id", "sketch", "children").join(dense, "node", "left_anti").select("tree", F.explode("children").alias("node"), "doc_id", "sketch")
    return stored(reduce(DataFrame.unionByName, found).groupBy("a", "b").agg(F.max("agree").alias("agree")), "dup-candidates"), crowded


def met_pivots(crowded: DataFrame) -> DataFrame:
    """(a, b, agree): each class with the likeliest pivot of each of its nodes."""
    met = crowded.select(F.col("doc_id").alias("own"), F.explode(F.slice("near", 1, 1)).alias("n")).select("own", F.col("n.pivot").alias("with"), F.col("n.agree").cast("int").alias("agree")).distinct()
    return met.select(F.least("own", "with").alias("a"), F.greatest("own", "with").alias("b"), "agree")


def settle(crowded: DataFrame, classes: DataFrame, links: DataFrame, labels: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Labels after the classes outside their crowded node's main kind were held against all classes of the node.

    A kind is a component or, in the trees after the first, the classes that were together in a crowded node of the first:
    two of a kind need no look. A node's main kind is its largest, so all other pairs have an end outside it.
    """
    rows = crowded.select("tree", "node", "doc_id", "sketch").join(classes.select("doc_id", "n_shingles"), "doc_id")
    met = crowded.filter("tree = 1").groupBy("doc_id").agg(F.min("node").alias("met"))
    later = rows.filter("tree > 1").join(met, "doc_id", "left")
    for part in (rows.filter("tree = 1").withColumn("met", F.lit(None).cast("long")), later):
        known = part.join(labels, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
        known = stored(known.withColumn("met", F.coalesce("met", F.xxhash64("doc_id"))), "dup-known")
        near = stored(with_partner(cells(known)), "dup-near")
        if near.isEmpty():
            continue
        found = stored(cell_links(near.join(texts, "doc_id"), k, percent).distinct(), "dup-confirmed")
        if not found.isEmpty():
            links = links.unionByName(found)
            labels = components(links)
    return labels


def cells(known: DataFrame) -> DataFrame:
    """The rows dealt out in cells (node, outer, inner): each class outside the main kind and each of the node share one.

    Both are dealt out in blocks, and each pair of blocks is a cell: its size is bounded, whatever the node's.
    """
    kinds = known.select("node", "n_shingles", F.explode(F.array(F.struct(F.lit(True).alias("linked"), F.col("component").alias("kind")), F.struct(F.lit(False).alias("linked"), F.col("met").alias("kind")))).alias("k"))
    shares = kinds.groupBy("node", "k").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    whole = F.col("k.linked").cast("int")  # each class counts once in either way of telling kinds
    nodes = shares.groupBy("node").agg(F.sum(F.col("n") * whole).alias("n"), F.sum(F.col("s") * whole).alias("s"), F.max(F.struct("n", "k", "s")).alias("m")).filter(F.col("n") > F.col("m.n"))
    blocks = lambda n, s: F.ceil(F.greatest(n / BLOCK_ROWS, s / BLOCK_SHINGLES))
    nodes = nodes.select("node", F.col("m.k").alias("main"), blocks(F.col("n"), F.col("s")).alias("parts"), blocks(F.col("n") - F.col("m.n"), F.col("s") - F.col("m.s")).alias("outer_parts"))
    rows = known.join(stored(nodes, "dup-main"), "node").withColumn("salt", F.xxhash64("doc_id", "node"))
    dealt = lambda column: F.pmod("salt", column)
    each = lambda column: F.explode(F.sequence(F.lit(0).cast("long"), F.col(column) - 1))
    inner = rows.select("node", each("outer_parts").alias("outer"), dealt(F.col("parts")).alias("inner"), F.lit(False).alias("outside"), "doc_id", "component", "met", "sketch")
    outside = F.when(F.col("main.linked"), F.col("component")).otherwise(F.col("met")) != F.col("main.kind")
    outer = rows.filter(outside).select("node", dealt(F.col("outer_parts")).alias("outer"), each("parts").alias("inner"), F.lit(True).alias("outside"), "doc_id", "component", "met", "sketch")
    return inner.unionByName(outer)


def with_partner(cells: DataFrame) -> DataFrame:
    """The rows of cells whose sketch agrees with one of another kind on the cell's other side."""

    def run(cell: pa.Table) -> pa.Table:
        outside, sketch, component, met = (cell.column(c).to_numpy() for c in ("outside", "sketch", "component", "met"))
        own, others = np.flatnonzero(outside), np.flatnonzero(~outside)
        found = np.zeros(len(outside), bool)
        for at in range(0, len(own), 256):
            some = own[at : at + 256]
            agree = 64 - np.bitwise_count((sketch[some, None] ^ sketch[others]).view(np.uint64)) >= AGREE
            agree &= (component[some, None] != component[others]) & (met[some, None] != met[others])
            found[some] = agree.any(1)
            found[others] |= agree.any(0)
        return cell.drop_columns("sketch").filter(pa.array(found))

    return cells.groupBy("node", "outer", "inner").applyInArrow(run, "node long, outer long, inner long, outside boolean, doc_id long, component long, met long")


def intersections(sets: list[np.ndarray], own: np.ndarray, others: np.ndarray, block: int = 1024, steps: int = 1 << 22) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(some of own, sizes of their intersections with each of others). Shingles that a sixteenth of the sets have are counted
    by products of 0-1 matrices, a block of shingles at a time; the others by the lists of their sets."""
    rows = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    order = np.argsort(codes, kind="stable")
    codes, rows = codes[order], rows[order]
    n = np.bincount(codes)
    common = n * 16 >= len(sets)
    number = np.cumsum(common) - 1

    def split(members: np.ndarray) -> tuple[np.ndarray, ...]:
        """Shingles and places among the members, for common and for rare shingles, by shingle."""
        place = np.full(len(sets), -1)
        place[members] = np.arange(len(members))
        here = place[rows] >= 0
        c, r = codes[here], place[rows[here]]
        many = common[c]
        return number[c[many]], r[many], c[~many], r[~many]

    def matrix(c: np.ndarray, r: np.ndarray, size: int, low: int) -> np.ndarray:
        a, b = np.searchsorted(c, [low, low + block])
        made = np.zeros((size, block), np.float32)
        made[r[a:b], c[a:b] - low] = 1
        return made

    far_common, far_common_rows, far_rare, far_rare_rows = split(others)
    first = np.searchsorted(far_rare, np.arange(len(n) + 1))
    for at in range(0, len(own), block):
        some = own[at : at + block]
        both = np.zeros((len(some), len(others)), np.float32)
        c, r, rare, rare_rows = split(some)
        for low in range(0, int(common.sum()), block):
            both += matrix(c, r, len(some), low) @ matrix(far_common, far_common_rows, len(others), low).T
        lens = first[rare + 1] - first[rare]
        cuts = np.unique(np.searchsorted(np.cumsum(lens), np.arange(0, int(lens.sum()) + 1, steps)))
        for a, b in zip(cuts, np.append(cuts[1:], len(lens)), strict=True):
            partner = far_rare_rows[ragged(first[rare[a:b]], lens[a:b])]
            np.add.at(both.reshape(-1), np.repeat(rare_rows[a:b], lens[a:b]) * len(others) + partner, np.float32(1))
        yield some, both


def cell_links(cells: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) of full sets that join all components of a cell that any of its pairs joins."""

    def run(cell: pa.Table) -> pa.Table:
        sets = []
        for batch in cell.select(["text"]).to_batches():
            for _, data, offsets in unpacked_slices(batch, "text"):
                h, bounds = shingles(data, offsets, k)
                sets += [np.unique(h[x:y]) for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        outside, doc, component, met = (cell.column(c).to_numpy() for c in ("outside", "doc_id", "component", "met"))
        component = np.unique(component, return_inverse=True)[1]
        sizes = np.array([len(x) for x in sets], np.int64)
        own, others, found = np.flatnonzero(outside), np.flatnonzero(~outside), []
        for some, both in intersections(sets, own, others) if len(own) and len(others) else ():
            good = (both > 0) & (100 * both >= percent * (sizes[some, None] + sizes[others] - both))
            good &= (component[some, None] != component[others]) & (met[some, None] != met[others])
            for x, partners in zip(some, good, strict=True):
                partners = others[partners]
                # one partner of each component is enough
                for y in partners[np.unique(component[partners], return_index=True)[1]]:
                    if component[y] != component[x]:
                        found.append((min(doc[x], doc[y]), max(doc[x], doc[y])))
                        component[component == component[y]] = component[x]
        ends = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"a": ends[:, 0], "b": ends[:, 1]})

    return cells.groupBy("node", "outer", "inner").applyInArrow(run, "a long, b long")


def between(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends are in different components, written."""
    ends = pairs.join(labels.select(F.col("doc_id").alias("a"), F.col("component").alias("ca")), "a", "left").join(labels.select(F.col("doc_id").alias("b"), F.col("component").alias("cb")), "b", "left")
    return stored(ends.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b"), "dup-apart")


def confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union. texts: (doc_id, packed text) of the classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = []
            for side in ("text_a", "text_b"):
                own, before, at = [], None, -1
                for _, data, offsets in unpacked_slices(batch, side):
                    h, bounds = shingles(data, offsets, k)
                    own += [np.unique(h[x:y]) for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                sets.append(own)
            good = []
            for x, y in zip(*sets, strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    first = pairs.select("a", "b").join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    both = first.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(doc_id, component) of every id in links (a, b): the smallest id that can be reached.

    Each round takes the smallest label among an id and its neighbours, then that label's own label. Labels are written
    every round; rounds grow with the logarithm of a component's width.
    """
    both = stored(links.select(F.col("a").alias("doc_id"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("doc_id"), F.col("a").alias("other"))), "dup-links")
    labels = stored(both.groupBy("doc_id").agg(F.least(F.col("doc_id"), F.min("other")).alias("component")), "dup-labels")
    while True:
        near = both.join(labels.withColumnRenamed("doc_id", "other"), "other").groupBy("doc_id").agg(F.min("component").alias("least"))
        met = labels.join(near, "doc_id").select("doc_id", "component", F.least("component", "least").alias("next"))
        # pointer jumping: the label's label
        jump = labels.select(F.col("doc_id").alias("next"), F.col("component").alias("far"))
        made = stored(met.join(jump, "next", "left").select("doc_id", F.least("next", F.coalesce("far", "next")).alias("component"), (F.least("next", F.coalesce("far", "next")) < F.col("component")).alias("moved")), "dup-labels")
        labels = made.select("doc_id", "component")
        if made.filter("moved").isEmpty():
            return labels


def link(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs."""
    with temporary(docs.sparkSession):
        rows, repeated = own_texts(docs, id_col, text_col)
        marked = stored(describe(rows, k), "dup-sets", keep=True)
        known = stored(labelled(marked, rows.filter("own").select("doc_id", "text"), repeated, k, percent), "dup-known", keep=True)
    if not repeated:
        return marked.join(known, "digest", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    # where ids repeat, rows go by their id's own text
    own = marked.filter("own and doc_id is not null").select("doc_id", "digest").distinct().join(known, "digest").select("doc_id", "component")
    named = marked.select("doc_id", "n_shingles").filter("doc_id is not null").join(own, "doc_id", "left")
    nameless = marked.filter("doc_id is null").join(known, "digest", "left")
    return named.unionByName(nameless.select(*named.columns)).select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def labelled(marked: DataFrame, texts: DataFrame, repeated: bool, k: int, percent: int) -> DataFrame:
    """(digest, component) of the classes of several documents or with links; the rest stand alone."""
    # classes of equal sets: the smallest id stands for all
    named = marked.filter("own and digest is not null and doc_id is not null")
    heads = stored(named.groupBy("digest").agg(F.min("doc_id").alias("head"), F.count("*").alias("n")), "dup-heads")
    alike = named.select("doc_id", "digest", "n_shingles", "sketch", "signature")
    alike = alike.dropDuplicates(["doc_id"]) if repeated else alike
    classes = stored(alike.join(heads.select(F.col("head").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "n_shingles", "sketch", "signature"), "dup-classes")
    pairs, crowded = candidates(classes, percent / 100)
    needed = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id")))
    needed = needed if crowded is None else needed.unionByName(crowded.select("doc_id"))  # pivots are rows of their nodes
    texts = texts.join(stored(needed.distinct(), "dup-needed"), "doc_id", "left_semi")
    texts = packed(texts.dropDuplicates(["doc_id", "text"]) if repeated else texts, "text")
    # each class's likeliest partner first; what then lies in one component needs no look
    best = pairs.groupBy("b").agg(F.max(F.struct("agree", F.col("a").alias("with"))).alias("m")).select(F.col("m.with").alias("a"), "b")
    best = stored(best, "dup-best")
    first = stored(confirmed(best, texts, k, percent), "dup-confirmed")
    labels = components(first)
    apart = between(pairs.select("a", "b").join(best, ["a", "b"], "left_anti"), labels)
    links = first.unionByName(stored(confirmed(apart, texts, k, percent), "dup-confirmed"))
    labels = components(links)
    if crowded is not None:
        labels = settle(crowded, classes, links, labels, texts, k, percent)
    linked = labels.join(heads.select(F.col("head").alias("doc_id"), "digest"), "doc_id").select("digest", "component")
    return heads.filter("n > 1").select("digest", "head").join(linked, "digest", "full").select("digest", F.coalesce("component", "head").alias("component"))


def dedup(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that are their component's smallest id, one row of each id, that of the smallest text; rows without id stay."""
    kept = stored(link(docs, k, percent).filter("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n")).withColumnsRenamed({"doc_id": "__kept", "n": "__n"}), "dup-kept")
    once = docs.join(kept.filter("__n = 1"), docs["doc_id"] == kept["__kept"], "left_semi")
    nameless = docs.filter("doc_id is null")
    if kept.filter("__n > 1").isEmpty():
        return once.unionByName(nameless)
    order = Window.partitionBy("doc_id").orderBy(*(F.col(f"`{c}`").cast("string").asc_nulls_first() for c in dict.fromkeys(["text", *docs.columns])))
    several = docs.join(kept.filter("__n > 1"), docs["doc_id"] == kept["__kept"], "left_semi").withColumn("__place", F.row_number().over(order)).filter("__place = 1").drop("__place")
    return once.unionByName(several).unionByName(nameless)
