"""Exact nearest neighbours of vectors by pivots and the triangle inequality.

Each row goes to the cell of its nearest pivot, and each cell is cut by the distance from the pivot into rings, blocks of
bounded size. A query's distance to the pivot bounds its distance to every row of a ring from below. A query first visits
the blocks of the least bounds that hold k rows; the k-th distance found so far rules out the blocks whose bound is larger,
and the rest is visited, nearer ones first. So the result is that of comparing all, whatever is skipped. Where vectors spread
evenly in many dimensions bounds are low and little is skipped; the search then is the comparison of all, in blocks.

A block is one row of a written table. A task holds a few thousand queries of like place and reads one block after the other
from the shared folder, so neither queries nor rows are sent out again for each other, and disk grows with the rows alone.
What the driver holds is PIVOTS vectors and a row a block, at most MOST_BLOCKS.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinespark.functions.steps import store_of, written

PIVOTS, BLOCK_ROWS, MOST_BLOCKS, QUERY_ROWS = 128, 4096, 1 << 16, 4096
#: Queries whose bounds to all blocks are held at once, and rows that go out together.
ASKED, SENT_ROWS = 256, 4096
#: Pairs of a query and a row that are compared at once.
PAIRS = 1 << 20
#: Distances by products of vectors are off by about this part of the vectors' lengths; candidates so near are compared exactly.
SLACK = 1e-6


def vectors(column: pa.Array) -> np.ndarray:
    """The rows of a list column as a matrix; all lists have one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """By products, about the middle of y."""
    x, y = x - y.mean(0), y - y.mean(0)
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T, 0))


def placed(rows: DataFrame, ident: str, vector: str, centres: np.ndarray) -> DataFrame:
    """(id, v, cell, d) of the rows with a vector: the nearest pivot and the distance from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = distances(vectors(batch.column("v")), centres)
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(cell), pa.array(d[np.arange(len(d)), cell])], names=["id", "v", "cell", "d"])

    read = rows.filter(F.col(vector).isNotNull()).select(F.col(ident).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return read.mapInArrow(run, "id long, v array<double>, cell long, d double")


def in_blocks(rows: DataFrame, block_rows: int) -> DataFrame:
    """rows with block: the ring of its cell, and the part of the ring where equal distances make it too large."""
    sizes = rows.groupBy("cell").agg(F.count("*").alias("n"))
    rings = F.greatest(F.lit(1), F.least(F.lit(1024), F.ceil(F.col("n") / block_rows))).cast("int")
    # cuts of each cell at the quantiles of its distances
    cuts = rows.join(sizes, "cell").filter(rings > 1).groupBy("cell").agg(F.percentile_approx("d", [k / 1024 for k in range(1, 1024)], 10_000).alias("all"), F.any_value("n").alias("n"))
    cuts = cuts.select("cell", F.transform(F.sequence(F.lit(1), rings - 1), lambda k: F.element_at("all", F.greatest(F.lit(1), F.floor(k * 1024 / rings)).cast("int"))).alias("cuts"))
    ringed = rows.join(F.broadcast(cuts), "cell", "left").withColumn("ring", F.when(F.col("cuts").isNull(), 0).otherwise(F.size(F.filter("cuts", lambda c: c < F.col("d"))))).drop("cuts")
    ringed = written(ringed, "neighbour-rings")
    parts = ringed.groupBy("cell", "ring").agg(F.ceil(F.count("*") / (2 * block_rows)).alias("parts"))
    part = F.pmod(F.xxhash64("id"), F.col("parts"))

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        d = rows.column("d").to_numpy()
        made = [rows.column("block")[0].as_py(), rows.column("cell")[0].as_py(), d.min(), d.max(), len(d), rows.column("id").to_numpy().tobytes(), vectors(rows.column("v").combine_chunks()).tobytes()]
        return pa.table([pa.array([x]) for x in made], names=["block", "cell", "low", "high", "n", "ids", "v"])

    blocks = ringed.join(F.broadcast(parts), ["cell", "ring"]).withColumn("block", F.concat_ws(".", "cell", "ring", part)).drop("ring", "parts")
    blocks = blocks.groupBy("block").applyInArrow(pack, "block string, cell long, low double, high double, n long, ids binary, v binary")
    # a block of usual size is a row group, so that each can be read alone
    return written(blocks, "neighbour-blocks", **{"parquet.block.size": str(1 << 20), "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "1", "parquet.enable.dictionary": "false"})


class Reader:
    """The rows of blocks, by the file and the place that the driver listed; files stay open for a task."""

    def __init__(self, places: list[tuple[str, int]], dim: int) -> None:
        self.places, self.dim, self.files = places, dim, {}

    def __call__(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        path, row = self.places[b]
        if path not in self.files:
            store, inner = store_of(path)
            file = pq.ParquetFile(store.open_input_file(inner))
            self.files[path] = file, np.cumsum([0, *(file.metadata.row_group(g).num_rows for g in range(file.num_row_groups))])
        file, starts = self.files[path]
        group = int(np.searchsorted(starts, row, "right")) - 1
        found = file.read_row_group(group, columns=["ids", "v"]).slice(row - int(starts[group]), 1)
        ids, v = (found.column(c)[0].as_buffer() for c in ("ids", "v"))
        return np.frombuffer(ids, np.int64), np.frombuffer(v).reshape(-1, self.dim)

    def close(self) -> None:
        for file, _ in self.files.values():
            file.close()
        self.files.clear()


def sent(batches: Iterator[pa.RecordBatch], chosen: Callable[[pa.RecordBatch], np.ndarray], names: np.ndarray, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Each query (chunk, id, v) once for every block that chosen tells, a few queries at a time and their visits in parts."""
    for whole in batches:
        for start in range(0, whole.num_rows, ASKED):
            batch = whole.slice(start, ASKED)
            visits = np.nonzero(chosen(batch))
            for at in range(0, len(visits[0]), SENT_ROWS):
                q, b = (v[at : at + SENT_ROWS] for v in visits)
                yield pa.RecordBatch.from_arrays([pa.array(names[b]), *(batch.column(c).take(pa.array(q)) for c in ("chunk", "id", "v")), pa.array(sizes[b])], names=["block", "chunk", "id", "v", "n"])


class Best:
    """The best k rows so far of some queries (ids, x): ids and distances, nearest first, ties by id."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int) -> None:
        self.ids, self.x, self.k = ids, x, k
        self.near, self.distance = np.zeros((len(x), k), np.int64), np.full((len(x), k), np.inf)

    @property
    def reach(self) -> np.ndarray:
        return self.distance[:, -1]

    def compare(self, which: np.ndarray, others: np.ndarray, y: np.ndarray) -> None:
        """Take what is better from a block's rows.

        Squared distances from products, in single precision about the block's middle, tell the candidates; their error is
        bounded, and the candidates' distances are computed exactly.
        """
        centre = y.mean(0)
        moved = y - centre
        square = (moved * moved).sum(1)
        some = max(ASKED, PAIRS // len(y))
        for at in range(0, len(which), some):
            w = which[at : at + some]
            x = self.x[w] - centre
            own = (x * x).sum(1)
            kind = np.float32 if max(own.max(), square.max()) < 1e30 else np.float64
            # error of a product of so many terms, and of its terms
            slack = (x.shape[1] + 8) * float(np.finfo(kind).eps) * (own + square.max())
            s = np.c_[-2 * x, np.ones(len(x))].astype(kind) @ np.c_[moved, square].astype(kind).T
            least = (self.reach[w] * (1 + SLACK) + SLACK) ** 2 - own + slack
            close = s <= least.astype(kind)[:, None]
            if np.count_nonzero(close) > 8 * self.k * len(w):
                s[self.ids[w, None] == others] = np.inf
                last = np.partition(s, min(self.k, s.shape[1]) - 1, axis=1)[:, self.k - 1] if s.shape[1] >= self.k else np.full(len(w), np.inf)
                least = np.minimum(least, last + (last + own + 2 * slack).clip(0) * SLACK + 2 * slack + SLACK)
                close = s <= least.astype(kind)[:, None]
            q, r = np.divmod(np.flatnonzero(close), len(y))
            other = self.ids[w[q]] != others[r]
            q, r = q[other], r[other]
            if len(q):
                exact = np.concatenate([np.sqrt(((self.x[w[q[a : a + 8192]]] - y[r[a : a + 8192]]) ** 2).sum(1)) for a in range(0, len(q), 8192)])
                self.merge(w[q], others[r], exact)

    def merge(self, q: np.ndarray, near: np.ndarray, distance: np.ndarray) -> None:
        some = np.unique(q)
        q, near, distance = (np.concatenate(c) for c in ((q, np.repeat(some, self.k)), (near, self.near[some].ravel()), (distance, self.distance[some].ravel())))
        good = np.isfinite(distance)
        q, near, distance = q[good], near[good], distance[good]
        order = np.lexsort((near, distance.round(9), q))
        q, near, distance = q[order], near[order], distance[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < self.k
        self.near[q[keep], rank[keep]], self.distance[q[keep], rank[keep]] = near[keep], distance[keep]


def search(queries: DataFrame, rows: DataFrame, ident: str, vector: str, k: int, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """The k nearest rows (query, neighbour, distance, rank) of each query, itself excluded, ties by id; and the visits (query, block, n).

    Visits are found by a search of their own when they are asked for.
    """
    rows = written(rows.filter(F.col(vector).isNotNull()).select(F.col(ident).cast("long").alias("id"), F.col(vector).alias("v")), "neighbour-rows")
    n = rows.count()
    first = rows.orderBy(F.xxhash64("id"), "id").limit(max(1, min(PIVOTS, n // 64))).collect()
    spark = rows.sparkSession
    if not first:
        return spark.createDataFrame([], "query long, neighbour long, distance double, rank int"), spark.createDataFrame([], "query long, block string, n long")
    centres = np.array([r.v for r in first], float)
    blocks = in_blocks(placed(rows, "id", "v", centres), max(block_rows, n // MOST_BLOCKS))
    listed = sorted(blocks.select("block", "cell", "low", "high", "n", F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row")).collect())
    names, sizes, places = np.array([r.block for r in listed]), np.array([r.n for r in listed]), [(r.path, r.row) for r in listed]
    cell, low, high = (np.array([r[c] for r in listed]) for c in ("cell", "low", "high"))

    length = np.sqrt(((centres - centres.mean(0)) ** 2).sum(1))

    def bounds(d: np.ndarray, b: np.ndarray | slice) -> np.ndarray:
        """The least distance to a row of each block, for each query's distances to the pivots; rounding makes none too large."""
        d = d[:, cell[b]]
        return np.maximum(0, np.maximum(d - high[b], low[b] - d)) - SLACK * (1 + d + high[b] + length[cell[b]])

    def enough(d: np.ndarray) -> np.ndarray:
        """The blocks of the least bounds that hold k rows beside the query."""
        bound = bounds(d, slice(None))
        order = np.argsort(bound, axis=1, kind="stable")
        held = np.cumsum(sizes[order], axis=1)
        taken = np.zeros(bound.shape, bool)
        np.put_along_axis(taken, order, np.c_[np.zeros(len(order)), held[:, :-1]] < k + 1, axis=1)
        return taken

    def through(batch: pa.RecordBatch, read: Reader) -> tuple[Best, Iterator[tuple[int, np.ndarray]]]:
        """The queries' best, which are complete at the end of the visits (block, queries)."""
        best = Best(batch.column("id").to_numpy(), vectors(batch.column("v")), k)
        d = distances(best.x, centres)

        def visits() -> Iterator[tuple[int, np.ndarray]]:
            found = [np.nonzero(enough(d[at : at + ASKED])) for at in range(0, len(d), ASKED)]
            q, b = np.concatenate([f[0] + at * ASKED for at, f in enumerate(found)]), np.concatenate([f[1] for f in found])
            met = {int(at): q[b == at] for at in np.unique(b)}
            for at, which in met.items():
                best.compare(which, *read(at))
                yield at, which
            for at in np.argsort([bounds(d, np.array([c])).mean() for c in range(len(cell))], kind="stable").tolist():
                which = np.flatnonzero(bounds(d, np.array([at]))[:, 0] <= best.reach)
                which = np.setdiff1d(which, met.get(at, which[:0]), assume_unique=True)
                if len(which):
                    best.compare(which, *read(at))
                    yield at, which

        return best, visits()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Reader(places, centres.shape[1])
        for whole in batches:
            for start in range(0, whole.num_rows, QUERY_ROWS):
                best, visits = through(whole.slice(start, QUERY_ROWS), read)
                for _ in visits:
                    pass
                q, r = np.nonzero(np.isfinite(best.distance))
                yield pa.RecordBatch.from_arrays([pa.array(best.ids[q]), pa.array(best.near[q, r]), pa.array(best.distance[q, r])], names=["query", "neighbour", "distance"])
        read.close()

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Reader(places, centres.shape[1])

        def chosen(batch: pa.RecordBatch) -> np.ndarray:
            taken = np.zeros((batch.num_rows, len(names)), bool)
            for b, which in through(batch, read)[1]:
                taken[which, b] = True
            return taken

        yield from sent(batches, chosen, names, sizes)
        read.close()

    asked = placed(queries, ident, vector, centres)
    count = queries.count()
    # queries of like place share their blocks
    chunks = max(1, -(-count // QUERY_ROWS), min(spark.sparkContext.defaultParallelism, -(-count // ASKED)))
    asked = asked.repartitionByRange(chunks, "cell", "d", "id").withColumn("chunk", F.spark_partition_id())
    found = asked.mapInArrow(run, "query long, neighbour long, distance double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.round("distance", 9), "neighbour"))
    told = asked.mapInArrow(tell, "block string, chunk int, id long, v array<double>, n long")
    return written(found, "neighbours").withColumn("rank", rank).filter(F.col("rank") <= k), told.select(F.col("id").alias("query"), "block", "n")


def neighbours(queries: DataFrame, rows: DataFrame, ident: str, vector: str, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query, neighbour, distance, rank): the k nearest rows of each query, itself excluded, ties by id."""
    return search(queries, rows, ident, vector, k, block_rows)[0]


def compared_share(visits: DataFrame, queries: DataFrame, rows: DataFrame) -> DataFrame:
    """One row (compared, pairs, share): how many pairs of queries and rows were compared, of all there are."""
    whole = queries.agg(F.count("*").alias("q")).crossJoin(rows.agg(F.count("*").alias("r")))
    return visits.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("compared")).crossJoin(whole).select("compared", (F.col("q") * F.col("r")).alias("pairs"), F.try_divide("compared", F.col("q") * F.col("r")).alias("share"))
