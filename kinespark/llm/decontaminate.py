"""Benchmark decontamination by a prefix-filtered set join.

A window is WINDOW consecutive words of an item (a shorter item is one window), taken as the set of its shingles of SHINGLE
words. To hold a window, a document must hold all its shingles, so for containment 1 the necessary prefix of a window, its
shingles ordered by rarity over all documents, is the rarest one alone. Documents give their places of prefix shingles as
candidates, each with the words around it; these join the windows on the shingle, the window must lie within the document
(its length and the shingle's position in it), and the words themselves are compared. Words inside confirmed windows are
marked in masks of 64 words, which add up by bitwise or.

Nothing grows with the documents but the joins: the benchmark's shingles reach the tasks as a Bloom filter of bounded size
(FILTER_BITS), whose false hits the join drops; the windows are broadcast up to BROADCAST_WINDOWS, else joined by shuffle.
Items of equal words are one class until the end. Documents are read twice (rarity, candidates); each reading is one pass
without a shuffle of texts.

Words are runs of ASCII letters and digits and of characters beyond ASCII, A-Z folded. Defined results: null, empty and
wordless texts have no words and no hits; items without words have no window; a null item id counts as an empty one; rows of
one item id count as one item; repeated rows and null or repeated document ids are documents of their own; long texts are
taken whole; other columns are left out, whatever their names; without documents the result is empty, without items nothing
is hit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinespark.llm.common import lower_ascii, mixed, ragged, span_hashes, stored, text_or_empty, text_slices, word_spans

WINDOW, SHINGLE = 10, 3
#: Bits of a filter: 64 for each shingle, between these bounds; every shingle sets PROBES of them.
FILTER_BITS, PROBES = (1 << 16, 1 << 28), 4
#: Windows (at most WINDOW words each) up to this many are broadcast.
BROADCAST_WINDOWS = 100_000
_BREAK = np.ones(256, bool)
_BREAK[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The folded bytes, the words' starts and lengths, and rows' first words."""
    folded = lower_ascii(data)
    return folded, *word_spans(folded, offsets, _BREAK)


def shingle_hashes(one: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every run of size words, from the words' hashes; runs that leave the array are cut off."""
    h = np.full(max(len(one) - size + 1, 0), size, np.uint64)
    for k in range(size):
        h = mixed(h ^ one[k : k + len(h)])
    return h


def shingles_of(one: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, hash) of every run of size words inside a row; word is the run's first."""
    hashes = shingle_hashes(one, size)
    row = np.searchsorted(rows, np.arange(len(hashes)), "right") - 1
    inside = np.flatnonzero(np.arange(len(hashes)) + size <= rows[row + 1]) if len(hashes) else np.zeros(0, np.int64)
    return inside, hashes[inside]


def windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """The windows (class, at, size, words, shingles) of the distinct word sequences, and their items (class, item).

    class is the sha256 of an item's words; shingles are hashes in order of position.
    """

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in text_slices(batches, "__text"):
            folded, starts, lens, rows = words(data, offsets)
            joined = [b" ".join(folded[a : a + n].tobytes() for a, n in zip(starts[lo:hi], lens[lo:hi], strict=True)) for lo, hi in zip(rows[:-1], rows[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("__item"), pa.array(joined, pa.binary()).cast(pa.string())], names=["item", "words"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in text_slices(batches, "words"):
            _, starts, lens, rows = words(data, offsets)
            one = span_hashes(data, starts, lens)
            for name, lo, hi in zip(part.column("class").to_pylist(), rows[:-1], rows[1:], strict=True):
                size = min(window, hi - lo)
                first = np.arange(lo, hi - size + 1)
                width = min(shingle, size)
                hashes = shingle_hashes(one[lo:hi], width).view(np.int64)
                texts = [data[starts[a] : starts[a + size - 1] + lens[a + size - 1]].tobytes() for a in first]
                lists = [hashes[a - lo : a - lo + size - width + 1] for a in first]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(first)), pa.array(first - lo), pa.array(np.full(len(first), size)), pa.array(np.full(len(first), width)), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(lists, pa.list_(pa.int64()))], names=["class", "at", "size", "width", "words", "shingles"])

    rows = items.select(F.coalesce(items[id_col].cast("string"), F.lit("")).alias("__item"), text_or_empty(text_col).alias("__text"))
    spelled = rows.mapInArrow(spell, "item string, words string").filter("words <> ''")
    spelled = stored(spelled.withColumn("class", F.sha2(F.encode("words", "utf-8"), 256)), "leak-items")
    distinct = spelled.groupBy("class").agg(F.any_value("words").alias("words"))
    made = distinct.mapInArrow(cut, "class string, at long, size long, width long, words string, shingles array<long>")
    return stored(made, "leak-windows"), spelled.select("class", "item").distinct()


class Bloom:
    """A set of 64-bit hashes with false hits, of bounded size; built by Spark, held by the tasks."""

    def __init__(self, hashes: DataFrame, column: str):
        """hashes has no repeated rows; what reaches the driver is the filter's bytes."""
        n = hashes.count()
        low, high = FILTER_BITS
        self.bits = min(high, max(low, 1 << max(64 * n - 1, 1).bit_length()))
        places = F.explode(F.array(*(self._place(F.col(column), k) for k in range(PROBES))))
        cells = hashes.select(places.alias("p")).groupBy((F.col("p") / 32).cast("int").alias("cell"))
        found = cells.agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 32).cast("int"))).alias("mask")).toPandas()
        self.cells = np.zeros(self.bits // 32, np.uint32)
        self.cells[found["cell"].to_numpy(np.int64)] = found["mask"].to_numpy(np.int64).astype(np.uint32)

    def _place(self, h: Column, k: int) -> Column:
        return F.shiftrightunsigned(h, 9 * k).bitwiseAND(F.lit(self.bits - 1))

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        """Places in hashes that may be in the set."""
        at = np.arange(len(hashes))
        for k in range(PROBES):
            p = (hashes[at] >> np.uint64(9 * k)) & np.uint64(self.bits - 1)
            at = at[(self.cells[p >> np.uint64(5)] >> (p & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1]
        return at


def document_counts(docs: DataFrame, text_col: str, known: DataFrame, widths: list[int]) -> DataFrame:
    """(shingle, n): how often the documents have a shingle of known, counted in the tasks first; with false hits."""
    bloom = docs.sparkSession.sparkContext.broadcast(Bloom(known, "shingle"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in text_slices(batches, "__text"):
            folded, starts, lens, rows = words(data, offsets)
            one = span_hashes(folded, starts, lens)
            for size in widths:
                _, hashes = shingles_of(one, rows, size)
                keys, n = np.unique(hashes[bloom.value.holds(hashes)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["shingle", "n"])

    counted = docs.select(text_or_empty(text_col).alias("__text")).mapInArrow(run, "shingle long, n long")
    return counted.groupBy("shingle").agg(F.sum("n").alias("n"))


def rarest(made: DataFrame, docs: DataFrame, text_col: str, widths: list[int]) -> DataFrame:
    """The windows with their rarest shingle over all documents and its place: (class, size, width, words, shingle, place)."""
    each = made.select("class", "at", F.posexplode("shingles").alias("place", "shingle"))
    known = stored(each.select("shingle").distinct(), "leak-shingles")
    counts = document_counts(docs, text_col, known, widths)
    ranked = each.join(counts, "shingle", "left").groupBy("class", "at").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "place")).alias("best"))
    return made.join(ranked, ["class", "at"]).select("class", "size", "width", "words", F.col("best.shingle").alias("shingle"), F.col("best.place").cast("long").alias("place"))


def candidates(docs: DataFrame, id_col: str, text_col: str, prefixes: DataFrame, widths: list[int], window: int) -> DataFrame:
    """(row, id, n_words, at, shingle, around, lead): a row for each document (at null), and for each place of a prefix shingle.

    around is the words near the place, at most window - 1 before it and window from it on, lead how many are before it.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    bloom = docs.sparkSession.sparkContext.broadcast(Bloom(prefixes.select("shingle").distinct(), "shingle"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in text_slices(batches, "__text"):
            folded, starts, lens, rows = words(data, offsets)
            one = span_hashes(folded, starts, lens)
            keys = part.column("__row").to_numpy()
            n = np.diff(rows)
            none = len(keys)
            yield pa.RecordBatch.from_arrays([part.column("__row"), part.column("__id"), pa.array(n), *(pa.nulls(none, t) for t in (pa.int64(), pa.int64(), pa.string(), pa.int64()))], names=["row", "id", "n_words", "at", "shingle", "around", "lead"])
            for size in widths:
                at, hashes = shingles_of(one, rows, size)
                hit = bloom.value.holds(hashes)
                at, hashes = at[hit], hashes[hit]
                if not len(at):
                    continue
                row = np.searchsorted(rows, at, "right") - 1
                low, high = np.maximum(rows[row], at - window + 1), np.minimum(rows[row + 1], at + window)
                texts = spaced(folded, starts, lens, low, high - low)
                yield pa.RecordBatch.from_arrays([pa.array(keys[row]), pa.nulls(len(at), part.column("__id").type), pa.array(n[row]), pa.array(at - rows[row]), pa.array(hashes.view(np.int64)), texts, pa.array(at - low)], names=["row", "id", "n_words", "at", "shingle", "around", "lead"])

    # the row's key holds for this one reading of the documents: the table is written and everything else reads that
    rows = docs.select(F.monotonically_increasing_id().alias("__row"), docs[id_col].alias("__id"), text_or_empty(text_col).alias("__text"))
    return stored(rows.mapInArrow(run, f"row long, id {kind}, n_words long, at long, shingle long, around string, lead long"), "leak-candidates")


def spaced(data: np.ndarray, starts: np.ndarray, lens: np.ndarray, first: np.ndarray, n: np.ndarray) -> pa.Array:
    """Texts of n words from first on, each word followed by a space."""
    which = ragged(first, n)
    sizes = lens[which] + 1
    flat = ragged(starts[which], sizes)
    ends = np.cumsum(sizes)
    raw = data[np.minimum(flat, len(data) - 1)]
    raw[ends - 1] = 32
    bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n)])].astype(np.int32)
    return pa.StringArray.from_buffers(len(n), pa.py_buffer(bounds), pa.py_buffer(raw))


def overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents (row, id, n_words), their hit words (row, block, mask) of 64 words a block, and their items (row, item)."""
    made, members = windows(items, item_col, item_text_col, window, shingle)
    shape = made.agg(F.count("*").alias("n"), F.collect_set("width").alias("widths")).first()
    widths = sorted(shape["widths"])
    prefixes = stored(rarest(made, docs, text_col, widths), "leak-prefixes")
    found = candidates(docs, id_col, text_col, prefixes, widths, window)
    side = F.broadcast(prefixes) if shape["n"] <= BROADCAST_WINDOWS else prefixes
    pairs = found.filter("at is not null").select("row", "n_words", "at", "shingle", "around", "lead").join(side, "shingle")
    first = F.col("at") - F.col("place")
    pairs = pairs.withColumn("first", first).filter((F.col("first") >= 0) & (F.col("first") + F.col("size") <= F.col("n_words")) & (F.col("lead") >= F.col("place")))
    inside = F.array_join(F.slice(F.split("around", " "), (F.col("lead") - F.col("place") + 1).cast("int"), F.col("size").cast("int")), " ")
    hits = pairs.filter(inside == F.col("words")).select("row", "class", "first", (F.col("first") + F.col("size")).alias("end"))
    # the words of a hit by blocks of 64
    block = F.explode(F.sequence(F.floor(F.col("first") / 64), F.floor((F.col("end") - 1) / 64)))
    hits = hits.withColumn("block", block)
    low, high = F.greatest(F.col("first") - 64 * F.col("block"), F.lit(0)), F.least(F.col("end") - 64 * F.col("block"), F.lit(64))
    ones = F.shiftrightunsigned(F.lit(-1).cast("long"), 0)
    mask = F.call_function("shiftleft", F.call_function("shiftrightunsigned", ones, (64 - (high - low)).cast("int")), low.cast("int"))
    marked = stored(hits.groupBy("row", "class", "block").agg(F.bit_or(mask).alias("mask")), "leak-hits")
    docs_of = found.filter("at is null").select("row", "id", "n_words")
    masks = marked.groupBy("row", "block").agg(F.bit_or("mask").alias("mask"))
    return docs_of, masks, marked.select("row", "class").distinct().join(members, "class").select("row", "item").distinct()


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", **how) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated) of every document.

    items_sha256 is of the item ids sorted as strings and joined by commas.
    """
    docs_of, masks, items_of = overlaps(docs, items, id_col, text_col, item_col, item_text_col, **how)
    hit = masks.groupBy("row").agg(F.sum(F.bit_count("mask")).cast("long").alias("n_hit"))
    listed = items_of.groupBy("row").agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("listed"))
    all_of = docs_of.join(hit, "row", "left").join(listed, "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return all_of.select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.sha2(F.encode(F.coalesce("listed", F.lit("")), "utf-8"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT coalesce(item_id::VARCHAR, '') AS item, w, least(len(w), {WINDOW}) AS size FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
v AS (SELECT DISTINCT item, size, array_to_string(w[k:k + size - 1], ' ') AS words FROM (SELECT item, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM i)),
s AS (SELECT DISTINCT size FROM v),
p AS (SELECT row, size, k, array_to_string(w[k:k + size - 1], ' ') AS words FROM (SELECT row, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d, s WHERE len(w) >= size)),
h AS (SELECT row, k, p.size, item FROM p JOIN v ON p.size = v.size AND p.words = v.words),
n AS (SELECT row, count(DISTINCT x)::BIGINT AS n_hit FROM (SELECT row, unnest(range(k, k + size)) AS x FROM h) GROUP BY row),
m AS (SELECT row, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT row, item FROM h) GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (row) LEFT JOIN m USING (row)"""
