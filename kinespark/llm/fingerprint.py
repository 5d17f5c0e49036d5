"""Canonical exact fingerprints: Unicode normalisation, case and white-space folding, then a 128-bit xxhash.

canonical() is NFKC, casefold, NFKC again, runs of white space as one space, none at the ends. Texts with equal
canonical forms have equal fingerprints. exact_groups() and edits() group by fingerprint and compare the canonical bytes of
each document with those of its bucket's first, so a collision of hashes joins nothing. Fingerprints alone tell which
documents share a bucket; only these bring their canonical bytes to the comparison. edits() moves texts and canonical bytes
compressed; the compression loses nothing, so equal bytes are equal still.

Defined results: a null text counts as empty; all empty texts have one fingerprint; repeated rows are separate
documents; ids may repeat or be null (null first), ties of the order are settled by the text's hash, then by text; texts of any length are
taken whole; an empty table gives an empty result; other columns are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinespark.llm.common import n_partitions, pack, packed, packed_slices, stored, text_or_empty, text_slices, unpack

#: Up to so many range bounds are compared in one expression.
MANY_CUTS = 1000
#: A range of one id is cut on from this many rows at least; no range has more than MOST_PARTS parts.
MIN_CUT, MOST_PARTS = 1000, 1 << 20


def canonical(text: str) -> str:
    if text.isascii():
        return " ".join(text.lower().split())
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split())


def digest(form: str) -> str:
    return xxhash.xxh3_128_hexdigest(form.encode())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", forms: bool = True) -> DataFrame:
    """(id, fingerprint, canonical) of every whole text; canonical is null unless forms are asked for."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, _ in text_slices(batches, "__text"):
            made = [canonical(t) for t in part.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("__id"), pa.array([digest(f) for f in made], pa.string()), pa.array(made if forms else [None] * len(made), pa.string())], names=["id", "fingerprint", "canonical"])

    return docs.select(docs[id_col].alias("__id"), text_or_empty(text_col).alias("__text")).mapInArrow(run, f"id {kind}, fingerprint string, canonical string").withColumnRenamed("id", id_col)


def shared_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id) of the documents whose fingerprint another row has too, written; no text is moved."""
    prints = stored(fingerprints(docs, id_col, text_col, forms=False).select(id_col, "fingerprint"), "prints")
    shared = prints.groupBy("fingerprint").agg(F.count("*").alias("n")).filter("n > 1").select("fingerprint")
    return stored(prints.join(shared, "fingerprint").select(id_col).distinct(), "prints-shared")


def in_groups(marked: DataFrame, id_col: str) -> DataFrame:
    """marked's columns but canonical, and group_id, n_copies: group_id is the smallest id with the same canonical bytes.

    Buckets are pre-aggregated to a first id and its form, so a bucket with a third of all rows sends a row a task; the
    join back is one that Spark splits where a bucket is large. Rows whose bytes differ from the first's (a collision) are
    grouped by the bytes themselves. Rows without a canonical form are known to be alone.
    """
    others = [c for c in marked.columns if c != "canonical"]
    several, alone = marked.filter("canonical is not null"), marked.filter("canonical is null").select(*others)
    first = several.groupBy("fingerprint").agg(F.count("*").alias("__n"), F.min(F.struct(F.col(id_col).alias("i"), F.col("canonical").alias("c"))).alias("__first")).filter("__n > 1")
    joined = several.join(first.withColumnRenamed("fingerprint", "__f"), F.col("fingerprint") == F.col("__f"), "left")
    same = F.col("__n").isNull() | (F.col("canonical") == F.col("__first.c"))
    settled = joined.filter(same).select(*others, F.when(F.col("__n").isNull(), F.col(id_col)).otherwise(F.col("__first.i")).alias("group_id"))
    apart = joined.filter(~same).select(*others, F.min(id_col).over(Window.partitionBy("fingerprint", "canonical")).alias("group_id"))
    grouped = stored(settled.unionByName(apart), "print-groups")
    sizes = grouped.groupBy(F.col("fingerprint").alias("__f"), F.col("group_id").alias("__g")).agg(F.count("*").alias("n_copies"))
    counted = grouped.join(sizes, (F.col("fingerprint") == F.col("__f")) & F.col("group_id").eqNullSafe(F.col("__g"))).drop("__f", "__g")
    return counted.unionByName(alone.select(*others, F.col(id_col).alias("group_id"), F.lit(1).cast("long").alias("n_copies")))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, group_id, n_copies) of every document."""
    return in_groups(fingerprints(docs, id_col, text_col), id_col)


def with_next(docs: DataFrame, marks: DataFrame, id_col: str = "doc_id", text_col: str = "text", small: bool = False) -> DataFrame:
    """(id, text, next_text, marked): the text of the next document by ascending id; after the last, the first.

    marked tells whether marks (id) holds the id, or there is none; marks come as rows beside the texts, which so stay put.
    Ids are cut into ranges by quantiles, a bounded list; a range of one id (or none) with many rows is cut on by the hash of
    the text, which settles ties. The first document of each slot is also sent to the slot before it, so each slot is
    windowed by itself and every text moves once. With small, texts move and come packed.
    """
    base = docs.select(docs[id_col].cast("long").alias("__id"), text_or_empty(text_col).alias("__text"))
    base = base.withColumn("__tie", F.xxhash64("__text"))
    n = 4 * n_partitions(docs)
    cuts = sorted(set(base.select("__id").approxQuantile("__id", [k / n for k in range(1, n)], 0.25 / n))) if n > 1 else []
    cuts = [int(c) for c in cuts]
    at = F.when(F.col("__id").isNull(), -1).otherwise(place(cuts, F.col("__id"))).cast("long")
    sizes = base.groupBy(at.alias("range")).agg(F.count("*").alias("n"), F.min("__id").alias("low"), F.max("__id").alias("high")).collect()
    most = max(MIN_CUT, 2 * sum(r["n"] for r in sizes) // n)
    hot = {r["range"]: -(-r["n"] // most) for r in sizes if r["low"] == r["high"] and r["n"] > most}
    parts, slot = F.lit(1).cast("long"), at * MOST_PARTS
    for r, k in hot.items():
        parts = F.when(at == r, k).otherwise(parts)
        slot = F.when(at == r, r * MOST_PARTS + F.floor((F.col("__tie") / F.lit(2.0**64) + 0.5) * k)).otherwise(slot)
    ranged = base.withColumn("__range", slot.cast("long"))
    heads = sorted((r["__range"], r["h"]) for r in ranged.groupBy("__range").agg(F.min("__id").alias("h")).collect())
    order = [F.col("__id").asc_nulls_first(), F.col("__tie"), F.col("__text")]
    if not heads:
        base = packed(base, "__text") if small else base
        return base.select(F.col("__id").alias(id_col), F.col("__text").alias("text"), F.col("__text").alias("next_text"), F.lit(False).alias("marked"))
    before = {heads[(k + 1) % len(heads)][0]: r for k, (r, _) in enumerate(heads)}
    # the first row of each slot: a min by slot that every task pre-aggregates
    spark = docs.sparkSession
    firsts = ranged.join(F.broadcast(spark.createDataFrame(heads, "__range long, __head long")), "__range").filter(F.col("__id").eqNullSafe(F.col("__head")))
    firsts = firsts.groupBy("__range").agg(F.min(F.struct("__tie", "__text")).alias("__first"))
    to = spark.createDataFrame([(k, v) for k, v in before.items()], "__range long, __to long")
    copies = firsts.join(F.broadcast(to), "__range").select(F.lit(None).cast("long").alias("__id"), F.col("__first.__text").alias("__text"), F.col("__first.__tie").alias("__tie"), F.col("__to").alias("__range"), F.lit(1).alias("__copy"))
    rows = ranged.withColumn("__copy", F.lit(0)).unionByName(copies)
    rows = packed(rows, "__text") if small else rows
    ids = marks.select(marks[id_col].cast("long").alias("__id")).filter("__id is not null")
    every = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda k: at * MOST_PARTS + k))
    rows = rows.unionByName(ids.select("__id", F.lit(None).cast("binary" if small else "string").alias("__text"), F.lit(None).cast("long").alias("__tie"), every.alias("__range"), F.lit(2).alias("__copy")))
    follow = Window.partitionBy("__range").orderBy("__copy", *order)
    marked = F.col("__id").isNull() | (F.max("__copy").over(Window.partitionBy("__range", "__id")) == 2)
    rows = rows.withColumn("next_text", F.lead("__text").over(follow)).withColumn("marked", marked)
    return rows.filter("__copy = 0").select(F.col("__id").alias(id_col), F.col("__text").alias("text"), "next_text", "marked")


def place(cuts: list[int], value: Column) -> Column:
    """The number of cuts at or below value, by halving; a long list is searched by NumPy."""
    if not cuts:
        return F.lit(0)
    if len(cuts) > MANY_CUTS:
        known = np.array(cuts)
        return F.pandas_udf(lambda ids: pd.Series(np.searchsorted(known, ids.to_numpy(), "right").astype(np.int32)), "int")(value)

    def half(low: int, high: int):
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(value < F.lit(cuts[mid]), half(low, mid)).otherwise(half(mid + 1, high))

    return half(0, len(cuts))


def likeness(a: str, b: str, form_a: str, form_b: str) -> float:
    """1 if the fingerprints and then the bytes agree, else 0: an exact fingerprint knows no degrees."""
    return 1.0 if a == b and form_a == form_b else 0.0


def edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part: int = 4) -> DataFrame:
    """Fingerprints of every text, of its edited text and of the next text, and the text's group of exact copies.

    The edited text has its last floor(n / part) code points replaced by the first as many of the next document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in (part for batch in batches for part in packed_slices(batch, "text")):
            found, held = [], rows.column("text").to_pylist()
            texts = [unpack(t).decode() for t in held]
            forms = [canonical(t) for t in texts]
            prints = [digest(f) for f in forms]
            for at, (text, following, marked) in enumerate(zip(texts, rows.column("next_text").to_pylist(), rows.column("marked").to_pylist(), strict=True)):
                k = len(text) // part
                # the next text is the next row's but at a slice's end
                known = at + 1 < len(texts) and held[at + 1] == following
                following = texts[at + 1] if known else unpack(following).decode()
                edited = text[: len(text) - k] + following[:k]
                form = canonical(edited)
                after = (prints[at + 1], forms[at + 1]) if known else (digest(f := canonical(following)), f)
                own, other = prints[at], digest(form)
                found.append((len(text), hashlib.sha256(edited.encode()).hexdigest(), own, other, pack(forms[at].encode()) if marked else None, likeness(own, other, forms[at], form), likeness(own, after[0], forms[at], after[1])))
            columns = list(zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([rows.column(id_col).cast(pa.int64()), pa.array(columns[0], pa.int64()), *(pa.array(c, pa.string()) for c in columns[1:4]), pa.array(columns[4], pa.binary()), *(pa.array(c, pa.float64()) for c in columns[5:])], names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "canonical", "near_edited", "near_next"])

    paired = with_next(docs, shared_ids(docs, id_col, text_col), id_col, text_col, small=True)
    made = paired.mapInArrow(run, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, canonical binary, near_edited double, near_next double").withColumnRenamed("id", id_col)
    return in_groups(stored(made, "edits"), id_col)
