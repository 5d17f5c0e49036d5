"""Texts that are moved or written between steps go packed, and come back whole."""

import random

from pyspark.sql import functions as F

from kinespark.llm import common, fingerprint


def test_next_texts_move_packed(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice(["river", "stone", "übermäßig", "\u0000", "𝔘"]) for _ in range(rng.randrange(300)))) for k in range(200)] + [(None, ""), (7, "x")]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    marks = spark.createDataFrame([(7,)], "doc_id long")
    plain = fingerprint.with_next(table, marks).collect()
    small = fingerprint.with_next(table, marks, small=True).collect()
    told = sorted((str(r.doc_id), common.unpack(r.text).decode(), common.unpack(r.next_text).decode(), r.marked) for r in small)
    assert told == sorted((str(r.doc_id), r.text, r.next_text, r.marked) for r in plain)
    assert 2 * sum(len(r.text) for r in small) < sum(len(t.encode()) for _, t in rows)
    assert fingerprint.edits(table).filter(F.col("n_chars") == 0).count() == sum(not t for _, t in rows)


def test_slices_of_packed_texts_are_bounded(spark):
    import pyarrow as pa

    texts = [b"", b"a" * 900, b"b" * 900, b"c" * 5000, b"d"]
    batch = pa.RecordBatch.from_arrays([pa.array([common.pack(t) for t in texts], pa.binary())], names=["text"])
    parts = [[common.unpack(t) for t in p.column("text").to_pylist()] for p in common.packed_slices(batch, "text", 1000)]
    assert parts == [texts[:2], texts[2:3], texts[3:4], texts[4:]]
    assert sum(len(o) - 1 for _, _, o in common.unpacked_slices(batch, "text")) == len(texts)
