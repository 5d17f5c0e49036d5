"""Ids that many rows share, shards and packages that end within a partition, names of attempts."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
from pyspark.sql import functions as F

from kinespark.llm import fingerprint, sstable, warc


def test_hot_ids_are_cut_on_by_text(spark, monkeypatch):
    """A third of the rows without an id, a third with one: no slot holds more than a few times its share, and the order stays."""
    monkeypatch.setattr(fingerprint, "MIN_CUT", 20)
    rng = random.Random(2)
    ids = [None] * 300 + [7] * 300 + list(range(-100, 200))
    rows = [(i, f"text {k} " + "w " * rng.randrange(9)) for k, i in enumerate(ids)] + [(7, "the same")] * 3
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    ties = {r.text: r.h for r in table.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, ties[r[1]], r[1]))
    follows = {}
    for k, (i, t) in enumerate(order):
        follows.setdefault((i, t), []).append(order[(k + 1) % len(order)][1])
    marks = spark.createDataFrame([(7,), (3,), (None,)], "doc_id long")
    got = fingerprint.with_next(table, marks).collect()
    assert len(got) == len(rows) and all(r.marked == (r.doc_id in (None, 3, 7)) for r in got)
    found = {}
    for r in got:
        found.setdefault((r.doc_id, r.text), []).append(r.next_text)
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in follows.items()}


def test_shards_end_by_bytes(spark, monkeypatch):
    """Shards of a few blocks in a single partition: order, starts, filters and lookups hold over their bounds."""
    monkeypatch.setattr(sstable, "BLOCK_BYTES", 256)
    monkeypatch.setattr(sstable, "SHARD_BYTES", 1000)
    rows = [(k % 90 - 40, f"words of document {k} " * (k % 7)) for k in range(200)] + [(None, "no id"), (5, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        manifest = sstable.write_shards(table, P.path("byte_bpe_50k.json"))
        made = sstable.read_shards(manifest).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert manifest.count() > 5 and sorted(str(r.doc_id) for r in made) == sorted(str(i) for i, _ in rows)
    start = 0
    for r in sorted(made, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
    ids = [r.doc_id for r in sorted(made, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    for doc_id in (None, -40, 5, 49):
        stored = sorted(zlib.crc32(x.astype("<u4").tobytes()) for x in sstable.lookup(manifest, doc_id))
        assert stored == sorted(r.ids_crc32 for r in made if r.doc_id == doc_id) and stored
    assert sstable.lookup(manifest, 10**6) == []


def test_filter_in_bulk_equals_one_by_one():
    class Out(bytearray):
        write = bytearray.extend

    out = Out()
    writer = sstable.Writer(out, 2)
    keys = [sstable.key_of(k * 977 - 5000) for k in range(500)]
    for key in keys:
        writer.add(key, b"\0\0")
    writer.close()
    bits = (10 * 500 + 7) & ~7
    bloom = bytes(out)[writer.at : writer.at + bits // 8]
    want = np.zeros(bits, np.uint8)
    want[[p for key in keys for p in sstable.bloom_places(key, 7, bits)]] = 1
    assert bloom == np.packbits(want, bitorder="little").tobytes()


def test_packages_of_attempts_do_not_meet(spark, monkeypatch):
    """Packages of one partition carry its attempt in their names, and a page is in one of them."""
    monkeypatch.setattr(warc, "PACKAGE_BYTES", 4000)
    pages = spark.createDataFrame([(k, f"http://x/{k}", hashlib.sha256(str(k).encode()).hexdigest() * 30) for k in range(40)], "page_id long, url string, html string").coalesce(1)
    manifest = warc.write(pages)
    names = [r.path.rsplit("/", 1)[1] for r in manifest.collect()]
    assert len(names) > 3 and all(len(n.split("-")) == 3 for n in names)
    assert sorted(r.page_id for r in warc.read(manifest).select("page_id").collect()) == list(range(40))
