"""Held-out quality of the toxicity scores, the signs of the curve, and what is left in the shared folder."""

import zlib

import numpy as np

from kinespark.llm import common, toxicity
from kinespark.llm.queries import table

LARGE = "/root/testdata/sf0.1"


def test_held_out_rows_are_told_apart(spark):
    docs, labels = table(spark, LARGE, "documents"), table(spark, LARGE, "labels")
    model = toxicity.fit(docs, labels)
    assert (model.curve[1:] >= 0).all()
    truth = labels.filter("toxic is not null").select("doc_id", "toxic")
    held = toxicity.score(docs.select("doc_id", "text"), model).join(truth, "doc_id").filter(toxicity.remainder(docs["doc_id"]) == 0).toPandas()
    y, s = held["toxic"].to_numpy(), held["score"].to_numpy()
    ranks, positive = held["score"].rank().to_numpy(), int(y.sum())
    auc = (ranks[y == 1].sum() - positive * (positive + 1) / 2) / (positive * (len(y) - positive))
    said = s >= 0.5
    assert auc >= 0.95 and y[said].mean() >= 0.95 and said[y == 1].mean() >= 0.68


def test_slopes_stay_at_zero_or_above():
    """A figure that goes down with the label gets no weight, whatever its size; one that goes up does."""
    rng = np.random.default_rng(0)
    y = (rng.random(300) < 0.3).astype(float)
    x = np.stack([y + rng.normal(size=300), -5 * y + rng.normal(size=300), rng.normal(size=300) / 100], 1)
    curve = toxicity.fit_curve(x, y, np.ones(300))
    assert curve[1] > 0.5 and curve[2] == 0 and curve[3] >= 0
    few = toxicity.fit_curve(x[:12], y[:12], np.ones(12))
    assert few[1] < curve[1]


def test_choice_takes_the_largest_discount_that_is_as_good():
    rng = np.random.default_rng(1)
    y = np.r_[np.zeros(200), np.ones(200)]
    good, bad = y + rng.normal(size=400) / 2, rng.normal(size=400)
    alike = good + rng.normal(size=400) / 100
    x = np.stack([c[:, None] for c in (bad, good, alike, bad)], 1)
    assert toxicity.best_choice(x, y, np.ones(400), np.arange(400) % 5) == 2
    assert toxicity.best_choice(x[:3], y[:3], np.ones(3), np.arange(3)) == 0


def test_tables_are_deleted_with_their_block(spark):
    with common.temporary(spark):
        inside = common.stored(spark.range(3), "gone")
        fs, folder = common.filesystem(toxicity.folder_of(inside))
        kept = common.stored(spark.range(3), "kept", keep=True)
    assert fs.get_file_info(folder).type.name == "NotFound" and kept.count() == 3
    paths = [p for p in common._AT_END if "/kept-" in p]
    assert len(paths) == 1
    common._AT_END.remove(paths[0])
    common.delete(paths)


def test_every_labelled_row_outside_the_held_out_fifth_is_fitted(spark):
    """A class of more than 10,000 rows was sampled: words of the rows left out were unknown."""
    n = 14_000
    docs = spark.range(n).selectExpr("id AS doc_id", "concat('only', id, ' of all') AS text")
    labels = docs.selectExpr("doc_id", "1 AS quality", "int(doc_id % 7 = 0) AS toxic")
    counted, curve = toxicity.fit_rows(docs, labels)
    parts = [zlib.crc32(str(k).encode()) % 5 for k in range(n)]
    assert sum(p > 0 for p in parts) > 11_000 and (counted.count(), curve.count()) == (sum(p > 1 for p in parts), parts.count(1))
    assert toxicity.count_pairs(counted).select("here").distinct().count() == sum(p > 1 for p in parts) + 2
    assert counted.agg({"toxic": "sum"}).first()[0] == sum(p > 1 and k % 7 == 0 for k, p in enumerate(parts))


def test_ids_of_other_kinds_and_labels_given_twice(spark):
    docs = spark.createDataFrame([(f"d{k}", "a text") for k in range(50)] + [(None, "without an id")], "doc_id string, text string")
    labels = spark.createDataFrame([(f"d{k}", t) for k in range(0, 60, 2) for t in (0, int(k % 3 == 0), None)], "doc_id string, toxic int")
    got = sum(([r.toxic for r in rows.collect()] for rows in toxicity.fit_rows(docs, labels)), [])
    assert sorted(got) == sorted(int(k % 3 == 0) for k in range(0, 50, 2) if zlib.crc32(f"d{k}".encode()) % 5)
    assert all(rows.isEmpty() for rows in toxicity.fit_rows(docs, labels.limit(0)))


def test_large_tables_are_streamed_through(spark, monkeypatch):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 400, 60)) for _ in range(300)]
    rows = spark.createDataFrame([(t, int(k % 3 == 0)) for k, t in enumerate(texts)], "text string, toxic int").repartition(3)
    model = toxicity.fit_counts(common.stored(toxicity.count_pairs(rows), "counts"))
    raw = np.frombuffer(" ".join([*texts[:9], "unknown words"]).encode(), np.uint8)
    at, choices = np.array([0, len(raw)]), range(len(model.choices))
    monkeypatch.setattr(toxicity, "_READ", {})
    held = model.evidence_of(raw, at, choices)
    assert len(toxicity._READ) == 3 and model.limit() == toxicity.SCORE_BYTES
    monkeypatch.setattr(toxicity, "_READ", {})
    monkeypatch.setattr(toxicity, "HELD_BYTES", 0)
    assert (model.evidence_of(raw, at, choices) == held).all() and np.abs(held).min() > 0
    assert not toxicity._READ and model.limit() == toxicity.STREAM_BYTES


def test_curves_of_sums_in_tasks(spark):
    rng = np.random.default_rng(6)
    y = (rng.random(500) < 0.4).astype(int)
    x, fold = y[:, None] * 1.5 + rng.normal(size=(500, 4)), np.arange(500) % 5
    seen = spark.createDataFrame([(int(a), int(f), *map(float, r)) for a, f, r in zip(y, fold, x, strict=True)], "toxic int, fold int, x0 double, x1 double, x2 double, x3 double").repartition(3)
    tasks, here = toxicity.in_tasks(seen, 2, 2), toxicity.in_memory(x.reshape(-1, 2, 2), y, np.ones(500), fold)
    fits = [(0, None), (1, None), (1, 3)]
    assert np.allclose(toxicity.curves(tasks, 2, fits), toxicity.curves(here, 2, fits), atol=1e-6)
    assert toxicity.choose(tasks, 2, 2) == toxicity.choose(here, 2, 2)
