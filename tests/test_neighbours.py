"""Exact neighbour search against comparing all, on clustered, even and degenerate vectors."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinespark.operators import neighbours as nb


def by_hand(queries, rows, k):
    found = {}
    for i, v in queries:
        d = sorted((round(float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), 9), j) for j, w in rows if j != i)
        found[i] = [(j, r + 1) for r, (_, j) in enumerate(d[:k])]
    return found


def frame(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "id long, v array<double>")


@pytest.fixture(params=["clusters", "even", "copies", "few"])
def points(request):
    rng = np.random.default_rng(8)
    if request.param == "clusters":
        return [(k, rng.normal(size=4) + 100 * (k % 12)) for k in range(900)]
    if request.param == "even":
        return [(k, rng.normal(size=16)) for k in range(600)]
    if request.param == "copies":  # two thirds are copies of one, at equal distance from every pivot
        return [(k, [1.0, 2.0, 3.0] if k % 3 else rng.normal(size=3)) for k in range(900)]
    return [(k, rng.normal(size=3)) for k in range(4)]


@pytest.mark.parametrize("k", [1, 7])
def test_neighbours_equal_comparing_all(spark, monkeypatch, points, k):
    monkeypatch.setattr(nb, "QUERY_ROWS", 50)
    rows = frame(spark, points).unionByName(spark.createDataFrame([(10**6, None)], "id long, v array<double>"))
    asked = [p for p in points if p[0] % 5 == 0] + [(-1, points[0][1])]
    found, visits = nb.search(frame(spark, asked), rows, "id", "v", k, block_rows=16)
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r.query, r.rank)):
        got.setdefault(r.query, []).append((r.neighbour, r.rank))
    assert got == by_hand(asked, points, k)
    # no query meets a block twice
    assert visits.count() == visits.select("query", "block").distinct().count()


def test_bounds_skip_what_is_far(spark):
    rng = np.random.default_rng(9)
    points = [(k, rng.normal(size=6) + 1000 * (k % 16)) for k in range(3200)]
    rows = frame(spark, points)
    queries = rows.filter("id % 20 = 0")
    found, visits = nb.search(queries, rows, "id", "v", 5, block_rows=64)
    share = nb.compared_share(visits, queries, rows).first()
    assert share.pairs == 160 * 3200 and 0 < share.share < 0.15
    assert found.filter(F.col("distance") > 100).isEmpty()


def test_no_rows(spark):
    none = frame(spark, [])
    assert nb.neighbours(none, none, "id", "v", 3).count() == 0
    assert nb.neighbours(frame(spark, [(1, [0.0])]), none, "id", "v", 3).count() == 0
    assert nb.neighbours(none, frame(spark, [(1, [0.0])]), "id", "v", 3).count() == 0


def test_visits_go_out_in_parts():
    """A batch of queries that visit every block is not one batch, as large as the product of the two."""
    n, blocks = 3000, 40
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), pa.array(np.arange(n)), pa.array(np.ones((n, 4)).tolist())], names=["chunk", "id", "v"])
    made = list(nb.sent(iter([batch]), lambda b: np.ones((b.num_rows, blocks), bool), np.array([f"b{k}" for k in range(blocks)]), np.arange(blocks)))
    assert max(m.num_rows for m in made) <= nb.SENT_ROWS and sum(m.num_rows for m in made) == n * blocks
    pairs = {(q, b) for m in made for q, b in zip(m.column("id").to_pylist(), m.column("block").to_pylist(), strict=True)}
    assert len(pairs) == n * blocks


def test_queries_are_not_sent_out_for_every_block(spark, tmp_path, monkeypatch):
    """Vectors near each other meet all blocks; what is written must not grow with queries times blocks."""
    made, plain = [], nb.written
    monkeypatch.setattr(nb, "written", lambda df, *a, **o: made.append(plain(df, *a, **o)) or made[-1])
    rng = np.random.default_rng(10)
    rows = frame(spark, [(k, rng.normal(size=16)) for k in range(900)])
    found, visits = nb.search(rows, rows, "id", "v", 3, block_rows=16)
    assert visits.count() > 20 * 900
    assert max(t.count() for t in made) <= 3 * 900 and found.count() == 3 * 900


def test_far_and_large_vectors_keep_their_order(spark):
    """Single precision tells candidates only: neighbours far from the origin and of very large numbers are exact."""
    rng = np.random.default_rng(11)
    for scale, middle in ((1e-3, 1e6), (1e18, 0.0), (1.0, 0.0)):
        points = [(k, rng.normal(size=5) * scale + middle) for k in range(300)]
        found = nb.neighbours(frame(spark, points[:40]), frame(spark, points), "id", "v", 4, block_rows=32)
        got = {(r.query, r.rank): r.neighbour for r in found.collect()}
        x = np.stack([v for _, v in points])
        for i in range(40):
            d = np.sqrt(((x - x[i]) ** 2).sum(1)).round(9)
            d[i] = np.inf
            assert [got[i, r] for r in range(1, 5)] == np.lexsort((np.arange(300), d))[:4].tolist()
