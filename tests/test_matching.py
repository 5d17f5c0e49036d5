"""Event matching as a stream over ranges against whole trials."""

import random

import pytest

from kinespark.operators import matching


def by_hand(detected, truth, tolerance):
    free, n, error = sorted(detected), 0, 0
    for t in sorted(truth):
        near = [(abs(d - t), k) for k, d in enumerate(free) if d is not None and abs(d - t) <= tolerance]
        if near:
            distance, k = min(near)
            free[k], n, error = None, n + 1, error + distance
    return n, len(detected) - n, len(truth) - n, len(detected), len(truth), error


@pytest.mark.parametrize("partitions", ["1", "9"])
def test_matches_over_ranges(spark, partitions):
    """Clusters longer than a range, equal times, one-sided trials, null keys; ranges of some twenty rows each."""
    rng = random.Random(7)
    trials = {("dense", "l"): 300, ("dense", "r"): 40, ("sparse", "l"): 60, (None, "l"): 20, ("one", None): 1}
    detected, truth = {}, {}
    for key, n in trials.items():
        width = n * (2 if key[0] == "dense" else 30)
        detected[key] = [rng.randrange(width) for _ in range(n)]
        truth[key] = [rng.randrange(width) for _ in range(n // 2)] if key[0] != "one" else []
    truth[("only", "l")], detected[("only", "l")] = [5, 5, 9], []
    rows = lambda of: [(*k, t) for k, ts in of.items() for t in ts] + [("dense", "l", None)]
    schema = "trial string, side string, t long"
    before = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        for c, v in zip(before, (partitions, "false", "11"), strict=True):
            spark.conf.set(c, v)
        made = matching.match_events(spark.createDataFrame(rows(detected), schema), spark.createDataFrame(rows(truth), schema), ["trial", "side"], "t", 7)
        got = {(r.trial, r.side): tuple(r)[2:] for r in made.collect()}
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert got == {k: by_hand(detected[k], truth[k], 7) for k in detected}


def test_no_events(spark):
    none = spark.createDataFrame([], "trial string, t long")
    assert matching.match_events(none, none, ["trial"], "t", 7).count() == 0
