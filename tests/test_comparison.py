"""Pairs of treatments: signed-rank tests, their corrections, and the matrix of differences."""

import math
import random

import pytest

from kinespark.operators import comparison


def by_hand(d):
    d = [x for x in d if x]
    n, order = len(d), sorted(abs(x) for x in d)
    rank = lambda x: (2 * order.index(abs(x)) + order.count(abs(x)) + 1) / 2
    up, down = (sum(rank(x) for x in d if x * s > 0) for s in (1, -1))
    ties = sum(order.count(v) ** 3 - order.count(v) for v in set(order))
    z = (min(up, down) - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    return n, min(up, down), z, math.erfc(abs(z) / math.sqrt(2))


def test_pairs_and_their_matrix(spark):
    rng = random.Random(6)
    values = {m: [round(shift + rng.random(), 2) for _ in range(40)] for m, shift in (("a", 0.0), ("b", 0.05), ("c", 1.0))}
    values["same"] = list(values["a"])
    rows = [(k, m, v) for m, vs in values.items() for k, v in enumerate(vs)]
    pairs = comparison.wilcoxon_pairs(spark.createDataFrame(rows, "block long, model string, v double"), "block", "model", "v")
    got = {(r.model_a, r.model_b): r for r in pairs.collect()}
    tests = {}
    for x in values:
        for y in values:
            if x < y:
                tests[x, y] = (0, None, None, 1.0) if (x, y) == ("a", "same") else by_hand([round(p - q, 12) for p, q in zip(values[x], values[y], strict=True)])
    assert set(got) == set(tests)
    most = 0.0
    for place, key in enumerate(sorted(tests, key=lambda k: tests[k][3])):
        n, w, z, p = tests[key]
        most = max(most, min(1.0, (len(tests) - place) * p))
        r = got[key]
        assert (r.n, r.w) == (n, w) and r.p == pytest.approx(p, rel=1e-6, abs=1e-12) and r.p_holm == pytest.approx(most, rel=1e-6, abs=1e-12) and (r.z is None if z is None else r.z == pytest.approx(z))
    matrix = {r.model: r.asDict() for r in comparison.difference_matrix(pairs, ["a", "b", "c", "same"]).collect()}
    assert matrix["a"]["c"] and matrix["c"]["a"] and matrix["c"]["b"] and not matrix["a"]["same"] and not matrix["b"]["b"]
