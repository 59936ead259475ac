"""The linear ranker against all pairs of a query, one by one."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators import learned, pairs

SCHEMA = "query_id long, product_id long, relevance int, a double, b double"


def planted(sizes, seed=1):
    rng, out = random.Random(seed), []
    for q, n in sizes.items():
        for i in range(n):
            a, b = rng.gauss(0, 1), rng.gauss(1e4, 2)
            out.append((q, i, rng.choice([None, 0, 1, 2, 3]) if rng.random() < 0.4 else int(max(0, min(3, round(a - 0.2 * (b - 1e4) + 1)))), a, b))
    return out


def slope(rows, weights):
    """Gradient of the mean loss over all pairs, and the loss."""
    total, loss, grad = 0.0, 0.0, np.zeros(2)
    for q, _, r, *x in rows:
        for p, _, s, *y in rows:
            if p == q and r is not None and s is not None and r > s:
                gap, d = 2.0**r - 2.0**s, np.array(x) - np.array(y)
                miss = 1 / (1 + math.exp(d @ weights))
                total, loss, grad = total + gap, loss + gap * math.log1p(math.exp(-(d @ weights))), grad - gap * miss * d
    return grad / total + learned.RIDGE * np.array(weights), loss / total + learned.RIDGE / 2 * np.dot(weights, weights)


@pytest.mark.parametrize("size", [4096, 9])
def test_no_pair_is_left_out(spark, monkeypatch, size):
    monkeypatch.setattr(pairs, "BLOCK", size)
    rows = planted({1: 60, 2: 25, 3: 8, None: 20, 5: 1})
    weights = learned.fit_pairwise(spark.createDataFrame(rows, SCHEMA), ["a", "b"])
    # At the least loss over all pairs there is no slope; a few partners of each row have theirs elsewhere.
    grad, _ = slope(rows, weights)
    assert np.abs(grad).max() < 1e-6 and weights[0] > 0.5 and weights[1] < -0.05


def test_pairs_are_each_taken_once(spark, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK", 9)
    rows = planted({1: 60, 2: 25, 3: 8, 4: 3, 5: 3, None: 20})
    df = spark.createDataFrame(rows, SCHEMA).where("relevance is not null").selectExpr("query_id as _query", "pow(2, relevance) - 1 as _gain", "array(a, b) as _x")
    held = pairs.dealt(df).localCheckpoint()
    groups = pairs.grouped(held)
    weight, loss, grad, _ = pairs.measured(held, np.array([0.3, -0.2]))
    want, own = slope(rows, np.array([0.3, -0.2]))
    assert np.allclose(grad / weight, want - learned.RIDGE * np.array([0.3, -0.2]), rtol=1e-9)
    assert loss / weight == pytest.approx(own - learned.RIDGE / 2 * 0.13, rel=1e-9)
    # No group has more than two blocks of a large query.
    fullest = groups.where("_a < _b").groupBy(*pairs.GROUP).count().agg(F.max("count")).first()[0]
    assert fullest <= 4 * 9 and groups.where("_large = 1").select("_a", "_b").distinct().count() > 10


def test_nothing_to_tell_apart(spark):
    df = spark.createDataFrame([(1, 1, 2, 0.5, 1.0), (1, 2, 2, 0.7, 2.0), (2, 1, 0, 0.1, 0.2), (3, 1, None, 0.1, 0.2)], SCHEMA)
    assert learned.fit_pairwise(df, ["a", "b"]) == [0.0, 0.0] == learned.fit_pairwise(df.limit(0), ["a", "b"])
