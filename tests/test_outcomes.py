"""A fitted outcome model against cell means, where the reward follows a number that cells don't tell apart."""

import random

import pytest
from pyspark.sql import functions as F

from rankloom.operators import metrics, outcomes

ACTIONS = {"a": (0.7, 0.2), "b": (0.2, 0.2), "c": (0.1, 0.6)}


def logged(n, seed=3):
    """Reward: x for a, 1 - x for b, 0.5 for c; true value of the policy: 0.2 * 0.5 + 0.2 * 0.5 + 0.6 * 0.5."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x, a = rng.random(), rng.choices(list(ACTIONS), [p for p, _ in ACTIONS.values()])[0]
        r = {"a": x, "b": 1 - x, "c": 0.5}[a] + rng.gauss(0, 0.02)
        out.append((i, "one", x, a, r, *ACTIONS[a]))
    return out


SCHEMA = "obs_id long, context string, x double, action string, reward double, logging_propensity double, candidate_propensity double"


def test_fitted_model_beats_cell_means(spark):
    log = spark.createDataFrame([*logged(1500), (9001, "one", 0.1, None, 0.5, 0.1, 0.1), (9002, "one", 0.1, "a", None, 0.1, 0.1)], SCHEMA)
    policy = spark.createDataFrame([(a, p) for a, (_, p) in ACTIONS.items()], "action string, pi double")
    fitted = outcomes.cross_fitted(log, policy, ["x"], ["context"]).cache()
    rows = fitted.collect()
    assert len(rows) == 1500 and {r.fold for r in rows} == set(range(5))
    by = fitted.join(log.select("obs_id", "action"), "obs_id").groupBy("action", "fold").count().collect()
    for a in ACTIONS:
        own = [r["count"] for r in by if r.action == a]
        assert max(own) - min(own) <= 1
    got = outcomes.estimates(fitted).first()
    assert got.direct == pytest.approx(0.5, abs=0.02) and got.doubly_robust == pytest.approx(0.5, abs=4 * got.standard_error + 0.005)
    # The model explains what cell means leave to the weights' noise.
    means = log.where("reward is not null and action is not null").groupBy("action").agg(F.avg("reward").alias("mu"))
    error = lambda df: df.agg(F.avg(F.pow(F.col("reward") - F.col("mu"), 2))).first()[0]
    plain = log.where("reward is not null and action is not null").join(means, "action")
    assert error(fitted) < 0.2 * error(plain)
    assert metrics.doubly_robust(log.where("reward is not null and action is not null")).first().doubly_robust == pytest.approx(0.5, abs=0.1)
    fitted.unpersist()


def test_edges(spark):
    policy = spark.createDataFrame([("a", 0.5), ("never", 0.5)], "action string, pi double")
    one = spark.createDataFrame(logged(1), SCHEMA)
    alone = outcomes.cross_fitted(one, policy, ["x"], ["context"]).first()
    assert alone.mu == 0 and alone.dm == 0
    assert outcomes.cross_fitted(one.where("false"), policy, ["x"], ["context"]).count() == 0
