"""Exact quantiles against numpy: hot values, nulls, small and empty groups, and the reports made of them."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators import metrics, quantiles, sampling

SHARES = {"a": 0.0, "b": 0.01, "c": 0.5, "d": 0.95, "e": 1.0}


def test_equals_numpy(spark):
    rng = random.Random(2)
    rows = [("hot", 7.0) for _ in range(3000)] + [("hot", rng.gauss(7, 3)) for _ in range(4000)] + [("few", x) for x in (3.0, 1.0)] + [("one", -2.5)] + [(None, float(i)) for i in range(500)]
    rows += [("none", None), ("none", float("nan")), ("few", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: r for r in quantiles.quantiles(df, F.col("v"), SHARES, ["g"]).collect()}
    assert set(got) == {"hot", "few", "one", None}
    for g, r in got.items():
        own = [v for k, v in rows if k == g and v is not None and v == v]
        assert r.n == len(own)
        for name, q in SHARES.items():
            assert r[name] == pytest.approx(np.quantile(own, q), abs=1e-12)
    whole = quantiles.quantiles(df, F.col("v"), SHARES, ranges=3).first()
    own = [v for _, v in rows if v is not None and v == v]
    assert all(whole[name] == pytest.approx(np.quantile(own, q), abs=1e-12) for name, q in SHARES.items())
    none = quantiles.quantiles(df.where("false"), F.col("v"), SHARES).first()
    assert none.n == 0 and none.c is None and quantiles.quantiles(df.where("false"), F.col("v"), SHARES, ["g"]).count() == 0


def test_reports(spark):
    rows = [("x", 1.0), ("x", 3.0), ("y", None), (None, 5.0)]
    got = {r.k: (r.n, r["mean"], r.p50) for r in metrics.value_report(spark.createDataFrame(rows, "k string, v double"), "v", ["k"]).collect()}
    assert got == {"x": (2, 2.0, 2.0), "y": (0, None, None), None: (1, 5.0, 5.0)}
    at = datetime.datetime(2024, 1, 1)
    log = spark.createDataFrame([(float(i), "full" if i % 4 else "hybrid", at + datetime.timedelta(seconds=i)) for i in range(101)], "latency_ms double, source string, ts timestamp")
    r = metrics.serving_report(log).first()
    assert (r.queries, r["mean"], r.p50, r.p95, r.fallbacks) == (101, 50.0, 50.0, 95.0, 26) and r.per_second == pytest.approx(1.01)
    none = metrics.serving_report(log.where("false")).first()
    assert (none.queries, none.p50, none.fallback_rate, none.per_second) == (0, None, None, None)


def test_ranges_are_cut_once(spark, monkeypatch):
    # A sketch that comes out otherwise at each evaluation, as those of large tables do when their parts meet in another order.
    rows = spark.createDataFrame([("a" if i % 3 else "b", float(i * 37 % 1000)) for i in range(1000)], "g string, v double").repartition(4)
    cut = F.udf(lambda most: sorted(random.SystemRandom().uniform(0, most) for _ in range(63)), "array<double>")
    monkeypatch.setattr(F, "percentile_approx", lambda c, *a: cut(F.max(c).cast("double")))
    for _ in range(3):
        got = quantiles.quantiles(rows, F.col("v"), SHARES, ["g"]).collect()
        for r in got:
            own = [float(i * 37 % 1000) for i in range(1000) if ("a" if i % 3 else "b") == r.g]
            assert all(r[name] == pytest.approx(np.quantile(own, q), abs=1e-12) for name, q in SHARES.items())
    placed = sampling.positions(rows, F.col("v"), [F.col("g")])
    assert sorted(r.position for r in placed.collect()) == list(range(1000))
    scores = metrics.binary_scores(rows.select(F.col("v").alias("p"), (F.col("v") > 400).cast("int").alias("y")))
    assert scores.first().auc == 1
