"""Nested validation: no group on both sides, planted signal found, baselines and intervals against plain Python."""

import random

import pytest

from rankloom.operators import heads

SCHEMA = "seed int, proposal_index int, action string, target_rank int, x double, cost double, utility double"
ACTIONS = ["a", "b", "c"]


def planted(seeds=6, contexts=8):
    rng = random.Random(4)
    rows = []
    for s in range(seeds):
        for c in range(contexts):
            x = rng.random()
            for r, a in enumerate(ACTIONS):
                u = {"a": 0.2, "b": x, "c": 0.6 - x}[a] + rng.gauss(0, 0.01)
                rows.append((s, c, a, r, x if rng.random() > 0.05 else None, x * (a == "b") + (1 - x) * (a == "c"), u))
    return rows


def test_groups_never_cross_and_signal_beats_the_baseline(spark):
    data = planted()
    df = spark.createDataFrame([*data, (0, 99, "a", 0, 0.5, 0.5, None), (None, 1, "a", 0, 0.5, 0.5, 0.1)], SCHEMA)
    from pyspark.sql import functions as F

    crossed = df.withColumn("x_b", F.col("x") * (F.col("action") == "b").cast("int"))
    tried = [heads.Candidate("flat", "ridge", {"regParam": 100.0}), heads.Candidate("sharp", "ridge", {"regParam": 1e-4})]
    out = heads.nested(crossed, "seed", ["seed", "proposal_index"], "action", "target_rank", F.col("utility"), ["x_b", "cost"], ["action"], tried, outer=3).collect()
    assert len(out) == len(data) and {r.candidate for r in out} == {"sharp"}
    fold = {r.seed: r.fold for r in out}
    assert sorted(fold.values()) == [0, 0, 1, 1, 2, 2] and all(fold[r.seed] == r.fold for r in out)
    for r in out:
        rest = [d[6] for d in data if fold[d[0]] != r.fold and d[2] == r.action]
        assert r.baseline == pytest.approx(sum(rest) / len(rest))
    error = lambda name: sum(abs(r[name] - r.utility) for r in out) / len(out)
    assert error("prediction") < 0.5 * error("baseline")
    frame = spark.createDataFrame([(r.seed, r.proposal_index, r.action, r.target_rank, r.utility, r.prediction, r.baseline) for r in out], "seed int, proposal_index int, action string, target_rank int, u double, prediction double, baseline double")
    mean = lambda name: heads.policy_value(frame, ["seed", "proposal_index"], "u", name, "target_rank").agg({"utility": "avg", "regret": "avg"}).first().asDict()
    model, plain = mean("prediction"), mean("baseline")
    assert model["avg(utility)"] > plain["avg(utility)"] and 0 <= model["avg(regret)"] < plain["avg(regret)"]


def test_a_risk_head_and_one_with_one_outcome(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(planted(), SCHEMA)
    out = heads.nested(df, "seed", ["seed", "proposal_index"], "action", "target_rank", (F.col("utility") < 0.15).cast("int"), ["cost"], ["action"], heads.RISK[:1], chance=True, outer=2).collect()
    assert all(0 < r.prediction < 1 and 0 <= r.baseline <= 1 for r in out)
    bad, good = [r.prediction for r in out if r.utility < 0.15], [r.prediction for r in out if r.utility >= 0.15]
    assert sum(bad) / len(bad) > sum(good) / len(good)
    never = heads.nested(df, "seed", ["seed", "proposal_index"], "action", "target_rank", F.lit(0), ["cost"], ["action"], heads.RISK[:1], chance=True, outer=2).select("prediction").distinct().collect()
    assert [r.prediction for r in never] == [heads.CLIP]


def test_edges(spark):
    from pyspark.sql import functions as F

    one = spark.createDataFrame([(1, 1, "a", 0, 0.1, 0.2, 0.3)], SCHEMA)
    for df in (one, one.where("false")):
        assert heads.nested(df, "seed", ["seed", "proposal_index"], "action", "target_rank", F.col("utility"), ["cost"], ["action"], heads.UTILITY[:1]).count() == 0
    with pytest.raises(ValueError, match="not known before"):
        heads.nested(one, "seed", ["seed", "proposal_index"], "action", "target_rank", F.col("utility"), ["seed"], [], heads.UTILITY[:1])
    ties = spark.createDataFrame([(1, 1, "b", 1, 0.0, 0.0, 0.5), (1, 1, "a", 0, 0.0, 0.0, 0.5), (1, 1, "c", 2, 0.0, 0.0, float("nan"))], SCHEMA)
    assert [r.action for r in heads.chosen_rows(ties, ["seed", "proposal_index"], "utility", "target_rank").collect()] == ["a"]


def test_group_interval_draws_whole_groups(spark):
    rows = [(g, float(g % 7) + 0.1 * i, None if g == 3 else 1.0) for g in range(18) for i in range(1 + g)]
    df = spark.createDataFrame([*rows, (None, 100.0, 1.0)], "seed int, d double, e double")
    got = {r.measure: r for r in heads.group_interval(df, "seed", ["d", "e"], 400).collect()}
    means = [sum(d for s, d, _ in rows if s == g) / (1 + g) for g in range(18)]
    assert got["d"].mean == pytest.approx(sum(means) / 18) and got["d"].groups == 18 and got["e"].groups == 17
    assert got["d"].low < got["d"].mean < got["d"].high and got["e"].low == got["e"].high == 1
    alone = heads.group_interval(df.where("seed = 5"), "seed", ["d"], 50).first()
    assert alone.low == pytest.approx(alone.mean) and alone.high == pytest.approx(alone.mean)
