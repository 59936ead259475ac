"""Gradients against all pairs written out, and trees against the linear ranker on a signal that no line can rank."""

import math
import random

import pytest

from rankloom.operators import lambda_trees, learned, metrics

SCHEMA = "query_id long, product_id long, relevance int, a double, b double"


def all_pairs(rows, k):
    """_g and _h of each row: every pair of the query, with NDCG@k written out."""
    out = {}
    for q in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == q), key=lambda r: (-r[3], r[1]))
        place = {r[1]: i for i, r in enumerate(own, 1)}
        d = lambda i: 1 / math.log2(i + 1) if i <= k else 0.0
        ideal = sum(g * d(i) for i, g in enumerate(sorted((r[2] for r in own), reverse=True)[:k], 1))
        for x in own if ideal else []:
            g = h = 0.0
            for t in own:
                up = (x[2] > t[2]) - (x[2] < t[2])
                worth = abs(x[2] - t[2]) * abs(d(place[x[1]]) - d(place[t[1]])) / ideal
                wrong = 1 / (1 + math.exp(up * (x[3] - t[3])))
                g, h = g + up * worth * wrong, h + (worth * wrong * (1 - wrong) if up else 0.0)
            out[q, x[1]] = (g, h)
    return out


def test_gradients_are_those_of_all_pairs(spark):
    rng = random.Random(1)
    rows = [(q, i, float(2 ** rng.randint(0, 3) - 1), rng.choice([0.0, 0.5, 1.0, rng.random()])) for q in range(6) for i in range(rng.choice([1, 5, 40]))]
    rows += [(9, i, 0.0, 0.1) for i in range(4)]
    df = spark.createDataFrame(rows, "_query long, _id long, _gain double, _score double")
    for k in (3, 10, 100):
        want = all_pairs(rows, k)
        got = {(r["_query"], r["_id"]): (r["_g"], r["_h"]) for r in lambda_trees.gradients(df, k).collect()}
        assert got.keys() == want.keys()
        assert all(got[x] == pytest.approx(want[x], abs=1e-12) for x in want)


def planted(queries, seed):
    """Rows are the better the nearer a lies to the middle, which no linear score can say."""
    rng = random.Random(seed)
    out = []
    for q in range(queries):
        for i in range(20):
            a, b = rng.random(), rng.random()
            out.append((q, i, 3 if abs(a - 0.5) < 0.05 else 2 if abs(a - 0.5) < 0.1 else 1 if abs(a - 0.5) < 0.25 else 0, a, b))
    return out


def quality(spark, rows, score):
    ranked = spark.createDataFrame(rows, SCHEMA)
    from rankloom.operators.retrieval import top

    best = top(score(ranked), "rank_score", 20, ["query_id"]).select("query_id", "product_id", "rank")
    return metrics.ndcg(best, ranked.select("query_id", "product_id", "relevance"), 10).agg({"ndcg": "avg"}).first()[0]


def test_trees_beat_the_linear_ranker_and_survive_saving(spark, tmp_path):
    train, later = spark.createDataFrame(planted(60, 1), SCHEMA), planted(30, 2)
    model = lambda_trees.fit(train, ["a", "b"], rounds=6, depth=3, rate=0.3)
    weights = learned.fit_pairwise(train, ["a", "b"])
    trees = quality(spark, later, model.transform)
    line = quality(spark, later, lambda df: df.withColumn("rank_score", learned.linear(["a", "b"], weights)))
    assert trees > 0.9 and trees > line + 0.15
    model.save(f"{tmp_path}/model")
    again = lambda_trees.LambdaTrees.load(spark, f"{tmp_path}/model")
    frame = spark.createDataFrame([*later, (1, 99, None, None, float("nan"))], SCHEMA)
    both = [sorted((r.query_id, r.product_id, r.rank_score, r.a is None) for r in m.transform(frame).collect()) for m in (model, again)]
    assert both[0] == both[1]


def test_nothing_to_learn(spark):
    for rows in ([], [(1, 1, 2, 0.1, 0.2)], [(1, 1, 0, 0.1, 0.2), (1, 2, 0, 0.3, 0.2)], [(1, 1, None, 0.1, 0.2), (1, 2, None, 0.3, 0.2)]):
        df = spark.createDataFrame(rows, SCHEMA)
        model = lambda_trees.fit(df, ["a", "b"], rounds=2)
        assert model.trees == [] and all(r.rank_score == 0 for r in model.transform(df).collect())
    with pytest.raises(ValueError, match="missing features"):
        lambda_trees.fit(spark.createDataFrame([], SCHEMA), ["c"])
