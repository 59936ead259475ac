"""Literal frames for the gate, placements, lent rates, positions, profiles, adapters and fitted models."""

import math

import pytest

from rankloom.operators import learned, profile, promotion, sampling, transfer
from rankloom.plans import models
from rankloom.sources import adapters
from rankloom.streaming import counters

COLUMNS = "query_id long, product_id long, base_score double, dense_score double, zero_history int, confidence double, support long, compatibility double, p_irrelevant double, target_utility double, ctr_lower double, purchase_lower double"
GATE = promotion.Gate(semantic=0.2, confidence=0.5, compatibility=0.3, risk=0.6, min_support=2, top_k=1, window=3, budget=1, boundary=False)


def rows(spark, *changes):
    base = dict(query_id=1, product_id=0, base_score=0.5, dense_score=0.9, zero_history=1, confidence=0.9, support=4, compatibility=0.8, p_irrelevant=0.1, target_utility=0.7, ctr_lower=0.4, purchase_lower=0.2)
    data = [tuple((base | {"product_id": i + 1} | c).values()) for i, c in enumerate(changes)]
    return spark.createDataFrame(data, COLUMNS)


@pytest.mark.parametrize(("change", "action", "reason"), [
    ({}, "BOOST", "eligible_reliable_transfer"), ({"compatibility": 0.0}, "BLOCK", "compatibility"), ({"p_irrelevant": 0.95}, "BLOCK", "irrelevant_risk"), ({"dense_score": math.nan}, "BLOCK", "semantic_threshold"),
    ({"confidence": None}, "SHRINK", "low_confidence"), ({"support": 0}, "FALLBACK", "insufficient_support"), ({"zero_history": 0}, "NATIVE", "native_history"), ({"zero_history": None}, "NATIVE", "native_history")])
def test_one_row(spark, change, action, reason):
    got = promotion.promote(rows(spark, change), GATE, [0.05]).first()
    assert (got.action, got.reason) == (action, reason) and 0 <= got.boost <= 0.05


def test_budget_goes_to_one_row_and_ties_to_the_smaller_id(spark):
    got = {r.product_id: r.action for r in promotion.promote(rows(spark, {}, {}, {}, {}), GATE, [0.05]).collect()}
    assert got == {1: "BOOST", 2: "SHRINK", 3: "SHRINK", 4: "SHRINK"}


@pytest.mark.parametrize(("low", "action"), [(0.6, "BOOST"), (0.4, "SHRINK")])
def test_boundary(spark, low, action):
    gate = promotion.Gate(0.2, 0.5, 0.3, 0.6, 2, 1, 1, 1, True)
    df = rows(spark, {"zero_history": 0, "base_score": 0.7}, {"base_score": low, "confidence": 1.0, "ctr_lower": 0.4, "purchase_lower": 0.0})
    got = {r.product_id: r for r in promotion.promote(df, gate, [0.15]).collect()}
    assert got[2].action == action and got[2].final_rank == (1 if action == "BOOST" else 2)
    assert action == "BOOST" or got[2].reason == "no_top_k_entry"


def test_placements(spark):
    df = rows(spark, {"base_score": 0.9}, {"base_score": 0.8}, {"base_score": 0.5})
    got = {(r.product_id, r.target): (r.achieved, r.feasible, r.required_lift) for r in promotion.placements(df, df.where("product_id = 3"), [1, 2, 9]).collect()}
    assert got[3, 1][:2] == (1, True) and got[3, 1][2] == pytest.approx(0.4) and got[3, 2][:2] == (2, True) and got[3, 9] == (3, False, None)


def test_lent_rates_do_not_depend_on_other_candidates(spark):
    products = spark.createDataFrame([(i, "c", "a") for i in range(1, 6)], "product_id long, category string, attribute string")
    graph = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.5), (4, 2, 0.5), (5, 2, 0.0)], "product_id long, neighbor_product_id long, similarity double")
    related = spark.createDataFrame([(9, i, 0.5, 0.5, 0.0, 0.0) for i in range(1, 6)], "query_id long, product_id long, p_exact double, p_substitute double, p_complement double, p_irrelevant double")
    state = spark.createDataFrame([(2, 10, 0.4, 0.2), (3, 10, 0.4, 0.2)], "product_id long, prior_impressions long, smoothed_ctr double, smoothed_purchase_rate double")
    priors = spark.createDataFrame([("c", 0.1, 0.05, 0.1, 0.05)], "category string, prior_ctr double, prior_purchase double, global_prior_ctr double, global_prior_purchase double")
    lent = lambda ids: {r.product_id: r for r in transfer.transfer(spark.createDataFrame([(9, i) for i in ids], "query_id long, product_id long"), related, graph, state, priors, products, 2, 2).collect()}
    every = lent([1, 4, 5])
    assert lent([1])[1] == every[1] and every[1].transfer_source == "neighbours" and every[1].dispersion == pytest.approx(0, abs=1e-6)
    assert every[1].confidence == pytest.approx(0.925) and every[1].ctr == pytest.approx(0.925 * 0.4 + 0.075 * 0.1)
    assert every[4].support == 1 and every[4].support_score == 0.5 and (every[4].confidence, every[4].dispersion, every[4].ctr) == (0, 1, 0.1) and every[5].support == 0


def test_positions(spark):
    df = spark.range(1000).selectExpr("id", "cast(if(id % 10 = 0, null, id % 7) as double) as v")
    got = [r.id for r in sampling.positions(df, df.v, [df.id.desc()], parts=8).orderBy("position").collect()]
    assert got == [r.id for r in sorted(df.collect(), key=lambda r: (r.v is not None, r.v or 0, -r.id))]
    assert sampling.hold_out(spark.range(1), "id", 0.25, 1).first().held_out
    assert sampling.capped(spark.range(50), "id", 7, 1).count() == 7 and sampling.positions(df.limit(0), df.v, [df.id]).count() == 0
    assert sampling.spaced(df, df.id, [], 3).agg({"id": "sum"}).first()[0] in (0 + 499 + 999, 0 + 500 + 999)


def test_profiles_of_nulls(spark):
    df = spark.createDataFrame([(1.0, "b"), (math.nan, "a"), (None, "a"), (math.inf, "b"), (1.0, None)], "x double, s string")
    n = profile.numeric(df, ["x"]).first()
    assert (n.n, n.missing, n.finite, n.constant, n.median) == (5, 2, 2, False, 1.0)
    c = profile.categorical(df, ["s"]).first()
    assert (c.n, c.missing, c.distinct, c["mode"], c.mode_count) == (5, 1, 2, "a", 2)
    assert profile.forbidden(["reward", "future_x", "my_label", "ok"], {"reward"}, ("future_",), ("label",)) == [("reward", "exact"), ("future_x", "prefix"), ("my_label", "part")]


def test_adapters(spark, tmp_path):
    df = spark.createDataFrame([("1", "x")], "product_id string, launch_block string")
    with pytest.raises(ValueError):
        adapters.items(df.drop("launch_block"), {})
    with pytest.raises(Exception, match="launch_block must be"):
        adapters.items(df, {}).collect()
    with pytest.raises(ValueError):
        adapters.ranking_log(spark.createDataFrame([(1, "q", 1, 0, 1)], "user_id int, query string, is_clicked int, is_purchased int, item_id int"))
    adapters.write_metrics(spark.createDataFrame([("a", 1.0)], "metric string, value double"), f"{tmp_path}/m")
    with pytest.raises(Exception, match="NaN in a"):
        adapters.write_metrics(spark.createDataFrame([("a", math.nan)], "metric string, value double"), f"{tmp_path}/n")
    adapters.write_table(df, f"{tmp_path}/t.csv", "csv")
    assert adapters.read_table(spark, f"{tmp_path}/t.csv").collect() == df.collect()


def test_velocity_over_several_files(spark, tmp_path):
    log = spark.range(40).selectExpr("id % 2 as product_id", "cast(id % 5 as int) as time_block", "cast(id % 3 = 0 as int) as clicked")
    log.repartition(4).write.parquet(f"{tmp_path}/in")
    got = {r.product_id: r.velocity for r in counters.running_velocity(spark, f"{tmp_path}/in", log.schema, f"{tmp_path}/out").collect()}
    want = {p: sum(r.clicked * 0.75 ** (4 - r.time_block) for r in log.collect() if r.product_id == p) for p in (0, 1)}
    assert got == pytest.approx(want)


def test_models_learn(spark):
    df = spark.range(400).selectExpr("id div 20 as query_id", "id as product_id", "cast(id % 4 as int) as relevance", "cast(id % 4 + 0.3 * sin(id) as double) as a", "cast(if(id % 9 = 0, 'nan', '0') as double) as b")
    model = learned.fit_logistic(df, ["a", "b"], "relevance", "multinomial")
    assert learned.relation_report(learned.probabilities(model, df, ["a", "b"], models.RELATION)).first().accuracy > 0.9
    weights = learned.fit_pairwise(df, ["a", "b"])
    assert weights[0] > 0.5 and abs(weights[1]) < 0.1
    assert learned.fit_pairwise(df.where("relevance = 1"), ["a", "b"]) == [0.0, 0.0]
    with pytest.raises(ValueError, match="missing features"):
        learned.clean(df, ["c"])


def test_relation_model_is_fitted_on_all_rows(spark, monkeypatch):
    rows = spark.range(200_040).selectExpr("id as query_id", "id as product_id", "cast(id % 4 as int) as relevance", "cast(id % 4 as double) as a", "id < 20 as held_out")
    seen, fit = [], learned.fit_logistic
    monkeypatch.setattr(models, "judged_features", lambda *_: (rows, ["a"]))
    monkeypatch.setattr(learned, "fit_logistic", lambda df, *more: seen.append(df.count()) or fit(df.limit(100), *more))
    assert models.relation_model(spark, "").first().n == 20 and seen == [200_020]


def test_one_class_is_not_calibrated(spark):
    df = spark.createDataFrame([(0.3, 1), (0.6, 1)], "score double, y int")
    assert [r.p for r in learned.calibrated(df, df, "score", "y").collect()] == [0.3, 0.6]
