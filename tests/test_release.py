"""The ranking report against sums in Python, and all named gates: each passes, fails, and fails on NaN."""

import math
import random

import pytest

from rankloom.operators import release

SCHEMA = "query_id long, product_id long, relevance int, relation string, zero_history int, semantic_score double, base_score double, final_score double, boost double, action string"
RELATIONS = {0: "irrelevant", 1: "complement", 2: "substitute", 3: "exact"}


def data():
    rng = random.Random(5)
    out = []
    for q in range(7):
        for p in range(rng.choice([3, 14, 25])):
            rel = None if rng.random() < 0.2 or q == 6 else rng.randint(0, 3) if q else 0
            b = round(rng.random(), 1)
            boost = rng.choice([0.0, 0.0, 0.3])
            out.append((q, p, rel, RELATIONS.get(rel), rng.choice([0, 1]), rng.random(), b, b + boost, boost, rng.choice(["BOOST", "BLOCK", "FALLBACK", "NATIVE"])))
    return out


def brute(rows, k=10):
    mean = lambda x: sum(x) / len(x) if x else 0.0
    queries = [[r for r in rows if r[0] == q] for q in sorted({r[0] for r in rows})]
    order = lambda g, at: sorted(g, key=lambda r: (-r[at], r[1]))
    d = lambda gains: sum((2**g - 1) / math.log2(i + 2) for i, g in enumerate(gains[:k]) if g is not None)

    def ndcg(g, at, cohort=None):
        gain = lambda r: r[2] if cohort is None or r[4] == cohort else None
        ideal = d(sorted((gain(r) for r in g if gain(r) is not None), reverse=True))
        return d([gain(r) for r in order(g, at)]) / ideal if ideal else None

    def judged(g, at, test):
        top = [r for r in order(g, at)[:k] if r[2] is not None]
        return mean([float(test(r)) for r in top]) if top else None

    some = lambda f: mean([x for g in queries if (x := f(g)) is not None])
    out = {f"{n}_ndcg_at_10": some(lambda g, at=at: ndcg(g, at)) for n, at in (("semantic", 5), ("base", 6), ("final", 7))}
    for n, at in (("base", 6), ("final", 7)):
        out |= {f"cold_ndcg_at_10_{n}": some(lambda g: ndcg(g, at, 1)), f"warm_ndcg_at_10_{n}": some(lambda g: ndcg(g, at, 0))}
        out |= {f"irrelevant_exposure_{n}": some(lambda g: judged(g, at, lambda r: r[2] == 0)), f"complement_exposure_{n}": some(lambda g: judged(g, at, lambda r: r[3] == "complement"))}
        share = lambda test: some(lambda g: mean([float(test(r)) for r in order(g, at)[:k]]))  # noqa: B023, E731
        out |= {f"cold_relevant_exposure_{n}": share(lambda r: r[4] == 1 and r[2] is not None and r[2] >= 2), f"judgment_coverage_{n}": share(lambda r: r[2] is not None), f"unjudged_exposure_{n}": share(lambda r: r[2] is None)}
    return out | {"boost_rate": mean([float(r[8] > 0) for r in rows]), "block_rate": mean([float(r[9] == "BLOCK") for r in rows]), "fallback_rate": mean([float(r[9] == "FALLBACK") for r in rows])}


def test_report(spark):
    rows = data()
    got = {r.metric: r.value for r in release.ranking_report(spark.createDataFrame(rows, SCHEMA), draws=100).collect()}
    want = brute(rows)
    assert len(want) == 20 and {k: got[k] for k in want} == {k: pytest.approx(v) for k, v in want.items()}
    ends = {k: v for k, v in got.items() if k not in want}
    assert len(ends) == 8
    for d, (a, b) in {"overall_ndcg_delta": ("final_ndcg_at_10", "base_ndcg_at_10"), "irrelevant_exposure_delta": ("irrelevant_exposure_final", "irrelevant_exposure_base")}.items():
        assert ends[f"{d}_ci_low"] <= got[a] - got[b] <= ends[f"{d}_ci_high"]


GOOD = {
    "final_ndcg_at_10": 0.6, "base_ndcg_at_10": 0.59, "cold_ndcg_at_10_final": 0.5, "cold_ndcg_at_10_base": 0.4, "warm_ndcg_at_10_final": 0.6, "warm_ndcg_at_10_base": 0.6, "irrelevant_exposure_final": 0.1, "irrelevant_exposure_base": 0.1,
    "overall_ndcg_delta_ci_low": 0.0, "cold_ndcg_lift_ci_low": 0.01, "warm_ndcg_delta_ci_low": 0.0, "irrelevant_exposure_delta_ci_high": 0.0, "effective_sample_size": 4000.0, "dr": 0.3, "dr_abs_error": 0.001, "dr_covers_true_value": 1.0,
    "support_overlap_rate": 1.0, "base_relevant_discovery": 100.0, "final_relevant_discovery": 101.0, "base_false_warmup": 3.0, "final_false_warmup": 3.0, "base_irrelevant_shown": 9.0, "final_irrelevant_shown": 8.0,
    "worst_scenario_utility_delta": 0.1, "p10_scenario_replication_utility_delta": 0.0, "judgment_coverage_base": 1.0, "judgment_coverage_final": 1.0, "future_behavior_roc_auc": 0.8, "future_behavior_brier": 0.1, "future_behavior_ece": 0.01,
    "future_logged_final_ndcg_at_10": 0.5, "future_logged_base_ndcg_at_10": 0.5, "relation_eligibility_brier": 0.001, "relation_eligibility_ece": 0.001, "policy_sensitivity_pass": 1.0, "p95_latency_ms": 20.0, "fallbacks": 0.0, "result_contract_pass": 1.0,
}
BAD = {
    "final_ndcg_at_10": (0.5, "overall_non_inferiority"), "overall_ndcg_delta_ci_low": (-0.1, "overall_ci_non_inferiority"), "cold_ndcg_at_10_final": (0.4, "cold_point_improvement"), "cold_ndcg_lift_ci_low": (-0.1, "cold_ci_non_inferiority"),
    "warm_ndcg_at_10_final": (0.5, "warm_non_inferiority"), "warm_ndcg_delta_ci_low": (-0.1, "warm_ci_non_inferiority"), "irrelevant_exposure_final": (0.2, "irrelevant_exposure_guardrail"), "irrelevant_exposure_delta_ci_high": (0.1, "irrelevant_ci_guardrail"),
    "effective_sample_size": (10.0, "ope_effective_sample_size"), "dr": (math.inf, "ope_dr_finite"), "dr_abs_error": (0.5, "ope_dr_accuracy"), "dr_covers_true_value": (0.0, "ope_dr_interval_coverage"), "support_overlap_rate": (0.9, "ope_support_overlap"),
    "final_relevant_discovery": (90.0, "dynamic_relevant_discovery_non_inferiority"), "final_false_warmup": (4.0, "dynamic_false_warmup_guardrail"), "final_irrelevant_shown": (10.0, "dynamic_irrelevant_exposure_guardrail"),
    "worst_scenario_utility_delta": (-0.1, "dynamic_worst_scenario_utility"), "p10_scenario_replication_utility_delta": (-0.1, "dynamic_p10_replication_utility"), "judgment_coverage_final": (0.9, "semantic_judgment_coverage"),
    "future_behavior_roc_auc": (0.6, "future_behavior_discrimination"), "future_behavior_brier": (0.3, "future_behavior_brier"), "future_behavior_ece": (0.3, "future_behavior_calibration"), "future_logged_final_ndcg_at_10": (0.4, "future_logged_ranking_non_inferiority"),
    "relation_eligibility_brier": (0.1, "relation_eligibility_brier"), "relation_eligibility_ece": (0.1, "relation_eligibility_calibration"), "policy_sensitivity_pass": (0.0, "policy_sensitivity"), "p95_latency_ms": (500.0, "serving_latency_p95"),
    "fallbacks": (1.0, "serving_no_fallback"), "result_contract_pass": (0.0, "serving_result_contract"),
}


def run(spark, values, **options):
    rows = release.evaluate(spark.createDataFrame(list(values.items()), "metric string, value double"), **options).collect()
    return {r.gate: r.passed for r in rows}, {r.status for r in rows}


def test_every_gate(spark):
    passed, status = run(spark, GOOD)
    assert len(passed) == 29 and all(passed.values()) and status == {"LAUNCH"}
    hold = {g: h for g, *_, h in [*release.GATES, *release.SENSITIVITY, *release.SERVING]}
    assert len(BAD) == 29 and {g for _, g in BAD.values()} == set(hold)
    for i, (metric, (value, gate)) in enumerate(BAD.items()):
        if i % 5 == 0 or gate.startswith(("ope_dr_finite", "serving")):
            passed, status = run(spark, GOOD | {metric: value})
            assert [g for g, ok in passed.items() if not ok] == [gate] and status == {"HOLD" if hold[gate] else "ITERATE"}


def test_all_bad_nan_missing_and_options(spark):
    assert not any(run(spark, GOOD | {m: v for m, (v, _) in BAD.items()})[0].values())
    nan = {m: math.nan for m in GOOD if not m.startswith("judgment")}
    passed, status = run(spark, GOOD | nan)
    assert [g for g, ok in passed.items() if ok] == ["semantic_judgment_coverage"] and status == {"HOLD"}
    passed, _ = run(spark, {"dr": 0.1}, serving=False, sensitivity=False)
    assert len(passed) == 25 and {g for g, ok in passed.items() if ok} == {"ope_dr_finite", "semantic_judgment_coverage"}
    assert run(spark, GOOD | {"effective_sample_size": 50.0}, thresholds={"min_ope_ess": 10.0})[1] == {"LAUNCH"}
    with pytest.raises(ValueError, match="no such thresholds"):
        release.evaluate(spark.createDataFrame([("dr", 0.1)], "metric string, value double"), {"min_nothing": 1.0})


def test_rank_diagnosis(spark):
    from rankloom.operators.promotion import rank_diagnosis

    rows = [(1, 10, 1, 0.9), (1, 11, 2, 0.5), (1, 12, 3, 0.5), (2, 10, 1, 0.2), (2, 11, 1, 0.1), (2, 11, 4, 0.3), (3, 10, None, 0.2), (3, 11, 1, math.nan), (4, 10, 2, 0.1), (4, 11, 3, 0.1)]
    df = spark.createDataFrame(rows, "query_id long, product_id long, rank int, score double")
    got = {r.query_id: r for r in rank_diagnosis(df, "rank", "score").collect()}
    flat = {q: (r.n, r.duplicate_ranks, r.duplicate_products, r.gaps, r.permutation, r.monotone, r.score_at_1, r.score_at_3) for q, r in got.items()}
    assert flat == {1: (3, 0, 0, 0, True, True, 0.9, 0.5), 2: (3, 1, 1, 2, False, False, 0.2, None), 3: (2, 0, 0, 0, False, False, None, None), 4: (2, 0, 0, 1, False, True, None, 0.1)}
    assert got[1].top_gap == pytest.approx(0.4) and got[3].top_gap is None
