"""The full report of a final ranking beside its base, and the named release gates that read it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.operators import gates
from rankloom.operators.heads import group_interval
from rankloom.operators.metrics import dcg
from rankloom.operators.promotion import ranked

# The gates' names, what they compare, and their default thresholds. (gate, metric, op, threshold, sign of the
# threshold, holds a launch). A threshold of None is 1 (a yes).
GATES = [
    ("overall_non_inferiority", "overall_ndcg_delta", ">=", "max_overall_ndcg_drop", -1, True),
    ("overall_ci_non_inferiority", "overall_ndcg_delta_ci_low", ">=", "max_overall_ndcg_drop_ci", -1, True),
    ("cold_point_improvement", "cold_ndcg_lift", ">=", "min_cold_ndcg_lift", 1, False),
    ("cold_ci_non_inferiority", "cold_ndcg_lift_ci_low", ">=", "min_cold_ndcg_lift_ci_low", 1, False),
    ("warm_non_inferiority", "warm_ndcg_delta", ">=", "max_warm_ndcg_drop", -1, True),
    ("warm_ci_non_inferiority", "warm_ndcg_delta_ci_low", ">=", "max_warm_ndcg_drop_ci", -1, True),
    ("irrelevant_exposure_guardrail", "irrelevant_exposure_delta", "<=", "max_irrelevant_exposure_increase", 1, True),
    ("irrelevant_ci_guardrail", "irrelevant_exposure_delta_ci_high", "<=", "max_irrelevant_exposure_ci_high", 1, True),
    ("ope_effective_sample_size", "effective_sample_size", ">=", "min_ope_ess", 1, False),
    ("ope_dr_finite", "dr_finite", ">=", None, 1, True),
    ("ope_dr_accuracy", "dr_abs_error", "<=", "max_ope_dr_abs_error", 1, False),
    ("ope_dr_interval_coverage", "dr_covers_true_value", ">=", None, 1, False),
    ("ope_support_overlap", "support_overlap_rate", ">=", "min_ope_support_overlap", 1, True),
    ("dynamic_relevant_discovery_non_inferiority", "dynamic_relevant_discovery_drop_rate", "<=", "max_dynamic_relevant_discovery_drop_rate", 1, True),
    ("dynamic_false_warmup_guardrail", "dynamic_false_warmup_increase", "<=", "max_dynamic_false_warmup_increase", 1, True),
    ("dynamic_irrelevant_exposure_guardrail", "dynamic_irrelevant_exposure_increase", "<=", "max_dynamic_irrelevant_exposure_increase", 1, True),
    ("dynamic_worst_scenario_utility", "worst_scenario_utility_delta", ">=", "min_worst_scenario_utility_delta", 1, False),
    ("dynamic_p10_replication_utility", "p10_scenario_replication_utility_delta", ">=", "min_p10_scenario_replication_utility_delta", 1, True),
    ("semantic_judgment_coverage", "judgment_coverage_at_10", ">=", "min_judgment_coverage_at_10", 1, True),
    ("future_behavior_discrimination", "future_behavior_roc_auc", ">=", "min_future_behavior_roc_auc", 1, True),
    ("future_behavior_brier", "future_behavior_brier", "<=", "max_future_behavior_brier", 1, True),
    ("future_behavior_calibration", "future_behavior_ece", "<=", "max_future_behavior_ece", 1, True),
    ("future_logged_ranking_non_inferiority", "future_logged_ndcg_delta", ">=", "max_future_logged_ndcg_drop", -1, True),
    ("relation_eligibility_brier", "relation_eligibility_brier", "<=", "max_relation_eligibility_brier", 1, True),
    ("relation_eligibility_calibration", "relation_eligibility_ece", "<=", "max_relation_eligibility_ece", 1, True),
]
SENSITIVITY = [("policy_sensitivity", "policy_sensitivity_pass", ">=", None, 1, True)]
SERVING = [
    ("serving_latency_p95", "p95_latency_ms", "<=", "max_serving_p95_ms", 1, False),
    ("serving_no_fallback", "fallbacks", "<=", "max_fallbacks", 1, True),
    ("serving_result_contract", "result_contract_pass", ">=", None, 1, True),
]
THRESHOLDS = {
    "max_overall_ndcg_drop": 0.002, "max_overall_ndcg_drop_ci": 0.005, "min_cold_ndcg_lift": 0.005, "min_cold_ndcg_lift_ci_low": 0.0, "max_warm_ndcg_drop": 0.01, "max_warm_ndcg_drop_ci": 0.02,
    "max_irrelevant_exposure_increase": 0.0, "max_irrelevant_exposure_ci_high": 0.005, "min_ope_ess": 3000.0, "max_ope_dr_abs_error": 0.02, "min_ope_support_overlap": 0.999,
    "max_dynamic_relevant_discovery_drop_rate": 0.0, "max_dynamic_false_warmup_increase": 0.0, "max_dynamic_irrelevant_exposure_increase": 0.0, "min_worst_scenario_utility_delta": 0.0,
    "min_p10_scenario_replication_utility_delta": 0.0, "max_serving_p95_ms": 150.0, "min_judgment_coverage_at_10": 1.0, "min_future_behavior_roc_auc": 0.70, "max_future_behavior_brier": 0.15,
    "max_future_behavior_ece": 0.05, "max_future_logged_ndcg_drop": 0.0, "max_relation_eligibility_brier": 0.01, "max_relation_eligibility_ece": 0.01, "max_fallbacks": 0.0,
}

SCORES = {"semantic": "semantic_score", "base": "base_score", "final": "final_score"}
DELTAS = {"overall_ndcg_delta": "ndcg", "cold_ndcg_lift": "cold_ndcg", "warm_ndcg_delta": "warm_ndcg", "irrelevant_exposure_delta": "irrelevant"}


def query_report(rows: DataFrame, k: int = 10) -> DataFrame:
    """Per query of `rows` (query_id, product_id, relevance, relation, zero_history, semantic_score, base_score, final_score): for
    each order NDCG@k of all rows, of the cold and of the warm (null where nothing relevant is judged), and over its top k the
    shares irrelevant and complement (of the judged; null without any), cold and relevant, judged, and unjudged; and the
    four deltas of final against base. One shuffle: all windows are of one query."""
    query = Window.partitionBy("query_id")
    gains = {"": F.col("relevance"), "cold_": F.when(F.col("zero_history") == 1, F.col("relevance")), "warm_": F.when(F.col("zero_history") == 0, F.col("relevance"))}
    at = rows.withColumns({f"_at_{n}": ranked(s, ["query_id"]) for n, s in SCORES.items()} | {f"_g_{c}": g.cast("double") for c, g in gains.items()})
    at = at.withColumns({f"_best_{c}": F.row_number().over(query.orderBy(F.desc_nulls_last(f"_g_{c}"), "product_id")) for c in gains})
    own = []
    for c in gains:
        ideal = F.coalesce(dcg(F.col(f"_g_{c}"), F.col(f"_best_{c}"), k), F.lit(0.0))
        own += [(F.coalesce(dcg(F.col(f"_g_{c}"), F.col(f"_at_{n}"), k), F.lit(0.0)) / F.nullif(ideal, F.lit(0.0))).alias(f"{c}ndcg_{n}") for n in SCORES]
    judged = F.col("relevance").isNotNull()
    for n in ("base", "final"):
        top = F.col(f"_at_{n}") <= k
        share = lambda what, of, top=top: F.avg(F.when(top & of, F.coalesce(what, F.lit(False)).cast("double")))
        own += [
            share(F.col("relevance") == 0, judged).alias(f"irrelevant_{n}"), share(F.col("relation") == "complement", judged).alias(f"complement_{n}"),
            share((F.col("zero_history") == 1) & judged & (F.col("relevance") >= 2), F.lit(True)).alias(f"cold_relevant_{n}"), share(judged, F.lit(True)).alias(f"coverage_{n}"), share(~judged, F.lit(True)).alias(f"unjudged_{n}")]
    per = at.groupBy("query_id").agg(*own)
    return per.withColumns({d: F.col(f"{c}_final") - F.col(f"{c}_base") for d, c in DELTAS.items()})


def ranking_report(rows: DataFrame, k: int = 10, draws: int = 300) -> DataFrame:
    """(metric, value): 20 metrics of `rows` (as for `query_report`, with boost and action) and the ends of 4 intervals. Means over
    no query at all are 0; queries are drawn whole."""
    per = query_report(rows, k)
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    named = {f"{n}_ndcg_at_10": f"ndcg_{n}" for n in SCORES} | {f"{c}_ndcg_at_10_{n}": f"{c}_ndcg_{n}" for c in ("cold", "warm") for n in ("base", "final")}
    named |= {f"{a}_{n}": f"{b}_{n}" for a, b in (("irrelevant_exposure", "irrelevant"), ("complement_exposure", "complement"), ("cold_relevant_exposure", "cold_relevant"), ("judgment_coverage", "coverage"), ("unjudged_exposure", "unjudged")) for n in ("base", "final")}
    means = per.agg(*[mean(c).alias(m) for m, c in named.items()])
    share = lambda c: F.coalesce(F.avg(F.coalesce(c, F.lit(False)).cast("double")), F.lit(0.0))
    rates = rows.agg(share(F.col("boost") > 0).alias("boost_rate"), share(F.col("action") == "BLOCK").alias("block_rate"), share(F.col("action") == "FALLBACK").alias("fallback_rate"))
    ends = group_interval(per, "query_id", list(DELTAS), draws)
    ends = ends.select(F.inline(F.array(*[F.struct(F.concat("measure", F.lit(f"_ci_{e}")).alias("metric"), F.col(e).alias("value")) for e in ("low", "high")])))
    return gates.long_metrics(means, rates).unionByName(ends)


def derived(metrics: DataFrame) -> DataFrame:
    """`metrics` (metric, value) with what the gates compare but nobody measures: deltas, increases and the drop rate. A delta of
    which one side is missing is missing."""
    names = [
        *[f"{c}ndcg_at_10{e}" for c, e in (("final_", ""), ("base_", ""), ("cold_", "_final"), ("cold_", "_base"), ("warm_", "_final"), ("warm_", "_base"))], "irrelevant_exposure_final", "irrelevant_exposure_base",
        *[f"{p}_{m}" for p in ("base", "final") for m in ("relevant_discovery", "false_warmup", "irrelevant_shown")], "judgment_coverage_base", "judgment_coverage_final", "future_logged_final_ndcg_at_10", "future_logged_base_ndcg_at_10", "dr"]
    # Metrics are as many as they have names.
    wide = metrics.agg(*[F.max(F.when(F.col("metric") == n, F.col("value"))).alias(n) for n in names])
    c = F.col
    new: dict[str, Column] = {
        "overall_ndcg_delta": c("final_ndcg_at_10") - c("base_ndcg_at_10"), "cold_ndcg_lift": c("cold_ndcg_at_10_final") - c("cold_ndcg_at_10_base"), "warm_ndcg_delta": c("warm_ndcg_at_10_final") - c("warm_ndcg_at_10_base"),
        "irrelevant_exposure_delta": c("irrelevant_exposure_final") - c("irrelevant_exposure_base"),
        "dynamic_relevant_discovery_drop_rate": F.when(c("base_relevant_discovery").isNotNull() & c("final_relevant_discovery").isNotNull(), F.greatest(F.lit(0.0), (c("base_relevant_discovery") - c("final_relevant_discovery")) / F.greatest(c("base_relevant_discovery"), F.lit(1.0)))),
        "dynamic_false_warmup_increase": c("final_false_warmup") - c("base_false_warmup"), "dynamic_irrelevant_exposure_increase": c("final_irrelevant_shown") - c("base_irrelevant_shown"),
        "judgment_coverage_at_10": F.least(F.coalesce("judgment_coverage_base", F.lit(1.0)), F.coalesce("judgment_coverage_final", F.lit(1.0))),
        "future_logged_ndcg_delta": c("future_logged_final_ndcg_at_10") - c("future_logged_base_ndcg_at_10"),
        "dr_finite": F.coalesce(~F.isnan("dr") & (F.abs("dr") < float("inf")), F.lit(False)).cast("double"),
    }
    return metrics.unionByName(gates.long_metrics(wide.select(*[v.alias(k) for k, v in new.items()])))


def gate_table(spark: SparkSession, thresholds: dict[str, float], serving: bool = True, sensitivity: bool = True) -> DataFrame:
    unknown = sorted(set(thresholds) - set(THRESHOLDS))
    if unknown:
        raise ValueError(f"no such thresholds: {unknown}")
    limits = THRESHOLDS | thresholds
    rows = [(g, m, op, sign * float(limits[t]) if t else 1.0, hold) for g, m, op, t, sign, hold in [*GATES, *(SENSITIVITY if sensitivity else []), *(SERVING if serving else [])]]
    return spark.createDataFrame(rows, "gate string, metric string, op string, threshold double, hold boolean")


def evaluate(metrics: DataFrame, thresholds: dict[str, float] | None = None, serving: bool = True, sensitivity: bool = True) -> DataFrame:
    """All named gates over `metrics` (metric, value) with the status of all: gate, metric, op, threshold, value, passed, status.
    A metric that is missing or NaN fails its gate. The gates of serving and of the sweep can be left out."""
    return gates.release(derived(metrics), gate_table(metrics.sparkSession, thresholds or {}, serving, sensitivity))
