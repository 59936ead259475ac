"""Registered report and named gates of a promoted ranking, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators import behavior, gates, metrics, panel, promotion, release, retrieval
from rankloom.operators.quantiles import quantiles
from rankloom.plans.audits import _WEIGHT
from rankloom.plans.policy import _ALL, _HYBRID, _PROMOTED, BOOSTS, hybrid, known, promoted
from rankloom.plans.registry import _REFERENCE, BLOCK, rounded
from rankloom.sources import bundle
from rankloom.sources.folders import shared_folder, stored
from rankloom.sources.views import judgments, view, with_views

DRAWS, K, CLIP = 100, 10, 1.5
#: Thresholds that the given tables can be held to; all others are the defaults.
OWN = {"min_ope_ess": 100.0, "min_judgment_coverage_at_10": 0.5, "max_future_behavior_brier": 0.3, "max_serving_p95_ms": 10_000.0}


def final_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranking of the largest swept boost with its judgments."""
    rows = stored(promoted(spark, sf_dir).where(F.col("max_boost") == BOOSTS[-1]), "promoted")
    judged = judgments(spark, sf_dir, rows).select("query_id", "product_id", "relevance", "relation")
    return rows.join(judged, ["query_id", "product_id"], "left").withColumnRenamed("dense_score", "semantic_score")


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return release.ranking_report(stored(final_rows(spark, sf_dir), "final-rows"), K, DRAWS)


def other_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the gates read besides the report: off-policy estimates, the panel of two policies, the log's counters, the
    calibration of scores, and the events' values as latencies. The share of relations and the later log are not measured here."""
    log = view(spark, sf_dir, "v_ope")
    ope = metrics.off_policy(log, CLIP).select(F.col("ess").alias("effective_sample_size"), F.col("support").alias("support_overlap_rate"))
    dr, truth = metrics.doubly_robust(log).select(F.col("doubly_robust").alias("dr"), F.lit(1).alias("one")), log.agg(F.avg("reward").alias("truth"), F.lit(1).alias("one"))
    error = F.abs(F.col("dr") - F.col("truth"))
    estimate = dr.join(truth, "one").select("dr", error.alias("dr_abs_error"), (error <= 0.01).cast("double").alias("dr_covers_true_value"))
    days = panel.scenario_summary(view(spark, sf_dir, "v_daily")).select(F.col("worst_scenario").alias("worst_scenario_utility_delta"), F.col("p10").alias("p10_scenario_replication_utility_delta"))
    policy = F.when(F.col("event_seq") % 2 == 0, "base").otherwise("final")
    sums = {"relevant_discovery": F.col("purchased"), "false_warmup": F.col("clicked") - F.col("purchased"), "irrelevant_shown": 1 - F.col("clicked")}
    shown = view(spark, sf_dir, "v_interactions").agg(*[F.sum(F.when(policy == p, x)).alias(f"{p}_{n}") for p in ("base", "final") for n, x in sums.items()])
    scored = view(spark, sf_dir, "v_calibration")
    later = metrics.binary_scores(scored).select(F.col("auc").alias("future_behavior_roc_auc"), F.col("brier").alias("future_behavior_brier"))
    ece = metrics.calibration_error(scored).select(F.col("ece").alias("future_behavior_ece"))
    events = view(spark, sf_dir, "events")
    latency, lost = quantiles(events, F.col("value"), {"p95_latency_ms": 0.95}).select("p95_latency_ms"), events.agg(F.count_if(F.col("value").isNull()).alias("fallbacks"))
    return gates.long_metrics(ope, estimate, days, shown, later, ece, latency, lost)


def named_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(final_rows(spark, sf_dir), "final-rows")
    # A list with a repeated place or product breaks its contract.
    per = rows.groupBy("query_id").agg(F.count("*").alias("n"), F.count_distinct("product_id").alias("a"), F.count_distinct("final_rank").alias("b"))
    contract = gates.long_metrics(per.agg(F.every((F.col("a") == F.col("n")) & (F.col("b") == F.col("n"))).cast("double").alias("result_contract_pass")))
    found = stored(release.ranking_report(rows, K, DRAWS).unionByName(other_metrics(spark, sf_dir)).unionByName(contract), "release-metrics")
    return rounded(release.evaluate(found, OWN, sensitivity=False), 9)


def bundle_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What breaks a bundle of the domain tables, some of whose rows are spoilt: written, read back as a whole and checked."""
    products, queries, judged, log = (view(spark, sf_dir, f"v_{n}") for n in ("products", "queries", "relevance", "interactions"))
    spoilt = bundle.Bundle(
        products.withColumn("price", F.when(F.col("product_id") % 97 == 5, -1.0).otherwise(F.col("price"))).where("product_id % 101 <> 7"), queries,
        judged.withColumn("relation", F.when((F.col("query_id") + F.col("product_id")) % 503 == 1, "other").otherwise(F.col("relation"))),
        log.withColumn("clicked", F.when(F.col("event_seq") % 211 == 3, F.lit(0)).otherwise(F.col("clicked"))))
    folder = shared_folder(spark, "bundle")
    bundle.write(spoilt, folder)
    found = bundle.violations(bundle.read(spark, folder))
    return found.select("table", "contract", "column", "n", F.array_join("examples", ",").alias("examples"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, fused = view(spark, sf_dir, "v_interactions"), hybrid(spark, sf_dir)
    products = known(spark, sf_dir, fused)
    # The products of the candidates are enough for their history.
    asked = fused.select("product_id").distinct()
    state = behavior.reference(log.join(asked, "product_id", "left_semi"), products, BLOCK + 1).where(F.col("time_block") == BLOCK)
    rows = retrieval.snapshot(fused, products, view(spark, sf_dir, "v_queries"), state, judgments(spark, sf_dir, fused))
    return rounded(rows.drop("title", "query", "price"), 9)


def diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The final list of each query by its final rank, and the same ranks held against the base scores."""
    rows = stored(final_rows(spark, sf_dir), "final-rows")
    of = lambda score: promotion.rank_diagnosis(rows, "final_rank", score).withColumn("by", F.lit(score))
    return rounded(of("final_score").unionByName(of("base_score")), 9)


QUERIES = {
    "a2_bundle_violations": bundle_violations,
    "e11_f17_candidate_snapshot": candidates,
    "k13_ranking_report": lambda s, d: rounded(report(s, d), 9),
    "n1_named_gates": named_gates,
    "w12_w13_rank_diagnosis": diagnosis,
}


def _share(n: str, what: str, of: str = "true") -> str:
    return f"avg(case when at_{n}<={K} and {of} then case when coalesce({what},false) then 1e0 else 0e0 end end)"


def _dcg(gain: str, at: str) -> str:
    return f"coalesce(sum(case when {at}<={K} then (pow(2e0,{gain})-1)/log2({at}+1) end),0e0)"


_GAINS = {"": "relevance", "cold_": "case when zero_history=1 then relevance end", "warm_": "case when zero_history=0 then relevance end"}
_PER = ", ".join(
    [f"{_dcg('g_' + c, 'at_' + n)}/nullif({_dcg('g_' + c, 'best_' + c)},0) as {c}ndcg_{n}" for c in _GAINS for n in release.SCORES]
    + [f"{_share(n, what, of)} as {name}_{n}" for n in ("base", "final") for name, what, of in (
        ("irrelevant", "relevance=0", "relevance is not null"), ("complement", "relation='complement'", "relevance is not null"), ("cold_relevant", "zero_history=1 and relevance>=2", "true"),
        ("coverage", "relevance is not null", "true"), ("unjudged", "relevance is null", "true"))])
_NAMED = {f"{n}_ndcg_at_10": f"ndcg_{n}" for n in release.SCORES} | {f"{c}_ndcg_at_10_{n}": f"{c}_ndcg_{n}" for c in ("cold", "warm") for n in ("base", "final")} | {
    f"{a}_{n}": f"{b}_{n}" for a, b in (("irrelevant_exposure", "irrelevant"), ("complement_exposure", "complement"), ("cold_relevant_exposure", "cold_relevant"), ("judgment_coverage", "coverage"), ("unjudged_exposure", "unjudged")) for n in ("base", "final")}
_REPORT_SQL = _PROMOTED + f""",
fr as (select p.*, v.relevance, v.relation from promoted p left join v_relevance v on v.query_id=p.query_id and v.product_id=p.product_id where max_boost={BOOSTS[-1]!r}::double),
placed as (select *, row_number() over (partition by query_id order by dense_score desc, product_id) as at_semantic, row_number() over (partition by query_id order by base_score desc, product_id) as at_base,
 row_number() over (partition by query_id order by final_score desc, product_id) as at_final, {', '.join(f'{g} as g_{c}' for c, g in _GAINS.items())},
 {', '.join(f'row_number() over (partition by query_id order by {g} desc nulls last, product_id) as best_{c}' for c, g in _GAINS.items())} from fr),
per0 as (select query_id, {_PER} from placed group by 1),
per1 as (select *, {', '.join(f'{c}_final-{c}_base as {d}' for d, c in release.DELTAS.items())} from per0),
rdrawn as (select *, cast(('0x'||substr(md5(concat_ws(':', query_id, draw)),1,8)) as bigint) as u from per1, (select unnest(range(1,{DRAWS + 1})) as draw) t),
rm as (select draw, {', '.join(f'sum(({_WEIGHT})*{d})/nullif(sum(case when {d} is not null then {_WEIGHT} end),0) as {d}' for d in release.DELTAS)} from rdrawn group by 1),
report as ({' union all '.join(f"select '{m}' as metric, coalesce(avg({c}),0e0) as value from per1" for m, c in _NAMED.items())}
 union all select 'boost_rate', avg(case when boost>0 then 1e0 else 0e0 end) from fr union all select 'block_rate', avg(case when action='BLOCK' then 1e0 else 0e0 end) from fr union all select 'fallback_rate', avg(case when action='FALLBACK' then 1e0 else 0e0 end) from fr
 union all {' union all '.join(f"select '{d}_ci_{e}', quantile_cont({d},{q}) from rm" for d in release.DELTAS for e, q in (('low', 0.025), ('high', 0.975)))})"""
_LIMITS = release.THRESHOLDS | OWN
_SPEC = ", ".join(f"('{g}','{m}','{op}',{(sign * _LIMITS[t] if t else 1.0) + 0.0!r}::double,{str(h).lower()})" for g, m, op, t, sign, h in [*release.GATES, *release.SERVING])
_GATES_SQL = _REPORT_SQL + f""",
r as (select *, cast(('0x'||substr(md5(cast(obs_id as varchar)),1,8)) as bigint)%5 as fold, candidate_propensity/greatest(logging_propensity,1e-8) as w from v_ope),
acts as (select action, max(candidate_propensity) as pi from r group by 1),
mu as (select c.context, a.action, a.pi, f.fold, coalesce((select avg(reward) from r where r.context=c.context and r.action=a.action and r.fold<>f.fold), (select avg(reward) from r where r.fold<>f.fold), 0e0) as mu
 from (select distinct context from r) c cross join acts a cross join (select distinct fold from r) f),
dm as (select context, fold, sum(pi*mu) as dm from mu group by 1,2),
dr as (select avg(dm+w*(reward-mu)) as dr from r join mu on mu.context=r.context and mu.action=r.action and mu.fold=r.fold join dm on dm.context=r.context and dm.fold=r.fold),
err as (select abs(dr-(select avg(reward) from r)) as e from dr),
paired as (select seed, proposal_index, action, scenario, replication, day, max(case when policy='base' then utility end) as base, max(case when policy='treatment' then utility end) as treatment from v_daily group by 1,2,3,4,5,6),
cells as (select scenario, replication, sum(treatment-base) as delta from paired where base is not null and treatment is not null group by 1,2),
shown as (select case when event_seq%2=0 then 'base' else 'final' end as p, cast(sum(purchased) as double) as d, cast(sum(clicked-purchased) as double) as f, cast(sum(1-clicked) as double) as i from v_interactions group by 1),
cal as (select y, p, rank() over (order by p)+(count(*) over (partition by p)-1)/2e0 as k from v_calibration),
found as (select * from report
 union all select 'effective_sample_size', pow(sum(w),2)/sum(w*w) from r union all select 'support_overlap_rate', avg(case when logging_propensity>1e-4 then 1e0 else 0e0 end) from r
 union all select 'dr_finite', 1e0 union all select 'dr_abs_error', e from err union all select 'dr_covers_true_value', cast(e<=0.01e0 as int) from err
 union all select 'worst_scenario_utility_delta', min(m) from (select avg(delta) as m from cells group by scenario) x union all select 'p10_scenario_replication_utility_delta', quantile_cont(delta,0.1) from cells
 union all select 'future_behavior_roc_auc', (sum(y*k)-sum(y)*(sum(y)+1)/2e0)/(sum(y)*sum(1-y)) from cal union all select 'future_behavior_brier', avg(pow(p-y,2)) from v_calibration
 union all select 'future_behavior_ece', sum(n*g)/sum(n) from (select count(*) as n, abs(avg(y)-avg(p)) as g from v_calibration where p between 0 and 1 group by least(floor(p*10),9)) x
 union all select 'p95_latency_ms', quantile_cont(value,0.95) from events union all select 'fallbacks', count(*)-count(value) from events
 union all select 'result_contract_pass', cast(bool_and(n=a and n=b) as int) from (select count(*) as n, count(distinct product_id) as a, count(distinct final_rank) as b from fr group by query_id) x
 union all select 'overall_ndcg_delta', (select value from report where metric='final_ndcg_at_10')-(select value from report where metric='base_ndcg_at_10')
 union all select 'cold_ndcg_lift', (select value from report where metric='cold_ndcg_at_10_final')-(select value from report where metric='cold_ndcg_at_10_base')
 union all select 'warm_ndcg_delta', (select value from report where metric='warm_ndcg_at_10_final')-(select value from report where metric='warm_ndcg_at_10_base')
 union all select 'irrelevant_exposure_delta', (select value from report where metric='irrelevant_exposure_final')-(select value from report where metric='irrelevant_exposure_base')
 union all select 'dynamic_relevant_discovery_drop_rate', greatest(0e0, (max(case when p='base' then d end)-max(case when p='final' then d end))/greatest(max(case when p='base' then d end),1e0)) from shown
 union all select 'dynamic_false_warmup_increase', max(case when p='final' then f end)-max(case when p='base' then f end) from shown
 union all select 'dynamic_irrelevant_exposure_increase', max(case when p='final' then i end)-max(case when p='base' then i end) from shown
 union all select 'judgment_coverage_at_10', least((select value from report where metric='judgment_coverage_base'),(select value from report where metric='judgment_coverage_final'))),
judged as (select g.*, f.value, coalesce(case when op='>=' then value>=threshold else value<=threshold end, false) as passed from (values {_SPEC}) g(gate, metric, op, threshold, hold) left join found f on f.metric=g.metric)
select gate, metric, op, round(threshold,9)+0e0 as threshold, round(round(value,12),9)+0e0 as value, passed, case when bool_and(passed) over () then 'LAUNCH' when bool_or(not passed and hold) over () then 'HOLD' else 'ITERATE' end as status from judged"""

_MISSED = "select {k} as k, count(*) as n from {t} where {k} in (select product_id from v_products where product_id%101=7) group by 1"
_KEYS_SQL = " union all ".join(
    f"select '{t}' as \"table\", 'key' as contract, '{k}' as \"column\", cast(sum(n) as bigint) as n, (select string_agg(cast(k as varchar), ',' order by k) from (select k from ({_MISSED.format(k=k, t=v)}) y order by k limit 10) z) as examples from ({_MISSED.format(k=k, t=v)}) x"
    for t, k, v in (("relevance", "product_id", "v_relevance"), ("interactions", "product_id", "v_interactions"), ("queries", "target_product_id", "v_queries")))
_BUNDLE_SQL = f"""select 'products' as "table", 'bounded' as contract, 'price' as "column", count(*) as n, '' as examples from v_products where product_id%97=5 and product_id%101<>7
 union all select 'relevance', 'allowed', 'relation', count(*), '' from v_relevance where (query_id+product_id)%503=1
 union all select 'interactions', 'funnel', 'purchased', count(*), '' from v_interactions where event_seq%211=3 and purchased=1 union all {_KEYS_SQL}"""



def _diagnosis(score: str) -> str:
    at = ", ".join(f"round(round(max(case when r={k} then {score} end),12),9) as score_at_{k}" for k in (1, 2, 3, 5, 10))
    return f"""l_{score} as (select *, coalesce({score}<=lag({score}) over (partition by query_id order by r, product_id), true) as falls from fr),
 d_{score} as (select query_id, '{score}' as by, count(*) as n, count(r)-count(distinct r) as duplicate_ranks, count(*)-count(distinct product_id) as duplicate_products, max(r)-count(distinct r) as gaps,
  count(distinct r)=count(*) and min(r)=1 and max(r)=count(*) as permutation, bool_and(falls) as monotone, {at}, round(round(max(case when r=1 then {score} end)-max(case when r=2 then {score} end),12),9)+0e0 as top_gap from l_{score} group by 1)"""


ORACLE_SQL = {
    "a2_bundle_violations": with_views(f"select * from ({_BUNDLE_SQL}) b where n>0", "v_products", "v_queries", "v_relevance", "v_interactions"),
    "e11_f17_candidate_snapshot": with_views("with " + _HYBRID.strip() + ", " + _REFERENCE.strip()[5:] + """, st as (select * from ref where time_block=4)
 select f.query_id, f.product_id, round(bm25_score,9) as bm25_score, round(dense_score,9) as dense_score, round(retrieval_score,9) as retrieval_score, candidate_source, p.brand, p.category, p.attribute, p.model, cast(p.launch_block as bigint) as launch_block,
 round(p.quality,9) as quality, round(round(ln(1+greatest(p.price,0)),12),9) as price_log, q.intent as query_intent, q.category as query_category, cast(i as bigint) as prior_impressions, cast(c as bigint) as prior_clicks, cast(s.p as bigint) as prior_purchases,
 round((c+1)/(i+5e0),9) as smoothed_ctr, round((s.p+0.5e0)/(i+8e0),9) as smoothed_purchase_rate, cast(c+s.p=0 as bigint) as zero_history, cast(c+s.p<=2 as bigint) as sparse_history, cast(v.relevance as bigint) as relevance, v.relation, cast(v.product_id is not null as bigint) as judged
 from fused f join v_products p on p.product_id=f.product_id join v_queries q on q.query_id=f.query_id join st s on s.product_id=f.product_id left join v_relevance v on v.query_id=f.query_id and v.product_id=f.product_id""", *_ALL),
    "k13_ranking_report": with_views(_REPORT_SQL + " select metric, round(round(value,12),9)+0e0 as value from report", *_ALL),
    "w12_w13_rank_diagnosis": with_views(_PROMOTED + f""", fr as (select *, final_rank as r from promoted where max_boost={BOOSTS[-1]!r}::double), {_diagnosis("final_score")}, {_diagnosis("base_score")}
 select * from d_final_score union all select * from d_base_score""", *_ALL[:3]),
    "n1_named_gates": with_views(_GATES_SQL, *_ALL, "v_ope", "v_daily", "v_calibration"),
}
