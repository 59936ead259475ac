"""Registered reports: cohorts, paired rankings, resampling, gates, panels, comparisons, streams - and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators import behavior, compare, gates, metrics, panel, retrieval
from rankloom.operators.metrics import poisson_steps
from rankloom.plans.registry import _BLOCKS_SQL, _PAIRS, _TOP, lexical, rounded
from rankloom.sources.folders import shared_folder
from rankloom.sources.views import judgments, view, with_views
from rankloom.streaming import counters

COLD_FROM, DRAWS = 3, 100
GATES = [
    ("ndcg_floor", "ndcg", ">=", 0.2, True), ("coverage_floor", "coverage", ">=", 0.5, False), ("irrelevant_ceiling", "irrelevant", "<=", 0.3, True),
    ("sample_floor", "ess", ">=", 100.0, True), ("support_floor", "support", ">=", 0.99, False), ("calibration_ceiling", "ece", "<=", 0.1, False),
]


def cohort_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = lexical(spark, sf_dir).join(view(spark, sf_dir, "v_products").select("product_id", "launch_block"), "product_id")
    return rounded(metrics.ndcg(ranked, judgments(spark, sf_dir, ranked), 10, F.col("launch_block") >= COLD_FROM))


def reranked(spark: SparkSession, sf_dir: str, listed: DataFrame | None = None) -> DataFrame:
    """The lexical lists, given or found, in another order."""
    rows = (listed or lexical(spark, sf_dir)).join(view(spark, sf_dir, "v_products").select("product_id", "quality"), "product_id")
    return retrieval.top(retrieval.blended(rows.drop("rank"), "bm25_score", "quality", 0.7, ["query_id"]), "base_score", 50, ["query_id"])


def paired_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = lexical(spark, sf_dir)
    judged = judgments(spark, sf_dir, ranked)
    a, b = metrics.ndcg(ranked, judged, 10), metrics.ndcg(reranked(spark, sf_dir, ranked), judged, 10)
    both = a.join(b.withColumnRenamed("ndcg", "other"), "query_id")
    return rounded(both.select("query_id", (F.col("other") - F.col("ndcg")).alias("delta")))


def release_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = lexical(spark, sf_dir)
    judged = judgments(spark, sf_dir, ranked)
    found = gates.long_metrics(
        metrics.ndcg(ranked, judged, 10).agg(F.avg("ndcg").alias("ndcg")), metrics.exposure(ranked, judged, 10).select("coverage", "irrelevant"),
        metrics.off_policy(view(spark, sf_dir, "v_ope"), 1.5).select("ess", "support"), metrics.calibration_error(view(spark, sf_dir, "v_calibration")))
    spec = spark.createDataFrame(GATES, "gate string, metric string, op string, threshold double, hold boolean")
    return rounded(gates.release(found, spec), 9)


def bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.col("candidate_propensity") / F.greatest("logging_propensity", F.lit(1e-8))
    return rounded(metrics.bootstrap_mean(view(spark, sf_dir, "v_ope").select("obs_id", (w * F.col("reward")).alias("gain")), "gain", "obs_id", DRAWS))


def diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders against a later version of them: some gone, some changed; the earlier version lacks some."""
    orders = view(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    later = orders.where("o_orderkey % 11 <> 0").withColumn("o_orderstatus", F.expr("case when o_orderkey % 7 = 0 then 'X' else o_orderstatus end"))
    return rounded(compare.table_diff(orders.where("o_orderkey % 13 <> 0"), later, "o_orderkey"))


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = f"{sf_dir}/events.parquet"
    return rounded(counters.daily_counters(spark, f"{files}*", spark.read.parquet(files).schema, shared_folder(spark, "daily-counters")))


QUERIES = {
    "o5_warmed_up": lambda s, d: rounded(behavior.warmed_up(view(s, d, "v_interactions"))),
    "k3_cohort_ndcg": cohort_ndcg,
    "k11_paired_ndcg": paired_ndcg,
    "k17_value_report": lambda s, d: rounded(metrics.value_report(view(s, d, "events"), "value", ["event_type"])),
    "k18_result_contract": lambda s, d: rounded(metrics.result_contract(lexical(s, d), "bm25_score")),
    "l8_bootstrap": bootstrap,
    "l10_softmax": lambda s, d: rounded(metrics.softmax(lexical(s, d), "bm25_score", ["query_id"]).select("query_id", "product_id", "share")),
    "n1_n2_release_gates": release_gates,
    "o4_scenario_summary": lambda s, d: rounded(panel.scenario_summary(view(s, d, "v_daily"))),
    "o9_aggregation_rules": lambda s, d: rounded(panel.aggregation_rules(view(s, d, "v_daily"))),
    "o16_best_action": lambda s, d: rounded(panel.best_action(view(s, d, "v_daily"), "view")),
    "o17_by_action": lambda s, d: rounded(panel.by_action(view(s, d, "v_daily"))),
    "r7_table_diff": diff,
    "r8_fingerprint": lambda s, d: rounded(compare.fingerprint(view(s, d, "customer"), ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"])),
    "s1_stream_counters": stream,
    "w3_blended_rank": lambda s, d: rounded(reranked(s, d).select("query_id", "product_id", "base_score", "rank")),
    "w12_rank_geometry": lambda s, d: rounded(retrieval.geometry(lexical(s, d), "bm25_score")),
}


def _ndcg_sql(name: str, ranked: str, gain: str) -> str:
    return f""", {name}_r as (select l.query_id, l.product_id, l.rank, {gain} as gain, row_number() over (partition by l.query_id order by {gain} desc nulls last, l.product_id) as ir
 from {ranked} l left join v_relevance v on v.query_id=l.query_id and v.product_id=l.product_id join v_products p on p.product_id=l.product_id),
 {name}_q as (select query_id, coalesce(sum(case when rank<=10 then (pow(2e0,gain)-1)/log2(rank+1) end),0e0) as d, coalesce(sum(case when ir<=10 then (pow(2e0,gain)-1)/log2(ir+1) end),0e0) as i from {name}_r group by 1),
 {name} as (select query_id, d/i as ndcg from {name}_q where i>0)"""


def _percentile_sql(score: str) -> str:
    return f"(rank() over (partition by query_id order by {score})+(count(*) over (partition by query_id, {score})-1)/2e0)/count(*) over (partition by query_id)"


_BLENDED = f""", shown as (select l.query_id, l.product_id, l.bm25_score, p.quality from lexical l join v_products p on p.product_id=l.product_id),
 mixed as (select query_id, product_id, round(0.7e0*{_percentile_sql('bm25_score')}+0.3e0*{_percentile_sql('quality')},9) as base_score from shown),
 reranked as (select *, row_number() over (partition by query_id order by base_score desc, product_id) as rank from mixed)"""
_UTILITY = _BLOCKS_SQL + ", u as (select seed, proposal_index, action, avg(delta) as utility from block group by 1,2,3)"
_RANKED = ("v_products", "v_queries", "v_relevance")
_WEIGHT = "+".join(f"cast(u>={s} as int)" for s in poisson_steps())
_SPEC = ", ".join(f"('{g}','{m}','{op}',{t!r}::double,{str(h).lower()})" for g, m, op, t, h in GATES)

ORACLE_SQL = {
    "o5_warmed_up": with_views("""select product_id, event_seq, cast(time_block as bigint) as time_block from (
 select *, sum(clicked) over (partition by product_id order by time_block, event_seq rows unbounded preceding) as upto from v_interactions) x where upto=3 and clicked=1""", "v_interactions"),
    "k3_cohort_ndcg": with_views(_TOP + _ndcg_sql("cold", "lexical", f"case when p.launch_block>={COLD_FROM} then v.relevance end") + " select query_id, round(ndcg,6) as ndcg from cold", *_RANKED),
    "k11_paired_ndcg": with_views(_TOP + _BLENDED + _ndcg_sql("a", "lexical", "v.relevance") + _ndcg_sql("b", "reranked", "v.relevance") + " select a.query_id, round(b.ndcg-a.ndcg,6)+0e0 as delta from a join b on a.query_id=b.query_id", *_RANKED),
    "k17_value_report": """select event_type, count(value) as n, round(avg(value),6) as mean, round(quantile_cont(value,0.5),6) as p50, round(quantile_cont(value,0.95),6) as p95, round(quantile_cont(value,0.99),6) as p99
 from events group by 1""",
    "k18_result_contract": with_views(_TOP + """select query_id, count(*) as n, count(distinct product_id) as products, max(rank)-count(distinct rank) as gaps, cast(sum(case when bm25_score>prev then 1 else 0 end) as bigint) as rises
 from (select *, lag(bm25_score) over (partition by query_id order by rank) as prev from lexical) x group by 1""", "v_products", "v_queries"),
    "l8_bootstrap": with_views(f"""with g as (select obs_id, candidate_propensity/greatest(logging_propensity,1e-8)*reward as gain from v_ope),
 drawn as (select d, gain, cast(('0x'||substr(md5(cast(obs_id as varchar)||':'||cast(d as varchar)),1,8)) as bigint) as u from g, (select unnest(range(1,{DRAWS + 1})) as d) t),
 m as (select d, sum(({_WEIGHT})*gain)/nullif(sum({_WEIGHT}),0) as m from drawn group by 1)
 select (select round(avg(gain),6) from g) as mean, round(quantile_cont(m,0.025),6) as low, round(quantile_cont(m,0.975),6) as high from m""", "v_ope"),
    "l10_softmax": with_views(_TOP + """select query_id, product_id, round(exp(bm25_score-top)/sum(exp(bm25_score-top)) over (partition by query_id),6) as share
 from (select *, max(bm25_score) over (partition by query_id) as top from lexical) x""", "v_products", "v_queries"),
    "n1_n2_release_gates": with_views(_TOP + _ndcg_sql("plain", "lexical", "v.relevance") + f""",
 e as (select avg(case when v.relevance is null then 0e0 else 1e0 end) as c, avg(case when v.relevance is not null then case when v.relevance=0 then 1e0 else 0e0 end end) as i
  from lexical l left join v_relevance v on v.query_id=l.query_id and v.product_id=l.product_id where l.rank<=10 group by l.query_id),
 o as (select pow(sum(w),2)/sum(w*w) as ess, avg(case when lp>1e-4 then 1e0 else 0e0 end) as support from (select candidate_propensity/greatest(logging_propensity,1e-8) as w, logging_propensity as lp from v_ope) x),
 c as (select sum(n*g)/sum(n) as ece from (select count(*) as n, abs(avg(y)-avg(p)) as g from v_calibration where p between 0 and 1 group by least(floor(p*10),9)) x),
 found as (select 'ndcg' as metric, (select avg(ndcg) from plain) as value union all select 'coverage', (select avg(c) from e) union all select 'irrelevant', (select avg(i) from e)
  union all select 'ess', (select ess from o) union all select 'support', (select support from o) union all select 'ece', (select ece from c)),
 judged as (select g.*, f.value, coalesce(case when op='>=' then value>=threshold else value<=threshold end, false) as passed from (values {_SPEC}) g(gate, metric, op, threshold, hold) left join found f on f.metric=g.metric)
 select gate, metric, op, round(threshold,9) as threshold, round(round(value,12),9)+0e0 as value, passed, case when bool_and(passed) over () then 'LAUNCH' when bool_or(not passed and hold) over () then 'HOLD' else 'ITERATE' end as status from judged""", *_RANKED, "v_ope", "v_calibration"),
    "o4_scenario_summary": with_views(_BLOCKS_SQL + """, c as (select scenario, replication, sum(delta) as delta from block group by 1,2), w as (select avg(delta) as m from c group by scenario)
 select (select round(quantile_cont(delta,0.1),6) from c) as p10, (select round(avg(delta),6) from c) as mean, (select round(min(m),6) from w) as worst_scenario, (select count(*) from w) as scenarios""", "v_daily"),
    "o9_aggregation_rules": with_views(_PAIRS + """, d as (select *, treatment-base as d from paired where base is not null and treatment is not null),
 b as (select seed, proposal_index, action, scenario, replication, sum(d) as s, avg(d) as m from d group by 1,2,3,4,5)
 select b.action, round(max(x.m),6) as daily_mean, round(avg(b.m),6) as mean_of_means, round(avg(b.s),6) as mean_of_sums from b join (select action, avg(d) as m from d group by 1) x on x.action=b.action group by 1""", "v_daily"),
    "o16_best_action": with_views(_UTILITY + """ select b.seed, b.proposal_index, b.action, round(b.utility,6) as utility, round(b.utility-v.utility,6)+0e0 as gap
 from (select *, row_number() over (partition by seed, proposal_index order by round(utility,9) desc, action) as n from u) b left join u v on v.seed=b.seed and v.proposal_index=b.proposal_index and v.action='view' where n=1""", "v_daily"),
    "o17_by_action": with_views(_UTILITY + " select action, count(*) as n, round(avg(utility),6) as mean, round(quantile_cont(utility,0.5),6) as median, cast(sum(case when utility>0 then 1 else 0 end) as bigint) as better from u group by 1", "v_daily"),
    "r7_table_diff": """with a as (select o_orderkey, o_orderstatus, o_orderpriority from orders where o_orderkey%13<>0),
 b as (select o_orderkey, case when o_orderkey%7=0 then 'X' else o_orderstatus end as o_orderstatus, o_orderpriority from orders where o_orderkey%11<>0)
 select o_orderkey, 'added' as change from b where o_orderkey not in (select o_orderkey from a) union all select o_orderkey, 'deleted' from a where o_orderkey not in (select o_orderkey from b)
 union all select a.o_orderkey, 'modified' from a join b on a.o_orderkey=b.o_orderkey where (a.o_orderstatus, a.o_orderpriority) is distinct from (b.o_orderstatus, b.o_orderpriority)""",
    "r8_fingerprint": """select count(*) as n, cast(coalesce(sum(cast(('0x'||substr(md5(concat_ws('|', coalesce(cast(c_custkey as varchar),'\\N'), coalesce(c_name,'\\N'), coalesce(cast(c_nationkey as varchar),'\\N'), coalesce(c_mktsegment,'\\N'))),1,8)) as bigint)),0) as varchar) as fingerprint from customer""",
    "s1_stream_counters": "select cast(ts as date) as day, event_type, count(*) as n, round(sum(value),6) as total from events where ts is not null group by 1,2",
    "w3_blended_rank": with_views(_TOP + _BLENDED + " select query_id, product_id, round(base_score,6) as base_score, rank from reranked", *_RANKED),
    "w12_rank_geometry": with_views(_TOP + """, x as (select *, max(case when rank=10 then bm25_score end) over (partition by query_id) as e, min(bm25_score) over (partition by query_id) as lo, avg(bm25_score) over (partition by query_id) as m,
  nullif(round(stddev_pop(bm25_score) over (partition by query_id),9),0) as sd, count(*) over (partition by query_id) as n, lag(bm25_score) over (partition by query_id order by rank) as above, lead(bm25_score) over (partition by query_id order by rank) as below from lexical)
 select query_id, product_id, rank, round((bm25_score-m)/sd,6)+0e0 as z_score, round(rank/cast(n as double),6) as rank_fraction, round(above-bm25_score,6) as gap_above, round(bm25_score-below,6) as gap_below, round(greatest(coalesce(e,lo)-bm25_score,0e0),6) as required_lift from x""", "v_products", "v_queries"),
}
