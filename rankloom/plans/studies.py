"""Registered profiles, samples, resampled contrasts, label studies and the velocity stream - and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators import panel, profile, sampling
from rankloom.plans.registry import _BLOCKS_SQL, _PAIRS, rounded
from rankloom.plans.reports import _UTILITY
from rankloom.sources.folders import shared_folder, stored
from rankloom.sources.views import view, with_views
from rankloom.streaming import counters

SEED, DRAWS, FOLDS, SPACED = 7, 60, 5, 12
PART_NUMBERS, PART_NAMES = ["p_partkey", "p_size", "p_retailprice"], ["p_brand", "p_type", "p_name"]
EXPECTED = {"action": 5, "scenario": 3, "replication": 5}
_CONTEXT = ["seed", "proposal_index"]


def velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = view(spark, sf_dir, "v_interactions")
    folder = shared_folder(spark, "velocity")
    log.select("product_id", "time_block", "clicked").write.parquet(f"{folder}/log")
    return rounded(counters.running_velocity(spark, f"{folder}/log", spark.read.parquet(f"{folder}/log").schema, folder))


def contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(panel.block_contrasts(view(spark, sf_dir, "v_daily"), "view").withColumn("d", F.round("d", 9)), "contrasts")
    return sampling.resampled(rows, "d", ["replication"], [*_CONTEXT, "action"], ["scenario"], DRAWS)


def decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts and seeds with a stable best contrast, and whether they are enough."""
    found = stored(contrasts(spark, sf_dir), "verdicts")
    out = found.agg(F.count_distinct(F.when(F.col("verdict") == "positive", F.struct(*_CONTEXT))).alias("contexts"), F.count_distinct(F.when(F.col("verdict") == "positive", F.col("seed"))).alias("seeds"), F.count_if(F.col("verdict") == "uncertain").alias("uncertain"))
    return rounded(out.withColumn("enough", (F.col("contexts") >= 12) & (F.col("seeds") >= 6)))


def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = view(spark, sf_dir, "v_daily")
    rules = panel.aggregation_rules(daily)
    published = panel.blocks(daily).groupBy("action").agg(F.avg("delta").alias("published"))
    return rounded(panel.reconciled(rules, published, ["action"], "published"))


QUERIES = {
    "b16_completeness": lambda s, d: rounded(profile.completeness(view(s, d, "v_daily"), _CONTEXT, EXPECTED)),
    "b17_numeric_profile": lambda s, d: rounded(profile.numeric(view(s, d, "part"), PART_NUMBERS)),
    "b18_categorical_profile": lambda s, d: rounded(profile.categorical(view(s, d, "part"), PART_NAMES)),
    "b19_inventory": lambda s, d: rounded(profile.inventory(view(s, d, "part").select(*PART_NUMBERS, *PART_NAMES)).drop("dtype")),
    "d4_hold_out": lambda s, d: rounded(sampling.hold_out(view(s, d, "v_queries").select("query_id"), "query_id", 0.25, SEED)),
    "d10_spaced": lambda s, d: rounded(sampling.spaced(view(s, d, "part").select("p_partkey", "p_retailprice"), F.col("p_retailprice"), [F.desc("p_partkey")], SPACED)),
    "d11_folds": lambda s, d: rounded(sampling.folds(view(s, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus", FOLDS, SEED)),
    "o10_o11_reconciled": reconcile,
    "o13_contrast_intervals": lambda s, d: rounded(contrasts(s, d)),
    "o18_feasibility": lambda s, d: rounded(panel.feasibility(view(s, d, "v_daily"))),
    "o19_regret": lambda s, d: rounded(panel.regret(view(s, d, "v_daily"))),
    "o22_decision": decision,
    "s2_stream_velocity": velocity,
}


def _hash(text: str) -> str:
    return f"cast(('0x'||substr(md5({text}),1,8)) as bigint)"


_CONTRASTS = _BLOCKS_SQL + f""", con as (select a.seed, a.proposal_index, a.action, a.scenario, a.replication, round(a.delta-b.delta,9) as v from block a join block b on a.seed=b.seed and a.proposal_index=b.proposal_index and a.scenario=b.scenario and a.replication=b.replication and b.action='view' where a.action<>'view'),
 num as (select *, row_number() over (partition by seed, proposal_index, action, scenario order by replication)-1 as i, count(*) over (partition by seed, proposal_index, action, scenario) as size from con),
 drawn as (select seed, proposal_index, action, scenario, draw, {_hash("concat_ws(':', draw, seed, proposal_index, action, scenario, i)")}%size as j from num cross join (select unnest(range(1,{DRAWS + 1})) as draw) t),
 per as (select seed, proposal_index, action, draw, avg(m) as m from (select d.seed, d.proposal_index, d.action, d.scenario, d.draw, avg(n.v) as m from drawn d join num n on n.seed=d.seed and n.proposal_index=d.proposal_index and n.action=d.action and n.scenario=d.scenario and n.i=d.j group by 1,2,3,4,5) x group by 1,2,3,4),
 ends as (select seed, proposal_index, action, quantile_cont(m,0.025) as low, quantile_cont(m,0.975) as high, avg(case when m>0 then 1e0 else 0e0 end) as above, avg(case when m<0 then 1e0 else 0e0 end) as below from per group by 1,2,3),
 plain as (select seed, proposal_index, action, cast(sum(n) as bigint) as blocks, avg(m) as mean from (select seed, proposal_index, action, scenario, avg(v) as m, count(*) as n from num group by 1,2,3,4) x group by 1,2,3),
 verdicts as (select p.*, low, high, above, below, case when low>0 then 'positive' when high<0 then 'negative' else 'uncertain' end as verdict from plain p join ends e on e.seed=p.seed and e.proposal_index=p.proposal_index and e.action=p.action)"""
_RULES = _PAIRS + """, d as (select *, treatment-base as d from paired where base is not null and treatment is not null),
 b as (select seed, proposal_index, action, scenario, replication, sum(d) as s, avg(d) as m from d group by 1,2,3,4,5),
 rules as (select b.action, max(x.m) as daily_mean, avg(b.m) as mean_of_means, avg(b.s) as mean_of_sums from b join (select action, avg(d) as m from d group by 1) x on x.action=b.action group by 1)"""
_FORMS = " union all ".join(f"select action, '{p}{c}' as metric, {s}*{c} as x from rules" for c in ("daily_mean", "mean_of_means", "mean_of_sums") for p, s in (("", 1), ("-", -1)))

ORACLE_SQL = {
    "b16_completeness": with_views("""select cast(seed as bigint) as seed, cast(proposal_index as bigint) as proposal_index, count(*) as n, count(distinct action) as n_action, count(distinct scenario) as n_scenario, count(distinct replication) as n_replication,
 count(distinct action)=5 and count(distinct scenario)=3 and count(distinct replication)=5 as complete from v_daily group by 1,2""", "v_daily"),
    "b17_numeric_profile": " union all ".join(f"select '{c}' as \"column\", count(*) as n, count(*)-count({c}) as missing, count({c}) as finite, count(distinct {c}) as \"distinct\", min({c})=max({c}) as constant, round(cast(min({c}) as double),6) as least, round(quantile_cont(cast({c} as double),0.01),6) as p01, round(quantile_cont(cast({c} as double),0.5),6) as median, round(quantile_cont(cast({c} as double),0.99),6) as p99, round(cast(max({c}) as double),6) as greatest from part" for c in PART_NUMBERS),
    "b18_categorical_profile": " union all ".join(f"(select '{c}' as \"column\", (select count(*) from part) as n, (select count(*)-count({c}) from part) as missing, (select count(distinct {c}) from part) as \"distinct\", {c} as mode, count(*) as mode_count from part where {c} is not null group by {c} order by count(*) desc, {c} limit 1)" for c in PART_NAMES),
    "b19_inventory": " union all ".join(f"select '{c}' as \"column\", count({c})/cast(count(*) as double) as coverage, count(distinct {c}) as \"distinct\", count(distinct {c})<=1 as constant from part" for c in PART_NUMBERS + PART_NAMES),
    "d4_hold_out": with_views(f"select query_id, row_number() over (order by {_hash(f'concat_ws({chr(39)}:{chr(39)}, {SEED}, query_id)')}, query_id)<=greatest(1, round(0.25e0*count(*) over ())) as held_out from v_queries", "v_queries"),
    "d10_spaced": f"""with r as (select p_partkey, p_retailprice, row_number() over (order by p_retailprice, p_partkey desc)-1 as position, count(*) over () as n from part)
 select p_partkey, round(p_retailprice,6) as p_retailprice, position from r where position in (select cast(round_even(k*(n-1)/{SPACED - 1}e0,0) as bigint) from (select unnest(range({SPACED})) as k) t, (select max(n) as n from r) m)""",
    "d11_folds": f"select o_orderkey, o_orderstatus, (row_number() over (partition by o_orderstatus order by {_hash(f'concat_ws({chr(39)}:{chr(39)}, {SEED}, o_orderkey)')}, o_orderkey)-1)%{FOLDS} as fold from orders",
    "o10_o11_reconciled": with_views(_RULES + f""", pub as (select action, avg(s) as v from b group by 1), forms as ({_FORMS})
 select metric, count(*) as matched, (select count(*) from pub)-count(*) as missing, round(avg(abs(x-v)),6) as mean_error, round(max(abs(x-v)),6) as max_error, max(abs(x-v))<=1e-8 and count(*)=(select count(*) from pub) as exact, round(corr(x,v),6) as correlation
 from pub join forms on forms.action=pub.action group by 1""", "v_daily"),
    "o13_contrast_intervals": with_views(_CONTRASTS + " select seed, proposal_index, action, blocks, round(mean,6) as mean, round(low,6) as low, round(high,6) as high, round(above,6) as above, round(below,6) as below, verdict from verdicts", "v_daily"),
    "o18_feasibility": with_views(_UTILITY + " select action, seed, count(*) as n, count(case when round(utility,9)>0 then 1 end) as benefit, count(case when round(utility,9)>=0 then 1 end) as no_harm, round(avg(round(utility,9)),6) as mean from u group by grouping sets ((action), (seed), ())", "v_daily"),
    "o19_regret": with_views(_UTILITY + """, r as (select seed, proposal_index, action, round(utility,9) as utility from u),
 g as (select a.action, a.seed, round(coalesce((select avg(utility) from r b where b.action=a.action and b.seed<>a.seed), (select avg(utility) from r)),9) as predicted from (select distinct action, seed from r) a),
 c as (select r.*, row_number() over (partition by r.seed, proposal_index order by predicted desc, r.action) as p, max(utility) over (partition by r.seed, proposal_index) as best from r join g on g.action=r.action and g.seed=r.seed)
 select seed, count(*) as contexts, count(case when best=utility then 1 end) as hits, round(avg(utility),6) as utility, round(avg(best-utility),6) as regret from c where p=1 group by 1""", "v_daily"),
    "o22_decision": with_views(_CONTRASTS + """ select count(distinct case when verdict='positive' then seed*1000+proposal_index end) as contexts, count(distinct case when verdict='positive' then seed end) as seeds, count(case when verdict='uncertain' then 1 end) as uncertain,
 count(distinct case when verdict='positive' then seed*1000+proposal_index end)>=12 and count(distinct case when verdict='positive' then seed end)>=6 as enough from verdicts""", "v_daily"),
    "s2_stream_velocity": with_views("""with m as (select product_id, max(time_block) as b from v_interactions group by 1)
 select i.product_id, cast(max(m.b) as bigint) as last_block, cast(sum(clicked) as bigint) as clicks, round(sum(clicked*pow(0.75e0, m.b-time_block)),6)+0e0 as velocity from v_interactions i join m on m.product_id=i.product_id group by 1""", "v_interactions"),
}
