"""Registered audits: more contracts, retrieval by block, answers with their fallbacks, reports of paired rankings, safety and
configured values - and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators import behavior, contracts, gates, metrics, panel, retrieval
from rankloom.operators.metrics import poisson_steps
from rankloom.plans import policy
from rankloom.plans.registry import _BM25, _TOP, lexical, rounded, shelves, words
from rankloom.plans.reports import _BLENDED, _ndcg_sql, reranked
from rankloom.sources import adapters
from rankloom.sources.folders import small_tasks, stored
from rankloom.sources.views import judgments, view, with_views

SCOPES, DRAWS, CUTOFF, VALUE, ASKED = [1, 2, 3, 4, 5], 200, 5, 0.01275, 10
LIMITS = {"delta": (">=", -0.001), "boosts": (">=", 1.0)}
MEASURES = {"total": 1, "events": 1, "least": 1, "users": -1, "most": -1}


def block_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexical lists of every query in every block, with the statistics of the block's own catalog."""
    queries, (groups, heads) = policy.asked(spark, sf_dir), shelves(spark, sf_dir, SCOPES, 5)
    with small_tasks(spark, retrieval.pairs(queries, groups)):
        found = stored(retrieval.best(words(queries, groups), "bm25_score", groups, heads, 5), "block-lexical")
    return rounded(found.select("scope", "query_id", "product_id", "bm25_score", "rank"))


def block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys, queries = ["scope", "query_id"], policy.asked(spark, sf_dir)
    groups, heads = shelves(spark, sf_dir, SCOPES)
    with small_tasks(spark, retrieval.pairs(queries, groups)):
        both = stored(retrieval.fused(words(queries, groups), policy.dense(queries, groups), groups, heads, 50).withColumn("retrieval_score", F.round("retrieval_score", 9)), "block-hybrid")
    return rounded(retrieval.top(both, "retrieval_score", 1, keys).select(*keys, "product_id"))


def with_history(spark: SparkSession, sf_dir: str, ranked: DataFrame) -> DataFrame:
    # Only what is listed has its history counted.
    of_list = lambda df: df.join(ranked.select("product_id").distinct(), "product_id", "left_semi")
    state = behavior.snapshot(of_list(view(spark, sf_dir, "v_interactions")), of_list(view(spark, sf_dir, "v_products")), CUTOFF)
    return ranked.join(state.select("product_id", F.col("zero_history").cast("int").alias("zero_history")), "product_id")


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = lambda df: with_history(spark, sf_dir, df).withColumn("cold", F.col("zero_history") == 1)
    ranked = lexical(spark, sf_dir)
    before, after = stored(rank(ranked), "before"), stored(rank(reranked(spark, sf_dir, ranked)), "after")
    return rounded(metrics.paired_report(before, after, stored(judgments(spark, sf_dir, ranked), "judged"), 10, "cold"))


def delta_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = lexical(spark, sf_dir)
    judged = judgments(spark, sf_dir, ranked)
    a, b = metrics.ndcg(ranked, judged, 10), metrics.ndcg(reranked(spark, sf_dir, ranked), judged, 10).withColumnRenamed("ndcg", "other")
    return rounded(metrics.bootstrap_mean(a.join(b, "query_id").select("query_id", (F.col("other") - F.col("ndcg")).alias("delta")), "delta", "query_id", DRAWS))


def estimate_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = view(spark, sf_dir, "v_ope")
    found = gates.long_metrics(metrics.off_policy(log, 1.5).select("ips", "snips", "clipped_ips"))
    intervals = found.select(F.col("metric").alias("estimator"), "value", (F.col("value") - 0.01).alias("low"), (F.col("value") + 0.01).alias("high"))
    return rounded(metrics.estimate_errors(intervals, log.agg(F.avg("reward").alias("truth"))))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = view(spark, sf_dir, "v_daily").groupBy(F.col("action").alias("metric"), "policy").agg(F.avg("utility").alias("value"))
    return rounded(gates.diagnostics(days.where("policy = 'base'"), days.where("policy = 'treatment'")))


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = view(spark, sf_dir, "v_interactions")
    rows = log.select(
        (F.col("user_id") % 5).alias("replication"), F.when(F.col("event_seq") % 2 == 0, "base").otherwise("treatment").alias("policy"),
        F.col("purchased").alias("discovery"), (1 - F.col("clicked")).alias("irrelevant"), (F.col("clicked") - F.col("purchased")).alias("false_warm_up"))
    return rounded(panel.counter_utility(rows))


def expected_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = lexical(spark, sf_dir)
    rows = ranked.join(view(spark, sf_dir, "v_products").select("product_id", "quality", "launch_block"), "product_id")
    rows = rows.join(judgments(spark, sf_dir, ranked).select("query_id", "product_id", "relevance"), ["query_id", "product_id"])
    chance = metrics.click_chance(F.col("relevance"), F.col("quality"), F.col("rank"), (F.col("launch_block") >= 3).cast("int"), 0.3)
    return rounded(rows.select("query_id", "product_id", chance.alias("chance")))


def cold_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = lexical(spark, sf_dir)
    return rounded(metrics.cold_exposure(with_history(spark, sf_dir, ranked), judgments(spark, sf_dir, ranked), 10))


def safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = view(spark, sf_dir, "events").withColumn("seed", F.col("user_id") % 7)
    effects = events.groupBy("seed", F.col("event_type").alias("action")).agg(
        F.round(F.sum("value"), 6).alias("total"), F.count("*").alias("events"), F.min("value").alias("least"), F.count_distinct("user_id").alias("users"), F.max("value").alias("most"))
    return rounded(panel.safety_contrast(effects, "view", MEASURES))


def answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries with a boosted row are answered by the promoted ranking, those with a candidate of both lists by the fused
    one, the rest by words alone; with the scores and the action where there are any."""
    promoted = stored(policy.promoted(spark, sf_dir).where(F.abs(F.col("max_boost") - VALUE) <= 1e-12).select("query_id", "product_id", "action", F.col("final_rank").alias("rank")), "answers")
    fused, boosted = policy.hybrid(spark, sf_dir), promoted.where("action = 'BOOST'").select("query_id").distinct()
    both = fused.where("candidate_source = 'hybrid'").select("query_id").distinct()
    ranked = retrieval.top(fused, "retrieval_score", 20, ["query_id"]).join(both, "query_id", "left_semi")
    sources = [("full", promoted.join(boosted, "query_id", "left_semi"), ASKED), ("hybrid", ranked, 20), ("lexical", lexical(spark, sf_dir), ASKED)]
    rows = retrieval.answers(view(spark, sf_dir, "v_queries"), sources, ASKED)
    on = ["query_id", "product_id"]
    rows = rows.join(fused.select(*on, "bm25_score", "dense_score", "retrieval_score"), on, "left").join(promoted.select(*on, "action"), on, "left")
    return rounded(rows.withColumn("action", F.when(F.col("source") == "full", F.col("action"))))


_RECALL = {"user_id": "user_id", "event_id": "session_id", "event_type": "query", "value": "item_id", "ts": "timestamp"}

QUERIES = {
    "b2_b9_table_checks": lambda s, d: rounded(contracts.table_checks(view(s, d, "orders"), ["o_custkey", "o_orderpriority"], {"o_orderstatus": ["F", "O"]}, ["o_totalprice", "o_discount"])),
    "b13_cardinality": lambda s, d: rounded(contracts.cardinality(view(s, d, "orders").select(F.col("o_custkey").alias("k")), view(s, d, "customer").select(F.col("c_custkey").alias("k")), ["k"])),
    "b14_duplicate_pairs": lambda s, d: rounded(contracts.duplicates(view(s, d, "v_interactions"), ["query_id", "product_id"])),
    "c3_recall_log": lambda s, d: rounded(adapters.recall_log(view(s, d, "events").select(*[F.col(a).alias(b) for a, b in _RECALL.items()])).groupBy("query").agg(F.count("product_id").alias("n"), F.min("time_block").alias("first"))),
    "c5_relevance_table": lambda s, d: rounded(adapters.relevance_table(view(s, d, "v_products").select("product_id", F.col("category").alias("query"), "title", F.col("quality").alias("score"), F.col("brand").alias("brand_name"))).select("query", "title", "relevance", "brand", "product_id")),
    "d2_catalog_judgments": lambda s, d: rounded(contracts.judged_in(view(s, d, "v_relevance"), view(s, d, "v_products").where("launch_block <= 4")).groupBy("query_id", "relation").agg(F.count("*").alias("n"))),
    "e8_last_state": lambda s, d: rounded(contracts.last_of(view(s, d, "v_interactions").select("time_block", "product_id", "event_seq", "clicked", "query_id"), ["time_block", "product_id"], ["event_seq"])),
    "f15_block_anchors": block_anchors,
    "f16_block_lexical": block_lexical,
    "f20_f21_answers": answered,
    "k7_cold_exposure": cold_shown,
    "k12_delta_interval": delta_interval,
    "k13_paired_report": paired,
    "k16_regression_scores": lambda s, d: rounded(metrics.regression_scores(view(s, d, "v_calibration"))),
    "l9_estimate_errors": estimate_errors,
    "n3_diagnostics": changes,
    "n5_configured_value": lambda s, d: rounded(gates.configured(policy.sweep(s, d), "max_boost", VALUE, LIMITS)),
    "o1_o2_counter_utility": counters,
    "o6_expected_clicks": expected_clicks,
    "o14_safety_contrast": safety,
}

_RANKED = ("v_products", "v_queries", "v_relevance")
_SCOPED = " union all ".join
_WEIGHT = "+".join(f"cast(u>={s} as int)" for s in poisson_steps())
_STATE = f"""state as (select q.product_id, cast(coalesce(sum(case when i.time_block<{CUTOFF} then i.clicked+i.purchased end),0)=0 as int) as zero_history
 from v_products q left join v_interactions i on i.product_id=q.product_id group by 1)"""
_COLD = "case when (select zero_history from state where state.product_id=l.product_id)=1 then v.relevance end"
_BOTH = _TOP + _BLENDED


def _scope(sql: str, block: int) -> str:
    return sql.replace("launch_block <= 4", f"launch_block <= {block}")


def _shown_sql(p: str, ranked: str) -> str:
    return f""", {p}shown as (select count(*) as {p}shown, count(v.relevance) as {p}judged, cast(coalesce(sum(case when v.relevance=0 then 1 else 0 end),0) as bigint) as {p}irrelevant,
 cast(coalesce(sum(case when s.zero_history=1 and v.relevance>=2 then 1 else 0 end),0) as bigint) as {p}cold_relevant
 from {ranked} l join state s on s.product_id=l.product_id left join v_relevance v on v.query_id=l.query_id and v.product_id=l.product_id where l.rank<=10)"""


def _means_sql(p: str, a: str, b: str) -> str:
    return f""", {p}means as (select count(*) as {p}queries, round(avg({a}.ndcg),6) as {p}base_ndcg, round(avg({b}.ndcg),6) as {p}final_ndcg, round(avg({b}.ndcg-{a}.ndcg),6)+0e0 as {p}delta
 from {a} join {b} on {a}.query_id={b}.query_id)"""


ORACLE_SQL = {
    "b2_b9_table_checks": """select 'non_empty' as check, '' as key, cast(count(*)=0 as bigint) as n from orders union all
 select 'allowed','o_orderstatus', cast(coalesce(sum(case when o_orderstatus in ('F','O') then 0 else 1 end),0) as bigint) from orders union all
 select 'optional_non_negative','o_totalprice', cast(coalesce(sum(case when o_totalprice<0 then 1 else 0 end),0) as bigint) from orders union all
 select 'unique_pair','o_custkey,o_orderpriority', (select count(*) from orders)-(select count(*) from (select distinct o_custkey, o_orderpriority from orders) x)""",
    "b13_cardinality": """select a as left_repeated, b as right_repeated, case when a>0 then 'many' else 'one' end||'_to_'||case when b>0 then 'many' else 'one' end as kind from
 (select count(*) as a from (select o_custkey from orders group by 1 having count(*)>1) x) l, (select count(*) as b from (select c_custkey from customer group by 1 having count(*)>1) y) r""",
    "b14_duplicate_pairs": with_views("select query_id, product_id, count(*) as n from v_interactions group by 1,2 having count(*)>1", "v_interactions"),
    "c3_recall_log": "select event_type as query, count(value) as n, min(ts) as first from events group by 1",
    "c5_relevance_table": with_views("select category as query, title, round(quality,6) as relevance, brand, product_id from v_products", "v_products"),
    "d2_catalog_judgments": with_views("select query_id, relation, count(*) as n from v_relevance where product_id in (select product_id from v_products where launch_block<=4) group by 1,2", "v_relevance", "v_products"),
    "e8_last_state": with_views("""select cast(time_block as bigint) as time_block, product_id, event_seq, cast(clicked as bigint) as clicked, query_id from (
 select *, row_number() over (partition by time_block, product_id order by event_seq desc) as n from v_interactions) x where n=1""", "v_interactions"),
    "f15_block_anchors": with_views(_SCOPED([f"select cast({b} as bigint) as scope, query_id, product_id from (with {_scope(policy._HYBRID.strip(), b)} select query_id, product_id from anchor) x{b}" for b in SCOPES]), "v_products", "v_queries"),
    "f16_block_lexical": with_views(_SCOPED([f"select cast({b} as bigint) as scope, query_id, product_id, round(bm25_score,6) as bm25_score, rank from (with {_scope(_BM25.strip(), b)} select * from lexical where rank<=5) x{b}" for b in SCOPES]), "v_products", "v_queries"),
    "f20_f21_answers": with_views(policy._PROMOTED + f""", own as (select query_id, product_id, action, final_rank as rank from promoted where abs(max_boost-{VALUE}e0)<=1e-12),
 src as (select query_id, product_id, rank, 0 as lvl from own where query_id in (select query_id from own where action='BOOST') and rank<={ASKED}
  union all select * from (select query_id, product_id, row_number() over (partition by query_id order by retrieval_score desc, product_id) as rank, 1 as lvl from fused where query_id in (select query_id from fused where candidate_source='hybrid')) x where rank<=20
  union all select query_id, product_id, rank, 2 from lexical where rank<={ASKED}),
 picked as (select s.* from src s join (select query_id, min(lvl) as lvl from src group by 1) f on f.query_id=s.query_id and f.lvl=s.lvl where s.rank<={ASKED})
 select c.query_id, c.product_id, c.rank, case lvl when 0 then 'full' when 1 then 'hybrid' else 'lexical' end as source, case lvl when 0 then '' when 1 then 'no_full' else 'no_full,no_hybrid' end as reason,
 round(f.bm25_score,6) as bm25_score, round(f.dense_score,6) as dense_score, round(f.retrieval_score,6) as retrieval_score, case when lvl=0 then o.action end as action
 from picked c left join fused f on f.query_id=c.query_id and f.product_id=c.product_id left join own o on o.query_id=c.query_id and o.product_id=c.product_id""", *policy._ALL),
    "k7_cold_exposure": with_views(_TOP + f""", {_STATE} select l.query_id, count(*) as n, cast(sum(case when s.zero_history=1 and v.relevance>=2 then 1 else 0 end) as bigint) as hits
 from lexical l join state s on s.product_id=l.product_id left join v_relevance v on v.query_id=l.query_id and v.product_id=l.product_id where l.rank<=10 group by 1""", *_RANKED, "v_interactions"),
    "k12_delta_interval": with_views(_BOTH + _ndcg_sql("a", "lexical", "v.relevance") + _ndcg_sql("b", "reranked", "v.relevance") + f""", g as (select a.query_id, b.ndcg-a.ndcg as gain from a join b on a.query_id=b.query_id),
 drawn as (select d, gain, cast(('0x'||substr(md5(cast(query_id as varchar)||':'||cast(d as varchar)),1,8)) as bigint) as u from g, (select unnest(range(1,{DRAWS + 1})) as d) t),
 m as (select d, sum(({_WEIGHT})*gain)/nullif(sum({_WEIGHT}),0) as m from drawn group by 1)
 select (select round(avg(gain),6)+0e0 from g) as mean, round(quantile_cont(m,0.025),6) as low, round(quantile_cont(m,0.975),6) as high from m""", *_RANKED),
    "k13_paired_report": with_views(_BOTH + ", " + _STATE + _ndcg_sql("a", "lexical", "v.relevance") + _ndcg_sql("b", "reranked", "v.relevance") + _ndcg_sql("ca", "lexical", _COLD) + _ndcg_sql("cb", "reranked", _COLD)
        + _means_sql("", "a", "b") + _means_sql("cold_", "ca", "cb") + _shown_sql("base_", "lexical") + _shown_sql("final_", "reranked") + " select * from means, cold_means, base_shown, final_shown", *_RANKED, "v_interactions"),
    "k16_regression_scores": with_views("""with m as (select avg(y) as m from v_calibration), e as (select avg(abs(p-y)) as a, avg(abs(m.m-y)) as b, avg(pow(p-y,2)) as c, avg(pow(m.m-y,2)) as d from v_calibration, m)
 select round(a,6) as mae, round(sqrt(c),6) as rmse, round(c,6) as brier, round(1-c/nullif(d,0),6) as brier_skill, round(1-a/nullif(b,0),6) as mae_improvement from e""", "v_calibration"),
    "l9_estimate_errors": with_views("""with w as (select candidate_propensity/greatest(logging_propensity,1e-8) as w, reward from v_ope), t as (select avg(reward) as truth from v_ope),
 e as (select 'ips' as estimator, avg(w*reward) as value from w union all select 'snips', sum(w*reward)/sum(w) from w union all select 'clipped_ips', avg(least(w,1.5e0)*reward) from w)
 select estimator, round(value,6) as value, round(truth,6) as truth, round(value-truth,6)+0e0 as error, round(abs(value-truth),6) as absolute_error, truth between value-0.01e0 and value+0.01e0 as covered from e, t""", "v_ope"),
    "n3_diagnostics": with_views("""with d as (select action as metric, avg(case when policy='base' then utility end) as base, avg(case when policy='treatment' then utility end) as final from v_daily group by 1)
 select metric, round(base,6) as base, round(final,6) as final, round(final-base,6)+0e0 as delta, round(greatest(base-final,0e0)/nullif(abs(base),0),6)+0e0 as drop_rate from d where base is not null and final is not null""", "v_daily"),
    "n5_configured_value": f"select *, abs(max_boost-{VALUE}e0)<=1e-12 as selected, coalesce(delta>=-0.001e0 and boosts>=1,false) as passed from ({policy.ORACLE_SQL['n4_boost_sweep']}) x",
    "o1_o2_counter_utility": with_views("""with c as (select user_id%5 as replication, case when event_seq%2=0 then 'base' else 'treatment' end as policy, sum(purchased) as d, sum(1-clicked) as i, sum(clicked-purchased) as f from v_interactions group by 1,2)
 select policy, count(*) as replications, round(avg(d),6) as discovery, round(avg(i),6) as irrelevant, round(avg(f),6) as false_warm_up, round(avg(d-0.2e0*i-2*f),6) as utility from c group by 1""", "v_interactions"),
    "o6_expected_clicks": with_views(_TOP + """ select l.query_id, l.product_id, round(1/(1+exp(-(-2.2e0+0.9e0*v.relevance+0.8e0*p.quality+ln(1/log2(l.rank+1.5e0))+0.3e0*case when p.launch_block>=3 then 1 else 0 end))),6) as chance
 from lexical l join v_products p on p.product_id=l.product_id join v_relevance v on v.query_id=l.query_id and v.product_id=l.product_id""", *_RANKED),
    "o14_safety_contrast": """with e as (select user_id%7 as seed, event_type as action, round(sum(value),6) as total, count(*) as events, min(value) as least, count(distinct user_id) as users, max(value) as most from events group by 1,2)
 select a.seed, a.action, round(a.total-b.total,6)+0e0 as delta_total, a.events-b.events as delta_events, round(a.least-b.least,6)+0e0 as delta_least, a.users-b.users as delta_users, round(a.most-b.most,6)+0e0 as delta_most,
 a.total-b.total>=-1e-8 and a.events>=b.events and a.least-b.least>=-1e-8 and a.users<=b.users and a.most-b.most<=1e-8 as safe
 from e a join e b on a.seed=b.seed and b.action='view' where a.action<>'view'""",
}
