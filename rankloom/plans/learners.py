"""Registered queries of latent retrieval, boosted ranking, action models, group intervals and the event stream. What is fitted
iteratively has no SQL and is held by tests on literal frames; the rest has its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators import behavior, contracts, heads, lambda_trees, latent, learned, metrics, panel, retrieval, transfer
from rankloom.plans.audits import _WEIGHT
from rankloom.plans.models import BEHAVIOR, judged_features
from rankloom.plans.policy import asked
from rankloom.plans.registry import _BLOCKS_SQL, BLOCK, BLOCKS, rounded
from rankloom.sources.folders import ROWS, shared_folder, small_tasks, stored
from rankloom.sources.views import view, with_views
from rankloom.streaming import velocity

FACTORS, LIST, ROUNDS, DRAWS = 32, 10, 8, 200
CONTEXT = ["seed", "proposal_index", "scenario", "replication"]
#: What can go wrong with an action, out of a context's daily deltas.
RISKS = {"loss": "utility < 0", "worst_day": "worst < 0", "low_tenth": "tenth < 0", "missing_days": "days < base_days"}


def latent_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of each query's list by truncated SVD, on the catalogs of two blocks, each with factors of its own."""
    products, queries = view(spark, sf_dir, "v_products"), asked(spark, sf_dir)
    with small_tasks(spark, ROWS):
        space = latent.fit(products, retrieval.members_by_block(products, [BLOCK - 1, BLOCK], "title"), FACTORS)
        return rounded(stored(latent.top(queries, space, LIST), "latent"))


def boosted_ranker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NDCG@10 of held-out queries as retrieved, as the linear ranker and as the boosted trees order them."""
    rows, columns = judged_features(spark, sf_dir)
    columns = [*columns, "retrieval_score"]
    train, test = rows.where("not held_out"), rows.where("held_out")
    model, weights = lambda_trees.fit(train, columns, rounds=ROUNDS), learned.fit_pairwise(train, columns)
    scored = stored(model.transform(test).withColumn("line", F.round(learned.linear(columns, weights), 9)).withColumn("rank_score", F.round("rank_score", 9)), "ranked-test")
    score = lambda by, name: metrics.ndcg(retrieval.top(scored.select("query_id", "product_id", by), by, 100, ["query_id"]), scored, 10).agg(F.avg("ndcg").alias(name), F.count("*").alias("queries"))
    first = score("retrieval_score", "retrieved_ndcg").join(score("line", "linear_ndcg").drop("queries"))
    return rounded(first.join(score("rank_score", "boosted_ndcg").drop("queries")))


def decisions(daily: DataFrame) -> DataFrame:
    """A row for each action of a context: its utility, worst day, 10th percentile of days, and what was known before."""
    rows = panel.paired(daily).withColumn("d", F.col("treatment") - F.col("base"))
    by = rows.groupBy(*CONTEXT, "action").agg(
        F.avg("d").alias("utility"), F.min("d").alias("worst"), F.percentile("d", F.lit(0.1)).alias("tenth"), F.count("d").alias("days"), F.count("base").alias("base_days"), F.avg("base").alias("base_mean"), F.max("base").alias("base_most"))
    return by.where("utility is not null").withColumn("place", F.dense_rank().over(_by_action()).cast("int"))


def _by_action():
    from pyspark.sql import Window

    return Window.partitionBy(*CONTEXT).orderBy("action")


def action_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per head: rows, the error of the models and of the action means on seeds they never saw (absolute error of utility, Brier
    score of risks), and for utility what the chosen actions bring and lose."""
    rows = stored(decisions(view(spark, sf_dir, "v_daily")), "decisions")
    known = (["base_mean", "base_most", "base_days"], ["action"])
    fitted = lambda target, candidates, chance: stored(heads.nested(rows, "seed", CONTEXT, "action", "place", target, *known, candidates, chance), "heads")
    own = fitted(F.col("utility"), heads.UTILITY[:2], False)
    error = lambda df, y, power: df.agg(F.count("*").alias("n"), F.avg(F.pow(F.abs(F.col("prediction") - y), power)).alias("model_error"), F.avg(F.pow(F.abs(F.col("baseline") - y), power)).alias("baseline_error"))
    value = lambda p: heads.policy_value(own, CONTEXT, "utility", p, "place").agg(F.avg("utility").alias(f"{p}_utility"), F.avg("regret").alias(f"{p}_regret"))
    out = error(own, F.col("utility"), 1.0).withColumn("head", F.lit("utility")).join(value("prediction")).join(value("baseline"))
    for name, bad in RISKS.items():
        y = F.expr(f"cast({bad} as double)")
        part = error(fitted(y, heads.RISK[:1], True), y, 2.0).withColumn("head", F.lit(name))
        out = out.unionByName(part, allowMissingColumns=True)
    return rounded(out)


def future_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A behaviour model fitted on past blocks and calibrated on a later one, saved, loaded, and held against the last block."""
    log, products = view(spark, sf_dir, "v_interactions"), view(spark, sf_dir, "v_products")
    seen = behavior.prior_features(log, products).drop("launch_block")
    rows = stored(contracts.temporal_split(seen, products), "split-log")
    of = lambda s: rows.where(F.col("split") == s)
    folder = shared_folder(spark, "behavior-model")
    learned.fit_calibrated(of("train"), of("validation"), BEHAVIOR, "clicked").save(folder)
    return rounded(learned.future_audit(learned.Calibrated.load(spark, folder), of("future"), view(spark, sf_dir, "v_relevance"), "clicked", "smoothed_ctr"))


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context of each logged query of a block: some rows carry their own category, some queries an anchor."""
    rows = view(spark, sf_dir, "v_interactions").select(
        "time_block", "query_id", "product_id", F.when(F.col("query_id") % 7 == 0, F.concat(F.lit("own "), F.col("query_id").cast("string"))).alias("query_category"), (F.col("event_seq") % 1000).alias("retrieval_score"))
    queries = view(spark, sf_dir, "v_queries")
    anchors = queries.where("query_id % 3 = 0").select("query_id", F.col("target_product_id").alias("product_id"))
    reference = behavior.reference(view(spark, sf_dir, "v_interactions"), view(spark, sf_dir, "v_products"), BLOCKS)
    return rounded(transfer.query_context(transfer.checked_blocks(rows, reference), queries, anchors))


def dynamic_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = view(spark, sf_dir, "v_daily").groupBy("seed", "action", "policy").agg(F.avg("utility").alias("utility"), F.count("*").alias("rows"), F.max("utility").alias("most"))
    return rounded(panel.summary_deltas(by, ["seed", "action"], ["utility", "rows", "most"]), 9)


def seed_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = panel.block_contrasts(view(spark, sf_dir, "v_daily"), "view").withColumns({c: F.round(c, 9) for c in ("d", "delta")})
    return rounded(heads.group_interval(rows, "seed", ["d", "delta"], DRAWS))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, folder = view(spark, sf_dir, "v_interactions"), shared_folder(spark, "event-velocity")
    log.select("product_id", "time_block", "query_id", "position", "event_seq", "clicked").write.parquet(f"{folder}/log")
    return rounded(velocity.event_velocities(spark, f"{folder}/log", spark.read.parquet(f"{folder}/log").schema, folder))


QUERIES = {
    "f7_f8_latent_lists": latent_lists,
    "h13_h14_query_context": contexts,
    "i1_lambda_trees": boosted_ranker,
    "i7_action_heads": action_heads,
    "k14_future_block": future_block,
    "o20_seed_intervals": seed_intervals,
    "o21_dynamic_deltas": dynamic_deltas,
    "s2_s3_event_velocity": event_stream,
}

ORACLE_SQL = {
    "h13_h14_query_context": with_views("""with b as (select time_block, query_id, product_id, row_number() over (partition by time_block, query_id order by event_seq%1000 desc, product_id) as n from v_interactions)
 select cast(b.time_block as bigint) as time_block, b.query_id, q.query, case when b.query_id%7=0 then 'own '||b.query_id else q.category end as query_category, q.intent, case when b.query_id%3=0 then q.target_product_id else b.product_id end as anchor
 from b join v_queries q on q.query_id=b.query_id where n=1""", "v_interactions", "v_queries"),
    "o21_dynamic_deltas": with_views("""with s as (select seed, action, policy, avg(utility) as u, count(*) as n, max(utility) as m from v_daily group by 1,2,3)
 select a.seed, a.action, round(round(b.u-a.u,12),9)+0e0 as delta_utility, b.n-a.n as delta_rows, round(round(b.m-a.m,12),9)+0e0 as delta_most from s a join s b on a.seed=b.seed and a.action=b.action and a.policy='base' and b.policy='treatment'""", "v_daily"),
    "o20_seed_intervals": with_views(_BLOCKS_SQL + f""", con as (select a.seed, round(a.delta-b.delta,9) as d, round(a.delta,9) as delta
  from block a join block b on a.seed=b.seed and a.proposal_index=b.proposal_index and a.scenario=b.scenario and a.replication=b.replication and b.action='view' where a.action<>'view'),
 per as (select seed, 'd' as measure, avg(d) as x from con group by 1 union all select seed, 'delta', avg(delta) from con group by 1),
 drawn as (select measure, x, draw, cast(('0x'||substr(md5(concat_ws(':', seed, draw)),1,8)) as bigint) as u from per, (select unnest(range(1,{DRAWS + 1})) as draw) t),
 m as (select measure, draw, sum(({_WEIGHT})*x)/nullif(sum({_WEIGHT}),0) as m from drawn group by 1,2),
 plain as (select measure, count(x) as groups, avg(x) as mean from per group by 1)
 select p.measure, groups, round(mean,6)+0e0 as mean, round(quantile_cont(m,0.025),6)+0e0 as low, round(quantile_cont(m,0.975),6)+0e0 as high from plain p join m on m.measure=p.measure group by p.measure, groups, mean""", "v_daily"),
    "s2_s3_event_velocity": with_views("""with r as (select product_id, time_block, clicked, row_number() over (partition by product_id order by time_block, query_id, position, event_seq) as rn from v_interactions),
 blocks as (select product_id, time_block, min(rn)-1 as before, max(rn) as after, count(*) as events from r group by 1,2)
 select b.product_id, cast(b.time_block as bigint) as time_block, events, round(coalesce(sum(case when r.rn<=b.before then r.clicked*pow(0.75e0, b.before-r.rn) end),0e0),6)+0e0 as before,
 round(coalesce(sum(r.clicked*pow(0.75e0, b.after-r.rn)),0e0),6)+0e0 as velocity, cast(0 as bigint) as late
 from blocks b left join r on r.product_id=b.product_id and r.rn<=b.after where b.time_block<(select max(time_block) from v_interactions) group by b.product_id, b.time_block, events""", "v_interactions"),
}
