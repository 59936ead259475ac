"""Registered queries of fitted models, held against held-out rows (no SQL: the fits are iterative), and of user tables
brought into shape, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators import behavior, contracts, learned, metrics, retrieval, sampling
from rankloom.operators.transfer import relations
from rankloom.plans.policy import anchors, hybrid, known
from rankloom.plans.registry import rounded
from rankloom.sources import adapters
from rankloom.sources.folders import stored
from rankloom.sources.views import judgments, view

RELATION = ["p_irrelevant", "p_complement", "p_substitute", "p_exact"]
BEHAVIOR = ["prior_impressions", "prior_clicks", "prior_purchases", "smoothed_ctr", "smoothed_purchase_rate", "first_observed_age", "zero_history", "sparse_history", "position"]


def judged_features(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """Features of the judged candidates, with relevance and whether the query is held out."""
    fused, queries = hybrid(spark, sf_dir), view(spark, sf_dir, "v_queries")
    found = relations(fused.select("query_id", "product_id"), queries, known(spark, sf_dir, fused), anchors(fused))
    columns = [c for c in found.columns if c not in ("query_id", "product_id")]
    out = found.join(judgments(spark, sf_dir, fused).select("query_id", "product_id", "relevance"), ["query_id", "product_id"]).join(fused.select("query_id", "product_id", "retrieval_score"), ["query_id", "product_id"])
    return stored(out.join(sampling.hold_out(queries.select("query_id"), "query_id", 0.25, 7), "query_id"), "judged"), columns


def relation_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model of all judged candidates says of held-out queries."""
    rows, columns = judged_features(spark, sf_dir)
    model = learned.fit_logistic(rows.where("not held_out"), columns, "relevance", "multinomial")
    return rounded(learned.relation_report(learned.probabilities(model, rows.where("held_out"), columns, RELATION)))


def pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NDCG@10 of held-out queries as retrieved and as the learned ranker orders them."""
    rows, columns = judged_features(spark, sf_dir)
    columns = [*columns, "retrieval_score"]
    weights = learned.fit_pairwise(rows.where("not held_out"), columns)
    test = rows.where("held_out").withColumn("learned", F.round(learned.linear(columns, weights), 9))
    score = lambda by, name: metrics.ndcg(retrieval.top(test.drop("relevance"), by, 100, ["query_id"]), test, 10).agg(F.avg("ndcg").alias(name), F.count("*").alias("queries"))
    return rounded(score("retrieval_score", "retrieved_ndcg").join(score("learned", "learned_ndcg").drop("queries")))


def behaviour_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC, Brier score and log-loss on the test block of the calibrated logistic model and of boosted trees."""
    log, products = view(spark, sf_dir, "v_interactions"), view(spark, sf_dir, "v_products")
    seen = behavior.prior_features(log, products).drop("launch_block")
    rows = stored(contracts.temporal_split(seen, products), "split-log")
    train, later, test = (rows.where(F.col("split") == s) for s in ("train", "validation", "test"))
    out = None
    for name, model in (("logistic", learned.fit_logistic(train, BEHAVIOR, "clicked")), ("trees", learned.fit_challenger(train, BEHAVIOR, "clicked"))):
        scored = lambda df: learned.probabilities(model, df, BEHAVIOR, ["p0", "score"])  # noqa: B023, E731
        done = learned.calibrated(scored(test), scored(later), "score", "clicked").select("p", F.col("clicked").alias("y"))
        part = metrics.binary_scores(stored(done, name)).select(F.lit(name).alias("model"), "*")
        out = part if out is None else out.unionByName(part)
    return rounded(out)


def item_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = view(spark, sf_dir, "part").selectExpr("p_partkey as sku", "p_name as label", "p_brand as maker", "cast(p_size as string) as week")
    return rounded(adapters.items(raw, {"sku": "product_id", "label": "title", "maker": "brand", "week": "launch_block"}))


def ranking_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = view(spark, sf_dir, "events").selectExpr("user_id", "event_type as query", "event_id as item_id", "case when event_id % 3 = 0 then user_id end as target_item_id", "event_type in ('click', 'purchase') as is_clicked", "event_type = 'purchase' as is_purchased", "cast(event_id % 8 as string) as relative_time")
    return rounded(adapters.ranking_log(raw))


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    examples = view(spark, sf_dir, "orders").selectExpr("o_custkey as product_id", "'us' as product_locale", "o_orderpriority as query", "element_at(array('E', 'S', 'C', 'I', 'X'), cast(o_orderkey % 5 + 1 as int)) as label")
    products = view(spark, sf_dir, "customer").selectExpr("c_custkey as product_id", "'us' as product_locale", "c_name as product_title").where("product_id % 7 <> 0")
    joined, refused = adapters.graded(examples, products)
    good = joined.groupBy("query", "relevance").agg(F.count("*").alias("n")).select("query", F.col("relevance").cast("string").alias("what"), "n")
    return rounded(good.unionByName(refused.groupBy("query", "reason").agg(F.count("*").alias("n")).withColumnRenamed("reason", "what")))


QUERIES = {
    "c1_item_table": item_table,
    "c4_ranking_log": ranking_log,
    "c6_graded_labels": graded,
    "h4_relation_model": relation_model,
    "i1_pairwise_ranker": pairwise,
    "i2_i5_behavior_models": behaviour_models,
}

ORACLE_SQL = {
    "c1_item_table": """select p_partkey as product_id, p_name as title, p_brand as brand, 'unknown' as category, 'unknown' as attribute, 'unknown' as model, 'unknown' as color, 0e0 as price, cast(p_size as bigint) as launch_block, 0.5e0 as quality from part""",
    "c4_ranking_log": """select cast(user_id as bigint) as user_id, event_type as query, cast(coalesce(case when event_id%3=0 then user_id end, event_id) as bigint) as product_id, cast(event_id%8 as bigint) as time_block,
 cast(event_type in ('click','purchase') as bigint) as clicked, cast(event_type='purchase' as bigint) as purchased from events""",
    "c6_graded_labels": """select o_orderpriority as query, case when o_orderkey%5=4 then 'unknown_label' when c.c_custkey is null then 'orphan' else cast(3-o_orderkey%5 as varchar) end as what, count(*) as n
 from orders o left join customer c on c.c_custkey=o.o_custkey and c.c_custkey%7<>0 group by 1,2""",
}
