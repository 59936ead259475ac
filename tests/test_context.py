"""The context of a query, blocks that the reference lacks, and deltas of summaries."""

import pytest

from rankloom.operators import panel, transfer


def test_what_goes_before_what(spark):
    queries = spark.createDataFrame([(1, "red shoe", "shoes", "generic"), (2, "hat", None, None), (5, "lamp", "home", "accessory")], "query_id long, query string, category string, intent string")
    anchors = spark.createDataFrame([(1, 70)], "query_id long, product_id long")
    rows = [(0, 1, 10, None, None, 0.1), (0, 2, 11, None, None, 0.5), (0, 2, 12, "hats", None, 0.5), (0, 3, 13, "x", "own text", None), (0, 3, 14, None, None, float("nan")), (1, 5, 15, None, None, 0.2), (1, 5, 16, None, None, 0.9)]
    df = spark.createDataFrame(rows, "time_block int, query_id long, product_id long, query_category string, query_text string, retrieval_score double")
    got = {(r.time_block, r.query_id): (r.query, r.query_category, r.intent, r.anchor) for r in transfer.query_context(df, queries, anchors).collect()}
    assert got == {(0, 1): ("red shoe", "shoes", "generic", 70), (0, 2): ("hat", "hats", "generic", 11), (0, 3): ("own text", "x", "generic", 13), (1, 5): ("lamp", "home", "accessory", 16)}
    both = df.drop("retrieval_score").selectExpr("*", "case when product_id = 12 then 0.4 else 0.3 end as bm25_score", "0.2 as dense_score")
    assert {r.query_id: r.anchor for r in transfer.query_context(both, queries, anchors).collect()}[2] == 12
    with pytest.raises(Exception, match="no text of query 9"):
        transfer.query_context(spark.createDataFrame([(0, 9, 1)], "time_block int, query_id long, product_id long"), queries, anchors).collect()


def test_blocks_must_be_in_the_reference(spark):
    rows, reference = spark.createDataFrame([(1,), (4,), (5,)], "time_block int"), spark.createDataFrame([(1,), (2,)], "time_block int")
    with pytest.raises(ValueError, match=r"\[4, 5\]"):
        transfer.checked_blocks(rows, reference)
    assert transfer.checked_blocks(rows.where("time_block = 1"), reference).count() == 1


def test_summary_deltas(spark):
    rows = [(1, "base", 2.0), (1, "treatment", 5.0), (2, "base", 1.0), (2, "treatment", None)]
    df = spark.createDataFrame(rows, "seed int, policy string, m double")
    assert {r.seed: r.delta_m for r in panel.summary_deltas(df, ["seed"], ["m"]).collect()} == {1: 3.0, 2: None}
    for bad in ([(3, "base", 1.0)], [(3, "base", 1.0), (3, "base", 1.0), (3, "treatment", 1.0)]):
        with pytest.raises(Exception, match="not one row of each policy: 3"):
            panel.summary_deltas(df.unionByName(spark.createDataFrame(bad, df.schema)), ["seed"], ["m"]).collect()


def test_a_candidate_without_history_or_judgment_keeps_its_row(spark):
    from rankloom.operators import retrieval

    fused = spark.createDataFrame([(1, 10, 0.5), (1, 11, 0.4)], "query_id long, product_id long, retrieval_score double")
    products = spark.createDataFrame([(i, "t", "b", "c", "a", "m", 0, 0.5, -1.0) for i in (10, 11)], "product_id long, title string, brand string, category string, attribute string, model string, launch_block int, quality double, price double")
    queries = spark.createDataFrame([(1, "q", "generic", "c")], "query_id long, query string, intent string, category string")
    state = spark.createDataFrame([(10, 4, 2, 1, 0.3, 0.1, 0, 0)], "product_id long, prior_impressions long, prior_clicks long, prior_purchases long, smoothed_ctr double, smoothed_purchase_rate double, zero_history int, sparse_history int")
    judged = spark.createDataFrame([(1, 11, 2, "substitute")], "query_id long, product_id long, relevance int, relation string")
    got = {r.product_id: r for r in retrieval.snapshot(fused, products, queries, state, judged).collect()}
    assert (got[10].prior_clicks, got[10].smoothed_ctr, got[10].zero_history, got[10].judged, got[10].relevance, got[10].price_log) == (2, 0.3, 0, 0, None, 0)
    assert (got[11].prior_clicks, got[11].smoothed_ctr, got[11].smoothed_purchase_rate, got[11].zero_history, got[11].judged, got[11].relevance) == (0, 1 / 5, 0.5 / 8, 1, 1, 2)
