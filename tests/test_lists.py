"""Lists by title against scores of every product, and judgments of pairs against the whole view."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rankloom.operators import behavior, retrieval, transfer
from rankloom.plans import policy, registry
from rankloom.sources.views import judgments, view

SF = "/root/testdata/sf0.001"
TITLES = ["Ring red steel", "ring RED steel", "bolt red", "bolt blue bolt", "blue ring", None, "", "a"]
PRODUCTS = [(i, TITLES[(i * 5 + i // 7) % len(TITLES)], i % 3) for i in range(300)]
QUERIES = [(1, "red ring"), (2, "bolt"), (3, "nothing"), (4, "blue BOLT blue"), (5, None)]


def words(text):
    return re.findall(r"\w{2,}", (text or "").lower())


def by_product(query, scope):
    """BM25 of every product of the scope that shares a term, each scored by itself."""
    own = {i: Counter(words(t)) for i, t, b in PRODUCTS if b <= scope}
    size, average = len(own), sum(sum(c.values()) for c in own.values()) / len(own)
    df = Counter(w for c in own.values() for w in c)
    out = {}
    for i, c in own.items():
        met = [w for w in set(words(query)) if w in c]
        if met:
            norm = 1.5 * (0.25 + 0.75 * sum(c.values()) / average)
            out[i] = round(sum(math.log(1 + (size - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.5 / (c[w] + norm + 1e-12) for w in met), 9)
    return out


def test_lists_by_title_are_those_of_all_products(spark):
    products = spark.createDataFrame(PRODUCTS, "product_id long, title string, launch_block int")
    queries = spark.createDataFrame(QUERIES, "query_id long, query string")
    groups, heads = retrieval.by_title(products, retrieval.members_by_block(products, [0, 2]), 60)
    assert groups.groupBy("scope").agg(F.sum("n").alias("n")).where("scope = 2").first().n == 300
    scored = retrieval.bm25(queries, groups).withColumn("bm25_score", F.round("bm25_score", 9))
    # Rows are as many as titles, not as products.
    assert scored.where("scope = 2 and query_id = 1").count() == 4
    for k in (3, 60):
        got = {(r.scope, r.query_id, r["rank"]): (r.product_id, r.bm25_score) for r in retrieval.best(scored, "bm25_score", groups, heads, k).collect()}
        want = {}
        for scope in (0, 2):
            for q, text in QUERIES:
                every = by_product(text, scope)
                for n, i in enumerate(sorted(every, key=lambda i: (-every[i], i))[:k], 1):
                    want[scope, q, n] = (i, every[i])
        assert got.keys() == want.keys()
        assert all(got[x][0] == want[x][0] and got[x][1] == pytest.approx(want[x][1], abs=2e-9) for x in want)


def test_judgments_are_those_of_the_view(spark):
    pairs = view(spark, SF, "v_products").where("product_id % 3 = 0").select("product_id").crossJoin(spark.range(0, 30, 4).select(F.col("id").alias("query_id")))
    want = view(spark, SF, "v_relevance").join(pairs, ["query_id", "product_id"], "left_semi")
    got = judgments(spark, SF, pairs)
    rows = lambda df: sorted(tuple(r) for r in df.select("query_id", "product_id", "relevance", "relation", "attribute_compatible").collect())
    assert rows(got) == rows(want) and len(rows(got)) > 50


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_join_pairs_all_queries_with_all_products(spark):
    text = plan(registry.flagship(spark, SF))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text


def test_members_with_titles_are_listed_without_the_catalog(spark):
    products = spark.createDataFrame(PRODUCTS, "product_id long, title string, launch_block int")
    joined = retrieval.by_title(products, retrieval.members_by_block(products, [0, 2]), 5)
    alone = retrieval.by_title(products, retrieval.members_by_block(products, [0, 2], "title"), 5)
    for a, b in zip(joined, alone, strict=True):
        assert sorted(a.select(*b.columns).collect(), key=str) == sorted(b.collect(), key=str)
        assert "Join" in plan(a) and "Join" not in plan(b)


def test_catalogs_are_not_sent_whole(spark):
    products = spark.createDataFrame([(*p, f"c{p[0] % 3}") for p in PRODUCTS], "product_id long, title string, launch_block int, category string")
    groups, heads = retrieval.by_title(products, retrieval.members_by_block(products, [2], "title"), 60)
    lists = retrieval.best(groups.select("scope", "title", F.lit(1).alias("query_id"), F.col("n").alias("s")), "s", groups, heads, 9)
    ref = spark.createDataFrame([(i, 4, i % 5, 0.25, 0.5) for i in range(300)], "product_id long, time_block int, prior_impressions long, smoothed_ctr double, smoothed_purchase_rate double")
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(1 << 40))
    try:
        # Any join that may be a broadcast is one now.
        by_title, priors = plan(lists), plan(behavior.category_priors(ref, products))
        edges = plan(transfer.edges(products, 4, ["category"], products.where("product_id % 7 = 0")))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
    assert "SortMergeJoin [scope" in by_title and "SortMergeJoin [product_id" in priors and edges.count("SortMergeJoin [category") >= 2


def test_judgments_do_not_send_the_catalog(spark):
    text = plan(judgments(spark, SF, spark.createDataFrame([(0, 1), (1, 7)], "query_id long, product_id long")))
    # The asked products and the queries' own meet by a shuffle each.
    assert "SortMergeJoin [target_product_id" in text and text.count("SortMergeJoin [product_id") >= 1


def test_state_of_a_block_is_that_of_the_reference(spark):
    log, products = view(spark, SF, "v_interactions"), view(spark, SF, "v_products")
    names = ["product_id", "prior_impressions", "prior_clicks", "prior_purchases", "smoothed_ctr", "smoothed_purchase_rate", "zero_history", "sparse_history"]
    want = behavior.reference(log, products, 5).where("time_block = 4").select(*names)
    got = behavior.snapshot(log, products.where("launch_block <= 4"), 4).select(*names)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 50


def test_lent_rates_work_out_one_block(spark, monkeypatch):
    monkeypatch.setattr(behavior, "reference", lambda *a: pytest.fail("every block was worked out"))
    assert policy.lent(spark, SF, policy.hybrid(spark, SF)).count() > 50
