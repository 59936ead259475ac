"""Truncated SVD against numpy on literal frames: strengths, cosines, the subspace, and the catalogs too small for it."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators import latent

TITLES = ["red shoe", "red red hat", "blue shoe lace", "blue hat", "green coat wool", "wool hat blue", "shoe", "coat coat red"]
QUERIES = [(0, "red shoe"), (1, "wool coat"), (2, "nothing known"), (3, "hat"), (4, None)]


def tfidf(titles):
    def grams(t):
        w = [x for x in t.lower().split() if len(x) > 1]
        return w + [f"{a} {b}" for a, b in zip(w, w[1:])]

    vocabulary = sorted({g for t in titles for g in grams(t)})
    idf = {g: math.log((1 + len(titles)) / (1 + sum(g in grams(t) for t in titles))) + 1 for g in vocabulary}

    def row(t):
        own = grams(t or "")
        return np.array([(1 + math.log(own.count(g))) * idf[g] if g in own else 0.0 for g in vocabulary])

    a = np.array([row(t) for t in titles])
    return a / np.linalg.norm(a, axis=1, keepdims=True), row


def expected(titles, d):
    a, row = tfidf(titles)
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    d = min(d, a.shape[0] - 1, a.shape[1] - 1)
    docs = a @ vt[:d].T
    docs = docs / np.linalg.norm(docs, axis=1, keepdims=True)
    out = {}
    for q, t in QUERIES:
        x = row(t) @ vt[:d].T
        if np.linalg.norm(row(t)) > 0:
            out[q] = docs @ (x / max(np.linalg.norm(x), 1e-300))
    return s[:d], out


def frames(spark, titles, scope=1):
    products = spark.createDataFrame(list(enumerate(titles)), "product_id long, title string")
    members = spark.createDataFrame([(scope, i) for i in range(len(titles))], "scope int, product_id long")
    return products, members, spark.createDataFrame(QUERIES, "query_id long, query string")


@pytest.mark.parametrize("d", [3, 64])
def test_equals_numpy(spark, d):
    products, members, queries = frames(spark, TITLES)
    more = members.unionByName(members.selectExpr("2 as scope", "product_id").where("product_id < 5"))
    space = latent.fit(products, more, d)
    strengths = {r.scope: r.strengths for r in space.strengths.collect()}
    got = {(r.scope, r.query_id, r.product_id): r.dense_score for r in latent.top(queries, space, 50).collect()}
    for scope, titles in ((1, TITLES), (2, TITLES[:5])):
        want, scores = expected(titles, d)
        assert np.allclose(strengths[scope], want, rtol=1e-8)
        assert {k[1:] for k in got if k[0] == scope} == {(q, i) for q in scores for i in range(len(titles))}
        assert all(math.isclose(got[scope, q, i], x, abs_tol=1e-6) for q, own in scores.items() for i, x in enumerate(own))


def test_singular_vectors_up_to_sign(spark):
    products, members, _ = frames(spark, TITLES)
    a, _ = tfidf(TITLES)
    _, _, vt = np.linalg.svd(a, full_matrices=False)
    space = latent.fit(products, members, 4)
    rows = sorted((r.term, r.loading) for r in space.terms.collect())
    v = np.array([x[:4] for _, x in rows])
    assert np.allclose(np.abs((v * vt[:4].T).sum(0)), 1, atol=1e-6)


@pytest.mark.parametrize("titles", [["red shoe"], ["shoe", "shoe"], []])
def test_too_small_for_factors(spark, titles):
    products, members, queries = frames(spark, titles)
    space = latent.fit(products, members, 8)
    got = {(r.query_id, r.product_id): r.dense_score for r in latent.top(queries, space, 5).collect()}
    if not titles:
        assert got == {}
    else:
        assert got[0, 0] == pytest.approx(1) and all(0 < x <= 1 for x in got.values()) and (2, 0) not in got
    assert all(r.d == 0 for r in space.sizes.collect())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def all_sent(spark):
    """Spark sends any table whole that it may."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    was = spark.conf.get(name)
    spark.conf.set(name, str(1 << 40))
    yield
    spark.conf.set(name, was)


def test_products_of_one_text_are_one_row(spark):
    titles = [TITLES[(i * 5 + i // 7) % len(TITLES)] if i % 29 else None for i in range(120)]
    products, members, queries = frames(spark, titles)
    space = latent.fit(products, members, 4)
    known = [i for i, t in enumerate(titles) if t]
    a, row = tfidf([titles[i] for i in known])
    # Null titles are members, but no rows of the matrix.
    df = (a > 0).sum(0)
    a = a * (np.log((1 + len(titles)) / (1 + df)) + 1) / (np.log((1 + len(known)) / (1 + df)) + 1)
    a = a / np.linalg.norm(a, axis=1, keepdims=True)
    _, s, vt = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(space.strengths.first().strengths, s[:4], rtol=1e-6)
    docs = a @ vt[:4].T
    docs = docs / np.linalg.norm(docs, axis=1, keepdims=True)
    got = {(r.query_id, r["rank"]): (r.product_id, r.dense_score) for r in latent.top(queries, space, 40).collect()}
    assert {q for q, _ in got} == {0, 1, 3}
    for q, words in ((0, "red shoe"), (1, "wool coat"), (3, "hat")):
        x = row(words) * (np.log((1 + len(titles)) / (1 + df)) + 1) / (np.log((1 + len(known)) / (1 + df)) + 1) @ vt[:4].T
        scores = np.round(docs @ (x / np.linalg.norm(x)), 6)
        want = sorted(zip(-scores, known))[:40]
        assert [got[q, n][0] for n in range(1, 41)] == [i for _, i in want]
        assert np.allclose([got[q, n][1] for n in range(1, 41)], [-x for x, _ in want], atol=2e-6)
    assert space.weights.select("product_id").distinct().count() == len(TITLES)


def test_no_catalog_is_sent_to_all_tasks(spark, monkeypatch, all_sent):
    products, members, queries = frames(spark, TITLES)
    plans, write = [], latent.stored
    monkeypatch.setattr(latent, "stored", lambda df, name: plans.append(plan(df)) or write(df, name))
    space = latent.fit(products, members, 3, rounds=1)
    # Members and rows meet what else is known of them by a shuffle.
    assert plans and not any("BroadcastHashJoin [product_id" in p or "BroadcastHashJoin [scope#, product_id" in re.sub(r"#\d+L?", "#", p) for p in plans)
    assert "SortMergeJoin [product_id" in plans[0] and "Broadcast" not in plans[0]
    lists = re.sub(r"#\d+L?", "#", plan(latent.top(queries, space, 5)))
    assert "SortMergeJoin [scope#, first#]" in lists and "SortMergeJoin [scope#, title#]" in lists


def test_members_with_their_text_do_not_meet_the_catalog(spark, monkeypatch):
    products, members, _ = frames(spark, TITLES)
    plans, write = [], latent.stored
    monkeypatch.setattr(latent, "stored", lambda df, name: plans.append(plan(df)) or write(df, name))
    monkeypatch.setattr(latent, "_fit", lambda groups, *_: groups)
    assert latent.fit(products, members.withColumn("title", F.lit("red shoe")), 3).first().n == len(TITLES) and "Join" not in plans[0]
