"""Every registered query against its SQL, and literal frames for the metrics."""

import glob
import math
import os

import duckdb
import pytest

from rankloom.operators import behavior, metrics, retrieval
from rankloom.plans import audits, learners, models, policy, registry, releases, reports, studies

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE_SQL = registry.QUERIES | reports.QUERIES | policy.QUERIES | studies.QUERIES | models.QUERIES | audits.QUERIES | learners.QUERIES | releases.QUERIES, registry.ORACLE_SQL | reports.ORACLE_SQL | policy.ORACLE_SQL | studies.ORACLE_SQL | models.ORACLE_SQL | audits.ORACLE_SQL | learners.ORACLE_SQL | releases.ORACLE_SQL


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def same(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, abs_tol=1e-9))


@pytest.mark.parametrize("name", list(QUERIES))
def test_against_sql(spark, oracle, name):
    df = QUERIES[name](spark, SF)
    if name not in ORACLE_SQL:
        assert df.count() > 0
        return
    names = sorted(df.columns)
    want = oracle.execute(f"select {', '.join(f'{chr(34)}{n}{chr(34)}' for n in names)} from ({ORACLE_SQL[name]})").fetchall()
    got = [tuple(r) for r in df.select(*names).collect()]
    key = lambda r: tuple((x is None, round(x, 4) if isinstance(x, float) else x) if not isinstance(x, str) else (False, x) for x in r)
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=key), sorted(want, key=key)):
        assert all(same(x, y) for x, y in zip(g, w)), (g, w)


def test_perfect_ranking(spark):
    ranked = spark.createDataFrame([(1, 10, 1), (1, 20, 2), (1, 30, 3)], "query_id long, product_id long, rank int")
    judged = spark.createDataFrame([(1, 10, 3, "exact"), (1, 20, 2, "substitute"), (1, 30, 0, "irrelevant")], "query_id long, product_id long, relevance int, relation string")
    assert metrics.ndcg(ranked, judged, 3).first().ndcg == pytest.approx(1)
    assert metrics.exposure(ranked, judged, 2).first().irrelevant == 0


def test_same_block_sees_the_same_state(spark):
    log = spark.createDataFrame([(1, 1, 0, 1, 1, 0), (2, 1, 0, 1, 0, 0), (3, 1, 1, 1, 0, 0)], "event_seq long, product_id long, time_block int, impressed int, clicked int, purchased int")
    products = spark.createDataFrame([(1, 0)], "product_id long, launch_block int")
    got = {r.event_seq: (r.prior_impressions, r.prior_clicks) for r in behavior.prior_features(log, products).collect()}
    assert got == {1: (0, 0), 2: (0, 0), 3: (2, 1)}


def test_ties_go_to_the_smaller_number(spark):
    rows = spark.createDataFrame([(1, 10, 0.5), (1, 2, 0.5), (1, 30, 0.5)], "query_id long, product_id long, score double")
    assert {r.product_id: r["rank"] for r in retrieval.top(rows, "score", 3, ["query_id"]).collect()} == {10: 2, 2: 1, 30: 3}
