"""What is sent to all tasks, and the reference of products by block."""

import re

from rankloom.operators import behavior
from rankloom.sources.views import view

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_catalogs_are_not_sent_to_all_tasks(spark):
    # Of the two joins only the one with the names is a broadcast; products meet the log by a shuffle, though their file is small.
    text = plan(view(spark, SF, "v_interactions"))
    assert re.search(r"SortMergeJoin \[pid#\d+L?\], \[product_id#\d+L?\], Inner", text)


def test_reference_joins_the_log_alone(spark):
    log = spark.createDataFrame([(1, 1, 1, 1, 0), (1, 3, 1, 1, 1), (2, 0, 1, 0, 0)], "product_id long, time_block int, impressed int, clicked int, purchased int")
    products = spark.createDataFrame([(1, 2), (2, 0), (3, 1)], "product_id long, launch_block int")
    df = behavior.reference(log, products, 5)
    assert len(re.findall(r"\bJoin\b", df._jdf.queryExecution().optimizedPlan().toString())) == 1
    got = {(r.product_id, r.time_block): (r.prior_impressions, r.prior_clicks, r.prior_purchases) for r in df.collect()}
    assert set(got) == {(1, b) for b in (2, 3, 4)} | {(2, b) for b in range(5)} | {(3, b) for b in range(1, 5)}
    assert got[1, 2] == (1, 1, 0) and got[1, 4] == (2, 2, 1) and got[2, 0] == (0, 0, 0) and got[2, 4] == (1, 0, 0) and got[3, 4] == (0, 0, 0)
