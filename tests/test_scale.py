"""How often, and how, the work on logs and catalogs reads its tables."""

import pytest
from pyspark.sql import functions as F

from rankloom.operators import behavior, metrics, retrieval, transfer
from rankloom.plans import audits, policy, registry, releases
from rankloom.sources import folders, views

SF = "/root/testdata/sf0.001"
LOG = [(i, f"c{i % 3}" if i % 17 else None, f"a{i % 5}", (i * 7 % 10) / 10 if i % 11 else None, 0.1 + (i % 4) / 10, 0.05 + (i % 5) / 10 if i % 23 else None) for i in range(300)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def by_row(rows, folds=5):
    """The estimates with every row held against its own cell's mean outside its fold."""
    import hashlib

    rows = [(int(hashlib.md5(str(r[0]).encode()).hexdigest()[:8], 16) % folds, *r) for r in rows]
    mean = lambda x, n: sum(v for v in x if v is not None) / n if n else None
    pi = {a: max(r[6] for r in rows if r[3] == a and r[6] is not None) for a in {r[3] for r in rows}}

    def mu(c, a, f):
        own = [r[4] for r in rows if (r[2], r[3]) == (c, a) and r[0] != f]
        return mean(own, len(own)) if own else mean([r[4] for r in rows if r[0] != f], sum(r[0] != f for r in rows))

    direct, robust = [], []
    for f, _, c, a, y, logged, new in rows:
        if c is not None:
            dm = sum(p * mu(c, b, f) for b, p in pi.items())
            direct.append(dm)
            if y is not None and new is not None:
                robust.append(dm + new / max(logged, 1e-8) * (y - mu(c, a, f)))
    return sum(direct) / len(direct), sum(robust) / len(robust)


def test_doubly_robust_reads_its_log_once(spark):
    log = spark.createDataFrame(LOG, "obs_id long, context string, action string, reward double, logging_propensity double, candidate_propensity double")
    found = metrics.doubly_robust(log)
    # The log's own rows are in no join: what is joined are its cells, written once.
    assert "Scan ExistingRDD" not in plan(found) and "LocalTableScan" not in plan(found)
    assert (found.first().direct, found.first().doubly_robust) == pytest.approx(by_row(LOG), rel=1e-9)


def test_latencies_of_the_gates_are_not_kept_by_one_task(spark):
    assert "percentile(value" not in plan(releases.other_metrics(spark, SF))


def test_sets_meet_the_smallest_products_of_their_texts(spark, monkeypatch):
    rows = [(i, f"ring {i % 3} {'x ' * (i % 2)}", "c") for i in range(300)]
    products = spark.createDataFrame(rows, "product_id long, title string, category string")
    kept, write = {}, transfer.stored
    monkeypatch.setattr(transfer, "stored", lambda df, name: kept.setdefault(name, write(df, name)))
    got = transfer.edges(products, 4, ["category"], products.where("product_id < 12")).groupBy("product_id").count().collect()
    # Of six titles five products each, not all 300.
    assert kept["smallest"].count() == 30 and sorted(map(tuple, got)) == [(i, 4) for i in range(12)]


def test_queries_are_worked_out_once(spark, monkeypatch):
    asked, view = [], views.view
    monkeypatch.setattr(policy, "view", lambda s, d, name, **done: asked.append((name, sorted(done))) or view(s, d, name, **done))
    policy.gate_input(spark, SF)
    assert [x for x in asked if x[0] in ("v_queries", "v_interactions")] == [("v_queries", []), ("v_interactions", ["v_queries"])]


def test_priors_of_rows_with_their_category(spark):
    log, products = views.view(spark, SF, "v_interactions"), views.view(spark, SF, "v_products").where("launch_block <= 4")
    state = behavior.standing(behavior.counts_before(log, 4), products, 4, "category").selectExpr("*", "4 as time_block")
    want = behavior.category_priors(behavior.reference(log, products, 5).where("time_block = 4"), products)
    rows = lambda df: sorted((r.time_block, r.category, *[round(v, 9) for v in r[2:]]) for r in df.collect())
    assert rows(behavior.category_priors(state)) == rows(want) and len(rows(want)) > 3


def test_pairs_of_query_and_title_are_added_up_where_they_are_made(spark):
    products = spark.createDataFrame([(i, f"brand t{i}", 0) for i in range(200)], "product_id long, title string, launch_block int")
    queries = spark.createDataFrame([(q, f"brand t{q}") for q in range(50)], "query_id long, query string")
    groups, _ = retrieval.by_title(products, retrieval.members_by_block(products, [0], "title"), 3)
    scored = retrieval.bm25(queries, groups)
    # A word of all titles and queries: 200 rows of it go by term, not 50 x 200.
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = retrieval.bm25(queries, groups)
        assert df.count() == 50 * 200
        text = plan(df)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
    shuffled = [line for line in text.splitlines() if "Exchange hashpartitioning" in line and "query_id" in line]
    below = text[text.index(shuffled[0]):].split("Exchange hashpartitioning")
    assert len(shuffled) == 1 and "partial_sum(gain" in below[1] and scored.count() == 50 * 200


@pytest.fixture
def nothing_sent(spark):
    """Spark sends no table to all tasks unless it is told to."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    was = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, was)


def fullest(df):
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_no_task_has_all_pairs_of_a_common_word(spark, monkeypatch, nothing_sent):
    monkeypatch.setattr(folders, "ROWS", 1000)
    groups = spark.createDataFrame([(0, f"brand t{i}", 1, i) for i in range(400)], "scope int, title string, n long, first long")
    queries = spark.createDataFrame([(q, f"brand t{q}") for q in range(50)], "query_id long, query string")
    scored = retrieval.bm25(queries, groups)
    assert scored.count() == 20_000 and fullest(scored) < 3000
    dense = retrieval.tfidf(queries, groups)
    with folders.small_tasks(spark, 20_000):
        assert dense.count() == 20_000
    assert "REPARTITION_BY_NUM" in plan(retrieval.tfidf(queries, groups))


def test_common_terms_stay_where_they_are(spark, nothing_sent):
    rows = spark.range(2000).selectExpr("0 as scope", "case when id % 2 = 0 then 'brand' else concat('t', id) end as term", "id").repartition(8)
    found = rows.groupBy("scope", "term").agg(F.count("*").alias("held")).withColumn("idf", F.length("term"))
    got, want = retrieval.meet(rows, found), rows.join(found.drop("held"), ["scope", "term"])
    seen = lambda df: sorted(map(tuple, df.select("scope", "term", "id", "idf").collect()))
    assert seen(got) == seen(want) and len(seen(got)) == 2000
    assert fullest(got.where("term = 'brand'")) < 300 and fullest(want.where("term = 'brand'")) == 1000


def test_members_of_one_file_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(folders, "ROWS", 100)
    members = spark.range(1000).coalesce(1).selectExpr("0 as scope", "id as product_id", "concat('t', id % 7) as title")
    groups, heads = retrieval.by_title(members, members, 3)
    assert "REPARTITION_BY_NUM" in plan(heads) and groups.agg(F.sum("n")).first()[0] == 1000
    assert sorted(r.product_id for r in heads.collect()) == list(range(21))


def test_shuffles_are_cut_for_their_rows_alone(spark):
    names = ["spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"]
    now = lambda: [spark.conf.get(n, None) for n in names]
    before = now()
    with pytest.raises(ValueError), folders.small_tasks(spark, 1000 * folders.ROWS):
        assert now() == ["1000", folders.BYTES]
        raise ValueError
    assert now() == before


def test_history_is_that_of_listed_products(spark, monkeypatch):
    ranked, counted, snapshot = registry.lexical(spark, SF), [], behavior.snapshot
    monkeypatch.setattr(audits.behavior, "snapshot", lambda log, products, cutoff: counted.append(products.count()) or snapshot(log, products, cutoff))
    found = audits.with_history(spark, SF, ranked)
    assert found.count() == ranked.count() and counted == [ranked.select("product_id").distinct().count()]
    assert counted[0] < views.view(spark, SF, "v_products").count()
