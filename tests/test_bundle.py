"""A bundle read back from files, and each contract broken by itself."""

import pytest
from pyspark.sql import functions as F

from rankloom.sources import bundle

PRODUCTS = [(1, "t", "b", "c", "a", "m", "red", 1.0, 0, 0.5), (2, "t", "b", "c", "a", "m", "red", 0.0, 1, 1.0)]
QUERIES = [(1, "q", "generic", "c", 1), (2, "q", "generic", "c", None)]
RELEVANCE = [(1, 1, 3, "exact", 1), (1, 2, 0, "irrelevant", 0), (2, 1, 2, "substitute", 1)]
LOG = [(0, 7, 1, 1, 1, 1, 1, 0, 0.5), (1, 7, 1, 2, 2, 1, 0, 0, 1.0)]


def whole(spark):
    rows = dict(zip(bundle.SCHEMAS, (PRODUCTS, QUERIES, RELEVANCE, LOG), strict=True))
    return bundle.Bundle(**{t: spark.createDataFrame(rows[t], s) for t, s in bundle.SCHEMAS.items()})


def changed(b, table, df):
    return bundle.Bundle(**(b.tables() | {table: df}))


def broken(b):
    return sorted((r.table, r.contract, r.column, r.n, r.examples) for r in bundle.violations(b).collect())


@pytest.mark.parametrize("kind", ["parquet", "csv"])
def test_written_and_read_back(spark, tmp_path, kind):
    b = whole(spark)
    bundle.write(b, str(tmp_path), kind)
    again = bundle.load(spark, str(tmp_path), kind)
    for t, df in b.tables().items():
        assert sorted(map(str, df.collect())) == sorted(map(str, again.tables()[t].collect()))


def test_missing_tables_are_all_named(spark, tmp_path):
    b = whole(spark)
    b.products.write.parquet(f"{tmp_path}/products.parquet")
    with pytest.raises(FileNotFoundError, match="queries.parquet.*relevance.parquet.*interactions.parquet"):
        bundle.load(spark, str(tmp_path))


def test_each_contract(spark):
    b = whole(spark)
    assert broken(b) == []
    p, q, r, log = b.products, b.queries, b.relevance, b.interactions
    first = lambda df, key, name, value: df.withColumn(name, F.when(F.col(key) == 1, F.lit(value)).otherwise(F.col(name)))
    cases = [
        ("products", p.drop("title"), [("products", "column", "title", 1, [])]),
        ("products", first(p, "product_id", "title", None), [("products", "required", "title", 1, [])]),
        ("products", first(p, "product_id", "price", -1.0), [("products", "bounded", "price", 1, [])]),
        ("products", first(p, "product_id", "quality", float("nan")), [("products", "required", "quality", 1, [])]),
        ("products", p.unionByName(p), [("products", "unique", "product_id", 2, [])]),
        ("queries", first(q, "query_id", "target_product_id", 99), [("queries", "key", "target_product_id", 1, ["99"])]),
        ("queries", first(q, "query_id", "target_product_id", -1), [("queries", "bounded", "target_product_id", 1, []), ("queries", "key", "target_product_id", 1, ["-1"])]),
        ("queries", q.drop("target_product_id"), []),
        ("relevance", first(r, "query_id", "relevance", 4), [("relevance", "bounded", "relevance", 2, [])]),
        ("relevance", first(r, "query_id", "relation", "other"), [("relevance", "allowed", "relation", 2, [])]),
        ("relevance", r.unionByName(r.where("product_id = 2")), [("relevance", "unique", "query_id,product_id", 1, [])]),
        ("relevance", r.unionByName(r.selectExpr("query_id", "product_id + 100 as product_id", "relevance", "relation", "attribute_compatible")), [("relevance", "key", "product_id", 3, ["101", "102"])]),
        ("interactions", log.withColumn("purchased", F.lit(1)), [("interactions", "funnel", "purchased", 1, [])]),
        ("interactions", log.withColumn("impressed", F.lit(0)), [("interactions", "funnel", "clicked", 1, [])]),
        ("interactions", log.withColumn("time_block", F.lit(0)), [("interactions", "available", "product_id", 1, [])]),
        ("interactions", log.withColumn("logging_propensity", F.lit(0.0)), [("interactions", "bounded", "logging_propensity", 2, [])]),
        ("interactions", log.where("false"), [("interactions", "non_empty", "", 1, [])]),
    ]
    # Cases of different tables are told apart, so several are broken at once.
    rounds = [[2, 5, 9, 12], [0, 8, 13], [3, 6, 10, 14], [4, 11, 15], [1, 7, 16]]
    assert sorted(i for x in rounds for i in x) == list(range(len(cases)))
    for together in rounds:
        bad, want = b, []
        for table, df, found in (cases[i] for i in together):
            bad, want = changed(bad, table, df), want + found
        assert broken(bad) == sorted(want), together
    with pytest.raises(ValueError, match=r"products.price: bounded \(1\); relevance.product_id: key"):
        bundle.validated(changed(changed(b, "products", first(p, "product_id", "price", -1.0)), "relevance", cases[11][1]))


def test_only_the_first_keys_are_named(spark):
    b = whole(spark)
    many = spark.range(100, 140).selectExpr("1L as query_id", "id as product_id", "1 as relevance", "'exact' as relation", "1 as attribute_compatible")
    assert broken(changed(b, "relevance", b.relevance.unionByName(many))) == [("relevance", "key", "product_id", 40, [str(i) for i in range(100, 110)])]
