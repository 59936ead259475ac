"""Contracts of tables as DataFrames of what breaks them, and the split of a log by time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def column_checks(df: DataFrame, not_null: list[str], unique: str, bounded: dict[str, tuple[float, float]]) -> DataFrame:
    """check, key, n: rows with a null, rows beyond the first of a key, and rows outside bounds (unparseable ones count),
    all in one pass over the table."""
    missing = lambda c: F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
    inside = lambda c, lo, hi: F.coalesce(F.expr(f"try_cast(`{c}` as double)").between(lo, hi), F.lit(False))
    found = {("not_null", c): F.count_if(missing(c)) for c in not_null} | {("unique", unique): F.count("*") - F.count_distinct(unique)}
    found |= {("bounded", c): F.count_if(~inside(c, lo, hi)) for c, (lo, hi) in bounded.items()}
    row = df.agg(*[v.cast("long").alias(f"n{i}") for i, v in enumerate(found.values())])
    rows = F.array(*[F.struct(F.lit(a).alias("check"), F.lit(b).alias("key"), F.col(f"n{i}").alias("n")) for i, (a, b) in enumerate(found)])
    return row.select(F.inline(rows))


def orphans(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Keys of `rows` that `keys` lacks, with their number of rows."""
    return rows.join(keys.select(key), key, "left_anti").groupBy(key).agg(F.count("*").alias("n"))


def funnel(log: DataFrame) -> DataFrame:
    """Rows, purchases without a click, and clicks on what wasn't shown."""
    return log.agg(F.count("*").alias("n"), F.count_if(F.col("purchased") > F.col("clicked")).alias("purchased_unclicked"), F.count_if(F.col("clicked") > F.col("impressed")).alias("clicked_unseen"))


def unavailable(log: DataFrame, products: DataFrame) -> DataFrame:
    """Rows of the log that name a product launched after their block."""
    out = log.join(products.select("product_id", "launch_block"), "product_id").where("launch_block > time_block")
    return out.select("event_seq", "product_id", "time_block", "launch_block")


def temporal_split(log: DataFrame, products: DataFrame) -> DataFrame:
    """The log of products launched by the test block, with `split`: the last block is the future audit, then test,
    validation, and all before it training."""
    last = log.agg(F.max("time_block").alias("last"))
    b, m = F.col("time_block"), F.col("last")
    name = F.when(b == m, "future").when(b == m - 1, "test").when(b == m - 2, "validation").otherwise("train")
    # One row, from an aggregate without keys.
    rows = log.join(F.broadcast(last), F.lit(True)).join(products.select("product_id", "launch_block"), "product_id").where("launch_block <= last - 1")
    return rows.withColumn("split", name).drop("last", "launch_block")


def query_text(queries: DataFrame) -> DataFrame:
    """Queries of 1 to 300 characters after white space is collapsed, with a stable negative key."""
    q = queries.select(F.trim(F.regexp_replace("query", "[ \\t\\n\\x0B\\f\\r]+", " ")).alias("query")).where(F.length("query").between(1, 300))
    return q.withColumn("query_key", -F.conv(F.substring(F.sha2("query", 256), 1, 8), 16, 10).cast("long") - 1)


def table_checks(df: DataFrame, pair: list[str], allowed: dict[str, list[str]], optional: list[str]) -> DataFrame:
    """check, key, n: 1 for an empty table, rows beyond the first of a pair of keys, rows outside a set of values (nulls
    count), and rows below 0 in columns that need not be there (no row of the result where they aren't; unparseable values
    count). One pass over the table, and one over its pairs."""
    found = {("non_empty", ""): (F.count("*") == 0).cast("long")}
    found |= {("allowed", c): F.count_if(~F.coalesce(F.col(c).isin(v), F.lit(False))) for c, v in allowed.items()}
    found |= {("optional_non_negative", c): F.count_if(F.col(c).isNotNull() & ~F.coalesce(F.expr(f"try_cast(`{c}` as double)") >= 0, F.lit(False))) for c in optional if c in df.columns}
    row = df.agg(*[v.cast("long").alias(f"n{i}") for i, v in enumerate(found.values())])
    rows = F.array(*[F.struct(F.lit(a).alias("check"), F.lit(b).alias("key"), F.col(f"n{i}").alias("n")) for i, (a, b) in enumerate(found)])
    again = duplicates(df, pair).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n"))
    return row.select(F.inline(rows)).unionByName(again.select(F.lit("unique_pair").alias("check"), F.lit(",".join(pair)).alias("key"), "n"))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has, with their number of rows: to be empty before rows are paired by them."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def cardinality(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One row: keys that repeat on the left and on the right, and the kind of join that `keys` make."""
    count = lambda df, name: duplicates(df, keys).agg(F.count("*").alias(name)).withColumn("one", F.lit(1))
    both = count(left, "left_repeated").join(count(right, "right_repeated"), "one")
    side = lambda c: F.when(F.col(c) > 0, "many").otherwise("one")
    return both.select("left_repeated", "right_repeated", F.concat_ws("_to_", side("left_repeated"), side("right_repeated")).alias("kind"))


def judged_in(judgments: DataFrame, catalog: DataFrame) -> DataFrame:
    """The judgments of products in the catalog."""
    return judgments.join(catalog.select("product_id"), "product_id", "left_semi")


def last_of(df: DataFrame, keys: list[str], recency: list[str]) -> DataFrame:
    """The latest row of each key by `recency`, in a partial aggregate: no group is sorted."""
    rest = [c for c in df.columns if c not in keys]
    latest = F.max_by(F.struct(*rest), F.struct(*recency)).alias("last")
    return df.groupBy(*keys).agg(latest).select(*keys, *[F.col("last")[c].alias(c) for c in rest])
