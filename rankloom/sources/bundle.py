"""Four tables - products, queries, relevance, interactions - read, checked and written as one."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import inf

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns that each table must have, and what must hold for them. Bounds are inclusive; `at_least` also
# refuses what is no number where a column is optional.
SCHEMAS = {
    "products": "product_id long, title string, brand string, category string, attribute string, model string, color string, price double, launch_block int, quality double",
    "queries": "query_id long, query string, intent string, category string, target_product_id long",
    "relevance": "query_id long, product_id long, relevance int, relation string, attribute_compatible int",
    "interactions": "time_block int, user_id long, query_id long, product_id long, position int, impressed int, clicked int, purchased int, logging_propensity double",
}
OPTIONAL = {"queries": ["target_product_id"]}
UNIQUE = {"products": [["product_id"]], "queries": [["query_id"]], "relevance": [["query_id", "product_id"]]}
BOUNDS = {
    "products": {"product_id": (0, inf), "price": (0, inf), "launch_block": (0, inf), "quality": (0, 1)},
    "queries": {"query_id": (0, inf), "target_product_id": (0, inf)},
    "relevance": {"relevance": (0, 3), "attribute_compatible": (0, 1)},
    "interactions": {"time_block": (0, inf), "user_id": (0, inf), "query_id": (0, inf), "product_id": (0, inf), "position": (0, inf), "impressed": (0, 1), "clicked": (0, 1), "purchased": (0, 1), "logging_propensity": (2.0**-52, 1)},
}
ALLOWED = {"relevance": {"relation": ["complement", "exact", "irrelevant", "substitute"]}}
KEYS = [("relevance", "product_id", "products", "product_id"), ("relevance", "query_id", "queries", "query_id"), ("interactions", "product_id", "products", "product_id"), ("interactions", "query_id", "queries", "query_id"), ("queries", "target_product_id", "products", "product_id")]
#: Values named for a broken key.
NAMED = 10
VIOLATION = "table string, contract string, column string, n long, examples array<string>"


@dataclass
class Bundle:
    products: DataFrame
    queries: DataFrame
    relevance: DataFrame
    interactions: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {n: getattr(self, n) for n in SCHEMAS}


def _rows(df: DataFrame, table: str, found: dict[tuple[str, str], Column]) -> DataFrame:
    """All these counts in one pass over the table, a row for each that isn't 0."""
    row = df.agg(*[v.cast("long").alias(f"n{i}") for i, v in enumerate(found.values())])
    none = F.array().cast("array<string>")
    each = F.array(*[F.struct(F.lit(table).alias("table"), F.lit(a).alias("contract"), F.lit(b).alias("column"), F.col(f"n{i}").alias("n"), none.alias("examples")) for i, (a, b) in enumerate(found)])
    return row.select(F.inline(each)).where("n > 0")


def _columns(df: DataFrame, table: str) -> DataFrame:
    kinds, optional = dict(df.dtypes), OPTIONAL.get(table, [])
    number = lambda c: F.expr(f"try_cast(`{c}` as double)")
    missing = lambda c: F.col(c).isNull() | (F.isnan(c) if kinds[c] in ("double", "float") else F.lit(False))
    found = {("non_empty", ""): (F.count("*") == 0)}
    found |= {("required", c): F.count_if(missing(c)) for c in _names(table) if c in kinds and c not in optional}
    # A null is broken once: as a required value.
    found |= {("bounded", c): F.count_if(~missing(c) & ~F.coalesce(number(c).between(lo, hi), F.lit(False))) for c, (lo, hi) in BOUNDS.get(table, {}).items() if c in kinds}
    found |= {("allowed", c): F.count_if(~missing(c) & ~F.col(c).isin(v)) for c, v in ALLOWED.get(table, {}).items() if c in kinds}
    if table == "interactions" and {"impressed", "clicked", "purchased"} <= set(kinds):
        found |= {("funnel", "purchased"): F.count_if(F.col("purchased") > F.col("clicked")), ("funnel", "clicked"): F.count_if(F.col("clicked") > F.col("impressed"))}
    return _rows(df, table, found)


def _names(table: str) -> list[str]:
    return [x.split()[0] for x in SCHEMAS[table].split(", ")]


def _absent(df: DataFrame, table: str) -> DataFrame:
    gone = [c for c in _names(table) if c not in df.columns and c not in OPTIONAL.get(table, [])]
    return df.sparkSession.createDataFrame([(table, "column", c, 1, []) for c in gone], VIOLATION)


def _repeated(df: DataFrame, table: str, keys: list[str]) -> DataFrame:
    """Rows beyond the first of a key; copies of one key meet as counts."""
    n = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").agg(F.sum(F.col("n") - 1).alias("n"))
    return n.where("n > 0").select(F.lit(table).alias("table"), F.lit("unique").alias("contract"), F.lit(",".join(keys)).alias("column"), "n", F.array().cast("array<string>").alias("examples"))


def _orphans(df: DataFrame, table: str, key: str, other: DataFrame, other_key: str) -> DataFrame:
    """Rows whose key the other table lacks, and the first such keys in their order."""
    lost = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).join(other.select(F.col(other_key).alias(key)), key, "left_anti")
    first = lost.orderBy(key).limit(NAMED).agg(F.transform(F.array_sort(F.collect_list(key)), lambda x: x.cast("string")).alias("examples"), F.lit(1).alias("one"))
    n = lost.agg(F.sum("n").alias("n"), F.lit(1).alias("one")).where("n > 0")
    return n.join(first, "one").select(F.lit(table).alias("table"), F.lit("key").alias("contract"), F.lit(key).alias("column"), "n", "examples")


def _early(log: DataFrame, products: DataFrame) -> DataFrame:
    """Rows of the log that name a product before its launch."""
    launches = products.groupBy("product_id").agg(F.max("launch_block").alias("launch_block"))
    met = log.select("product_id", "time_block").join(launches, "product_id").where("launch_block > time_block").agg(F.count("*").alias("n")).where("n > 0")
    return met.select(F.lit("interactions").alias("table"), F.lit("available").alias("contract"), F.lit("product_id").alias("column"), "n", F.array().cast("array<string>").alias("examples"))


def violations(bundle: Bundle) -> DataFrame:
    """table, contract, column, n, examples: every contract that is broken, with how many rows break it (1 for an absent column or
    an empty table) and, for keys, the first that are missing. A whole bundle gives no rows. Contracts whose columns are
    absent are not looked at."""
    tables = bundle.tables()
    parts = []
    for t, df in tables.items():
        has = set(df.columns)
        parts += [_absent(df, t), _columns(df, t), *[_repeated(df, t, k) for k in UNIQUE.get(t, []) if set(k) <= has]]
    parts += [_orphans(tables[t], t, k, tables[o], ok) for t, k, o, ok in KEYS if k in tables[t].columns and ok in tables[o].columns]
    if {"product_id", "time_block"} <= set(bundle.interactions.columns) and {"product_id", "launch_block"} <= set(bundle.products.columns):
        parts.append(_early(bundle.interactions, bundle.products))
    return reduce(DataFrame.unionByName, parts)


def validated(bundle: Bundle) -> Bundle:
    """The bundle if it breaks no contract; an error that names all that it breaks if it does."""
    # A row for each contract at most.
    if broken := violations(bundle).orderBy("table", "contract", "column").collect():
        raise ValueError("; ".join(f"{r.table}.{r.column or '*'}: {r.contract} ({r.n}{': ' + ', '.join(r.examples) if r.examples else ''})" for r in broken))
    return bundle


def read(spark: SparkSession, folder: str, kind: str = "parquet") -> Bundle:
    """The four tables of a folder, as `<name>.parquet` or `<name>.csv`. All that are missing are named in one error. CSV is read
    by its header: declared columns take their types, others stay text; cells that don't parse become null."""
    found, gone = {}, []
    for t, schema in SCHEMAS.items():
        path = f"{folder}/{t}.{kind}"
        try:
            raw = spark.read.option("header", True).csv(path) if kind == "csv" else spark.read.parquet(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            gone.append(path)
            continue
        types = dict(x.split() for x in schema.split(", "))
        found[t] = raw.select(*[F.expr(f"try_cast(`{c}` as {types[c]})").alias(c) if c in types else F.col(f"`{c}`") for c in raw.columns])
    if gone:
        raise FileNotFoundError(f"missing tables: {', '.join(gone)}")
    return Bundle(**found)


def load(spark: SparkSession, folder: str, kind: str = "parquet") -> Bundle:
    """`read`, refused as a whole if any table is missing or any contract is broken."""
    return validated(read(spark, folder, kind))


def write(bundle: Bundle, folder: str, kind: str = "parquet") -> None:
    """All four tables; each is put in place by the commit of its own job."""
    for t, df in bundle.tables().items():
        out = df.write.mode("overwrite")
        out.option("header", True).csv(f"{folder}/{t}.csv") if kind == "csv" else out.parquet(f"{folder}/{t}.parquet")
