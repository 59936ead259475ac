"""Profiles of columns, completeness of panels, and columns that must not be among features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.operators.quantiles import quantiles


def _rows(df: DataFrame, per: dict[str, dict[str, Column]]) -> DataFrame:
    """One row for each column named, out of one pass of aggregates."""
    aggs = {f"_{i}_{k}": v for i, cols in enumerate(per.values()) for k, v in cols.items()}
    once = df.agg(*[v.alias(k) for k, v in aggs.items()])
    structs = [F.struct(F.lit(name).alias("column"), *[F.col(f"_{i}_{k}").alias(k) for k in cols]) for i, (name, cols) in enumerate(per.items())]
    return once.select(F.inline(F.array(*structs)))


def numeric(df: DataFrame, columns: list[str], exact: bool = True) -> DataFrame:
    """column, n, missing (null or NaN), finite, distinct, constant, least, p01, median, p99, greatest. `exact=False` takes
    sketches for the distinct counts and percentiles, for tables where exact ones cost a shuffle of their values; exact
    ones come from counts of all columns' values at once, and no task holds a column."""
    def value(c: str) -> Column:
        return F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))

    def one(c: str) -> dict[str, Column]:
        x = value(c)
        there = F.when(F.abs(x) < float("inf"), x)
        out = {"n": F.count("*"), "missing": F.count("*") - F.count(x), "finite": F.count(there), "constant": F.coalesce(F.min(x) == F.max(x), F.lit(True)), "least": F.min(there), "greatest": F.max(there)}
        p = lambda q: F.percentile_approx(there, q, 10000)
        return out if exact else out | {"distinct": F.approx_count_distinct(x), "p01": p(0.01), "median": p(0.5), "p99": p(0.99)}

    names = ["column", "n", "missing", "finite", "distinct", "constant", "least", "p01", "median", "p99", "greatest"]
    rows = _rows(df, {c: one(c) for c in columns})
    if not exact:
        return rows.select(*names)
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), value(c).alias("x")) for c in columns]))).where("x is not null")
    distinct = long.groupBy("column", "x").agg(F.lit(1)).groupBy("column").agg(F.count("*").alias("distinct"))
    found = quantiles(long.where(F.abs("x") < float("inf")), F.col("x"), {"p01": 0.01, "median": 0.5, "p99": 0.99}, ["column"]).drop("n")
    return rows.join(distinct, "column", "left").join(found, "column", "left").na.fill(0, ["distinct"]).select(*names)


def categorical(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n, missing, distinct, mode, mode_count; ties go to the first value. Values are counted before they meet."""
    melted = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*")
    counts = melted.groupBy("column", "value").agg(F.count("*").alias("n"))
    best = F.max_by(F.struct("value", "n"), F.when(F.col("value").isNotNull(), F.col("n")))
    top = counts.groupBy("column").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("missing"), F.count("value").alias("distinct"), best["n"].alias("mode_count"))
    mode = counts.where("value is not null").join(top.select("column", F.col("mode_count").alias("n")), ["column", "n"]).groupBy("column").agg(F.min("value").alias("mode"))
    return top.join(mode, "column", "left").select("column", "n", "missing", "distinct", "mode", "mode_count")


def inventory(df: DataFrame) -> DataFrame:
    """column, dtype, coverage, distinct, constant for all columns but nested ones."""
    kinds = {c: t for c, t in df.dtypes if not t.startswith(("array", "map", "struct"))}
    out = _rows(df, {c: {"coverage": F.count(c) / F.nullif(F.count("*"), F.lit(0)), "distinct": F.count_distinct(c)} for c in kinds})
    dtype = F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("column"))
    return out.select("column", dtype.alias("dtype"), "coverage", "distinct", (F.col("distinct") <= 1).alias("constant"))


def completeness(panel: DataFrame, context: list[str], expected: dict[str, int]) -> DataFrame:
    """Contexts with their distinct values of each named column, and whether all are as many as expected."""
    out = panel.groupBy(*context).agg(F.count("*").alias("n"), *[F.count_distinct(c).alias(f"n_{c}") for c in expected])
    complete = F.lit(True)
    for c, k in expected.items():
        complete = complete & (F.col(f"n_{c}") == k)
    return out.withColumn("complete", complete)


def forbidden(columns: list[str], exact: set[str], prefixes: tuple[str, ...], parts: tuple[str, ...]) -> list[tuple[str, str]]:
    """(column, rule) for names that tell of the outcome; a matter of the schema alone."""
    found = [(c, "exact") for c in columns if c in exact]
    found += [(c, "prefix") for c in columns if c not in exact and c.startswith(prefixes)]
    return found + [(c, "part") for c in columns if c not in exact and not c.startswith(prefixes) and any(p in c for p in parts)]
