"""Release gates: metrics against thresholds, and a status out of what failed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def long_metrics(*rows: DataFrame) -> DataFrame:
    """(metric, value) out of one-row tables of numbers."""
    out = None
    for df in rows:
        cols = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in df.columns])
        part = df.select(F.inline(cols))
        out = part if out is None else out.unionByName(part)
    return out


def release(metrics: DataFrame, gates: DataFrame) -> DataFrame:
    """Each gate (gate, metric, op '>=' or '<=', threshold, hold) with its value, whether it passed, and the status of
    all: LAUNCH without failures, HOLD if one fails that holds, else ITERATE. Missing and NaN values fail."""
    value = F.nanvl("value", F.lit(None).cast("double"))
    rows = gates.join(metrics, "metric", "left").withColumn("value", value)
    passed = F.coalesce(F.when(F.col("op") == ">=", F.col("value") >= F.col("threshold")).otherwise(F.col("value") <= F.col("threshold")), F.lit(False))
    rows = rows.withColumn("passed", passed)
    # As many rows as gates are named: one window over all of them.
    every = Window.partitionBy(F.lit(1))
    status = F.when(F.every("passed").over(every), "LAUNCH").when(F.some(~F.col("passed") & F.col("hold")).over(every), "HOLD").otherwise("ITERATE")
    return rows.select("gate", "metric", "op", "threshold", "value", "passed", status.alias("status"))


def diagnostics(before: DataFrame, after: DataFrame) -> DataFrame:
    """metric, base, final, delta, drop_rate (the share of the base that was lost; null for a base of 0), from two tables of
    (metric, value)."""
    both = before.select("metric", F.col("value").alias("base")).join(after.select("metric", F.col("value").alias("final")), "metric")
    delta = F.col("final") - F.col("base")
    return both.select("metric", "base", "final", delta.alias("delta"), (F.greatest(-delta, F.lit(0.0)) / F.nullif(F.abs("base"), F.lit(0.0))).alias("drop_rate"))


def configured(sweep: DataFrame, parameter: str, value: float, limits: dict[str, tuple[str, float]], tolerance: float = 1e-12) -> DataFrame:
    """The sweep's rows with `selected` (the parameter has the configured value) and `passed` (all limits hold: a column,
    ">=" or "<=", a number). A configured value that was not swept selects nothing."""
    passed = F.lit(True)
    for column, (op, limit) in limits.items():
        passed = passed & F.coalesce(F.col(column) >= limit if op == ">=" else F.col(column) <= limit, F.lit(False))
    return sweep.withColumn("selected", F.abs(F.col(parameter) - value) <= tolerance).withColumn("passed", passed)
