"""Comparing tables: differences of two versions by key, and a fingerprint that row order doesn't change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def table_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key, change ('added', 'deleted', 'modified') for keys whose rows differ. Only digests are shuffled. Nulls
    equal nulls; the tables need the same columns; a null key meets nothing."""
    digest = lambda df, name: df.select(key, F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256).alias(name))
    both = digest(old, "_old").join(digest(new, "_new"), key, "full")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "deleted").when(F.col("_old") != F.col("_new"), "modified")
    return both.select(key, change.alias("change")).where("change is not null")


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """n and the sum of 32-bit digests of the rows, as text: equal for equal tables in any order, one pass."""
    row = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns])
    part = F.conv(F.substring(F.md5(row.cast("binary")), 1, 8), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(part), F.lit(0)).cast("decimal(38,0)").cast("string").alias("fingerprint"))
