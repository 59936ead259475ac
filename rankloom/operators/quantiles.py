"""Exact quantiles of large groups: values are counted, cut into ranges by a sketch, and only counts are put in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.sources.folders import stored

RANGES = 64


def quantiles(df: DataFrame, value: Column, shares: dict[str, float], keys: list[str] | None = None, ranges: int = RANGES) -> DataFrame:
    """keys, n, and for each name in `shares` the quantile of `value` at that share, between its two neighbours in proportion. Null
    and NaN values don't count; a group without values has no row (the whole, without keys, has n 0 and nulls).

    Equal values meet as one count before the shuffle, so one that a third of all rows hold weighs no more than another; a
    sketch of each group cuts its distinct values into ranges, which are summed, and each range is put in order by itself. The
    sketch decides where the cuts are and never what comes out. No task holds a group."""
    keys = keys or []
    by = df.select(*keys, F.nanvl(value.cast("double"), F.lit(None).cast("double")).alias("_v")).where("_v is not null").groupBy(*keys, "_v").agg(F.count("*").alias("_n"))
    # A sketch of many values depends on the order in which its parts meet, and ranges are read twice: one run must settle them.
    cuts = stored(by.groupBy(*keys).agg(F.percentile_approx("_v", [i / ranges for i in range(1, ranges)], 1000).alias("_cuts"), F.sum("_n").alias("n")), "cuts")
    null_safe = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]

    def joined(a: DataFrame, b: DataFrame, *take: str) -> DataFrame:
        on = F.lit(True)
        for c in null_safe:
            on = on & c
        return a.alias("a").join(F.broadcast(b.alias("b")) if not keys else b.alias("b"), on).select("a.*", *[F.col(f"b.{t}") for t in take])

    placed = joined(by, cuts, "_cuts", "n").withColumn("_part", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))).drop("_cuts")
    sums = placed.groupBy(*keys, "_part").agg(F.sum("_n").alias("_in"))
    each = Window.partitionBy(*(keys or [F.lit(1)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # As many rows as ranges, for each group.
    before = sums.select(*keys, "_part", F.coalesce(F.sum("_in").over(each), F.lit(0)).alias("_before"))
    on = F.col("a._part") == F.col("b._part")
    for c in null_safe:
        on = on & c
    rows = placed.alias("a").join(before.alias("b"), on).select("a.*", "b._before")
    inside = Window.partitionBy(*keys, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_first", F.col("_before") + F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    out = []
    for name, q in shares.items():
        at = q * (F.col("n") - 1)
        has = lambda i: (F.col("_first") <= i) & (i < F.col("_first") + F.col("_n"))
        low, high = (F.max(F.when(has(i), F.col("_v"))) for i in (F.floor(at), F.ceil(at)))
        part = F.max(at - F.floor(at))
        out.append(F.when(part == 0, low).otherwise(low * (1 - part) + high * part).alias(name))
    return rows.groupBy(*keys).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), *out)
