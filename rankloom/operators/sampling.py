"""Positions in a whole order, and what rests on them: hold-outs, folds, evenly spaced rows, resampled means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.sources.folders import stored


def digest(*parts: Column) -> Column:
    """The first 32 bits of the md5 of the parts joined by ':'."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary")), 1, 8), 16, 10).cast("long")


def positions(df: DataFrame, first: Column, then: list[Column], keys: list[str] | None = None, parts: int = 64) -> DataFrame:
    """`df` with position (from 0) and size, by `first` and then `then`, in each group of `keys` (or the whole table).
    No task sorts a whole group: quantiles of `first` cut each into ranges, and a position is the rows of the ranges
    before plus the row number in its own. Equal values of `first` share a range. Nulls of `first` come first."""
    keys = keys or []
    rows = df.withColumn("_f", first)
    cuts = [i / parts for i in range(1, parts)]
    # Ranges are read twice, and the sketch may come out otherwise each time: one run settles them.
    edges = stored(rows.groupBy(*keys).agg(F.percentile_approx("_f", cuts, 1000).alias("_cuts")), "cuts")
    rows = rows.join(F.broadcast(edges) if not keys else edges, keys) if keys else rows.join(F.broadcast(edges))
    part = F.when(F.col("_f").isNull(), -1).otherwise(F.size(F.filter("_cuts", lambda c: c < F.col("_f"))))
    rows = rows.withColumn("_part", part).drop("_cuts")
    each = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    # As many rows as ranges, for each group.
    sizes = rows.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    sizes = sizes.select(*keys, "_part", F.coalesce(F.sum("_n").over(each.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(each).alias("size"))
    rows = rows.join(sizes, [*keys, "_part"])
    inside = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(F.asc_nulls_first("_f"), *then))
    return rows.withColumn("position", F.col("_before") + inside - 1).drop("_f", "_part", "_before")


def hold_out(df: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """`df` (one row a key) with held_out: a seeded share of the keys, one at least."""
    placed = positions(df, digest(F.lit(seed), F.col(key)), [F.col(key)])
    return placed.withColumn("held_out", F.col("position") < F.greatest(F.lit(1), F.round(share * F.col("size")))).drop("position", "size")


def capped(df: DataFrame, key: str, most: int, seed: int) -> DataFrame:
    """A seeded sample of `most` rows, for fitting on a bounded number of rows."""
    return positions(df, digest(F.lit(seed), F.col(key)), [F.col(key)]).where(F.col("position") < most).drop("position", "size")


def folds(df: DataFrame, key: str, label: str, k: int, seed: int) -> DataFrame:
    """`df` with fold, from 0 to k - 1, as even as can be in each label."""
    placed = positions(df, digest(F.lit(seed), F.col(key)), [F.col(key)], [label])
    return placed.withColumn("fold", F.col("position") % k).drop("position", "size")


def spaced(df: DataFrame, first: Column, then: list[Column], k: int) -> DataFrame:
    """k rows at even steps of the order, both ends included; all rows where there are no more than k."""
    placed = positions(df, first, then)
    i = F.round(F.col("position") * (k - 1) / F.greatest(F.col("size") - 1, F.lit(1)))
    hit = F.rint(i * (F.col("size") - 1) / max(k - 1, 1)) == F.col("position")
    return placed.where((F.col("size") <= k) | hit).drop("size")


def resampled(rows: DataFrame, value: str, key: list[str], group: list[str], strata: list[str], draws: int) -> DataFrame:
    """Per group: blocks, mean of the strata's means, its 2.5 and 97.5 % under resampling inside the strata, the shares of
    draws above and below zero, and a verdict. In each draw the i-th row of a stratum stands for a row whose number
    is a digest of draw and i, so reruns agree."""
    cell = [*group, *strata]
    own = Window.partitionBy(*cell)
    held = rows.select(*cell, F.col(value).alias("v"), (F.row_number().over(own.orderBy(*key)) - 1).alias("i"), F.count("*").over(own).alias("size"))
    drawn = held.select(*cell, "size", "i", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    drawn = drawn.select(*cell, "draw", (digest(F.col("draw"), *[F.col(c) for c in cell], F.col("i")) % F.col("size")).alias("i"))
    means = drawn.join(held.select(*cell, "i", "v"), [*cell, "i"]).groupBy(*cell, "draw").agg(F.avg("v").alias("m"))
    per = means.groupBy(*group, "draw").agg(F.avg("m").alias("m"))
    ends = per.groupBy(*group).agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"), F.avg((F.col("m") > 0).cast("double")).alias("above"), F.avg((F.col("m") < 0).cast("double")).alias("below"))
    plain = held.groupBy(*cell).agg(F.avg("v").alias("m"), F.count("*").alias("n")).groupBy(*group).agg(F.sum("n").alias("blocks"), F.avg("m").alias("mean"))
    verdict = F.when(F.col("low") > 0, "positive").when(F.col("high") < 0, "negative").otherwise("uncertain")
    return plain.join(ends, group).withColumn("verdict", verdict)
