"""Behaviour of products over time blocks; a block sees only what came before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DECAY = 0.75


def per_block(log: DataFrame) -> DataFrame:
    return log.groupBy("product_id", "time_block").agg(
        F.sum("impressed").alias("impressions"), F.sum("clicked").alias("clicks"), F.sum("purchased").alias("purchases"))


def smoothed(clicks: Column, purchases: Column, impressions: Column) -> dict[str, Column]:
    return {"smoothed_ctr": (clicks + 1) / (impressions + 5), "smoothed_purchase_rate": (purchases + 0.5) / (impressions + 8)}


def history_flags(clicks: Column, purchases: Column) -> dict[str, Column]:
    return {"zero_history": (clicks + purchases == 0).cast("int"), "sparse_history": (clicks + purchases <= 2).cast("int")}


def prior_features(log: DataFrame, products: DataFrame) -> DataFrame:
    """Each impression with its product's counts from strictly earlier blocks. One row per product and block goes
    through the window; the log meets it by an equal join."""
    before = Window.partitionBy("product_id").orderBy("time_block").rowsBetween(Window.unboundedPreceding, -1)
    state = per_block(log).select("product_id", "time_block", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"prior_{c}") for c in ("impressions", "clicks", "purchases")])
    c, p, i = (F.col(f"prior_{x}") for x in ("clicks", "purchases", "impressions"))
    out = log.join(state, ["product_id", "time_block"]).join(products.select("product_id", "launch_block"), "product_id", "left")
    age = F.greatest(F.lit(0), F.col("time_block") - F.col("launch_block"))
    return out.withColumns(smoothed(c, p, i) | {"first_observed_age": age} | history_flags(c, p))


def first_observed(log: DataFrame) -> DataFrame:
    return log.groupBy("product_id").agg(F.min("time_block").alias("first_block"))


def counts_before(log: DataFrame, cutoff: int, recent: int = 2) -> DataFrame:
    """Counts of the products that the log shows before `cutoff`, one row a product: what `standing` reads."""
    return log.where(F.col("time_block") < cutoff).groupBy("product_id").agg(
        F.sum("impressed").alias("i"), F.sum("clicked").alias("c"), F.sum("purchased").alias("p"),
        F.sum(F.when(F.col("time_block") >= cutoff - recent, F.col("clicked"))).alias("v"))


def standing(counts: DataFrame, products: DataFrame, cutoff: int, *also: str) -> DataFrame:
    """All products, with their columns `also`, as the counts say that they stand at `cutoff`; without history all counts are zero."""
    # Counts are as many as products with history, however small their file is.
    out = products.select("product_id", "launch_block", *also).join(counts.hint("merge"), "product_id", "left").na.fill(0, ["i", "c", "p", "v"])
    c, p, i = F.col("c"), F.col("p"), F.col("i")
    named = {"prior_impressions": i, "prior_clicks": c, "prior_purchases": p, "behavior_velocity": F.col("v")}
    more = smoothed(c, p, i) | {"first_observed_age": F.greatest(F.lit(0), F.lit(cutoff) - F.col("launch_block"))} | history_flags(c, p)
    return out.select("product_id", *also, *[v.alias(k) for k, v in (named | more).items()])


def snapshot(log: DataFrame, products: DataFrame, cutoff: int, recent: int = 2) -> DataFrame:
    """All products as they stand at `cutoff`; without history all counts are zero."""
    return standing(counts_before(log, cutoff, recent), products, cutoff)


def reference(log: DataFrame, products: DataFrame, blocks: int) -> DataFrame:
    """A row for each block below `blocks` and each product launched by then: counts of earlier blocks, and clicks that
    lose a quarter with each block passed, empty ones included."""
    every = products.select("product_id", "launch_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("time_block")).join(per_block(log), ["product_id", "time_block"], "left").na.fill(0, ["impressions", "clicks", "purchases"])
    before = Window.partitionBy("product_id").orderBy("time_block").rowsBetween(Window.unboundedPreceding, -1)
    # The sum of clicks * DECAY^-(block + 1), scaled back: blocks are few, so the powers stay small.
    aged = F.sum(F.col("clicks") * F.pow(F.lit(1 / DECAY), F.col("time_block") + 1)).over(before) * F.pow(F.lit(DECAY), F.col("time_block"))
    state = every.select("product_id", "time_block", "launch_block", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"prior_{c}") for c in ("impressions", "clicks", "purchases")], F.coalesce(aged, F.lit(0.0)).alias("behavior_velocity"))
    out = state.where("launch_block <= time_block")
    c, p, i = (F.col(f"prior_{x}") for x in ("clicks", "purchases", "impressions"))
    return out.withColumns(smoothed(c, p, i) | {"first_observed_age": F.greatest(F.lit(0), F.col("time_block") - F.col("launch_block"))} | history_flags(c, p)).drop("launch_block")


def event_velocity(log: DataFrame) -> DataFrame:
    """Per product and block, the decayed clicks before the block: each event keeps 3/4 of what was and adds its click. A
    block of n events turns v into v * (3/4)^n plus its own clicks, each decayed by the events after it; one row for each
    block of a product is folded in order."""
    block = Window.partitionBy("product_id", "time_block")
    later = F.count("*").over(block) - F.row_number().over(block.orderBy("query_id", "position", "event_seq"))
    own = log.select("product_id", "time_block", (F.col("clicked") * F.pow(F.lit(DECAY), later)).alias("v"))
    blocks = own.groupBy("product_id", "time_block").agg(F.sum("v").alias("v"), F.count("*").alias("n"))
    rows = blocks.groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct("time_block", "v", "n"))).alias("b"))
    step = lambda a, x: F.struct((a["v"] * F.pow(F.lit(DECAY), x["n"]) + x["v"]).alias("v"), F.concat(a["seen"], F.array(a["v"])).alias("seen"))
    start = F.struct(F.lit(0.0).alias("v"), F.array().cast("array<double>").alias("seen"))
    before = F.aggregate("b", start, step, lambda a: a["seen"])
    return rows.select("product_id", F.explode(F.arrays_zip(F.col("b.time_block").alias("time_block"), before.alias("velocity"))).alias("x")).select("product_id", "x.time_block", "x.velocity")


def category_priors(ref: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """Impression-weighted rates by block and category, over products with history; and the same for all categories,
    which falls back to all products where none has history. Without `products` the rows of `ref` have their category."""
    # A catalog whose file is small would be sent whole to all tasks.
    known = ref if products is None else ref.join(products.select("product_id", "category").hint("merge"), "product_id")
    rows = known.withColumn("w", F.greatest(F.col("prior_impressions"), F.lit(1)))
    seen = F.col("prior_impressions") > 0
    mean = lambda c, when: F.sum(F.when(when, F.col("w") * F.col(c))) / F.sum(F.when(when, F.col("w")))
    rates = {"prior_ctr": "smoothed_ctr", "prior_purchase": "smoothed_purchase_rate"}
    by_category = rows.groupBy("time_block", "category").agg(*[mean(c, seen).alias(k) for k, c in rates.items()])
    whole = rows.groupBy("time_block").agg(*[F.coalesce(mean(c, seen), mean(c, F.lit(True))).alias(f"global_{k}") for k, c in rates.items()])
    return by_category.join(whole, "time_block").select("time_block", "category", *[F.coalesce(k, f"global_{k}").alias(k) for k in rates], *[f"global_{k}" for k in rates])


def warmed_up(log: DataFrame, clicks: int = 3) -> DataFrame:
    """The event at which a product has its `clicks`-th click. Only that many rows of a product leave each task."""
    order = Window.partitionBy("product_id").orderBy("time_block", "event_seq")
    first = log.where("clicked = 1").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= clicks)
    return first.where(F.col("_n") == clicks).select("product_id", "event_seq", "time_block")
