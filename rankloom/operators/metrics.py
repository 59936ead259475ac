"""Ranking, exposure, calibration and off-policy metrics as aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.operators.quantiles import quantiles
from rankloom.sources.folders import stored


#: Ranges of values that are ranked apart.
RANGES = 64


def dcg(relevance: Column, rank: Column, k: int) -> Column:
    return F.sum(F.when(rank <= k, (F.pow(F.lit(2.0), relevance) - 1) / F.log2(rank + 1)))


def ndcg(ranked: DataFrame, judged: DataFrame, k: int, cohort: Column | None = None) -> DataFrame:
    """Per query NDCG@k of `ranked` (query_id, product_id, rank) by `judged` (query_id, product_id, relevance). Unjudged
    rows keep their rank and gain nothing; the ideal is made of the ranked rows that are judged; with `cohort` only
    its rows gain, at the ranks they have. Queries whose ideal is 0 have no row."""
    rows = ranked.join(judged.select("query_id", "product_id", "relevance"), ["query_id", "product_id"], "left")
    gain = F.col("relevance") if cohort is None else F.when(cohort, F.col("relevance"))
    rows = rows.withColumn("gain", gain)
    ideal = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("gain"), "product_id")
    rows = rows.withColumn("ideal_rank", F.row_number().over(ideal))
    both = rows.groupBy("query_id").agg(F.coalesce(dcg(F.col("gain"), F.col("rank"), k), F.lit(0.0)).alias("dcg"), F.coalesce(dcg(F.col("gain"), F.col("ideal_rank"), k), F.lit(0.0)).alias("ideal"))
    return both.where("ideal > 0").select("query_id", (F.col("dcg") / F.col("ideal")).alias("ndcg"))


def exposure(ranked: DataFrame, judged: DataFrame, k: int) -> DataFrame:
    """Over the top k of each query: judged share, unjudged share, and share of irrelevant and substitute rows among
    the judged (queries without a judged row don't count for these), each a mean over queries."""
    top = ranked.where(F.col("rank") <= k).join(judged.select("query_id", "product_id", "relevance", "relation"), ["query_id", "product_id"], "left")
    seen = F.col("relevance").isNotNull()
    by = top.groupBy("query_id").agg(
        F.avg(seen.cast("double")).alias("coverage"),
        F.avg(F.when(seen, (F.col("relevance") == 0).cast("double"))).alias("irrelevant"),
        F.avg(F.when(seen, (F.col("relation") == "substitute").cast("double"))).alias("substitute"))
    return by.agg(F.avg("coverage").alias("coverage"), F.avg(1 - F.col("coverage")).alias("unjudged"), F.avg("irrelevant").alias("irrelevant"), F.avg("substitute").alias("substitute"))


def calibration_error(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Expected calibration error of p against y over equal bins; the last one is closed, values outside don't count."""
    inside = rows.where("p >= 0 and p <= 1").withColumn("bin", F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)))
    by = inside.groupBy("bin").agg(F.count("*").alias("n"), F.abs(F.avg("y") - F.avg("p")).alias("gap"))
    return by.agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"))


def binary_scores(rows: DataFrame) -> DataFrame:
    """ROC-AUC (mean ranks; null with one class), Brier score and log-loss of p against y."""
    # Ranks come from counts by value, summed inside ranges of values that quantiles cut, and over the few ranges before.
    by = rows.groupBy("p").agg(F.count("*").alias("n"), F.sum("y").alias("pos"))
    # Ranges are read twice, and the sketch may come out otherwise each time: one run settles them.
    cuts = stored(by.agg(F.percentile_approx("p", [i / RANGES for i in range(1, RANGES)], 1000).alias("cuts")), "cuts")
    by = by.join(F.broadcast(cuts)).withColumn("range", F.size(F.filter("cuts", lambda c: c < F.col("p")))).drop("cuts")
    ranges = by.groupBy("range").agg(F.sum("n").alias("n"))
    below = Window.partitionBy(F.lit(1)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    by = by.join(ranges.select("range", F.coalesce(F.sum("n").over(below), F.lit(0)).alias("below")), "range")
    inside = Window.partitionBy("range").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    upto = F.col("below") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    ranked = by.select("n", "pos", (upto + (F.col("n") + 1) / 2).alias("rank"))
    auc = ranked.agg(F.sum(F.col("pos") * F.col("rank")).alias("r"), F.sum("pos").alias("a"), F.sum(F.col("n") - F.col("pos")).alias("b"))
    auc = auc.select(((F.col("r") - F.col("a") * (F.col("a") + 1) / 2) / F.nullif(F.col("a") * F.col("b"), F.lit(0))).alias("auc"), F.lit(1).alias("one"))
    q = F.least(F.greatest(F.col("p"), F.lit(1e-6)), F.lit(1 - 1e-6))
    loss = rows.agg(F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"), F.avg(-(F.col("y") * F.log(q) + (1 - F.col("y")) * F.log(1 - q))).alias("log_loss"), F.lit(1).alias("one"))
    return auc.join(loss, "one").drop("one")


def off_policy(log: DataFrame, clip: float = 20.0) -> DataFrame:
    """IPS, self-normalised and clipped IPS, effective sample size and the weights' shape, in one pass."""
    w = F.col("candidate_propensity") / F.greatest(F.col("logging_propensity"), F.lit(1e-8))
    rows = log.select(w.alias("w"), "reward", "logging_propensity")
    wr = F.col("w") * F.col("reward")
    return rows.agg(
        F.avg(wr).alias("ips"), (F.sum(wr) / F.sum("w")).alias("snips"), F.avg(F.least(F.col("w"), F.lit(clip)) * F.col("reward")).alias("clipped_ips"),
        (F.pow(F.sum("w"), F.lit(2)) / F.sum(F.col("w") * F.col("w"))).alias("ess"), F.max("w").alias("max_weight"), F.avg("w").alias("mean_weight"),
        F.avg((F.col("w") > clip).cast("double")).alias("clipped_rate"), F.avg((F.col("logging_propensity") > 1e-4).cast("double")).alias("support"))


def doubly_robust(log: DataFrame, folds: int = 5) -> DataFrame:
    """Direct and doubly robust estimates with out-of-fold mean rewards by (context, action); a cell without rows
    outside the fold takes the mean outside the fold. Actions are weighed by their candidate propensity."""
    fold = F.pmod(F.conv(F.substring(F.md5(F.col("obs_id").cast("string").cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(folds))
    w = F.col("candidate_propensity") / F.greatest(F.col("logging_propensity"), F.lit(1e-8))
    gain = F.col("w") * F.col("reward")
    rows = log.select("context", "action", fold.alias("fold"), "reward", "candidate_propensity", w.alias("w"))
    # Cells are a few, and their sums are all that is needed: the log is read once, and none of its rows meets a model.
    cells = stored(rows.groupBy("context", "action", "fold").agg(
        F.sum("reward").alias("r"), F.count("*").alias("n"), F.max("candidate_propensity").alias("pi"),
        F.count(gain).alias("gn"), F.sum(F.when(gain.isNotNull(), F.col("w"))).alias("gw"), F.sum(gain).alias("gain")), "cells")
    whole = cells.groupBy("context", "action").agg(F.sum("r").alias("tr"), F.sum("n").alias("tn"))
    all_folds = cells.groupBy("fold").agg(F.sum("r").alias("fr"), F.sum("n").alias("fn"))
    every = all_folds.agg(F.sum("fr").alias("er"), F.sum("fn").alias("en")).withColumn("one", F.lit(1))
    all_folds = all_folds.withColumn("one", F.lit(1)).join(every, "one")
    actions = cells.groupBy("action").agg(F.max("pi").alias("pi"))
    contexts = whole.select("context").distinct()
    # Contexts, actions and folds are a few each: the grid is their product, not the log's.
    grid = contexts.withColumn("one", F.lit(1)).join(actions.withColumn("one", F.lit(1)), "one").join(all_folds, "one").drop("one")
    mu = grid.join(whole, ["context", "action"], "left").join(cells.drop("pi"), ["context", "action", "fold"], "left").na.fill(0, ["tr", "tn", "r", "n"])
    own = (F.col("tr") - F.col("r")) / F.nullif(F.col("tn") - F.col("n"), F.lit(0))
    mu = mu.select("context", "action", "fold", "pi", F.coalesce(own, (F.col("er") - F.col("fr")) / F.nullif(F.col("en") - F.col("fn"), F.lit(0)), F.lit(0.0)).alias("mu"))
    direct = mu.groupBy("context", "fold").agg(F.sum(F.col("pi") * F.col("mu")).alias("dm"))
    full = cells.join(mu.select("context", "action", "fold", "mu"), ["context", "action", "fold"]).join(direct, ["context", "fold"]).where("dm is not null")
    residual = F.sum(F.when(F.col("gn") > 0, F.col("gn") * F.col("dm") + F.col("gain") - F.col("mu") * F.col("gw")))
    return full.agg((F.sum(F.col("n") * F.col("dm")) / F.nullif(F.sum("n"), F.lit(0))).alias("direct"), (residual / F.nullif(F.sum("gn"), F.lit(0))).alias("doubly_robust"))


def softmax(rows: DataFrame, score: str, keys: list[str], name: str = "share") -> DataFrame:
    """exp(score) over its sum in each group, shifted by the group's greatest score."""
    group = Window.partitionBy(*keys)
    e = F.exp(F.col(score) - F.max(score).over(group))
    return rows.withColumn("_e", e).withColumn(name, F.col("_e") / F.sum("_e").over(group)).drop("_e")


def poisson_steps(most: int = 12) -> list[int]:
    """A Poisson(1) draw is the number of these that a draw from 0 to 2**32 - 1 reaches."""
    out, term, total = [], math.exp(-1), 0.0
    for k in range(most):
        total += term
        out.append(math.floor(total * 2**32))
        term /= k + 1
    return out


def bootstrap_mean(rows: DataFrame, value: str, key: str, draws: int = 100) -> DataFrame:
    """mean, low and high (2.5 and 97.5 %) of a mean under Poisson resampling. A row's weight in a draw follows from
    its key, so reruns agree; draws are summed where the rows are read, and one row for each draw is shuffled."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.col("draw").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    weight = sum((F.when(F.col("u") >= s, 1).otherwise(0) for s in poisson_steps()), F.lit(0))
    spread = rows.where(F.col(value).isNotNull()).select(key, value, F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw")).withColumn("u", u).withColumn("w", weight)
    means = spread.groupBy("draw").agg((F.sum(F.col("w") * F.col(value)) / F.nullif(F.sum("w"), F.lit(0))).alias("m"))
    ends = means.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
    return rows.agg(F.avg(value).alias("mean")).join(ends)


def result_contract(ranked: DataFrame, score: str) -> DataFrame:
    """Per query: rows, distinct products, ranks that are missing, and rows scored above the row before them."""
    w = Window.partitionBy("query_id").orderBy("rank")
    rows = ranked.withColumn("rises", (F.col(score) > F.lag(score).over(w)) | F.isnan(score))
    return rows.groupBy("query_id").agg(F.count("*").alias("n"), F.count_distinct("product_id").alias("products"), (F.max("rank") - F.count_distinct("rank")).alias("gaps"), F.count_if("rises").alias("rises"))


def value_report(rows: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """n, mean and the 50th, 95th and 99th percentile by group; exact, without a group in one task. Groups without a value have
    n 0 and nulls."""
    plain = rows.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    found = quantiles(rows, F.col(value), {"p50": 0.5, "p95": 0.95, "p99": 0.99}, keys).drop("n")
    named = found.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return plain.join(named, on, "left").drop(*[f"_{k}" for k in keys])


def serving_report(log: DataFrame, latency: str = "latency_ms", source: str = "source", at: str = "ts") -> DataFrame:
    """One row of a log of answered queries: queries, mean, p50, p95 and p99 of the latency, how many and which share came from
    another source than the first (`full`), and queries a second between the first and the last (null for one moment)."""
    one = lambda df: df.withColumn("_one", F.lit(1))
    fell = F.count_if(F.coalesce(F.col(source) != "full", F.lit(True)))
    span = F.unix_micros(F.max(at).cast("timestamp")) - F.unix_micros(F.min(at).cast("timestamp"))
    plain = log.agg(F.count("*").alias("queries"), F.avg(latency).alias("mean"), fell.alias("fallbacks"), (fell / F.nullif(F.count("*"), F.lit(0))).alias("fallback_rate"), (F.count("*") * 1e6 / F.nullif(span, F.lit(0))).alias("per_second"))
    found = quantiles(log, F.col(latency), {"p50": 0.5, "p95": 0.95, "p99": 0.99}).drop("n")
    return one(plain).join(one(found), "_one", "left").drop("_one")


def cold_exposure(ranked: DataFrame, judged: DataFrame, k: int) -> DataFrame:
    """Per query: n (rows of the top k) and hits (those without history that are judged relevant, 2 or more), as counts."""
    top = ranked.where(F.col("rank") <= k).join(judged.select("query_id", "product_id", "relevance"), ["query_id", "product_id"], "left")
    return top.groupBy("query_id").agg(F.count("*").alias("n"), F.count_if((F.col("zero_history") == 1) & (F.col("relevance") >= 2)).alias("hits"))


def paired_report(before: DataFrame, after: DataFrame, judged: DataFrame, k: int, cold: str) -> DataFrame:
    """One row over the queries that both rankings answer: queries, mean NDCG@k before and after and its mean delta, the
    same over the cold rows alone, and of both top k the irrelevant, the judged and the cold relevant rows as counts.
    `before` and `after` have query_id, product_id, rank, zero_history and the boolean column `cold`."""
    name = lambda df, n: df.withColumnRenamed("ndcg", n)
    whole = name(ndcg(before, judged, k), "base").join(name(ndcg(after, judged, k), "final"), "query_id")
    part = name(ndcg(before, judged, k, F.col(cold)), "base").join(name(ndcg(after, judged, k, F.col(cold)), "final"), "query_id")
    means = lambda df, p: df.agg(F.count("*").alias(f"{p}queries"), F.avg("base").alias(f"{p}base_ndcg"), F.avg("final").alias(f"{p}final_ndcg"), F.avg(F.col("final") - F.col("base")).alias(f"{p}delta")).withColumn("one", F.lit(1))
    out = means(whole, "").join(means(part, "cold_"), "one")
    for p, ranked in (("base_", before), ("final_", after)):
        top = ranked.where(F.col("rank") <= k).join(judged.select("query_id", "product_id", "relevance"), ["query_id", "product_id"], "left")
        shown = top.agg(
            F.count("*").alias(f"{p}shown"), F.count_if(F.expr("relevance is not null")).alias(f"{p}judged"), F.count_if(F.expr("relevance = 0")).alias(f"{p}irrelevant"),
            F.count_if(F.expr("zero_history = 1 and relevance >= 2")).alias(f"{p}cold_relevant"))
        out = out.join(shown.withColumn("one", F.lit(1)), "one")
    return out.drop("one")


def regression_scores(rows: DataFrame) -> DataFrame:
    """MAE, RMSE, Brier score and what they gain on always predicting the mean (null where that is perfect)."""
    mean = rows.agg(F.avg("y").alias("m")).withColumn("one", F.lit(1))
    # One row, from an aggregate without keys.
    both = rows.withColumn("one", F.lit(1)).join(F.broadcast(mean), "one")
    mae, plain = F.avg(F.abs(F.col("p") - F.col("y"))), F.avg(F.abs(F.col("m") - F.col("y")))
    brier, flat = F.avg(F.pow(F.col("p") - F.col("y"), 2)), F.avg(F.pow(F.col("m") - F.col("y"), 2))
    return both.agg(mae.alias("mae"), F.sqrt(brier).alias("rmse"), brier.alias("brier"), (1 - brier / F.nullif(flat, F.lit(0.0))).alias("brier_skill"), (1 - mae / F.nullif(plain, F.lit(0.0))).alias("mae_improvement"))


def estimate_errors(estimates: DataFrame, truth: DataFrame) -> DataFrame:
    """Estimates (estimator, value, low, high) against the one row of `truth` (truth): error, its size, and whether the
    interval holds the true value."""
    both = estimates.withColumn("one", F.lit(1)).join(F.broadcast(truth.select("truth", F.lit(1).alias("one"))), "one")
    return both.select("estimator", "value", "truth", (F.col("value") - F.col("truth")).alias("error"), F.abs(F.col("value") - F.col("truth")).alias("absolute_error"), F.col("truth").between(F.col("low"), F.col("high")).alias("covered"))


def click_chance(relevance: Column, quality: Column, rank: Column, cold: Column, novelty: float, base: float = -2.2, gain: float = 0.9, worth: float = 0.8) -> Column:
    """Expected click of a shown row: a logistic of relevance, quality, the place's attention and novelty."""
    x = base + gain * relevance + worth * quality + F.log(1 / F.log2(rank + 1.5)) + novelty * cold
    return 1 / (1 + F.exp(-x))
