"""Daily panels of two policies: paired deltas, blocks, and contrasts of actions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["seed", "proposal_index", "action", "scenario", "replication", "day"]


def paired(daily: DataFrame) -> DataFrame:
    """A row for each key with the utility under either policy, null where it is missing."""
    of = lambda p: F.max(F.when(F.col("policy") == p, F.col("utility"))).alias(p)
    return daily.groupBy(*KEYS).agg(of("base"), of("treatment"))


def paired_delta(daily: DataFrame) -> DataFrame:
    """By action and scenario: keys, keys with both policies, and the mean delta of those."""
    both = F.col("base").isNotNull() & F.col("treatment").isNotNull()
    return paired(daily).groupBy("action", "scenario").agg(F.count("*").alias("keys"), F.count_if(both).alias("pairs"), F.avg(F.col("treatment") - F.col("base")).alias("mean_delta"))


def blocks(daily: DataFrame) -> DataFrame:
    """Deltas added over days; days without both policies don't count."""
    rows = paired(daily).where("base is not null and treatment is not null")
    return rows.groupBy(*KEYS[:-1]).agg(F.sum(F.col("treatment") - F.col("base")).alias("delta"))


def action_utility(daily: DataFrame) -> DataFrame:
    return blocks(daily).groupBy("seed", "proposal_index", "action").agg(F.count("*").alias("blocks"), F.avg("delta").alias("utility"))


def contrast(daily: DataFrame, baseline: str) -> DataFrame:
    """Each action against `baseline` on the blocks that both have."""
    every = blocks(daily)
    on = ["seed", "proposal_index", "scenario", "replication"]
    base = every.where(F.col("action") == baseline).select(*on, F.col("delta").alias("base_delta"))
    rows = every.where(F.col("action") != baseline).join(base, on).withColumn("d", F.col("delta") - F.col("base_delta"))
    return rows.groupBy("seed", "proposal_index", "action").agg(F.count("*").alias("blocks"), F.avg("d").alias("contrast"), F.percentile("d", F.lit(0.5)).alias("median"))


def scenario_summary(daily: DataFrame) -> DataFrame:
    """One row: the worst scenario's mean delta, and the 10th percentile and mean over (replication, scenario)."""
    cells = blocks(daily).groupBy("scenario", "replication").agg(F.sum("delta").alias("delta"))
    worst = cells.groupBy("scenario").agg(F.avg("delta").alias("m")).agg(F.min("m").alias("worst_scenario"), F.count("*").alias("scenarios"))
    return cells.agg(F.percentile("delta", F.lit(0.1)).alias("p10"), F.avg("delta").alias("mean")).join(worst)


def aggregation_rules(daily: DataFrame) -> DataFrame:
    """By action the mean delta of days, the mean of blocks' means, and the mean of blocks' sums."""
    rows = paired(daily).withColumn("d", F.col("treatment") - F.col("base")).where("d is not null")
    by = rows.groupBy(*KEYS[:-1]).agg(F.sum("d").alias("s"), F.count("*").alias("n"))
    return by.groupBy("action").agg((F.sum("s") / F.sum("n")).alias("daily_mean"), F.avg(F.col("s") / F.col("n")).alias("mean_of_means"), F.avg("s").alias("mean_of_sums"))


def best_action(daily: DataFrame, baseline: str) -> DataFrame:
    """Per context (seed, proposal_index) the action of the greatest utility, ties to the first by name, and its gap
    to `baseline`, null where the context lacks that."""
    rows = action_utility(daily).withColumn("utility", F.round("utility", 9))
    order = Window.partitionBy("seed", "proposal_index").orderBy(F.desc("utility"), "action")
    best = rows.withColumn("_n", F.row_number().over(order)).where("_n = 1")
    base = rows.where(F.col("action") == baseline).select("seed", "proposal_index", F.col("utility").alias("_base"))
    return best.join(base, ["seed", "proposal_index"], "left").select("seed", "proposal_index", "action", "utility", (F.col("utility") - F.col("_base")).alias("gap"))


def by_action(daily: DataFrame) -> DataFrame:
    u = action_utility(daily)
    return u.groupBy("action").agg(F.count("*").alias("n"), F.avg("utility").alias("mean"), F.percentile("utility", F.lit(0.5)).alias("median"), F.count_if(F.col("utility") > 0).alias("better"))


def block_contrasts(daily: DataFrame, baseline: str) -> DataFrame:
    """`d` of each block: an action's delta less the baseline's on the same block."""
    every = blocks(daily)
    on = ["seed", "proposal_index", "scenario", "replication"]
    base = every.where(F.col("action") == baseline).select(*on, F.col("delta").alias("base_delta"))
    return every.where(F.col("action") != baseline).join(base, on).withColumn("d", F.col("delta") - F.col("base_delta"))


def feasibility(daily: DataFrame) -> DataFrame:
    """Labels of (context, action) counted by action, by seed, and in all, in one scan: contexts, those of benefit and
    those without harm, the mean utility. Nulls in action or seed mean all of them."""
    rows = action_utility(daily).select("action", "seed", F.round("utility", 9).alias("utility"))
    rows = rows.groupingSets([[F.col("action")], [F.col("seed")], []], F.col("action"), F.col("seed"))
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("utility") > 0).alias("benefit"), F.count_if(F.col("utility") >= 0).alias("no_harm"), F.avg("utility").alias("mean"))


def regret(daily: DataFrame) -> DataFrame:
    """By seed: the policy that takes, in each context, the action of the greatest mean utility over other seeds (the mean
    of all where it has none there), against the best action of the context: contexts, hits, mean utility and regret."""
    rows = action_utility(daily).withColumn("utility", F.round("utility", 9))
    own = rows.groupBy("action", "seed").agg(F.sum("utility").alias("s"), F.count("*").alias("n"))
    every = own.groupBy("action").agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    whole = every.agg((F.sum("ts") / F.sum("tn")).alias("overall"))
    guess = own.join(F.broadcast(every), "action").join(F.broadcast(whole)).select("action", "seed", F.round(F.coalesce((F.col("ts") - F.col("s")) / F.nullif(F.col("tn") - F.col("n"), F.lit(0)), F.col("overall")), 9).alias("predicted"))
    ctx = Window.partitionBy("seed", "proposal_index")
    both = rows.join(guess, ["action", "seed"]).withColumns({"_p": F.row_number().over(ctx.orderBy(F.desc("predicted"), "action")), "_best": F.max("utility").over(ctx)})
    chosen = both.where("_p = 1").withColumn("_lost", F.col("_best") - F.col("utility"))
    return chosen.groupBy("seed").agg(F.count("*").alias("contexts"), F.count_if(F.col("_lost") == 0).alias("hits"), F.avg("utility").alias("utility"), F.avg("_lost").alias("regret"))


def reconciled(candidates: DataFrame, published: DataFrame, keys: list[str], value: str, tolerance: float = 1e-8) -> DataFrame:
    """metric, matched, missing, mean_error, max_error, exact, correlation: how well each numeric column of `candidates`,
    as it is or negated, gives the published value."""
    names = [c for c, t in candidates.dtypes if c not in keys and t in ("double", "float", "bigint", "int") or t.startswith("decimal")]
    forms = F.array(*[F.struct(F.lit(p + c).alias("metric"), (s * F.col(c).cast("double")).alias("x")) for c in names for p, s in (("", 1), ("-", -1))])
    long = candidates.select(*keys, F.inline(forms))
    both = published.select(*keys, F.col(value).cast("double").alias("_v")).join(long, keys)
    gap = F.abs(F.col("x") - F.col("_v"))
    total = published.agg(F.count("*").alias("_all"))
    out = both.groupBy("metric").agg(F.count("x").alias("matched"), F.avg(gap).alias("mean_error"), F.max(gap).alias("max_error"), F.corr("x", "_v").alias("correlation")).join(F.broadcast(total))
    return out.select("metric", "matched", (F.col("_all") - F.col("matched")).alias("missing"), "mean_error", "max_error", F.coalesce((F.col("max_error") <= tolerance) & (F.col("matched") == F.col("_all")), F.lit(False)).alias("exact"), "correlation")


def counter_utility(rows: DataFrame) -> DataFrame:
    """Counters of each (replication, policy) and their utility (discoveries - 0.2 irrelevant - 2 false warm-ups), as means
    over the replications of a policy."""
    per = rows.groupBy("replication", "policy").agg(*[F.sum(c).alias(c) for c in ("discovery", "irrelevant", "false_warm_up")])
    per = per.withColumn("utility", F.col("discovery") - 0.2 * F.col("irrelevant") - 2 * F.col("false_warm_up"))
    return per.groupBy("policy").agg(F.count("*").alias("replications"), *[F.avg(c).alias(c) for c in ("discovery", "irrelevant", "false_warm_up", "utility")])


def safety_contrast(effects: DataFrame, baseline: str, measures: dict[str, int], tolerance: float = 1e-8) -> DataFrame:
    """Per context and alternative action: the delta of each measure against the baseline action, and `safe` - no measure is
    worse by more than the tolerance. `measures` maps a column to 1 (more is better) or -1."""
    keys = [c for c in effects.columns if c not in measures and c != "action"]
    base = effects.where(F.col("action") == baseline).select(*keys, *[F.col(m).alias(f"_{m}") for m in measures])
    both = effects.where(F.col("action") != baseline).join(base, keys)
    deltas = {m: F.col(m) - F.col(f"_{m}") for m in measures}
    safe = F.lit(True)
    for m, sign in measures.items():
        safe = safe & (sign * deltas[m] >= -tolerance)
    return both.select(*keys, "action", *[d.alias(f"delta_{m}") for m, d in deltas.items()], safe.alias("safe"))


def summary_deltas(summaries: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """keys, and for each measure treatment less base, from `summaries` (keys, policy, measures): one row of keys that have both
    policies once. Keys that lack one, or have it more than once, fail the job: a delta of other rows would mean nothing."""
    one = lambda p: F.count_if(F.col("policy") == p)
    of = lambda p, m: F.max(F.when(F.col("policy") == p, F.col(m)))
    by = summaries.groupBy(*keys).agg(one("base").alias("_b"), one("treatment").alias("_t"), *[(of("treatment", m) - of("base", m)).alias(f"delta_{m}") for m in measures])
    named = F.concat_ws(":", *[F.col(k).cast("string") for k in keys])
    whole = F.when((F.col("_b") == 1) & (F.col("_t") == 1), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("not one row of each policy: "), named)).cast("boolean"))
    return by.where(whole).drop("_b", "_t")
