"""Bounded promotion of products without history: eligibility, boost, budget, re-ranking, and placements at a rank."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Gate:
    semantic: float = 0.18
    confidence: float = 0.8
    compatibility: float = 0.32
    risk: float = 0.6
    min_support: int = 2
    top_k: int = 10
    window: int = 5
    budget: int = 1
    boundary: bool = True


def ranked(score: str, keys: list[str]) -> Column:
    """Position by score, ties to the smaller product_id; NaN counts as no score and comes last."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(F.nanvl(score, F.lit(None).cast("double")).desc_nulls_last(), F.asc("product_id")))


def promote(rows: DataFrame, gate: Gate, max_boosts: list[float], keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Every row once for each value of `max_boosts`, with base_rank, boost, action, reason, final_score and final_rank.
    All values are one job: the value is part of each window's keys. Null and NaN inputs fail their test."""
    safe = lambda c: F.nanvl(c, F.lit(None).cast("double"))
    test = lambda c: F.coalesce(c, F.lit(False))
    cold = test(F.col("zero_history") == 1)
    tests = {
        "semantic_threshold": test(safe("dense_score") >= gate.semantic), "irrelevant_risk": test(safe("p_irrelevant") <= gate.risk),
        "compatibility": test(safe("compatibility") >= gate.compatibility), "insufficient_support": test(F.col("support") >= gate.min_support),
        "low_confidence": test(safe("confidence") >= gate.confidence),
    }
    eligible = cold
    for t in tests.values():
        eligible = eligible & t
    # The base rank is the same for all values: it is found before rows are repeated.
    out = rows.withColumns({"_cold": cold, "_eligible": eligible, "base_rank": ranked("base_score", list(keys))})
    out = out.withColumn("max_boost", F.explode(F.array(*[F.lit(float(b)) for b in sorted(set(max_boosts))])))
    each = [*keys, "max_boost"]
    worth = F.col("confidence") * F.greatest(0.75 * F.col("ctr_lower") + 0.25 * F.col("purchase_lower"), F.lit(0.0))
    inside = F.col("base_rank") <= gate.top_k + gate.window
    if gate.boundary:
        inside = inside & (F.col("base_rank") > gate.top_k)
    out = out.withColumns({"_boost": F.when(F.col("_eligible"), F.coalesce(F.least(worth, "max_boost"), F.lit(0.0))).otherwise(0.0), "_inside": inside})
    out = out.withColumns({"_candidate": F.col("_eligible") & F.col("_inside") & (F.col("_boost") > 0), "_priority": F.round(F.col("_boost") + 1e-3 * F.coalesce("target_utility", F.lit(0.0)) + 1e-6 * F.col("confidence"), 12)})
    turn = F.row_number().over(Window.partitionBy(*each).orderBy(F.desc("_candidate"), F.desc("_priority"), F.asc("product_id")))
    out = out.withColumn("_chosen", F.col("_candidate") & (turn <= gate.budget))
    if gate.boundary:
        out = out.withColumn("_try", F.col("base_score") + F.when(F.col("_chosen"), F.col("_boost")).otherwise(0.0))
        out = out.withColumn("_refused", F.col("_chosen") & (ranked("_try", each) > gate.top_k)).drop("_try")
    else:
        out = out.withColumn("_refused", F.lit(False))
    out = out.withColumn("_chosen", F.col("_chosen") & ~F.col("_refused"))
    blocked = F.col("_cold") & ~(tests["compatibility"] & tests["irrelevant_risk"] & tests["semantic_threshold"])
    outside, spent = F.col("_eligible") & ~F.col("_inside"), F.col("_candidate") & ~F.col("_chosen")
    action = F.when(F.col("_chosen"), "BOOST").when(blocked, "BLOCK").when(F.col("_cold") & (F.col("support") > 0) & (~F.col("_eligible") | spent | outside), "SHRINK")
    action = action.when(F.col("_cold") & (F.coalesce("support", F.lit(0)) == 0), "FALLBACK").otherwise("NATIVE")
    reason = F.when(F.col("_chosen"), "eligible_reliable_transfer").when(F.col("_refused"), "no_top_k_entry")
    for name, t in tests.items():
        reason = reason.when(F.col("_cold") & ~t, name)
    reason = reason.when(outside, "outside_promotion_window").when(spent, "promotion_budget").when(F.col("_cold") & (F.coalesce("support", F.lit(0)) == 0), "no_substitute_support").otherwise("native_history")
    out = out.withColumns({"boost": F.when(F.col("_chosen"), F.col("_boost")).otherwise(0.0), "action": action, "reason": reason})
    out = out.withColumn("final_score", F.col("base_score") + F.col("boost")).withColumn("final_rank", ranked("final_score", each))
    return out.drop(*[c for c in out.columns if c in {"_cold", "_eligible", "_boost", "_inside", "_candidate", "_priority", "_chosen", "_refused"}])


def placements(rows: DataFrame, candidates: DataFrame, targets: list[int], keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """keys, product_id, target, base_rank, achieved, feasible, required_lift: each candidate put just above the row that
    holds the target rank. Taking a row out and putting it back higher moves only those between, so the rank it gets
    follows from the ranks there are, and nothing is sorted again; a target that the list doesn't reach, or that lies
    below the row, can't be met."""
    size = Window.partitionBy(*keys)
    at = rows.withColumns({"base_rank": ranked("base_score", list(keys)), "_n": F.count("*").over(size)})
    for t in targets:
        at = at.withColumn(f"_s{t}", F.max(F.when(F.col("base_rank") == t, F.col("base_score"))).over(size))
    held = at.join(candidates.select(*keys, "product_id").distinct(), [*keys, "product_id"], "left_semi")
    per = F.array(*[F.struct(F.lit(t).alias("target"), F.col(f"_s{t}").alias("edge")) for t in targets])
    out = held.select(*keys, "product_id", "base_rank", "base_score", "_n", F.inline(per))
    fits = (F.col("target") <= F.col("_n")) & (F.col("target") <= F.col("base_rank"))
    return out.select(
        *keys, "product_id", "target", "base_rank", F.when(fits, F.col("target")).otherwise(F.col("base_rank")).alias("achieved"), fits.alias("feasible"),
        F.when(fits, F.greatest(F.col("edge") - F.col("base_score"), F.lit(0.0))).alias("required_lift"))


def best_proposals(rows: DataFrame) -> DataFrame:
    """One cold, unboosted row of each query: the greatest confidence, then compatibility, then utility, then the better
    base rank, then the smaller id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("confidence"), F.desc("compatibility"), F.desc("target_utility"), F.asc("base_rank"), F.asc("product_id"))
    return rows.where("zero_history = 1").withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def order_agreement(rows: DataFrame, stored: str, score: str) -> DataFrame:
    """strategy, queries, agreeing: in how many queries a way of ordering gives the stored ranks exactly."""
    s, i = F.col(score), F.col("product_id")
    ways = {
        "score_desc_id_asc": [s.desc(), i.asc()], "score_desc_id_desc": [s.desc(), i.desc()], "score_asc_id_asc": [s.asc(), i.asc()], "id_asc": [i.asc()],
        "id_text_asc": [i.cast("string").asc()], "rounded_desc_id_asc": [F.round(s, 3).desc(), i.asc()], "score_desc_id_text": [s.desc(), i.cast("string").asc()],
    }
    by = Window.partitionBy("query_id")
    out = rows.select("query_id", *[(F.row_number().over(by.orderBy(*o)) == F.col(stored)).alias(k) for k, o in ways.items()])
    per = out.groupBy("query_id").agg(*[F.every(k).alias(k) for k in ways])
    once = per.agg(F.count("*").alias("queries"), *[F.count_if(k).alias(k) for k in ways])
    return once.select(F.inline(F.array(*[F.struct(F.lit(k).alias("strategy"), F.col("queries"), F.col(k).alias("agreeing")) for k in ways])))


def rank_diagnosis(rows: DataFrame, rank: str, score: str, at: tuple[int, ...] = (1, 2, 3, 5, 10), keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Per list what its stored ranks are worth: n, duplicates (rows beyond the first of a rank or a product), gaps (ranks from 1 to
    the greatest that no row has), permutation (each of 1 to n once), monotone (no score is above the one before it by rank; a
    missing or NaN score breaks it), the scores at the ranks in `at` (null where the list is shorter) and top_gap, the first
    less the second. Rows without a rank count in n and break the permutation."""
    value = F.nanvl(F.col(score).cast("double"), F.lit(None).cast("double"))
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(F.asc_nulls_last(rank), "product_id"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.asc_nulls_last(rank), "product_id"))
    own = rows.select(*keys, "product_id", F.col(rank).alias("_r"), value.alias("_v"), F.when(place > 1, F.coalesce(value <= before, F.lit(False))).otherwise(value.isNotNull()).alias("_falls"))
    n, distinct = F.count("*"), F.count_distinct("_r")
    scores = [F.max(F.when(F.col("_r") == r, F.col("_v"))) for r in at]
    out = own.groupBy(*keys).agg(
        n.alias("n"), (F.count("_r") - distinct).alias("duplicate_ranks"), (n - F.count_distinct("product_id")).alias("duplicate_products"), F.greatest(F.coalesce(F.max("_r"), F.lit(0)) - F.count_distinct(F.when(F.col("_r") >= 1, F.col("_r"))), F.lit(0)).alias("gaps"),
        F.coalesce((distinct == n) & (F.min("_r") == 1) & (F.max("_r") == n), F.lit(False)).alias("permutation"), F.every("_falls").alias("monotone"), *[s.alias(f"score_at_{r}") for r, s in zip(at, scores, strict=True)])
    return out.withColumn("top_gap", F.col(f"score_at_{at[0]}") - F.col(f"score_at_{at[1]}"))
