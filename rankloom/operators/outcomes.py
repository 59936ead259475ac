"""Off-policy estimates with a fitted, cross-fitted outcome model: each fold's rewards are predicted, for every action, by a model
of the other folds. Folds are as even in each action as can be."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.operators.heads import Candidate, fit, predicted
from rankloom.operators.sampling import folds as stratified
from rankloom.sources.folders import stored

FOREST = Candidate("forest", "forest", {"numTrees": 20, "maxDepth": 6, "minInstancesPerNode": 5, "featureSubsetStrategy": "all"})


def cross_fitted(log: DataFrame, policy: DataFrame, numbers: list[str], names: list[str], model: Candidate = FOREST, key: str = "obs_id", folds: int = 5, seed: int = 7) -> DataFrame:
    """key, fold, mu (the predicted reward of the logged action), dm (of all actions, weighed by `policy`: action, pi), and w, the
    clipped-from-below weight candidate_propensity / logging_propensity, for each row of `log` (key, action, reward, both propensities,
    and the context's `numbers` and `names`). Rows without a reward or an action are left out; actions of the policy that
    the other folds never saw are predicted like any unknown category. A row is repeated once for each action of the
    policy, never for contexts, and nothing but the folds' numbers comes to the driver."""
    rows = log.where("reward is not null and action is not null").withColumn("_y", F.col("reward").cast("double"))
    rows = rows.withColumns({c: F.col(c).cast("double") for c in numbers} | {c: F.coalesce(F.col(c).cast("string"), F.lit("none")) for c in names})
    rows = stored(stratified(rows, key, "action", folds, seed), "outcome-folds")
    out = None
    for f in sorted(r.fold for r in rows.select("fold").distinct().collect()):
        taught, own = rows.where(F.col("fold") != f), rows.where(F.col("fold") == f)
        # Actions are few.
        every = own.withColumnRenamed("action", "_logged").crossJoin(F.broadcast(policy.select("action", "pi")))
        if taught.isEmpty():
            told = every.withColumn("_prediction", F.lit(0.0))
        else:
            told = predicted(fit(taught, numbers, [*names, "action"], model, False, seed), every, False)
        logged = F.max(F.when(F.col("action") == F.col("_logged"), F.col("_prediction")))
        part = told.groupBy(key, "fold").agg(F.coalesce(logged, F.lit(0.0)).alias("mu"), F.sum(F.col("pi") * F.col("_prediction")).alias("dm"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = rows.select(key, "fold", F.lit(0.0).alias("mu"), F.lit(0.0).alias("dm"))
    w = F.col("candidate_propensity") / F.greatest(F.col("logging_propensity"), F.lit(1e-8))
    return out.join(rows.select(key, "_y", w.alias("w")), key).withColumnRenamed("_y", "reward")


def estimates(fitted: DataFrame) -> DataFrame:
    """One row: the direct and the doubly robust estimate, and the standard error of the latter."""
    each = F.col("dm") + F.col("w") * (F.col("reward") - F.col("mu"))
    return fitted.agg(F.avg("dm").alias("direct"), F.avg(each).alias("doubly_robust"), (F.stddev_samp(each) / F.sqrt(F.count("*"))).alias("standard_error"))
