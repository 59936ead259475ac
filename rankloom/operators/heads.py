"""Action-conditioned models under nested validation: a regressor of an action's utility, classifiers of what may go wrong,
and the policy that takes each context's most promising action.

Folds are a column given to whole groups (seeds), so no group ever lies on both sides of a fit; each outer fold is predicted by
a model chosen by inner folds of the others. Beside every prediction stands the training groups' mean of the same action,
for all folds out of one pass: a total less the fold's own.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.operators.sampling import digest, positions
from rankloom.sources.folders import stored

CLIP = 1e-6


@dataclass(frozen=True)
class Candidate:
    """A model to choose from: `ridge` or `forest` for numbers, `logistic` or `forest` for chances, with its settings."""

    name: str
    family: str
    settings: dict = field(default_factory=dict, hash=False)


UTILITY = [Candidate("ridge_0.1", "ridge", {"regParam": 0.1}), Candidate("ridge_1", "ridge", {"regParam": 1.0}), Candidate("forest_5", "forest", {"numTrees": 20, "minInstancesPerNode": 5})]
RISK = [Candidate("logistic_0.01", "logistic", {"regParam": 0.01}), Candidate("logistic_0.1", "logistic", {"regParam": 0.1}), Candidate("forest_5", "forest", {"numTrees": 20, "minInstancesPerNode": 5})]


def grouped_folds(df: DataFrame, group: str, k: int, seed: int, name: str = "fold") -> DataFrame:
    """`df` with a fold from 0 to k - 1 for each group, as even in groups as can be. Rows without a group have none."""
    groups = df.select(group).where(F.col(group).isNotNull()).distinct()
    placed = positions(groups, digest(F.lit(seed), F.col(group)), [F.col(group)])
    return df.join(placed.select(group, (F.col("position") % k).cast("int").alias(name)), group, "left")


def prepared(numbers: list[str], names: list[str]) -> list:
    """Medians for missing numbers, scaled; one column for each category, and for one never seen."""
    stages = [Imputer(strategy="median", inputCols=numbers, outputCols=[f"_m_{c}" for c in numbers])] if numbers else []
    if names:
        stages += [StringIndexer(inputCols=names, outputCols=[f"_i_{c}" for c in names], handleInvalid="keep"), OneHotEncoder(inputCols=[f"_i_{c}" for c in names], outputCols=[f"_o_{c}" for c in names])]
    if numbers:
        stages += [VectorAssembler(inputCols=[f"_m_{c}" for c in numbers], outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True)]
    return [*stages, VectorAssembler(inputCols=[*(["_scaled"] if numbers else []), *[f"_o_{c}" for c in names]], outputCol="_x")]


def estimator(candidate: Candidate, chance: bool, seed: int):
    if candidate.family == "forest":
        kind = RandomForestClassifier if chance else RandomForestRegressor
        model = kind(featuresCol="_x", labelCol="_y", predictionCol="_p", seed=seed, **candidate.settings)
    elif chance and candidate.family == "logistic":
        model = LogisticRegression(featuresCol="_x", labelCol="_y", predictionCol="_p", standardization=False, **candidate.settings)
    elif not chance and candidate.family == "ridge":
        model = LinearRegression(featuresCol="_x", labelCol="_y", predictionCol="_p", standardization=False, **candidate.settings)
    else:
        raise ValueError(f"no such model: {candidate.family}")
    return model.setProbabilityCol("_chances").setRawPredictionCol("_raw_p") if chance else model


def fit(train: DataFrame, numbers: list[str], names: list[str], candidate: Candidate, chance: bool, seed: int) -> PipelineModel | float:
    """A fitted pipeline; for chances with one outcome only that outcome's clipped rate."""
    if chance:
        ends = train.agg(F.avg("_y")).first()[0] or 0.0
        if ends in (0.0, 1.0):
            return min(max(ends, CLIP), 1 - CLIP)
    return Pipeline(stages=[*prepared(numbers, names), estimator(candidate, chance, seed)]).fit(train)


def predicted(model: PipelineModel | float, rows: DataFrame, chance: bool) -> DataFrame:
    """`rows` with _prediction."""
    if isinstance(model, float):
        return rows.withColumn("_prediction", F.lit(model))
    out = model.transform(rows)
    value = F.least(F.greatest(F.element_at(vector_to_array("_chances"), 2), F.lit(CLIP)), F.lit(1 - CLIP)) if chance else F.col("_p")
    return out.select(*rows.columns, value.alias("_prediction"))


def chosen_rows(rows: DataFrame, context: list[str], prediction: str, place: str) -> DataFrame:
    """The row of each context with the greatest prediction, ties to the smaller `place` (NaN and nulls last)."""
    value = F.nanvl(F.col(prediction), F.lit(None).cast("double"))
    order = Window.partitionBy(*context).orderBy(F.desc_nulls_last(value), F.asc_nulls_last(place))
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def policy_value(rows: DataFrame, context: list[str], target: str, prediction: str, place: str) -> DataFrame:
    """Per context, with the chosen action's `place`: its utility, `best` (that of the best action), regret, and whether they are one."""
    best = chosen_rows(rows, context, target, place).select(*context, F.col(target).alias("best"), F.col(place).alias("_place"))
    own = chosen_rows(rows, context, prediction, place).join(best, context)
    return own.select(*context, place, F.col(target).alias("utility"), "best", (F.col("best") - F.col(target)).alias("regret"), (F.col(place) == F.col("_place")).cast("int").alias("hit"))


def worth(rows: DataFrame, chance: bool, context: list[str], place: str) -> tuple:
    """What a candidate is chosen by, smaller is better: for chances the log-loss, for numbers the mean over inner folds of
    the chosen actions' utility (negated), their regret, and the absolute error of all rows."""
    if chance:
        p = F.col("_prediction")
        per = rows.groupBy("_inner").agg(F.avg(-(F.col("_y") * F.log(p) + (1 - F.col("_y")) * F.log(1 - p))).alias("loss"))
        return tuple(per.agg(F.avg("loss")).first())
    value = policy_value(rows, [*context, "_inner"], "_y", "_prediction", place).groupBy("_inner").agg(F.avg("utility").alias("u"), F.avg("regret").alias("r"))
    error = rows.groupBy("_inner").agg(F.avg(F.abs(F.col("_prediction") - F.col("_y"))).alias("e"))
    return tuple(round(x, 12) for x in value.join(error, "_inner").agg(-F.avg("u"), F.avg("r"), F.avg("e")).first())


def nested(rows: DataFrame, group: str, context: list[str], action: str, place: str, target: Column, numbers: list[str], names: list[str], candidates: list[Candidate], chance: bool = False, outer: int = 3, inner: int = 2, seed: int = 7) -> DataFrame:
    """`rows` with fold, candidate (chosen without the fold), prediction, and baseline (the action's mean in the other folds, or
    of all actions there if it has none). `context` names a decision (with its group), `place` orders its actions. Rows
    without a target or a group have no prediction and are left out; so is a fold whose others have no rows."""
    forbidden = [c for c in (*numbers, *names) if c in (group, *context)]
    if forbidden:
        raise ValueError(f"not known before the action: {forbidden}")
    own = grouped_folds(rows.withColumn("_y", target.cast("double")).where("_y is not null and not isnan(_y)"), group, outer, seed).where("fold is not null")
    own = stored(own.withColumns({c: F.col(c).cast("double") for c in numbers} | {c: F.coalesce(F.col(c).cast("string"), F.lit("none")) for c in names}), "outer-folds")
    parts = None
    for f in sorted(r.fold for r in own.select("fold").distinct().collect()):
        train = stored(grouped_folds(own.where(F.col("fold") != f), group, inner, seed + 1, "_inner"), "inner-folds")
        if train.isEmpty():
            continue
        scores = {}
        for c in candidates if len(candidates) > 1 else []:
            tried = None
            for i in sorted(r["_inner"] for r in train.select("_inner").distinct().collect()):
                taught = train.where(F.col("_inner") != i)
                if taught.isEmpty():
                    continue
                part = predicted(fit(taught, numbers, names, c, chance, seed), train.where(F.col("_inner") == i), chance)
                tried = part if tried is None else tried.unionByName(part)
            if tried is not None:
                scores[c.name] = worth(stored(tried, "inner-predictions"), chance, context, place)
        best = min(candidates, key=lambda c: (scores.get(c.name, ()), c.name))
        part = predicted(fit(train, numbers, names, best, chance, seed), own.where(F.col("fold") == f), chance).withColumn("candidate", F.lit(best.name))
        parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        parts = own.where("false").withColumns({"_prediction": F.lit(None).cast("double"), "candidate": F.lit(None).cast("string")})
    return parts.join(baseline(own, action), ["fold", action], "left").withColumnRenamed("_prediction", "prediction").drop("_y")


def baseline(rows: DataFrame, action: str) -> DataFrame:
    """fold, action, baseline: the mean of _y over the other folds' rows of the action, or over all their rows."""
    own = rows.groupBy("fold", action).agg(F.sum("_y").alias("s"), F.count("*").alias("n"))
    total = own.groupBy(action).agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    fold = own.groupBy("fold").agg(F.sum("s").alias("fs"), F.sum("n").alias("fn"))
    whole = fold.agg(F.sum("fs").alias("ws"), F.sum("fn").alias("wn")).withColumn("one", F.lit(1))
    # Folds are few, and the whole is one row.
    every = own.join(total, action).join(F.broadcast(fold), "fold").withColumn("one", F.lit(1)).join(F.broadcast(whole), "one")
    rest = F.nullif(F.col("tn") - F.col("n"), F.lit(0))
    return every.select("fold", action, F.coalesce((F.col("ts") - F.col("s")) / rest, (F.col("ws") - F.col("fs")) / F.nullif(F.col("wn") - F.col("fn"), F.lit(0))).alias("baseline"))


def group_interval(rows: DataFrame, group: str, values: list[str], draws: int = 1000) -> DataFrame:
    """measure, groups, mean, low and high (2.5 and 97.5 %) of the mean over groups, whose own values are the means of their rows.
    Groups are what is drawn: in each draw a group counts as often as a Poisson draw out of a digest of both says, so
    rows are read once, no group is split and reruns agree. Draws without any group are left out."""
    from rankloom.operators.metrics import poisson_steps

    per = rows.where(F.col(group).isNotNull()).groupBy(group).agg(*[F.avg(v).alias(v) for v in values])
    u = digest(F.col(group), F.col("draw"))
    weight = sum((F.when(F.col("_u") >= s, 1).otherwise(0) for s in poisson_steps()), F.lit(0))
    drawn = per.select("*", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw")).withColumn("_u", u).withColumn("_w", weight)
    mean = lambda v: F.sum(F.col("_w") * F.col(v)) / F.nullif(F.sum(F.when(F.col(v).isNotNull(), F.col("_w"))), F.lit(0))
    means = drawn.groupBy("draw").agg(*[mean(v).alias(v) for v in values])
    long = lambda df, name: df.select(F.inline(F.array(*[F.struct(F.lit(v).alias("measure"), F.col(v).alias(name)) for v in values])))
    ends = long(means, "m").groupBy("measure").agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
    plain = long(per, "x").groupBy("measure").agg(F.count("x").alias("groups"), F.avg("x").alias("mean"))
    return plain.join(ends, "measure").select("measure", "groups", "mean", "low", "high")
