"""Models fitted with pyspark.ml: relations of (query, product), behaviour with a calibrated probability and a challenger; and
a ranker learned from all pairs (see `pairs`). Features are plain double columns; nulls and NaN count as 0."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators import gates, metrics, pairs, retrieval
from rankloom.operators.contracts import last_of
from rankloom.sources.folders import stored

CLIP = 1e-6
#: Of the linear ranker: weight of the squares, Newton steps at most, and the fall of the loss that is no step any more.
RIDGE, STEPS, ENOUGH = 1e-4, 50, 1e-12


def clean(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing features: {missing}")
    return df.withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in columns})


def balanced(df: DataFrame, label: str) -> DataFrame:
    """`df` with weight: rows / (classes * rows of the class)."""
    by = df.groupBy(label).agg(F.count("*").alias("_n"))
    whole = by.agg(F.sum("_n").alias("_all"), F.count("*").alias("_classes"))
    # A row for each class.
    return df.join(F.broadcast(by.join(whole)), label).withColumn("weight", F.col("_all") / (F.col("_classes") * F.col("_n"))).drop("_n", "_all", "_classes")


def _logistic(columns: list[str], label: str, family: str, reg: float) -> Pipeline:
    return Pipeline(stages=[
        VectorAssembler(inputCols=columns, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True),
        LogisticRegression(featuresCol="_scaled", labelCol=label, weightCol="weight", family=family, regParam=reg, standardization=False, maxIter=50, probabilityCol="_p", rawPredictionCol="_r", predictionCol="_c")])


def fit_logistic(df: DataFrame, columns: list[str], label: str, family: str = "binomial", reg: float = 1e-3) -> PipelineModel:
    """Class-balanced logistic regression on scaled features."""
    rows = balanced(clean(df, columns).withColumn(label, F.col(label).cast("double")), label)
    return _logistic(columns, label, family, reg).fit(rows)


def probabilities(model: PipelineModel, df: DataFrame, columns: list[str], names: list[str]) -> DataFrame:
    """`df` with a column for each class; classes that the model never saw are 0."""
    out = model.transform(clean(df, columns)).withColumn("_a", vector_to_array("_p"))
    out = out.withColumns({n: F.coalesce(F.try_element_at("_a", F.lit(i + 1)), F.lit(0.0)) for i, n in enumerate(names)})
    return out.drop("_raw", "_scaled", "_r", "_p", "_c", "_a")


def relation_report(rows: DataFrame, label: str = "relevance") -> DataFrame:
    """One row: accuracy, log-loss, and Brier score and calibration error of 'eligible' (exact or substitute: 3 or 2)
    for rows with p_irrelevant, p_complement, p_substitute, p_exact."""
    ps = [F.col(f"p_{k}") for k in ("irrelevant", "complement", "substitute", "exact")]
    own = F.element_at(F.array(*ps), F.col(label).cast("int") + 1)
    best = F.array_position(F.array(*ps), F.greatest(*ps)) - 1
    p, y = F.least(ps[2] + ps[3], F.lit(1.0)), (F.col(label) >= 2).cast("double")
    rows = rows.select((best == F.col(label)).cast("double").alias("hit"), F.greatest(own, F.lit(CLIP)).alias("own"), p.alias("p"), y.alias("y"))
    by = rows.groupBy(F.least(F.floor(F.col("p") * 10), F.lit(9)).alias("bin")).agg(
        F.count("*").alias("n"), F.sum("hit").alias("hits"), F.sum(-F.log("own")).alias("loss"), F.sum(F.pow(F.col("p") - F.col("y"), 2)).alias("sq"), F.abs(F.avg("y") - F.avg("p")).alias("gap"))
    total = F.sum("n")
    return by.agg(total.alias("n"), (F.sum("hits") / total).alias("accuracy"), (F.sum("loss") / total).alias("log_loss"), (F.sum("sq") / total).alias("brier"), (F.sum(F.col("n") * F.col("gap")) / total).alias("ece"))


def _logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(CLIP)), F.lit(1 - CLIP))
    return F.log(q / (1 - q))


def calibrated(df: DataFrame, later: DataFrame, score: str, label: str, name: str = "p") -> DataFrame:
    """`df` with `name`: the score's logit put through a logistic fit on `later`, a block of rows after those the model
    learned from. With one class there the score stands."""
    fit_on = later.select(_logit(F.col(score)).alias("_logit"), F.col(label).cast("double").alias("_y"))
    rows = df.withColumn("_logit", _logit(F.col(score)))
    if fit_on.agg(F.count_distinct("_y")).first()[0] < 2:
        return rows.withColumn(name, F.col(score)).drop("_logit")
    stages = [VectorAssembler(inputCols=["_logit"], outputCol="_v"), LogisticRegression(featuresCol="_v", labelCol="_y", regParam=1e-6, standardization=False, probabilityCol="_p", rawPredictionCol="_r", predictionCol="_c")]
    model = Pipeline(stages=stages).fit(fit_on)
    p = F.least(F.greatest(F.element_at(vector_to_array("_p"), 2), F.lit(CLIP)), F.lit(1 - CLIP))
    return model.transform(rows).withColumn(name, p).drop("_logit", "_v", "_r", "_p", "_c")


def fit_challenger(df: DataFrame, columns: list[str], label: str, rounds: int = 10, depth: int = 4) -> PipelineModel:
    """Boosted trees on the same features and weights as the logistic model."""
    rows = balanced(clean(df, columns).withColumn(label, F.col(label).cast("double")), label)
    trees = GBTClassifier(featuresCol="_raw", labelCol=label, weightCol="weight", maxIter=rounds, maxDepth=depth, seed=7, predictionCol="_c").setProbabilityCol("_p").setRawPredictionCol("_r")
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="_raw"), trees]).fit(rows)


def fit_pairwise(df: DataFrame, columns: list[str], label: str = "relevance", query: str = "query_id") -> list[float]:
    """Weights of a linear ranker: a logistic model, on their differences, of all pairs of a query's judged rows that have unequal
    gain; a pair counts by its gap in gain. Pairs grow with the squares of a query's rows and are summed in blocks, so
    that they take time and no room. Without two rows of unequal gain all weights are 0."""
    rows = clean(df, columns).where(F.col(label).isNotNull()).select(F.col(query).alias("_query"), (F.pow(F.lit(2.0), F.col(label)) - 1).alias("_gain"), F.array(*columns).alias("_x"))
    return pairs.fitted(stored(rows, "pair-rows"), len(columns), RIDGE, STEPS, ENOUGH)


def linear(columns: list[str], weights: list[float]) -> Column:
    return sum((w * F.col(c) for c, w in zip(columns, weights)), F.lit(0.0))


@dataclass
class Calibrated:
    """A behaviour model and its calibration, each a fitted pipeline. `platt` is None where the later block had one class."""

    columns: list[str]
    model: PipelineModel
    platt: PipelineModel | None

    def transform(self, df: DataFrame, name: str = "p", raw: str = "p_raw") -> DataFrame:
        """`df` with the calibrated chance and the model's own, both within CLIP of 0 and 1."""
        rows = probabilities(self.model, df, self.columns, ["_no", raw]).drop("_no").withColumn("_logit", _logit(F.col(raw)))
        within = lambda c: F.least(F.greatest(c, F.lit(CLIP)), F.lit(1 - CLIP))
        if self.platt is None:
            return rows.withColumns({name: within(F.col(raw)), raw: within(F.col(raw))}).drop("_logit")
        out = self.platt.transform(rows).withColumn(name, within(F.element_at(vector_to_array("_p"), 2)))
        return out.withColumn(raw, within(F.col(raw))).drop("_logit", "_v", "_r", "_p", "_c")

    def save(self, folder: str) -> None:
        """Both by Spark's own writers; the columns beside them say whether there is a calibration."""
        spark = SparkSession.getActiveSession()
        self.model.write().overwrite().save(f"{folder}/model")
        if self.platt is not None:
            self.platt.write().overwrite().save(f"{folder}/platt")
        spark.createDataFrame([(self.columns, self.platt is not None)], "columns array<string>, calibrated boolean").coalesce(1).write.mode("overwrite").json(f"{folder}/contract")

    @staticmethod
    def load(spark: SparkSession, folder: str) -> Calibrated:
        kept = spark.read.schema("columns array<string>, calibrated boolean").json(f"{folder}/contract").first()
        return Calibrated(list(kept.columns), PipelineModel.load(f"{folder}/model"), PipelineModel.load(f"{folder}/platt") if kept.calibrated else None)


def fit_calibrated(train: DataFrame, later: DataFrame, columns: list[str], label: str) -> Calibrated:
    """A class-balanced logistic model of `train`, calibrated on the later block. One class in `train` is an error."""
    if train.agg(F.count_distinct(label)).first()[0] < 2:
        raise ValueError("the training rows must have both outcomes")
    model = fit_logistic(train, columns, label)
    scored = probabilities(model, later, columns, ["_no", "_raw_p"]).select(_logit(F.col("_raw_p")).alias("_logit"), F.col(label).cast("double").alias("_y"))
    if scored.agg(F.count_distinct("_y")).first()[0] < 2:
        return Calibrated(list(columns), model, None)
    stages = [VectorAssembler(inputCols=["_logit"], outputCol="_v"), LogisticRegression(featuresCol="_v", labelCol="_y", regParam=1e-6, standardization=False, probabilityCol="_p", rawPredictionCol="_r", predictionCol="_c")]
    return Calibrated(list(columns), model, Pipeline(stages=stages).fit(scored))


def future_audit(model: Calibrated, block: DataFrame, judged: DataFrame, label: str, base: str, weight: float = 0.5, k: int = 10) -> DataFrame:
    """(metric, value) of a block that the model never saw: AUC, Brier score, log-loss and calibration error of its calibrated
    and its plain chances, and NDCG@k of the logged rows by `base` and by `weight` times its percentile and the rest
    times the chance's. Of a query's rows for one product the last stands (`event_seq`)."""
    rows = stored(model.transform(block), "future-block")
    parts = []
    for name, p in (("future_behavior_", "p"), ("future_behavior_uncalibrated_", "p_raw")):
        own = rows.select(F.col(p).alias("p"), F.col(label).cast("double").alias("y"))
        scores = metrics.binary_scores(own).select(F.col("auc").alias(f"{name}roc_auc"), F.col("brier").alias(f"{name}brier"), F.col("log_loss").alias(f"{name}log_loss"))
        parts += [scores, metrics.calibration_error(own).select(F.col("ece").alias(f"{name}ece"))]
    last = last_of(rows.select("query_id", "product_id", "event_seq", base, "p"), ["query_id", "product_id"], ["event_seq"])
    both = stored(retrieval.blended(last, base, "p", weight, ["query_id"], "_final"), "future-ranked")
    for name, score in (("base", base), ("final", "_final")):
        ranked = retrieval.top(both, score, 1 << 30, ["query_id"]).select("query_id", "product_id", "rank")
        parts.append(metrics.ndcg(ranked, judged, k).agg(F.avg("ndcg").alias(f"future_logged_{name}_ndcg_at_{k}")))
    return gates.long_metrics(*parts)
