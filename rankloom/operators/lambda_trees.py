"""A ranker of boosted trees on NDCG@k, learned from graded rows of queries.

Each round takes every query's k best rows by score now. A pair of rows moves NDCG@k only if one of the two is among these, so
the gradients of all pairs are sums over each row's pairs with the k best: the row's own side is an array fold, the other
side a grouped sum. Work grows with rows times k, whatever a query's size, and no task gets a whole query. A regression
tree is fitted to the gradients on binned features and its leaves take one Newton step.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.operators.learned import clean
from rankloom.sources.folders import stored

TOP, RATE, RIDGE = 32, 0.1, 1.0


@dataclass
class LambdaTrees:
    features: list[str]
    trees: list[DecisionTreeRegressionModel]
    leaves: list[list[float]]

    def transform(self, df: DataFrame, name: str = "rank_score") -> DataFrame:
        """`df` with the summed leaves of all trees; nulls and NaN among the features count as 0."""
        # The features as they are counted stand under names of their own: `df` keeps its columns.
        own = [f"_f{i}" for i in range(len(self.features))]
        out = clean(df.withColumns({o: F.col(c) for o, c in zip(own, self.features, strict=True)}), own)
        out = VectorAssembler(inputCols=own, outputCol="_x").transform(out).withColumn(name, F.lit(0.0))
        for tree, leaf in zip(self.trees, self.leaves, strict=True):
            out = tree.transform(out).withColumn(name, F.col(name) + leaf_value(leaf)).drop("_leaf", "_step")
        return out.drop("_x", *own)

    def save(self, folder: str) -> None:
        """Each tree by Spark's own writer, and the features and leaves as a table beside them."""
        spark = SparkSession.getActiveSession()
        for i, tree in enumerate(self.trees):
            tree.write().overwrite().save(f"{folder}/tree-{i:04d}")
        spark.createDataFrame([(json.dumps({"features": self.features, "leaves": self.leaves}),)], "model string").coalesce(1).write.mode("overwrite").json(f"{folder}/leaves")

    @staticmethod
    def load(spark: SparkSession, folder: str) -> LambdaTrees:
        kept = json.loads(spark.read.schema("model string").json(f"{folder}/leaves").first().model)
        return LambdaTrees(kept["features"], [DecisionTreeRegressionModel.load(f"{folder}/tree-{i:04d}") for i in range(len(kept["leaves"]))], kept["leaves"])


def leaf_value(leaves: list[float]) -> Column:
    return F.element_at(F.array(*[F.lit(float(x)) for x in leaves]), F.col("_leaf").cast("int") + 1)


def discount(rank: Column) -> Column:
    return 1 / F.log2(rank + 1)


def pair(gain: Column, score: Column, rank: Column, t: Column, ideal: Column) -> tuple[Column, Column]:
    """Gradient and curvature that the row gets from its pair with `t` (gain, score, rank); t's gradient is the opposite, its
    curvature the same. `rank` is null beyond the k best, where a place is worth nothing."""
    up = F.signum(gain - t["gain"])
    worth = F.abs(gain - t["gain"]) * F.abs(F.coalesce(discount(rank), F.lit(0.0)) - discount(t["rank"])) / ideal
    wrong = 1 / (1 + F.exp(up * (score - t["score"])))
    return up * worth * wrong, worth * wrong * (1 - wrong)


def gradients(rows: DataFrame, k: int) -> DataFrame:
    """`rows` (_query, _id, _gain, _score, ...) with _g and _h, the sums over all pairs of the query that move NDCG@k."""
    order = Window.partitionBy("_query")
    best = rows.select("_query", "_id", "_gain", "_score", F.row_number().over(order.orderBy(F.desc("_score"), "_id")).alias("_rank")).where(F.col("_rank") <= k)
    most = rows.select("_query", "_gain", F.row_number().over(order.orderBy(F.desc("_gain"))).alias("_at")).where(F.col("_at") <= k)
    ideal = most.groupBy("_query").agg(F.sum(F.col("_gain") * discount(F.col("_at"))).alias("_ideal")).where("_ideal > 0")
    tops = best.groupBy("_query").agg(F.collect_list(F.struct(F.col("_id").alias("id"), F.col("_gain").alias("gain"), F.col("_score").alias("score"), F.col("_rank").alias("rank"))).alias("_tops")).join(ideal, "_query")
    met = rows.join(tops, "_query").withColumn("_rank", F.get(F.filter("_tops", lambda t: t["id"] == F.col("_id")), 0)["rank"])

    def add(acc: Column, t: Column) -> Column:
        g, h = pair(F.col("_gain"), F.col("_score"), F.col("_rank"), t, F.col("_ideal"))
        return F.struct((acc["g"] + F.coalesce(g, F.lit(0.0))).alias("g"), (acc["h"] + F.coalesce(h, F.lit(0.0))).alias("h"))

    zero = F.struct(F.lit(0.0).alias("g"), F.lit(0.0).alias("h"))
    met = met.withColumn("_sum", F.aggregate("_tops", zero, add))
    # The other side: what rows beyond the k best give to these.
    low = met.where("_rank is null").select("_query", "_gain", "_score", "_ideal", F.explode("_tops").alias("t")).where("_gain <> t.gain")
    g, h = pair(F.col("_gain"), F.col("_score"), F.lit(None).cast("int"), F.col("t"), F.col("_ideal"))
    back = low.groupBy("_query", F.col("t.id").alias("_id")).agg(F.sum(-g).alias("_back_g"), F.sum(h).alias("_back_h"))
    out = met.drop("_tops", "_rank", "_ideal").join(back, ["_query", "_id"], "left").na.fill(0.0, ["_back_g", "_back_h"])
    return out.withColumns({"_g": F.col("_sum.g") + F.col("_back_g"), "_h": F.col("_sum.h") + F.col("_back_h")}).drop("_sum", "_back_g", "_back_h")


def fit(df: DataFrame, features: list[str], label: str = "relevance", query: str = "query_id", id_: str = "product_id", rounds: int = 20, depth: int = 4, rate: float = RATE, k: int = TOP, seed: int = 7) -> LambdaTrees:
    """Trees learned from graded rows: a row without a label counts for nothing, rows of a query are told apart by `id_`, and a
    query whose rows all have the lowest grade teaches nothing. Without any pair of unequal grades there are no trees."""
    rows = clean(df, features).where(F.col(label).isNotNull())
    rows = rows.select(F.col(query).alias("_query"), F.col(id_).alias("_id"), (F.pow(F.lit(2.0), F.col(label)) - 1).alias("_gain"), *features)
    rows = stored(VectorAssembler(inputCols=features, outputCol="_x").transform(rows).select("_query", "_id", "_gain", "_x", F.lit(0.0).alias("_score")), "graded-rows")
    model = LambdaTrees(list(features), [], [])
    for i in range(rounds):
        step = stored(gradients(rows, k), "gradients")
        # A target of gradient over curvature, weighed by curvature, is the Newton step's own least squares.
        taught = step.where("_h > 0").select("_x", (F.col("_g") / F.col("_h")).alias("_target"), F.col("_h").alias("_weight"))
        if taught.isEmpty():
            break
        tree = DecisionTreeRegressor(featuresCol="_x", labelCol="_target", weightCol="_weight", predictionCol="_step", leafCol="_leaf", maxDepth=depth, seed=seed + i).fit(taught)
        placed = tree.transform(step)
        sums = {int(r["_leaf"]): r.v for r in placed.groupBy("_leaf").agg((rate * F.sum("_g") / (F.sum("_h") + RIDGE)).alias("v")).collect()}
        leaves = [sums.get(j, 0.0) for j in range(max(2**depth, max(sums) + 1))]
        model.trees.append(tree)
        model.leaves.append(leaves)
        rows = stored(placed.withColumn("_score", F.col("_score") + leaf_value(leaves)).select("_query", "_id", "_gain", "_x", "_score"), "graded-rows")
    return model
