"""User tables brought into the shape of the domain tables, plain files in, and reports out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Defaults of an item table, the gain of each label, and names of a log's time column in their order.
DEFAULTS = {"title": "unknown", "brand": "unknown", "category": "unknown", "attribute": "unknown", "model": "unknown", "color": "unknown", "price": 0.0, "quality": 0.5}
GAINS = {"E": 3, "S": 2, "C": 1, "I": 0}
TIMES = ["time_block", "relative_time", "timestamp"]


def read_table(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """Parquet or CSV (compressed or not) by the name's ending; CSV types come from `schema`, or are all text."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith((".csv", ".csv.gz")):
        return (spark.read.schema(schema) if schema else spark.read).option("header", True).csv(path)
    raise ValueError(f"no reader for {path}")


def write_table(df: DataFrame, path: str, kind: str = "parquet", by: list[str] | None = None) -> None:
    """Parquet, CSV or JSON; the job's commit puts it in place as a whole."""
    out = df.write.mode("overwrite").partitionBy(*(by or []))
    out.option("header", True).csv(path) if kind == "csv" else out.format(kind).save(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """(metric, value) as JSON; a NaN fails the job."""
    checked = metrics.withColumn("value", F.when(F.isnan("value"), F.raise_error(F.concat(F.lit("NaN in "), F.col("metric"))).cast("double")).otherwise(F.col("value")))
    checked.write.mode("overwrite").json(path)


def _require(df: DataFrame, names: list[str]) -> None:
    if missing := sorted(set(names) - set(df.columns)):
        raise ValueError(f"missing columns: {missing}")


def items(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """An item table after renaming: product_id and launch_block are required, the rest is filled. Rows whose id or
    block isn't a number, or whose block is below 0, fail the job when read."""
    df = df.withColumnsRenamed(names)
    _require(df, ["product_id", "launch_block"])
    block = F.expr("try_cast(launch_block as int)")
    block = F.when(block >= 0, block).otherwise(F.raise_error(F.lit("launch_block must be a number of 0 or more")).cast("int"))
    pid = F.coalesce(F.expr("try_cast(product_id as bigint)"), F.raise_error(F.lit("product_id must be a number")).cast("long"))
    filled = {k: F.coalesce(F.col(k).cast("double" if isinstance(v, float) else "string"), F.lit(v)) if k in df.columns else F.lit(v) for k, v in DEFAULTS.items()}
    return df.select(pid.alias("product_id"), block.alias("launch_block"), *[v.alias(k) for k, v in filled.items()])


def ranking_log(df: DataFrame, time: str | None = None) -> DataFrame:
    """user_id, query, product_id, time_block, clicked, purchased. The target's id, where there is one, goes before the
    item's; a log without a time column is refused; a purchase counts as a click."""
    if time is None:
        time = next((c for c in TIMES if c in df.columns), None)
    _require(df, ["user_id", "query", "is_clicked", "is_purchased", *([time] if time else [])])
    ids = [F.expr(f"try_cast({c} as bigint)") for c in ("target_item_id", "item_id") if c in df.columns]
    if time is None or not ids:
        raise ValueError("a log needs a time column and an item id")
    bought = F.coalesce(F.col("is_purchased").cast("int"), F.lit(0))
    clicked = F.greatest(F.coalesce(F.col("is_clicked").cast("int"), F.lit(0)), bought)
    return df.select("user_id", "query", F.coalesce(*ids).alias("product_id"), F.expr(f"try_cast(`{time}` as int)").alias("time_block"), clicked.alias("clicked"), bought.alias("purchased"))


def graded(examples: DataFrame, products: DataFrame, label: str = "label") -> tuple[DataFrame, DataFrame]:
    """Examples with relevance from 3 to 0 by their label, joined to products on (product_id, product_locale); and the
    rows refused, with the reason: an unknown label, or no such product."""
    keys = ["product_id", "product_locale"]
    gain = F.element_at(F.create_map(*[F.lit(x) for kv in GAINS.items() for x in kv]), F.col(label))
    rows = examples.withColumn("relevance", gain).join(products.withColumn("_found", F.lit(True)), keys, "left")
    reason = F.when(F.col("relevance").isNull(), "unknown_label").when(F.col("_found").isNull(), "orphan")
    rows = rows.withColumn("reason", reason).drop("_found")
    return rows.where("reason is null").drop("reason"), rows.where("reason is not null")


def recall_log(df: DataFrame) -> DataFrame:
    """A recall log with its item and time columns renamed; user_id, session_id and query are required, the rest is kept."""
    df = df.withColumnsRenamed({"item_id": "product_id", "timestamp": "time_block"})
    _require(df, ["user_id", "session_id", "query"])
    return df


def relevance_table(df: DataFrame) -> DataFrame:
    """Judgments with their item, score and brand columns renamed; query, title and relevance are required."""
    df = df.withColumnsRenamed({"item_id": "product_id", "score": "relevance", "brand_name": "brand"})
    _require(df, ["query", "title", "relevance"])
    return df
