"""Counters kept by a stream over a folder of event files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, TimestampNTZType


def daily_counters(spark: SparkSession, files: str, schema: StructType, folder: str, late: str = "30 days") -> DataFrame:
    """day, event_type, n and the sum of values, counted by a stream that reads each new file once (availableNow).
    Rows later than `late` behind the greatest `ts` are dropped. Each micro-batch writes the counters it changed to a
    folder of its own, so a repeated batch overwrites itself; the last version of each counter is returned. Rows
    without a `ts` belong to no day. Days are those of UTC, and times without a zone are taken for UTC."""
    ts = F.to_timestamp(F.concat(F.col("ts").cast("string"), F.lit("Z"))) if isinstance(schema["ts"].dataType, TimestampNTZType) else F.col("ts")
    events = spark.readStream.schema(schema).parquet(files).withColumn("ts", ts).where("ts is not null").withWatermark("ts", late)
    counted = events.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    rows = counted.select(F.date_from_unix_date(F.floor(F.unix_seconds("w.start") / 86400).cast("int")).alias("day"), "event_type", "n", "total")
    out = f"{folder}/counters"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = rows.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    kept = spark.read.schema(StructType([*rows.schema.fields]).add("batch", "long")).option("basePath", out).parquet(f"{out}/batch=*")
    return kept.groupBy("day", "event_type").agg(F.max_by("n", "batch").alias("n"), F.max_by("total", "batch").alias("total"))


def running_velocity(spark: SparkSession, files: str, schema: StructType, folder: str, keep: float = 0.75) -> DataFrame:
    """product_id, last_block, clicks and velocity, where a click loses a quarter with each block since. Each click is
    counted as keep ** -block and the sum scaled back, so batches, partitions and late files merge by addition. The
    powers stay doubles for some 2,000 blocks; beyond that, count blocks from a later start."""
    log = spark.readStream.schema(schema).parquet(files).where("product_id is not null and time_block is not null")
    raised = F.sum(F.coalesce("clicked", F.lit(0)) * F.pow(F.lit(1 / keep), F.col("time_block")))
    rows = log.groupBy("product_id").agg(F.max("time_block").alias("last_block"), F.sum("clicked").alias("clicks"), raised.alias("raised"))
    out = f"{folder}/velocity"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    rows.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    kept = spark.read.schema(StructType([*rows.schema.fields]).add("batch", "long")).option("basePath", out).parquet(f"{out}/batch=*")
    last = kept.groupBy("product_id").agg(F.max_by(F.struct("last_block", "clicks", "raised"), "batch").alias("x"))
    return last.select("product_id", "x.last_block", "x.clicks", (F.col("x.raised") * F.pow(F.lit(keep), F.col("x.last_block"))).alias("velocity"))
