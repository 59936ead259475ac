"""The folder that all machines of a cluster share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows that one task is given of what grows with the tables, and shuffled bytes that are put together for one.
ROWS, BYTES = 500_000, "4m"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in spark.checkpoint.dir; a temporary one is set only where none is and the session is local (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` as Parquet in the shared folder, read back: what several branches use is worked out once."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts(rows: int) -> int:
    """How many tasks `rows` rows take."""
    return -(-rows // ROWS) or 1


@contextmanager
def small_tasks(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is run inside has shuffles cut for `rows` rows. Left to itself, Spark puts 64 MB of a shuffle together for one task;
    sorted short rows take some thirty times the bytes that they have in a shuffle."""
    most, size = "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    was, before = spark.conf.get(most), spark.conf.get(size, None)
    spark.conf.set(most, str(max(int(was), parts(rows))))
    spark.conf.set(size, BYTES)
    try:
        yield
    finally:
        spark.conf.set(most, was)
        spark.conf.set(size, before) if before else spark.conf.unset(size)
