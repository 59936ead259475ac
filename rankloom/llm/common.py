"""Shared helpers: scratch tables in the folder the cluster shares, table access, byte-level words."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters `[\x20\x09-\x0D]`.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: For bytes.translate: A-Z lower-cased, all else kept.
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one is set only where none is and the session is local (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """`df` as a Parquet table in the shared folder, read back: lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def batch_rows(spark: SparkSession, n: int) -> Iterator[None]:
    """Arrow batches of at most `n` rows for what runs inside: a worker and its executor hold whole texts of one batch."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, n)
    try:
        yield
    finally:
        spark.conf.set(name, was)


def join_rows(rows: DataFrame, found: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """`rows` joined on `key` to `found`, which has each key once and in `n` how many rows have it; `n` goes. Keys with
    over a thousandth of the rows - under a thousand keys, whatever the input - go to all tasks, so no task gets all
    rows of a hot key; all other keys meet by a shuffle."""
    total = found.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * 1000 > total
    many = F.broadcast(found.where(hot).drop("n"))
    rest = rows.join(F.broadcast(found.where(hot).select(key)), key, "left_anti").join(found.where(~hot).drop("n"), key, how)
    return rows.join(many, key).unionByName(rest)


def lower_ascii(c: Column) -> Column:
    """A-Z to lower case and nothing else; texts of ASCII alone take the quicker function."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def held_out(doc_id: Column, remainder: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == remainder


def text_bytes(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """The columns `keep` and the text as UTF-8 bytes in `_text`; extra columns stay behind."""
    return docs.select(*keep, F.coalesce(docs[text].cast("binary"), F.lit(b"")).alias("_text"))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict | None], schema: str, rows: int = 1 << 20) -> DataFrame:
    """`fn` turns each Arrow batch, in slices of at most `rows` rows, into columns (a dict of lists or arrays) of `schema`."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                if (cols := fn(whole.slice(at, rows))) is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)
