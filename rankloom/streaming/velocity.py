"""Click velocity kept event by event by a stream, with late events counted instead of lost.

Each product is a key of its own with two states: its velocity after the blocks that are closed, and the events of open
blocks. A timer at a block's end closes it once the watermark has passed: its events are put in order and each keeps a
part of the velocity and adds its click, as the batch feature does. Events of a block that is closed come too late to be
put in order; they change nothing and are counted by block.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

DAY_MS, DECAY = 86_400_000, 0.75
PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Per closed block: its events, the velocity before and after it. Per late batch of a block: how many events came late.
CLOSED = "product_id long, time_block long, events long, before double, velocity double, late long"
_EVENT = "time_block long, query_id long, position long, event_seq long, clicked double"
_ORDER = ["query_id", "position", "event_seq"]


class Velocity(StatefulProcessor):
    def __init__(self, keep: float = DECAY):
        self.keep = keep

    def init(self, handle) -> None:
        self.handle = handle
        self.velocity = handle.getValueState("velocity", "velocity double, closed long")
        self.open = handle.getListState("open", _EVENT)

    def _closed(self) -> tuple[float, int]:
        return self.velocity.get() if self.velocity.exists() else (0.0, -(1 << 62))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # Blocks that end at the watermark or before it are closed, also for products that have none of their events.
        passed = timerValues.getCurrentWatermarkInMs() // DAY_MS - 1
        closed, late = max(self._closed()[1], passed), {}
        for part in rows:
            own = part["time_block"] > closed
            for b, n in part.loc[~own, "time_block"].value_counts().items():
                late[int(b)] = late.get(int(b), 0) + int(n)
            kept = part.loc[own]
            if len(kept):
                events = kept[["time_block", *_ORDER, "clicked"]].fillna(0)
                self.open.appendList([(int(b), int(q), int(p), int(s), float(c)) for b, q, p, s, c in events.itertuples(index=False)])
                for b in kept["time_block"].unique():
                    self.handle.registerTimer((int(b) + 1) * DAY_MS)
        yield pd.DataFrame([(key[0], b, 0, None, None, n) for b, n in sorted(late.items())], columns=["product_id", "time_block", "events", "before", "velocity", "late"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        block = expiredTimerInfo.getExpiryTimeInMs() // DAY_MS - 1
        # Timers of a key need not come in order: each closes every open block up to its own.
        events = sorted(tuple(e) for e in self.open.get())
        now, left = [e for e in events if e[0] <= block], [e for e in events if e[0] > block]
        out, (v, closed) = [], self._closed()
        for b in sorted({e[0] for e in now}):
            before, own = v, [e for e in now if e[0] == b]
            for e in own:
                v = self.keep * v + e[4]
            out.append((key[0], b, len(own), before, v, 0))
        if out:
            self.velocity.update((v, max(closed, out[-1][1])))
            self.open.put(left) if left else self.open.clear()
        yield pd.DataFrame(out, columns=["product_id", "time_block", "events", "before", "velocity", "late"])

    def close(self) -> None:
        pass


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Keyed state with timers needs the store that Spark brings for it."""
    was = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, was)


def event_velocities(spark: SparkSession, files: str, schema: StructType, folder: str, wait: int = 0, keep: float = DECAY, files_at_a_time: int = 1000) -> DataFrame:
    """product_id, time_block, events, before, velocity, late: per closed block of a product its events and its velocity before
    and after them, and how many events came after it was closed (blocks of late events alone have nulls). A block is
    closed when an event `wait` + 1 blocks later has been read in an earlier micro-batch.

    The stream reads each new file in `files` once (availableNow) and goes on where the progress in `folder` says; each
    micro-batch writes to a folder of its own, so what is repeated after a failure overwrites itself. Rows without a product
    or a block are left out; without clicks, places or numbers they count as 0."""
    log = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_a_time).parquet(files).where("product_id is not null and time_block is not null")
    timed = log.withColumn("_at", F.timestamp_seconds(F.col("time_block").cast("long") * 86400)).withWatermark("_at", f"{wait} days")
    # The time itself stays behind: with it Spark would drop late rows before they are counted.
    events = timed.select(*[F.col(c).cast(t).alias(c) for c, t in (x.split() for x in ("product_id long", *_EVENT.split(", ")))])
    rows = events.groupBy("product_id").transformWithStateInPandas(Velocity(keep), CLOSED, "Append", "EventTime")
    out = f"{folder}/closed"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    with keyed_state(spark):
        rows.writeStream.outputMode("append").foreachBatch(put).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    kept = spark.read.schema(f"{CLOSED}, batch long").option("basePath", out).parquet(f"{out}/batch=*")
    one = lambda c: F.max(c).alias(c)
    return kept.groupBy("product_id", "time_block").agg(one("events"), one("before"), one("velocity"), F.sum("late").alias("late"))
