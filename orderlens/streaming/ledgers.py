"""Streams whose results count once: a ledger of batches, tables folded batch by batch, hedges joined with their fills, and one event time for several sources."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .flows import event_time


class BatchLedger:
    """A table in a folder that a stream's foreachBatch writes to, where each batch counts once however often it is tried.

    A batch's files go to a folder of its own; then its number enters the ledger, as an empty file that is made or not. Readers see entered batches alone: a batch that
    failed before its entry is written over when the stream tries it again, and one that was entered is passed over.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def entered(self) -> list[int]:
        """Numbers of the batches that count, in order."""
        files, path = self._path("ledger")
        if not files.exists(path):
            return []
        return sorted(int(f.getPath().getName()) for f in files.listStatus(path) if f.getPath().getName().isdigit())

    def _enter(self, batch_id: int) -> None:
        files, path = self._path(f"ledger/{batch_id}")
        files.createNewFile(path)

    def _data(self, batch_id: int) -> str:
        return f"{self.folder}/batch={batch_id}"

    def append(self, batch: DataFrame, batch_id: int) -> None:
        """For writeStream.foreachBatch(): the table is the union of its batches."""
        if batch_id not in self.entered():
            batch.write.mode("overwrite").parquet(self._data(batch_id))
            self._enter(batch_id)

    def read(self) -> DataFrame | None:
        paths = [self._data(i) for i in self.entered()]
        return self.spark.read.parquet(*paths) if paths else None

    def folding(self, merge: Callable[[DataFrame | None, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
        """For foreachBatch(): the table is merge(the table before or None, batch). The table before the last one is kept until the next batch is in."""

        def fold(batch: DataFrame, batch_id: int) -> None:
            entered = self.entered()
            if batch_id in entered:
                return
            merge(self.latest(), batch).write.mode("overwrite").parquet(self._data(batch_id))
            self._enter(batch_id)
            for old in entered[:-1]:
                files, path = self._path(f"batch={old}")
                files.delete(path, True)

        return fold

    def latest(self) -> DataFrame | None:
        """The table that the last batch left."""
        entered = self.entered()
        return self.spark.read.parquet(self._data(entered[-1])) if entered else None


def several_sources(flows: list[DataFrame], time_ns: str, delay: str) -> DataFrame:
    """Several streams as one, each with event time and a watermark of its own: event time passes when it has passed for all (Spark's policy min)."""
    policy = flows[0].sparkSession.conf.get("spark.sql.streaming.multipleWatermarkPolicy")
    if policy != "min":
        raise ValueError("spark.sql.streaming.multipleWatermarkPolicy must be min")
    return reduce(DataFrame.unionByName, [event_time(f, time_ns, delay) for f in flows])


HEDGE = "sequence long, quantity long, filled long, left long, status string"


def hedge_ledger(pending: DataFrame, fills: DataFrame, retention: str, delay: str = "1 minute") -> DataFrame:
    """Pending hedges (sequence, quantity with a sign, time_ns) joined with fills (sequence, filled with a sign, time_ns) that go their way, in update mode.

    A row for each change: how much is filled and left, and whether the hedge is open, filled or expired. A hedge is dropped from the state once it is filled, or when event time has passed its
    last row by the retention; fills that come before their hedge wait as long. Sequences are unique, what a filled hedge gets beyond its quantity
    isn't counted, and rows later than the delay are Spark's to drop.
    """
    keep_ms = int(pending.sparkSession.sql(f"SELECT unix_millis(timestamp_seconds(0) + interval {retention}) AS ms").first()["ms"])
    both = several_sources(
        [
            pending.select("sequence", F.col("quantity").cast("long").alias("quantity"), F.lit(0).cast("long").alias("filled"), "time_ns"),
            fills.select("sequence", F.lit(None).cast("long").alias("quantity"), F.col("filled").cast("long").alias("filled"), "time_ns"),
        ],
        "time_ns", delay,
    )

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        quantity, bought, sold, last_ms = state.get if state.exists else (None, 0, 0, 0)
        if state.hasTimedOut:
            state.remove()
            if quantity is not None:
                yield row(key[0], quantity, bought, sold, "expired")
            return
        for batch in batches:
            told = batch["quantity"].dropna()
            quantity = int(told.iloc[0]) if len(told) else quantity
            amounts = batch["filled"].astype("int64")
            bought, sold = bought + int(amounts[amounts > 0].sum()), sold - int(amounts[amounts < 0].sum())
            last_ms = max(last_ms, int(batch["time_ns"].max()) // 1_000_000)
        if quantity is not None and abs(quantity) <= (bought if quantity > 0 else sold if quantity < 0 else 0):
            if state.exists:
                state.remove()
            yield row(key[0], quantity, bought, sold, "filled")
            return
        state.update((quantity, bought, sold, last_ms))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, last_ms + keep_ms))
        if quantity is not None:
            yield row(key[0], quantity, bought, sold, "open")

    def row(sequence: int, quantity: int, bought: int, sold: int, status: str) -> pd.DataFrame:
        sign = (quantity > 0) - (quantity < 0)
        filled = min(abs(quantity), bought if sign > 0 else sold)
        return pd.DataFrame([(sequence, quantity, sign * filled, sign * (abs(quantity) - filled), status)], columns=[f.split()[0] for f in HEDGE.split(", ")])

    held = "quantity long, bought long, sold long, last_ms long"
    return both.groupBy("sequence").applyInPandasWithState(step, HEDGE, held, "update", GroupStateTimeout.EventTimeTimeout)
