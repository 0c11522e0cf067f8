"""The batch jobs as streams: trends, change detection, alerts and upserts.

Each job takes a streaming DataFrame and returns one, or a function for foreachBatch.
Batches are written below their number, so a batch that runs again replaces its own files.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from statutory.operators.changes import alert_matches
from statutory.operators.keyed import KeyedTable
from statutory.operators.sinks import shared_folder


def trend(events: DataFrame, time: str, dimension: str, period: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Counts per event-time window and dimension; rows that come later than the delay are dropped."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    counts = timed.groupBy(F.window(time, period).alias("w"), F.col(dimension).alias("dimension")).agg(F.count("*").alias("count"))
    return counts.select(F.col("w.start").alias("period"), "dimension", "count")


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LastValue(StatefulProcessor):
    """Keeps the last value of a key and emits its changes; after `keep` milliseconds of event time without a row it is forgotten.

    A row is compared with the time of the one before it, whatever batches they come in. The
    timer frees the state once the watermark is so far that every further row comes too late for it.
    """

    def __init__(self, key: str, order: list[str], value: str, keep: int | None) -> None:
        self.key, self.order, self.value, self.keep = key, order, value, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "value string, at long")

    def _at(self, row: Any) -> int:
        return 0 if self.keep is None else int(getattr(row, self.order[0]).timestamp() * 1000)

    def handleInputRows(self, key: tuple[Any, ...], rows: Iterator[pd.DataFrame], timer_values: Any) -> Iterator[pd.DataFrame]:  # noqa: N802
        known = self.last.exists()
        last, newest = self.last.get() if known else (None, 0)
        frame = pd.concat(list(rows)).sort_values(self.order)
        out = []
        for row in frame.itertuples(index=False):
            now, at = getattr(row, self.value), self._at(row)
            now = None if pd.isna(now) else now
            if known and self.keep is not None and at - newest > self.keep:
                known, last = False, None
            if not known or now != last:
                out.append((key[0], getattr(row, self.order[-1]), last, now))
            last, known, newest = now, True, max(newest, at)
        self.last.update((last, newest))
        if self.keep is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(max(newest + self.keep, timer_values.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame(out, columns=[self.key, self.order[-1], "old_value", "new_value"])

    def handleExpiredTimer(self, key: tuple[Any, ...], timer_values: Any, expired: Any) -> Iterator[pd.DataFrame]:  # noqa: N802
        self.last.clear()
        yield pd.DataFrame([], columns=[self.key, self.order[-1], "old_value", "new_value"])

    def close(self) -> None:
        pass


def changes(rows: DataFrame, key: str, order: list[str], value: str, delay: str | None = None, keep_days: int | None = None) -> DataFrame:
    """A row for every change of a value, against the last known one of its key, which is kept as state.

    The first of order is the event time. With delay and keep_days state is bounded: rows
    later than the delay are dropped, and a key without rows for keep_days after its newest
    one is forgotten, so that its next row is a first one again.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    kind = lambda c: rows.schema[c].dataType.simpleString()
    selected = rows.select(key, *order, value)
    if delay is not None:
        selected = selected.withColumn(order[0], F.col(order[0]).cast("timestamp")).withWatermark(order[0], delay)
    keep = None if keep_days is None else keep_days * 86_400_000
    return selected.groupBy(key).transformWithStateInPandas(
        LastValue(key, order, value, keep), f"{key} {kind(key)}, {order[-1]} {kind(order[-1])}, old_value string, new_value string", "append", "None" if keep is None else "EventTime"
    )


def alert_batch(searches: DataFrame, bills: DataFrame, out: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the batch's changes matched with the static searches and bills."""

    def run(batch: DataFrame, number: int) -> None:
        alert_matches(batch, searches, bills).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return run


def once_per_key(rows: DataFrame, time: str, keys: list[str], delay: str) -> DataFrame:
    """The first row of every key within the delay."""
    return rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def upsert_batch(table: KeyedTable, compact_every: int = 10) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: add the batch to a table whose first row of a key stays; running a batch again changes nothing.

    A batch reads no earlier one; every compact_every-th merges what has come together.
    """

    def run(batch: DataFrame, number: int) -> None:
        table.add(batch, number)
        if number % compact_every == compact_every - 1:
            table.compact()

    return run


def replay(rows: DataFrame, files: int = 1) -> DataFrame:
    """The rows written as files and read as a stream, all files at once or one per batch."""
    spark = rows.sparkSession
    path = shared_folder(spark)
    rows.repartition(files).write.parquet(path)
    reader = spark.readStream.schema(rows.schema)
    return (reader.option("maxFilesPerTrigger", 1) if files > 1 else reader).parquet(path)


def run_to_end(stream: DataFrame, batch: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Run a stream to the end of its input."""
    started = stream.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", shared_folder(stream.sparkSession)).trigger(availableNow=True).start()
    started.awaitTermination()


def drain(stream: DataFrame, batch: Callable[[DataFrame, int], None] | None = None, mode: str = "append", out: str | None = None) -> DataFrame:
    """Run a stream to the end of its input and return what it has written, with the number of its batch."""
    spark = stream.sparkSession
    out = out or shared_folder(spark)

    def write(frame: DataFrame, number: int) -> None:
        frame.write.mode("overwrite").parquet(f"{out}/batch={number}")

    run_to_end(stream, batch or write, mode)
    return spark.read.parquet(out)
