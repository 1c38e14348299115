"""Daily feeds as Structured Streaming jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from terrahaz.functions import kernels
from terrahaz.operators.climate import SERIES, with_indices
from terrahaz.plans.asset_groups import unexposed


def monthly_stream(feed: DataFrame, keys: Sequence[str], value: str, date: str = "date",
                   delay: str = "40 days") -> DataFrame:
    """Monthly means of a daily feed; a month closes once the watermark passes its end.

    The grouping window is the calendar month, kept as a real event-time column
    so state is dropped as the watermark moves on.
    """
    stamped = feed.withColumn("month_start", F.date_trunc("month", F.col(date).cast("timestamp")))
    return (
        stamped.withWatermark("month_start", delay)
        .groupBy(*keys, "month_start")
        .agg(F.avg(value).alias(value))
    )


def closing_months(feed: DataFrame, closed: DataFrame, keys: Sequence[str], value: str, date: str = "date") -> DataFrame:
    """Months of a feed that has ended which its stream still held open, with the columns of ``closed``.

    ``feed`` is the same feed as a table, ``closed`` what :func:`monthly_stream` has written; a month
    there is final, so running this again after an append adds nothing.
    """
    stamped = feed.withColumn("month_start", F.date_trunc("month", F.col(date).cast("timestamp")))
    left = stamped.join(closed.select(*keys, "month_start"), [*keys, "month_start"], "left_anti")
    return left.groupBy(*keys, "month_start").agg(F.avg(value).alias(value)).select(*closed.columns)


class BlockCodes(StatefulProcessor):
    """Fire weather of one block of cells: its state is one row of arrays, its cells advance together (see :class:`kernels.DayWalk`).

    A row dated at or before the last day of its cell arrives too late and is dropped, of several rows
    of a cell and day the first by its values counts. A block without rows for ``idle_days`` of
    event time gives its state back by a timer; a run would start anew by then anyway.
    """

    STATE = "cells array<bigint>, lat array<double>, last array<bigint>, ffmc array<double>, dmc array<double>, dc array<double>"

    def __init__(self, names: list[str], idle_days: int):
        self.names, self.idle_days = names, idle_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("codes", self.STATE)

    def _walk(self) -> kernels.DayWalk:
        walk = kernels.DayWalk()
        if self.state.exists():
            cells, lat, last, *codes = self.state.get()
            walk.keys, walk.lat, walk.last = np.array(cells, np.int64), np.array(lat, float), np.array(last, np.int64)
            walk.codes = np.array(codes, float)
        return walk

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        walk = self._walk()
        frame = pd.concat(list(rows), ignore_index=True)
        frame = frame.sort_values(["walk_day", "walk_key", *kernels.WEATHER]).drop_duplicates(["walk_day", "walk_key"])
        day, cells = frame["walk_day"].to_numpy(np.int64), frame["walk_key"].to_numpy(np.int64)
        if len(walk.keys):
            at = np.searchsorted(walk.keys, cells).clip(max=len(walk.keys) - 1)
            fresh = (walk.keys[at] != cells) | (walk.last[at] < day)
            frame, day, cells = frame[fresh], day[fresh], cells[fresh]
        if not len(frame):
            return
        lat = frame["lat"].to_numpy(float)
        weather = frame[list(kernels.WEATHER)].to_numpy(float).T
        out = walk.walk(day, cells, lat, weather)
        self.state.update((walk.keys.tolist(), walk.lat.tolist(), walk.last.tolist(), *walk.codes.tolist()))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((int(day[-1]) + self.idle_days) * 86_400_000)
        result = frame[[*self.names, "date", "sfcwind"]].copy()
        for name, values in zip(kernels.START, out):
            result[name] = values
        yield result

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def fwi_stream(feed: DataFrame, series: Sequence[str] = SERIES, block_deg: float = 2.0, idle_days: int = 800) -> DataFrame:
    """Fire weather of a daily feed, keyed by series and block of cells like the batch (see :class:`BlockCodes`).

    One call per block and micro-batch, however many cells the block has. Sets the session's state store to
    RocksDB, which this kind of state needs.
    """
    spark = feed.sparkSession
    if spark.conf.get(STORE, "") != ROCKS:
        spark.conf.set(STORE, ROCKS)
    names = [*series, "lat", "lon"]
    schema = ", ".join([*(f"{s} string" for s in series), "lat double", "lon double", "date date",
                        "sfcwind double", "ffmc double", "dmc double", "dc double"])
    rows = feed.select(*names, F.col("date").cast("date").alias("date"), *kernels.WEATHER).filter(F.col("date").isNotNull()).select(
        "*", F.unix_date("date").cast("bigint").alias("walk_day"), F.xxhash64(*names).alias("walk_key"), F.col("date").cast("timestamp").alias("walk_time"),
        F.floor(F.col("lon") / block_deg).alias("walk_bx"), F.floor(F.col("lat") / block_deg).alias("walk_by"))
    codes = rows.withWatermark("walk_time", f"{idle_days} days").groupBy(*series, "walk_bx", "walk_by").transformWithStateInPandas(
        BlockCodes(names, idle_days), schema, "append", "EventTime")
    codes = codes.select(*names, "date", "sfcwind", *[
        F.when(~F.isnan(c), F.col(c)).alias(c) for c in kernels.START])
    return with_indices(codes).drop("sfcwind")


def exposure_stream(assets: DataFrame, table: str, expose: Callable[[DataFrame], DataFrame],
                    key: Sequence[str]) -> DataStreamWriter:
    """Expose changed assets as they arrive; replays add nothing.

    Each micro-batch keeps the assets the target table lacks, runs the exposure
    plan on them and appends. A repeated batch finds its ids exposed already.
    """
    def handle(batch: DataFrame, _: int) -> None:
        from terrahaz.sources.sinks import append_new

        spark = batch.sparkSession
        try:
            fresh = unexposed(batch, spark.read.parquet(table))
        except Exception as error:  # no table before the first batch
            if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
                raise
            fresh = batch.distinct()
        append_new(expose(fresh), table, key)

    return assets.writeStream.foreachBatch(handle)


def shared_folder(spark, name: str) -> str:
    """A fresh folder under the cluster's checkpoint folder, or under the session's warehouse where that is unset."""
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def drain_to_table(stream: DataFrame, folder: str, schema=None) -> DataFrame:
    """Run a stream over what is available now into a Parquet table and read it back."""
    query = (
        stream.writeStream.format("parquet").option("path", f"{folder}/table")
        .option("checkpointLocation", f"{folder}/checkpoint").outputMode("append")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(schema or stream.schema).parquet(f"{folder}/table")
