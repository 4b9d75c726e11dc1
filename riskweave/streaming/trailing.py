"""Exact trailing windows on a stream: velocity (D1) and aggregation (D3) by keyed state instead of aligned windows.

Each sender is a key of ``transformWithStateInPandas`` in event time. Its state holds the transactions and money of each
instant it has seen (map state) and the instants not yet answered. An instant is answered when the watermark passes it:
by then every transaction of the trailing window ``[at - width, at]`` has arrived (rows later than the watermark are
dropped as late, as any stateful Spark operator does), so the sums equal the batch's. Instants older than the longest
width behind the last answered one are evicted: a sender's state is one window of its own instants, not its history.

Sums are the batch's: counts of rows and money in units of ``MONEY_UNITS``, over the inclusive window. A window that a
burst crosses, or that spans micro-batches, is no different to the state."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..config import RiskConfig
from ..functions.temporal import SECOND_US, as_micros, from_micros
from ..operators.sliding import MONEY_UNITS, money_units

HOUR_US = 3600 * SECOND_US
OUTPUT = "sender_id string, at long, hour_n long, span_n long, span_units long"
#: The state store that keyed state needs.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class TrailingSums(StatefulProcessor):
    """Per sender: rows in the last hour and rows and money in the last ``span_us``, at each instant, once final."""

    def __init__(self, span_us: int):
        self.span_us = span_us
        self.longest = max(span_us, HOUR_US)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getMapState("events", "at long", "n long, units long")
        self.pending = handle.getMapState("pending", "at long", "due long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        late = timerValues.getCurrentWatermarkInMs() * 1000
        for batch in rows:
            batch = batch[batch["at"] > late] if late > 0 else batch
            if batch.empty:
                continue
            grouped = batch.groupby("at").agg(n=("units", "size"), units=("units", "sum"))
            for at, n, units in zip(grouped.index, grouped["n"], grouped["units"], strict=True):
                at = int(at)
                if self.events.containsKey((at,)):
                    old_n, old_units = self.events.getValue((at,))
                    n, units = n + old_n, units + old_units
                self.events.updateValue((at,), (int(n), int(units)))
                if not self.pending.containsKey((at,)):
                    due = -(-at // 1000)
                    self.pending.updateValue((at,), (due,))
                    self.handle.registerTimer(due)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        limit = expiredTimerInfo.getExpiryTimeInMs() * 1000
        due = sorted(at for (at,) in self.pending.keys() if at <= limit)
        if not due:
            yield from ()
            return
        points = sorted((at, n, units) for (at,), (n, units) in self.events.iterator())
        times = [p[0] for p in points]
        n_sum = np.concatenate([[0], np.cumsum([p[1] for p in points])])
        units_sum = np.concatenate([[0], np.cumsum([p[2] for p in points])])
        out = []
        for at in due:
            end = bisect.bisect_right(times, at)
            hour = bisect.bisect_left(times, at - HOUR_US)
            span = bisect.bisect_left(times, at - self.span_us)
            out.append((key[0], at, int(n_sum[end] - n_sum[hour]), int(n_sum[end] - n_sum[span]), int(units_sum[end] - units_sum[span])))
            self.pending.removeKey((at,))
        # Instants still to come are later than this timer: they need nothing before limit - longest.
        for at in times:
            if at >= limit - self.longest:
                break
            self.events.removeKey((at,))
        yield pd.DataFrame(out, columns=["sender_id", "at", "hour_n", "span_n", "span_units"])

    def close(self) -> None:
        pass


def trailing_stream(stream: DataFrame, cfg: RiskConfig, lateness: str = "10 minutes") -> DataFrame:
    """Per sender and instant, once the watermark has passed it: the trailing sums of D1 and D3."""
    spark = stream.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != ROCKSDB:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    events = (
        stream.where(F.col("sender_id").isNotNull() & F.col("timestamp").isNotNull())
        .select(
            "sender_id",
            F.timestamp_micros(as_micros(F.col("timestamp"))).alias("event_time"),
            as_micros(F.col("timestamp")).alias("at"),
            F.coalesce(money_units(F.col("amount")), F.lit(0)).cast("long").alias("units"),
        )
        .withWatermark("event_time", lateness)
    )
    processor = TrailingSums(cfg.aggregation_hours * HOUR_US)
    return events.groupBy("sender_id").transformWithStateInPandas(processor, OUTPUT, "Append", "EventTime")


def velocity_exact(sums: DataFrame, cfg: RiskConfig) -> DataFrame:
    """D1 on the stream: the batch's rows of ``hourly_velocity``."""
    return sums.where(F.col("hour_n") > cfg.hourly_limit).select(
        "sender_id", from_micros(F.col("at")).alias("timestamp"), F.col("hour_n").alias("txns_last_hour")
    )


def aggregation_exact(sums: DataFrame, cfg: RiskConfig) -> DataFrame:
    """D3 on the stream: the batch's rows of ``aggregation``."""
    many = F.col("span_n") >= cfg.aggregation_count
    large = F.col("span_units") >= int(cfg.aggregation_amount * MONEY_UNITS)
    return sums.where(many & large).select(
        "sender_id",
        from_micros(F.col("at")).alias("timestamp"),
        F.col("span_n").alias("window_txns"),
        (F.col("span_units") / MONEY_UNITS).alias("window_amount"),
    )
