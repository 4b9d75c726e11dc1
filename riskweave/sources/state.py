"""Run state: a strict high-water mark kept as an append-only table.

A state row is appended after the sink commits; a crash in between repeats the batch
rather than losing it."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import path_exists

EPOCH = datetime(1970, 1, 1)
STATE_VERSION = "1"

STATE = T.StructType(
    [
        T.StructField("last_run_timestamp", T.TimestampNTZType()),
        T.StructField("total_processed_to_date", T.LongType()),
        T.StructField("version", T.StringType()),
        T.StructField("last_updated", T.TimestampNTZType()),
        T.StructField("seq", T.LongType()),
        T.StructField("batch", T.StringType()),
    ]
)


def initial_state() -> Row:
    return Row(
        last_run_timestamp=EPOCH, total_processed_to_date=0, version=STATE_VERSION, last_updated=None, seq=0, batch=None
    )


def load_state(spark: SparkSession, path: str) -> Row:
    """The latest state; a missing or unreadable table means a full scan from the epoch."""
    if not path_exists(spark, path):
        return initial_state()
    rows = spark.read.schema(STATE).json(path, mode="DROPMALFORMED").where("seq IS NOT NULL")
    return rows.orderBy(F.desc("seq")).first() or initial_state()


def _append(spark: SparkSession, path: str, values: tuple) -> None:
    spark.createDataFrame([values], STATE).coalesce(1).write.mode("append").json(path)


def delta(df: DataFrame, watermark: datetime, timestamp: str = "timestamp") -> DataFrame:
    """Rows strictly after the watermark. A plain comparison, so it reaches the scan."""
    return df.where(F.col(timestamp) > F.lit(watermark).cast("timestamp_ntz"))


def watermark_columns(timestamp: str = "timestamp") -> list[Column]:
    return [F.max(timestamp).alias("max_timestamp"), F.count(F.lit(1)).alias("n_rows")]


def knows_batch(spark: SparkSession, path: str, batch: str) -> bool:
    """Whether a batch has advanced the state already."""
    return path_exists(spark, path) and not spark.read.schema(STATE).json(path).where(F.col("batch") == batch).isEmpty()


def advance_state(
    spark: SparkSession, path: str, max_timestamp: datetime | None, n_rows: int, batch: str | None = None
) -> Row:
    """Append the new high-water mark; an empty batch, and a named one that was counted before, change nothing.

    Named batches may be repeated out of order, so the mark never goes back for them."""
    state = load_state(spark, path)
    if n_rows == 0 or (batch is not None and knows_batch(spark, path, batch)):
        return state
    if batch is not None and max_timestamp is not None:
        max_timestamp = max(max_timestamp, state.last_run_timestamp)
    mark = state.last_run_timestamp if max_timestamp is None else max_timestamp
    total = state.total_processed_to_date + n_rows
    _append(spark, path, (mark, total, STATE_VERSION, datetime.now(), state.seq + 1, batch))
    return load_state(spark, path)


def reset_state(spark: SparkSession, path: str) -> Row:
    """Back to the epoch; the history of earlier rows stays readable."""
    _append(spark, path, (EPOCH, 0, STATE_VERSION, datetime.now(), load_state(spark, path).seq + 1, None))
    return load_state(spark, path)
