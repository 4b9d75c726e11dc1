"""Continuous monitoring with Structured Streaming.

Row rules run on the stream as they are. Windowed rules use event time and a watermark.
Whatever compares a row with its batch (identity, network, hubs, models) runs per
micro-batch through the batch plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..config import RiskConfig
from ..functions.rules import integration_mismatch, zscore_score
from ..operators.behavior import STATS, with_baselines
from ..operators.rules import night_flag, score_rules
from ..operators.sliding import MONEY_UNITS, money_units
from ..plans.score import fit_models, score_batch
from ..session import path_exists
from ..sources import state
from ..sources.transactions import parse_timestamp


def read_stream(spark: SparkSession, path: str, schema: StructType, max_files: int | None = None) -> DataFrame:
    """New parquet files of a folder as they arrive."""
    reader = spark.readStream.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return parse_timestamp(reader.parquet(path))


def row_rules(stream: DataFrame, cfg: RiskConfig) -> DataFrame:
    """The rules that need one row only: same code as in batch."""
    mismatch = integration_mismatch(F.col("mcc_code"), F.col("sender_occupation"), F.col("amount"), cfg)
    return score_rules(night_flag(stream), cfg).withColumn("mcc_mismatch", mismatch)


def window_activity(
    stream: DataFrame, cfg: RiskConfig, window: str, slide: str, lateness: str = "10 minutes"
) -> DataFrame:
    """Transactions and money per sender and sliding event-time window."""
    event = F.col("timestamp").cast("timestamp")
    return (
        stream.withColumn("event_time", event)
        .withWatermark("event_time", lateness)
        .groupBy(F.window("event_time", window, slide), "sender_id")
        .agg(F.count(F.lit(1)).alias("n_txns"), (F.sum(money_units(F.col("amount"))) / MONEY_UNITS).alias("total_amount"))
        .select(F.col("window.start").alias("window_start"), "sender_id", "n_txns", "total_amount")
    )


def velocity_windows(stream: DataFrame, cfg: RiskConfig) -> DataFrame:
    return window_activity(stream, cfg, "1 hour", "5 minutes").where(F.col("n_txns") > cfg.hourly_limit)


def aggregation_windows(stream: DataFrame, cfg: RiskConfig) -> DataFrame:
    span = f"{cfg.aggregation_hours} hours"
    busy = (F.col("n_txns") >= cfg.aggregation_count) & (F.col("total_amount") >= cfg.aggregation_amount)
    return window_activity(stream, cfg, span, "1 hour").where(busy)


def behavior_against_baselines(stream: DataFrame, baselines: DataFrame, cfg: RiskConfig, key: str = "sender_id") -> DataFrame:
    """z-score against stored baselines: a stream-static join, whose counts name the hot accounts."""
    score = zscore_score(F.col("amount"), *[F.col(c) for c in STATS], cfg)
    return with_baselines(stream, baselines, key).withColumn("behavioral_raw", score).drop(*STATS)


def score_micro_batch(
    spark: SparkSession,
    output: str,
    cfg: RiskConfig,
    classifier=None,
    state_path: str | None = None,
    strict_highwater: bool = False,
) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: the batch plan per micro-batch, one output folder per batch id.

    A repeated batch id is not written again if its folder is complete; the state is advanced if that id
    has not done so, so a restart between the two loses nothing and counts nothing twice.
    ``strict_highwater`` drops rows not later than the stored watermark, as the batch runs do."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        name = f"{batch_id:012d}"
        done = f"{output}/run={name}"
        if path_exists(session, f"{done}/_SUCCESS"):
            if state_path is not None and not state.knows_batch(session, state_path, name):
                figures = session.read.parquet(done).agg(*state.watermark_columns()).first()
                state.advance_state(session, state_path, figures.max_timestamp, figures.n_rows, name)
            return
        if strict_highwater and state_path is not None:
            batch = state.delta(batch, state.load_state(session, state_path).last_run_timestamp)
        if batch.isEmpty():
            return
        figures = batch.agg(*state.watermark_columns()).first()
        scored = score_batch(batch, cfg, fit_models(batch, cfg, classifier))
        _overwrite(scored, done)
        if state_path is not None:
            state.advance_state(session, state_path, figures.max_timestamp, figures.n_rows, name)

    return handle


def _overwrite(df: DataFrame, path: str) -> None:
    """An unfinished folder of the same batch id is replaced."""
    df.write.mode("overwrite").parquet(path)


def start_monitor(
    spark: SparkSession, stream: DataFrame, output: str, checkpoint: str, cfg: RiskConfig | None = None, **options
) -> StreamingQuery:
    """Score everything that has arrived, then stop; run again for what comes later."""
    return (
        stream.writeStream.foreachBatch(score_micro_batch(spark, output, cfg or RiskConfig(), **options))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
