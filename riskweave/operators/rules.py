"""The deterministic rule suite: one projection, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import RiskConfig
from ..functions import rules, temporal


def score_structuring(df: DataFrame, cfg: RiskConfig) -> DataFrame:
    """Adds structuring_raw; a table without amounts stays unchanged."""
    if "amount" not in df.columns:
        return df
    return df.withColumn("structuring_raw", rules.structuring(F.col("amount"), cfg))


def score_volume(df: DataFrame, cfg: RiskConfig) -> DataFrame:
    """Adds velocity_raw; 0 where the stated volume is not part of the table."""
    if not {"amount", "expected_monthly_vol"} <= set(df.columns):
        return df.withColumn("velocity_raw", F.lit(0.0))
    return df.withColumn("velocity_raw", rules.volume_breach(F.col("amount"), F.col("expected_monthly_vol"), cfg))


def score_jurisdiction(df: DataFrame, cfg: RiskConfig) -> DataFrame:
    """Adds geo_raw; 0 where the destination is not part of the table."""
    if "receiver_country" not in df.columns:
        return df.withColumn("geo_raw", F.lit(0.0))
    return df.withColumn("geo_raw", rules.jurisdiction(F.col("receiver_country"), cfg))


def score_rules(df: DataFrame, cfg: RiskConfig) -> DataFrame:
    return score_jurisdiction(score_volume(score_structuring(df, cfg), cfg), cfg)


def night_flag(df: DataFrame) -> DataFrame:
    if "timestamp" not in df.columns:
        return df
    return df.withColumn("is_night_txn", temporal.is_night(F.col("timestamp")))


def temporal_features(df: DataFrame) -> DataFrame:
    """Hour, weekday (Monday is 0) and the night flag."""
    if "timestamp" not in df.columns:
        return df
    ts = F.col("timestamp")
    return df.withColumns({"hour": F.hour(ts), "day_of_week": temporal.weekday(ts), "is_night_txn": temporal.is_night(ts)})
