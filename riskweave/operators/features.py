"""Feature columns shared by the models: fixed order, absent or unknown values are 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: model inputs in training order
ANOMALY_FEATURES = (
    "amount",
    "account_age_days",
    "user_risk_score",
    "historical_avg_txn",
    "historical_std_dev",
    "known_counterparties",
)
SUPERVISED_FEATURES = (
    "amount",
    "account_age_days",
    "user_risk_score",
    "historical_avg_txn",
    "historical_std_dev",
    "expected_monthly_vol",
    "known_counterparties",
)


def feature(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit(0.0)
    value = F.col(name).cast("double")
    return F.coalesce(F.nanvl(value, F.lit(None).cast("double")), F.lit(0.0))


def feature_matrix(df: DataFrame, names: tuple[str, ...], keep: tuple[str, ...] = ("transaction_id",)) -> DataFrame:
    return df.select(*keep, *[feature(df, n).alias(n) for n in names])


def standardize(matrix: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Zero mean and unit population deviation; a constant feature becomes 0."""
    fitted = matrix.agg(
        *[F.avg(n).alias(f"{n}_mean") for n in names], *[F.stddev_pop(n).alias(f"{n}_std") for n in names]
    ).first()
    scaled = {}
    for n in names:
        mean, std = fitted[f"{n}_mean"], fitted[f"{n}_std"]
        scaled[n] = (F.col(n) - F.lit(mean)) / F.lit(std if std else 1.0)
    return matrix.withColumns(scaled)
