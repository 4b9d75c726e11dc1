"""Per-entity baselines and the deviation scores built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import RiskConfig
from ..functions import rules
from ..schema import entity_column
from .rules import night_flag, temporal_features
from .skew import heaviest, skew_join

STATS = ("user_mean", "user_std", "txn_count")


def baseline_columns(amount: str = "amount") -> list[Column]:
    return [
        F.avg(amount).alias("user_mean"),
        F.coalesce(F.stddev_samp(amount), F.lit(0.0)).alias("user_std"),
        F.count(amount).alias("txn_count"),
    ]


def entity_baselines(df: DataFrame, key: str | None = None) -> DataFrame:
    """Mean, sample deviation and count per entity. Rows without an entity are left out."""
    key = key or entity_column(df)
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*baseline_columns())


def with_baselines(df: DataFrame, baselines: DataFrame, key: str) -> DataFrame:
    """Attach baselines; their counts also tell which entities are hot."""
    return skew_join(df, baselines, key, "transaction_id", "left", heaviest(baselines, key, "txn_count"))


def _scored(df: DataFrame, score, cfg: RiskConfig) -> DataFrame:
    value = score(F.col("amount"), *[F.col(c) for c in STATS], cfg)
    return df.withColumn("behavioral_raw", value).drop(*STATS)


def score_zscore(df: DataFrame, cfg: RiskConfig, baselines: DataFrame | None = None) -> DataFrame:
    """behavioral_raw from the z-score, against this batch unless baselines are given."""
    key = entity_column(df)
    baselines = entity_baselines(df, key) if baselines is None else baselines
    return _scored(with_baselines(df, baselines, key), rules.zscore_score, cfg)


def score_profile(df: DataFrame, cfg: RiskConfig, baselines: DataFrame | None = None) -> DataFrame:
    """behavioral_raw by the profile variant."""
    key = entity_column(df)
    baselines = entity_baselines(df, key) if baselines is None else baselines
    return _scored(with_baselines(df, baselines, key), rules.profile_score, cfg)


def enrich_behavior(df: DataFrame, cfg: RiskConfig) -> DataFrame:
    """Night flag and z-score: what the final risk score reads."""
    return score_zscore(night_flag(df), cfg)


def profile_features(df: DataFrame, cfg: RiskConfig) -> DataFrame:
    """Temporal features and the profile score."""
    return score_profile(temporal_features(df), cfg)


def peer_zscore(df: DataFrame, group: str = "peer_group") -> DataFrame:
    """Deviation from the peer group; a handful of groups, so every one of them is hot."""
    peers = df.where(F.col(group).isNotNull()).groupBy(group).agg(*baseline_columns())
    joined = skew_join(df, peers, group, "transaction_id", "left", heaviest(peers, group, "txn_count"))
    spread = F.when(F.col("user_std") == 0, 1.0).otherwise(F.col("user_std"))
    return joined.withColumn("peer_zscore", (F.col("amount") - F.col("user_mean")) / spread).drop(*STATS)
