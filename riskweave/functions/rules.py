"""Deterministic red-flag rules as column expressions, each scoring 0-100."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import RiskConfig
from .numeric import clip, nonzero


def structuring(amount: Column, cfg: RiskConfig) -> Column:
    """Just below the reporting limit."""
    hit = (amount >= cfg.structuring_floor) & (amount < cfg.reporting_limit)
    return F.when(hit, 100.0).otherwise(0.0)


def volume_breach(amount: Column, expected_volume: Column, cfg: RiskConfig) -> Column:
    """Starts at 50 when the stated volume is exceeded by the multiplier, 100 at twice that."""
    ratio = amount / nonzero(expected_volume)
    return F.when(ratio >= cfg.volume_multiplier, clip(ratio / cfg.volume_multiplier * 50, 0, 100)).otherwise(0.0)


def jurisdiction(country: Column, cfg: RiskConfig) -> Column:
    return F.when(country.isin(list(cfg.high_risk_jurisdictions)), 100.0).otherwise(0.0)


def integration_mismatch(mcc: Column, occupation: Column, amount: Column, cfg: RiskConfig) -> Column:
    """A low-income profile making a large purchase in a luxury or securities category."""
    return (
        mcc.isin(list(cfg.high_risk_mccs))
        & occupation.isin(list(cfg.low_income_profiles))
        & (amount >= cfg.reporting_limit * cfg.integration_ratio)
    )


def zscore_score(amount: Column, mean: Column, std: Column, count: Column, cfg: RiskConfig) -> Column:
    """100 from sigma upwards, linear from half of it, 0 below or with too little history."""
    z = (amount - mean) / nonzero(std)
    return clip(
        F.when(count < 3, 0.0).when(z >= cfg.sigma, 100.0).when(z >= cfg.sigma * 0.5, z / cfg.sigma * 100).otherwise(0.0),
        0,
        100,
    )


def profile_score(amount: Column, mean: Column, std: Column, count: Column, cfg: RiskConfig) -> Column:
    """Profile variant: strict breach of mean + sigma * std, a flat history breaks at 1.5x,
    and a rising deviation is held at 90."""
    z = (amount - mean) / F.when(std != 0, std)
    scaled = F.least(F.rint(z / cfg.sigma * 100 * 10.0) / 10.0, F.lit(90.0))
    return (
        F.when(count < cfg.min_history, 0.0)
        .when(std == 0, F.when(amount > mean * 1.5, 100.0).otherwise(0.0))
        .when(amount > mean + std * cfg.sigma, 100.0)
        .when(z > 1.0, scaled)
        .otherwise(0.0)
    )


def risk_band(score: Column, cfg: RiskConfig) -> Column:
    return (
        F.when(score >= cfg.critical, "CRITICAL")
        .when(score >= cfg.high, "HIGH")
        .when(score >= cfg.medium, "MEDIUM")
        .otherwise("LOW")
    )
