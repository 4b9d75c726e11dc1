"""From raw signals to one score, a band and an alert queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import RiskConfig
from ..functions.numeric import clip, round_half_even, row_max
from ..functions.rules import risk_band
from ..schema import ensure_columns

MODEL_SCORES = ("ml_anomaly_score", "ml_supervised_score")


def raw_columns(df: DataFrame) -> list[str]:
    """Every signal by naming convention, so a new rule is picked up without wiring."""
    return [c for c in df.columns if c.endswith("_raw")]


def rule_max(df: DataFrame) -> DataFrame:
    return df.withColumn("norm_rule_score", row_max(raw_columns(df)))


def normalize_models(df: DataFrame, tops: dict[str, Column] | None = None) -> DataFrame:
    """Model scores on 0-100: a batch whose maximum is at most 1 is taken for probabilities.

    ``tops`` gives maxima known from elsewhere; the others take one pass over the batch."""
    present = [c for c in MODEL_SCORES if c in df.columns]
    scaled = {}
    for name in present:
        top = (tops or {}).get(name)
        top = df.agg(F.max(name).alias("top")).scalar() if top is None else top
        scaled[name] = F.when(top <= 1.0, F.col(name) * 100).otherwise(F.col(name))
    return ensure_columns(df.withColumns(scaled) if scaled else df, {c: 0.0 for c in MODEL_SCORES})


def final_score(cfg: RiskConfig) -> Column:
    weighted = (
        F.col("norm_rule_score") * cfg.rule_weight
        + F.col("ml_anomaly_score") * cfg.anomaly_weight
        + F.col("ml_supervised_score") * cfg.supervised_weight
    )
    if cfg.behavioral_bias:
        weighted = weighted + F.col("behavioral_raw") * cfg.behavioral_bias
    return clip(round_half_even(weighted, 2), 0, 100)


def score_risk(df: DataFrame, cfg: RiskConfig, tops: dict[str, Column] | None = None) -> DataFrame:
    """Weighted score and band from the signals already on the rows."""
    scored = rule_max(normalize_models(df, tops)).withColumn("final_risk_score", final_score(cfg))
    return scored.withColumn("risk_band", risk_band(F.col("final_risk_score"), cfg)).drop("norm_rule_score")


def alert_queue(scored: DataFrame) -> DataFrame:
    return scored.where(F.col("risk_band").isin("HIGH", "CRITICAL"))


def band_histogram(scored: DataFrame) -> DataFrame:
    return scored.groupBy("risk_band").agg(F.count(F.lit(1)).alias("n_txns"))


def metric_columns(df: DataFrame) -> list[Column]:
    """One row of batch figures; also usable as an Observation on the sink write."""
    alert = F.col("risk_band").isin("HIGH", "CRITICAL")
    hits = [F.coalesce(F.sum((F.col(c) > 0).cast("long")), F.lit(0)).alias(f"{c}_hits") for c in raw_columns(df)]
    return [
        F.count(F.lit(1)).alias("n_txns"),
        F.coalesce(F.sum(alert.cast("long")), F.lit(0)).alias("n_alerts"),
        F.max("final_risk_score").alias("max_score"),
        *hits,
    ]


def run_metrics(scored: DataFrame, entity: str = "global_entity_id") -> DataFrame:
    """Batch figures plus the number of entities."""
    return scored.agg(*metric_columns(scored), F.count_distinct(entity).alias("n_entities"))


def attribution(scored: DataFrame, cfg: RiskConfig, model_version: str) -> DataFrame:
    """How much each silo adds to the score, the leading rule, and the model that scored."""
    names = sorted(raw_columns(scored))
    best = row_max(names)
    leading = F.coalesce(*[F.when((best > 0) & (F.col(n) == best), F.lit(n)) for n in names], F.lit("none"))
    return scored.select(
        "transaction_id",
        (best * cfg.rule_weight).alias("rule_part"),
        (F.col("ml_anomaly_score") * cfg.anomaly_weight).alias("anomaly_part"),
        (F.col("ml_supervised_score") * cfg.supervised_weight).alias("supervised_part"),
        leading.alias("top_rule"),
        F.lit(model_version).alias("model_version"),
        "final_risk_score",
    )


def audit_rows(scored: DataFrame, entity: str = "global_entity_id") -> DataFrame:
    """One row per transaction and firing rule."""
    names = sorted(raw_columns(scored))
    fired = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).cast("double").alias("raw_score")) for n in names])
    return scored.select("transaction_id", entity, F.inline(fired)).where(F.col("raw_score") > 0)


def backtest(scored: DataFrame, cfg: RiskConfig, thresholds: list[float]) -> DataFrame:
    """Alerts there would be at each alert threshold, in one pass over the batch."""
    counts = scored.agg(
        *[F.sum((F.col("final_risk_score") >= t).cast("long")).alias(f"t{i}") for i, t in enumerate(thresholds)]
    )
    rows = F.array(
        *[
            F.struct(F.lit(float(t)).alias("threshold"), F.coalesce(F.col(f"t{i}"), F.lit(0)).alias("n_alerts"))
            for i, t in enumerate(thresholds)
        ]
    )
    return counts.select(F.inline(rows))
