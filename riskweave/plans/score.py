"""The whole batch: identity, network, rules, scenarios, behaviour, models, final score.

Everything that needs more than one row is worked out per account or per pair first, with
map-side combining, straight from the scan. What an account contributes to its rows is then
gathered into one account table, so the transactions themselves are shuffled twice: once to
meet their sender's facts, once to meet their receiver's. Nothing of their size is stored
in between."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import RiskConfig
from ..functions import rules as rule_columns
from ..operators import graph
from ..operators.classifier import score_probability
from ..operators.entities import account_entities
from ..operators.isolation_forest import Forest, fit_forest
from ..operators.rules import night_flag, score_rules
from ..operators.scoring import score_risk
from ..operators.skew import heaviest, hot_keys, skew_join
from ..operators.typologies import smurfing_hubs, typology_scores, u_turn_senders
from ..session import materialize, together


@dataclass
class Models:
    """What scores the rows besides the rules. None leaves a model's score at 0."""

    forest: Forest | None = None
    classifier: PipelineModel | None = None


def sender_moments(df: DataFrame) -> DataFrame:
    """Per sender: rows, amounts, their mean and squared deviations."""
    return (
        df.where(F.col("sender_id").isNotNull())
        .groupBy("sender_id")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count("amount").alias("n"),
            F.avg("amount").alias("mean"),
            (F.var_pop("amount") * F.count("amount")).alias("m2"),
        )
    )


def entity_statistics(senders: DataFrame, mapping: DataFrame) -> DataFrame:
    """Baselines of entities out of the moments of their accounts."""
    known = senders.join(mapping, "sender_id").where(F.col("n") > 0)
    means = known.groupBy("global_entity_id").agg(
        (F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("user_mean"), F.count(F.lit(1)).alias("accounts")
    )
    hot = heaviest(means, "global_entity_id", "accounts")
    around = skew_join(known, means.drop("accounts"), "global_entity_id", "sender_id", "inner", hot)
    gap = F.col("mean") - F.col("user_mean")
    merged = around.groupBy("global_entity_id").agg(
        F.first("user_mean").alias("user_mean"),
        F.sum(F.col("m2") + F.col("n") * gap * gap).alias("m2"),
        F.sum("n").alias("txn_count"),
    )
    std = F.when(F.col("txn_count") > 1, F.sqrt(F.try_divide("m2", F.col("txn_count") - 1))).otherwise(0.0)
    return merged.select("global_entity_id", "user_mean", std.alias("user_std"), "txn_count")


def entity_edges(df: DataFrame, mapping: DataFrame, cfg: RiskConfig) -> DataFrame:
    """Network edges from entity to receiving account (or entity), summed per account pair first."""
    pairs = graph.graph_edges(df, cfg, "sender_id")
    fan = pairs.groupBy("src").agg(F.count(F.lit(1)).alias("fan"))
    source = mapping.select(F.col("sender_id").alias("src"), F.col("global_entity_id").alias("entity"))
    pairs = skew_join(pairs, source, "src", "dst", "inner", heaviest(fan, "src", "fan"))
    if cfg.resolve_receivers:
        target = mapping.select(F.col("sender_id").alias("dst"), F.col("global_entity_id").alias("receiver_entity"))
        pairs = skew_join(pairs, target, "dst", "src", "left", hot_keys(pairs, "dst"))
        pairs = pairs.withColumn("dst", F.coalesce("receiver_entity", "dst"))
    return pairs.groupBy(F.col("entity").alias("src"), "dst").agg(F.sum("amount").alias("amount"))


def account_facts(
    cfg: RiskConfig, mapping: DataFrame, senders: DataFrame, hubs: DataFrame, turns: DataFrame, entities: DataFrame
) -> DataFrame:
    """One row per sending account: entity, network features, baseline, scenario flags, rows."""
    hub = hubs.select(F.col("account_id").alias("sender_id"), F.lit(True).alias("_sender_hub"))
    turn = turns.select("sender_id", F.lit(True).alias("_u_turn"))
    accounts = (
        mapping.join(senders.select("sender_id", "rows"), "sender_id")
        .join(hub, "sender_id", "left")
        .join(turn, "sender_id", "left")
        .withColumns({c: F.coalesce(c, F.lit(False)) for c in ("_sender_hub", "_u_turn")})
    )
    hot = hot_keys(mapping, "global_entity_id")
    return skew_join(accounts, entities, "global_entity_id", "sender_id", "left", hot)


def add_models(df: DataFrame, models: Models) -> tuple[DataFrame, dict[str, Column]]:
    """Model scores on the bare scan, with their batch maxima."""
    tops: dict[str, Column] = {}
    if models.forest is not None:
        df = models.forest.score(df)
        tops["ml_anomaly_score"] = F.lit(models.forest.top_score)
    df = score_probability(df, models.classifier)
    if models.classifier is not None:
        tops["ml_supervised_score"] = df.agg(F.max("ml_supervised_score").alias("top")).scalar()
    else:
        tops["ml_supervised_score"] = F.lit(0.0)
    return df, tops


def score_batch(
    df: DataFrame, cfg: RiskConfig, models: Models | None = None, baselines: DataFrame | None = None
) -> DataFrame:
    """Every input row with its entity, all signals, final_risk_score and risk_band.

    ``baselines`` replaces the batch's own entity statistics by stored ones."""
    spark = df.sparkSession
    mapping, hubs, turns, senders = together(
        spark,
        lambda: materialize(account_entities(df, cfg)),
        lambda: materialize(smurfing_hubs(df, cfg)),
        lambda: materialize(u_turn_senders(df, cfg)),
        lambda: materialize(sender_moments(df)),
    )
    network, statistics = together(
        spark,
        lambda: graph.features_of(entity_edges(df, mapping, cfg), cfg),
        lambda: materialize(entity_statistics(senders, mapping)) if baselines is None else baselines,
    )
    entities = network.join(statistics, "global_entity_id", "full")
    accounts = materialize(account_facts(cfg, mapping, senders, hubs, turns, entities))

    rows, tops = add_models(df, models or Models())
    rows = score_rules(night_flag(rows), cfg)
    rows = skew_join(
        rows, accounts.drop("rows"), "sender_id", "transaction_id", "left", heaviest(accounts, "sender_id", "rows")
    )
    rows = rows.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("_sender_hub", "_u_turn")})
    receivers = hubs.select(F.col("account_id").alias("receiver_id"), F.lit(True).alias("_receiver_hub"))
    weights = hubs.select(F.col("account_id").alias("receiver_id"), "in_rows")
    rows = skew_join(rows, receivers, "receiver_id", "transaction_id", "left", heaviest(weights, "receiver_id", "in_rows"))
    rows = rows.withColumn("_receiver_hub", F.coalesce("_receiver_hub", F.lit(False)))

    rows = typology_scores(rows, cfg, "_sender_hub", "_receiver_hub", "_u_turn")
    z = rule_columns.zscore_score(F.col("amount"), F.col("user_mean"), F.col("user_std"), F.col("txn_count"), cfg)
    behavior = F.greatest("behavioral_raw", z) if cfg.preserve_typology else z
    rows = rows.withColumn("behavioral_raw", behavior).drop("user_mean", "user_std", "txn_count")
    return score_risk(rows, cfg, tops)


def fit_models(df: DataFrame, cfg: RiskConfig, classifier: PipelineModel | None = None) -> Models:
    """The forest is refitted on every batch; the classifier comes from training."""
    return Models(fit_forest(df, cfg), classifier)
