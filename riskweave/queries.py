"""Named queries over the derived transaction table: one per operator."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import RiskConfig
from .operators import behavior, entities, features, graph, linking, rules, scoring, typologies, windows
from .operators.classifier import score_probability, split_by_class, train_classifier
from .operators.hashed_forest import score_hashed
from .operators.isolation_forest import score_anomalies
from .plans.score import score_batch
from .schema import LABEL, nan_to_null
from .session import materialize
from .sources import baselines, state
from .sources.testdata import labelled_transactions, transactions
from .sources.transactions import parse_timestamp

#: Five matches per anchor, the compatible value; ``fuzzy_link_all`` has the library's default.
CFG = RiskConfig(fuzzy_limit=5)
WATERMARK = datetime(2026, 1, 16)
PAGERANK_ROUNDS = 10
TOP_NODES = 1000
# the derived table spans 30 days with about ten transactions per account
QUIET_DAYS = 10
BUSY_HOUR = 1

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        REGISTRY[name] = f
        return f

    return register


def _rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.graph_edges(transactions(spark, sf_dir), CFG)


def scored_by_sender(spark: SparkSession, sf_dir: str, cfg: RiskConfig = CFG) -> DataFrame:
    """All signals and the final score with every account as its own entity and no models."""
    df = typologies.score_typologies(rules.score_rules(transactions(spark, sf_dir), cfg), cfg)
    return scoring.score_risk(behavior.enrich_behavior(df, cfg), cfg)


# ---- sources and state


@query("scan_transactions")
def scan_transactions(spark, sf_dir):
    return nan_to_null(parse_timestamp(transactions(spark, sf_dir)))


@query("scan_training")
def scan_training(spark, sf_dir):
    return nan_to_null(parse_timestamp(labelled_transactions(spark, sf_dir)))


@query("delta_gate")
def delta_gate(spark, sf_dir):
    return state.delta(transactions(spark, sf_dir), WATERMARK).select("transaction_id", "timestamp")


@query("watermark_advance")
def watermark_advance(spark, sf_dir):
    return state.delta(transactions(spark, sf_dir), WATERMARK).agg(*state.watermark_columns())


@query("baseline_merge")
def baseline_merge(spark, sf_dir):
    df = transactions(spark, sf_dir)
    split = F.lit(WATERMARK).cast("timestamp_ntz")
    old = baselines.moments(df.where(F.col("timestamp") <= split), "sender_id")
    new = baselines.moments(df.where(F.col("timestamp") > split), "sender_id")
    return _rounded(baselines.as_baselines(baselines.merge_moments(old, new), "sender_id"), 6, "user_mean", "user_std")


# ---- projections


@query("night_flag")
def night_flag(spark, sf_dir):
    return rules.night_flag(transactions(spark, sf_dir)).select("transaction_id", "is_night_txn")


@query("temporal_features")
def temporal_features(spark, sf_dir):
    return rules.temporal_features(transactions(spark, sf_dir)).select("transaction_id", "hour", "day_of_week", "is_night_txn")


@query("feature_matrix")
def feature_matrix(spark, sf_dir):
    return features.feature_matrix(transactions(spark, sf_dir), features.SUPERVISED_FEATURES)


@query("standardize")
def standardize(spark, sf_dir):
    matrix = features.feature_matrix(transactions(spark, sf_dir), features.ANOMALY_FEATURES)
    return _rounded(features.standardize(matrix, features.ANOMALY_FEATURES), 6, *features.ANOMALY_FEATURES)


@query("distinct_profiles")
def distinct_profiles(spark, sf_dir):
    return linking.distinct_profiles(transactions(spark, sf_dir))


# ---- aggregates


@query("entity_baselines")
def entity_baselines(spark, sf_dir):
    return _rounded(behavior.entity_baselines(transactions(spark, sf_dir)), 6, "user_mean", "user_std")


@query("inflows")
def inflows(spark, sf_dir):
    df = typologies.inflows(transactions(spark, sf_dir)).select("receiver_id", "unique_senders", "total_in_amt")
    return _rounded(df, 2, "total_in_amt")


@query("outflows")
def outflows(spark, sf_dir):
    return _rounded(typologies.outflows(transactions(spark, sf_dir)).select("sender_id", "total_out_amt"), 2, "total_out_amt")


@query("graph_edges")
def graph_edges(spark, sf_dir):
    return _rounded(_edges(spark, sf_dir), 2, "amount")


@query("graph_degrees")
def graph_degrees(spark, sf_dir):
    return graph.graph_degrees(_edges(spark, sf_dir))


@query("degree_pct_rank")
def degree_pct_rank(spark, sf_dir):
    return graph.degree_rank(graph.graph_degrees(_edges(spark, sf_dir))).select("node", "pct_rank")


@query("top_degree_nodes")
def top_degree_nodes(spark, sf_dir):
    return graph.top_degree_nodes(graph.graph_degrees(_edges(spark, sf_dir)), TOP_NODES)


@query("degree_centrality")
def degree_centrality(spark, sf_dir):
    return graph.degree_centrality(graph.graph_degrees(_edges(spark, sf_dir)))


# ---- network


@query("pagerank")
def pagerank(spark, sf_dir):
    edges = materialize(_edges(spark, sf_dir))
    return _rounded(graph.pagerank(edges, iterations=PAGERANK_ROUNDS, tolerance=None).ranks, 8, "score")


@query("cycles_2hop")
def cycles_2hop(spark, sf_dir):
    return graph.two_hop_nodes(_edges(spark, sf_dir))


@query("cycles_3hop")
def cycles_3hop(spark, sf_dir):
    edges = materialize(_edges(spark, sf_dir))
    return graph.three_hop_nodes(edges, graph.graph_degrees(edges))


@query("cycles_3hop_top")
def cycles_3hop_top(spark, sf_dir):
    edges = materialize(_edges(spark, sf_dir))
    return graph.three_hop_nodes(edges, graph.graph_degrees(edges), TOP_NODES)


@query("network_risk")
def network_risk(spark, sf_dir):
    edges = materialize(_edges(spark, sf_dir))
    degrees = materialize(graph.graph_degrees(edges))
    return graph.network_risk(degrees, graph.cycle_nodes(edges, degrees))


@query("graph_features")
def graph_features(spark, sf_dir):
    return _rounded(graph.graph_features(transactions(spark, sf_dir), CFG), 8, "network_pagerank")


# ---- rules and scenarios


@query("rule_structuring")
def rule_structuring(spark, sf_dir):
    return rules.score_structuring(transactions(spark, sf_dir), CFG).select("transaction_id", "structuring_raw")


@query("rule_velocity")
def rule_velocity(spark, sf_dir):
    return rules.score_volume(transactions(spark, sf_dir), CFG).select("transaction_id", "velocity_raw")


@query("rule_geo")
def rule_geo(spark, sf_dir):
    return rules.score_jurisdiction(transactions(spark, sf_dir), CFG).select("transaction_id", "geo_raw")


@query("rules_all")
def rules_all(spark, sf_dir):
    df = rules.score_rules(transactions(spark, sf_dir), CFG)
    return df.select("transaction_id", "structuring_raw", "velocity_raw", "geo_raw")


@query("smurfing_hubs")
def smurfing_hubs(spark, sf_dir):
    hubs = typologies.smurfing_hubs(transactions(spark, sf_dir), CFG)
    return _rounded(hubs.select("account_id", "unique_senders", "total_in_amt", "total_out_amt"), 2, "total_in_amt", "total_out_amt")


@query("u_turns")
def u_turns(spark, sf_dir):
    return typologies.u_turn_senders(transactions(spark, sf_dir), CFG).select("sender_id")


@query("mcc_mismatch")
def mcc_mismatch(spark, sf_dir):
    return typologies.mcc_mismatches(transactions(spark, sf_dir), CFG).select("transaction_id")


@query("typologies")
def typology_scores(spark, sf_dir):
    df = typologies.score_typologies(rules.score_structuring(transactions(spark, sf_dir), CFG), CFG)
    return df.select("transaction_id", "structuring_raw", "behavioral_raw")


@query("behavior_zscore")
def behavior_zscore(spark, sf_dir):
    df = behavior.score_zscore(transactions(spark, sf_dir), CFG)
    return _rounded(df.select("transaction_id", "behavioral_raw"), 4, "behavioral_raw")


@query("behavior_profile")
def behavior_profile(spark, sf_dir):
    df = behavior.profile_features(transactions(spark, sf_dir), CFG)
    return df.select("transaction_id", "hour", "day_of_week", "is_night_txn", "behavioral_raw")


# ---- identity


@query("link_national_id")
def link_national_id(spark, sf_dir):
    return entities.link_national_id(transactions(spark, sf_dir))


@query("fuzzy_pairs")
def fuzzy_pairs(spark, sf_dir):
    return _rounded(linking.fuzzy_edges(transactions(spark, sf_dir), CFG), 6, "score")


@query("fuzzy_link")
def fuzzy_link(spark, sf_dir):
    return linking.fuzzy_link(transactions(spark, sf_dir), CFG)


@query("fuzzy_link_all")
def fuzzy_link_all(spark, sf_dir):
    return linking.fuzzy_link(transactions(spark, sf_dir), replace(CFG, fuzzy_limit=None))


@query("resolve_entities")
def resolve_entities(spark, sf_dir):
    return entities.resolve_entities(transactions(spark, sf_dir), CFG).select("transaction_id", "global_entity_id")


@query("entity_summary")
def entity_summary(spark, sf_dir):
    df = transactions(spark, sf_dir)
    linked = entities.link_national_id(df).withColumnRenamed("primary_id", "global_entity_id")
    mapping = (
        df.select("sender_id")
        .distinct()
        .join(linked, "sender_id", "left")
        .withColumn("global_entity_id", F.coalesce("global_entity_id", "sender_id"))
    )
    return _rounded(entities.entity_summary(entities.resolve_entities(df, CFG, mapping)), 2, "total_exposure")


# ---- models


@query("iforest_score")
def iforest_score(spark, sf_dir):
    """Trees from whole-number draws of md5, which the SQL grows alike."""
    return score_hashed(transactions(spark, sf_dir), CFG).select("transaction_id", "ml_anomaly_score")


@query("iforest_score_sampled")
def iforest_score_sampled(spark, sf_dir):
    """Trees from a random generator, checked by properties."""
    return score_anomalies(transactions(spark, sf_dir), CFG).select("transaction_id", "ml_anomaly_score")


@query("gbt_probability")
def gbt_probability(spark, sf_dir):
    training = train_classifier(labelled_transactions(spark, sf_dir), CFG)
    return score_probability(transactions(spark, sf_dir), training.model).select("transaction_id", "ml_supervised_score")


@query("gbt_holdout")
def gbt_holdout(spark, sf_dir):
    """Rows and positives of both parts of the split by class, and that the held-out scores are probabilities."""
    history = materialize(labelled_transactions(spark, sf_dir))
    training = train_classifier(history, CFG)
    fitted, held = split_by_class(history, CFG)
    label = F.col(LABEL).cast("long")
    counts = fitted.agg(F.count(F.lit(1)).alias("train_rows"), F.sum(label).alias("train_positives"))
    scores = score_probability(held, training.model)
    facts = scores.agg(
        F.count(F.lit(1)).alias("held_out_rows"),
        F.sum(label).alias("held_out_positives"),
        F.min(F.col("ml_supervised_score").between(0, 100)).alias("in_range"),
    )
    # one row meets one row
    return counts.withColumn("one", F.lit(1)).join(facts.withColumn("one", F.lit(1)), "one").drop("one")


def gbt_quality(spark, sf_dir):
    """Accuracy and area under the precision-recall curve of the held-out rows, beside the class share: figures, not laws.

    One row of figures, so not a registered query (those keep every transaction or are stated in SQL)."""
    history = materialize(labelled_transactions(spark, sf_dir))
    training = train_classifier(history, CFG)
    share = history.agg(F.avg(F.col(LABEL).cast("double")).alias("prevalence"))
    return share.select("prevalence", F.lit(training.accuracy).alias("accuracy"), F.lit(training.area_under_pr).alias("area_under_pr"))


# ---- scoring


@query("rule_max")
def rule_max(spark, sf_dir):
    df = scoring.rule_max(rules.score_rules(transactions(spark, sf_dir), CFG))
    return df.select("transaction_id", "norm_rule_score")


@query("ml_normalize")
def ml_normalize(spark, sf_dir):
    df = transactions(spark, sf_dir).select(
        "transaction_id",
        (F.col("user_risk_score") / 100.0).alias("ml_anomaly_score"),
        F.col("user_risk_score").cast("double").alias("ml_supervised_score"),
    )
    return scoring.normalize_models(df)


@query("final_score")
def final_score(spark, sf_dir):
    return scored_by_sender(spark, sf_dir).select("transaction_id", "final_risk_score", "risk_band")


@query("band_histogram")
def band_histogram(spark, sf_dir):
    return scoring.band_histogram(scored_by_sender(spark, sf_dir))


@query("alert_queue")
def alert_queue(spark, sf_dir):
    cfg = replace(CFG, high=40.0)
    queue = scoring.alert_queue(scored_by_sender(spark, sf_dir, cfg))
    return queue.select("transaction_id", "final_risk_score", "risk_band")


@query("run_metrics")
def run_metrics(spark, sf_dir):
    return scoring.run_metrics(scored_by_sender(spark, sf_dir), "sender_id")


@query("score_batch")
def full_batch(spark, sf_dir):
    scored = score_batch(transactions(spark, sf_dir), CFG).select(
        "transaction_id",
        "global_entity_id",
        "network_raw",
        "structuring_raw",
        "velocity_raw",
        "geo_raw",
        "behavioral_raw",
        "final_risk_score",
        "risk_band",
    )
    return _rounded(scored, 4, "behavioral_raw")


# ---- windowed rules and score add-ons


@query("d1_hourly_velocity")
def d1_hourly_velocity(spark, sf_dir):
    return windows.hourly_velocity(transactions(spark, sf_dir), replace(CFG, hourly_limit=BUSY_HOUR))


@query("d2_rapid_movement")
def d2_rapid_movement(spark, sf_dir):
    return windows.rapid_movement(transactions(spark, sf_dir), CFG)


@query("d3_aggregation_24h")
def d3_aggregation_24h(spark, sf_dir):
    return windows.aggregation(transactions(spark, sf_dir), CFG)


@query("d4_new_counterparty")
def d4_new_counterparty(spark, sf_dir):
    return windows.new_counterparties(transactions(spark, sf_dir), CFG)


@query("d5_fan_out")
def d5_fan_out(spark, sf_dir):
    return typologies.fan_out(transactions(spark, sf_dir), CFG)


@query("d6_dormancy")
def d6_dormancy(spark, sf_dir):
    return windows.dormant_reactivations(transactions(spark, sf_dir), replace(CFG, dormant_days=QUIET_DAYS))


@query("d7_rolling_baseline")
def d7_rolling_baseline(spark, sf_dir):
    return _rounded(windows.rolling_baseline(transactions(spark, sf_dir), CFG), 6, "prior_mean", "prior_std")


@query("d8_peer_zscore")
def d8_peer_zscore(spark, sf_dir):
    df = behavior.peer_zscore(transactions(spark, sf_dir)).select("transaction_id", "peer_zscore")
    return _rounded(df, 6, "peer_zscore")


@query("d9_bias")
def d9_bias(spark, sf_dir):
    scored = scored_by_sender(spark, sf_dir, replace(CFG, behavioral_bias=0.10))
    return scored.select("transaction_id", "final_risk_score", "risk_band")


@query("d10_attribution")
def d10_attribution(spark, sf_dir):
    df = scoring.attribution(scored_by_sender(spark, sf_dir), CFG, "none")
    return _rounded(df, 4, "rule_part", "anomaly_part", "supervised_part")


@query("d11_audit_long")
def d11_audit_long(spark, sf_dir):
    return _rounded(scoring.audit_rows(scored_by_sender(spark, sf_dir), "sender_id"), 4, "raw_score")


@query("d13_backtest")
def d13_backtest(spark, sf_dir):
    return scoring.backtest(scored_by_sender(spark, sf_dir), CFG, [20.0, 35.0, 40.0, 45.0])
