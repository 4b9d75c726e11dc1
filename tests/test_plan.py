import pytest
from pyspark.sql import functions as F

from riskweave.config import RiskConfig
from riskweave.operators import behavior, graph, rules, scoring, typologies
from riskweave.operators.entities import resolve_entities
from riskweave.plans.score import score_batch
from riskweave.sources.testdata import transactions
from tests.conftest import SF, at, payments

CFG = RiskConfig()
KEEP = ["transaction_id", "global_entity_id", "network_raw", "structuring_raw", "velocity_raw", "geo_raw", "behavioral_raw", "final_risk_score", "risk_band"]


def rows(df):
    return df.select(KEEP).withColumn("behavioral_raw", F.round("behavioral_raw", 6)).orderBy("transaction_id").collect()


def test_batch_plan_equals_operators_in_sequence(spark, skew):
    """The account-table plan against one operator after the other."""
    source = transactions(spark, SF)
    df = resolve_entities(source, CFG)
    df = df.join(graph.graph_features(df, CFG), "global_entity_id", "left")
    df = typologies.score_typologies(rules.score_rules(df, CFG), CFG)
    step_by_step = scoring.score_risk(behavior.enrich_behavior(df, CFG), CFG)
    assert rows(score_batch(source.repartition(5), CFG)) == rows(step_by_step)


@pytest.mark.parametrize("keep,expected", [(False, 0.0), (True, 90.0)])
def test_typology_scores_are_replaced_unless_kept(spark, keep, expected):
    df = payments(spark, [("A", "B", 3000.0, at("2026-01-01 00:00:00"))]).withColumns(
        {"mcc_code": F.lit(5944), "sender_occupation": F.lit("Student"), "sender_name": F.lit("x"), "sender_national_id": F.lit("1")}
    )
    scored = score_batch(df, CFG.with_options({"preserve_typology": keep})).first()
    assert scored.behavioral_raw == expected
