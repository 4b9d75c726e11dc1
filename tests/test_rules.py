from datetime import datetime

import pytest
from pyspark.sql import functions as F

from riskweave.config import RiskConfig, load_config
from riskweave.functions.numeric import round_half_even
from riskweave.operators import rules, scoring
from riskweave.schema import nan_to_null

CFG = RiskConfig()


def column(df, name):
    return [r[name] for r in df.orderBy("k").collect()]


def numbered(spark, values, schema):
    rows = [(k, *(v if isinstance(v, tuple) else (v,))) for k, v in enumerate(values)]
    return spark.createDataFrame(rows, "k int, " + schema)


def test_structuring_band(spark):
    df = numbered(spark, [8999.99, 9000.0, 9999.99, 10000.0, None], "amount double")
    assert column(rules.score_structuring(df, CFG), "structuring_raw") == [0, 100, 100, 0, 0]
    bare = df.select("k")
    assert rules.score_structuring(bare, CFG).columns == ["k"]


def test_volume_breach(spark):
    pairs = [(199.0, 100.0), (200.0, 100.0), (300.0, 100.0), (500.0, 100.0), (3.0, 0.0), (5.0, None)]
    df = numbered(spark, pairs, "amount double, expected_monthly_vol double")
    assert column(rules.score_volume(df, CFG), "velocity_raw") == [0, 50, 75, 100, 75, 0]
    assert column(rules.score_volume(df.select("k", "amount"), CFG), "velocity_raw") == [0.0] * 6


def test_jurisdiction(spark):
    df = numbered(spark, ["KY", "US", None], "receiver_country string")
    assert column(rules.score_jurisdiction(df, CFG), "geo_raw") == [100, 0, 0]
    assert column(rules.score_jurisdiction(df.select("k"), CFG), "geo_raw") == [0.0] * 3


def test_night_and_weekday(spark):
    times = [datetime(2026, 1, 5, h, m) for h, m in ((0, 59), (1, 0), (4, 59), (5, 0))]
    df = rules.temporal_features(numbered(spark, times, "timestamp timestamp_ntz"))
    assert column(df, "is_night_txn") == [0, 1, 1, 0]
    assert column(df, "day_of_week") == [0] * 4  # a Monday
    assert rules.night_flag(df.select("k")).columns == ["k"]


def test_bands_and_weights(spark):
    scores = [84.99, 85.0, 65.0, 64.99, 35.0, 34.99, None]
    df = numbered(spark, scores, "s double").select("k", scoring.risk_band(F.col("s"), CFG).alias("b"))
    assert column(df, "b") == ["HIGH", "CRITICAL", "HIGH", "MEDIUM", "MEDIUM", "LOW", "LOW"]
    signals = numbered(spark, [(100.0, 55.7, 73.0)], "x_raw double, ml_anomaly_score double, ml_supervised_score double")
    row = scoring.score_risk(signals, CFG).first()
    assert (row.final_risk_score, row.risk_band) == (79.96, "HIGH")


@pytest.mark.parametrize("top,expected", [(1.0, [50.0, 100.0]), (1.01, [0.5, 1.01])])
def test_model_scale_is_found_from_the_batch(spark, top, expected):
    df = numbered(spark, [0.5, top], "ml_anomaly_score double")
    assert column(scoring.normalize_models(df), "ml_anomaly_score") == expected
    assert column(scoring.normalize_models(df), "ml_supervised_score") == [0.0, 0.0]


def test_rule_max_skips_unknown_signals(spark):
    df = numbered(spark, [(None, 20.0), (30.0, 20.0), (None, None)], "a_raw double, b_raw double")
    assert column(scoring.rule_max(df), "norm_rule_score") == [20.0, 30.0, None]
    assert column(scoring.rule_max(df.select("k")), "norm_rule_score") == [0.0] * 3


def test_nan_is_not_a_high_score(spark):
    df = nan_to_null(numbered(spark, [float("nan"), 90.0], "x_raw double"))
    assert column(scoring.score_risk(df, CFG), "risk_band") == ["LOW", "MEDIUM"]


def test_rounding_is_half_even_on_the_scaled_value(spark):
    df = numbered(spark, [0.125, 0.375, 1.015], "x double").select("k", round_half_even(F.col("x"), 2).alias("y"))
    assert column(df, "y") == [0.12, 0.38, 1.01]


def test_attribution_audit_and_backtest(spark):
    df = numbered(
        spark, [("a", "e", 10.0, 80.0), ("b", "e", 0.0, 0.0)],
        "transaction_id string, global_entity_id string, a_raw double, b_raw double",
    )
    scored = scoring.score_risk(df, CFG)
    first = scoring.attribution(scored, CFG, "m1").orderBy("transaction_id").collect()
    assert [(r.top_rule, round(r.rule_part, 6), r.model_version) for r in first] == [("b_raw", 36.0, "m1"), ("none", 0.0, "m1")]
    assert {(r.transaction_id, r.rule) for r in scoring.audit_rows(scored).collect()} == {("a", "a_raw"), ("a", "b_raw")}
    assert [(r.threshold, r.n_alerts) for r in scoring.backtest(scored, CFG, [30.0, 40.0]).collect()] == [(30.0, 1), (40.0, 0)]


def test_config_rejects_unknown_settings(tmp_path):
    with pytest.raises(KeyError):
        RiskConfig().with_options({"n_estimator": 5})
    path = tmp_path / "c.yaml"
    path.write_text("fuzzy_threshold: 0.9\nhigh_risk_jurisdictions: [XX]\n")
    cfg = load_config(str(path))
    assert cfg.fuzzy_threshold == 90.0 and cfg.high_risk_jurisdictions == ("XX",)
