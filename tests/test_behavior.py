import pytest
from pyspark.sql import functions as F

from riskweave.config import RiskConfig
from riskweave.operators import behavior
from tests.conftest import at, payments

CFG = RiskConfig()
T0 = at("2026-01-01 00:00:00")


def one_outlier(spark, n):
    return payments(spark, [("s", "r", 100.0, T0)] * (n - 1) + [("s", "r", 500.0, T0)])


def outlier_score(df):
    return df.orderBy(F.desc("amount")).first().behavioral_raw


@pytest.mark.parametrize("n,expected", [(2, 0), (5, 59.63), (10, 94.87), (11, 100)])
def test_zscore(spark, skew, n, expected):
    scored = behavior.score_zscore(one_outlier(spark, n), CFG)
    assert scored.count() == n
    assert round(outlier_score(scored), 2) == expected


@pytest.mark.parametrize("n,expected", [(5, 59.6), (10, 90), (11, 100)])
def test_profile_variant(spark, n, expected):
    assert outlier_score(behavior.score_profile(one_outlier(spark, n), CFG)) == expected


def test_flat_history(spark):
    stored = spark.createDataFrame([("s", 100.0, 0.0, 5)], "sender_id string, user_mean double, user_std double, txn_count long")
    df = payments(spark, [("s", "r", 150.0, T0), ("s", "r", 151.0, T0)])
    scored = behavior.score_profile(df, CFG, stored).orderBy("amount").collect()
    assert [r.behavioral_raw for r in scored] == [0, 100]


def test_single_row_has_no_deviation(spark):
    row = behavior.entity_baselines(payments(spark, [("s", "r", 5.0, T0)])).first()
    assert (row.user_std, row.txn_count) == (0.0, 1)


def test_rows_without_an_account_are_kept(spark, skew):
    df = payments(spark, [(None, "r", 5.0, T0)] * 20 + [("s", "r", 5.0, T0)])
    assert behavior.score_zscore(df, CFG).where("behavioral_raw = 0").count() == 21
