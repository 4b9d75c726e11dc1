import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from riskweave.config import RiskConfig
from riskweave.operators import typologies
from tests.conftest import at, payments

CFG = RiskConfig()
T0 = at("2026-01-01 12:00:00")


def seconds(n):
    return T0 + timedelta(seconds=n)


@pytest.mark.parametrize("senders,out,hub", [(10, 800.0, True), (10, 799.0, False), (9, 800.0, False)])
def test_smurfing_hub(spark, senders, out, hub):
    df = payments(spark, [(f"s{k}", "H", 100.0, T0) for k in range(senders)] + [("H", "x", out, T0)])
    assert [r.account_id for r in typologies.smurfing_hubs(df, CFG).collect()] == (["H"] if hub else [])


@pytest.mark.parametrize("gap,hit", [(86_399, True), (86_400, False), (0, False), (1, True)])
def test_u_turn_limits(spark, gap, hit):
    df = payments(spark, [("A", "B", 1.0, T0), ("B", "A", 1.0, seconds(gap))])
    assert [r.sender_id for r in typologies.u_turn_senders(df, CFG).collect()] == (["A"] if hit else [])


def test_u_turn_to_oneself(spark):
    df = payments(spark, [("A", "A", 1.0, T0), ("A", "A", 1.0, seconds(10)), ("B", "B", 1.0, T0)])
    assert [r.sender_id for r in typologies.u_turn_senders(df, CFG).collect()] == ["A"]


def test_u_turns_against_all_pairs(spark, skew):
    rnd = random.Random(3)
    rows = [(f"a{rnd.randint(0, 30)}", f"a{rnd.randint(0, 30)}", 1.0, seconds(rnd.randint(0, 10 * 86_400))) for _ in range(220)]
    expected = {
        s for s, r, _, t in rows for s2, r2, _, t2 in rows if (s2, r2) == (r, s) and 0 < (t2 - t).total_seconds() < 86_400
    }
    got = [r.sender_id for r in typologies.u_turn_senders(payments(spark, rows), CFG).collect()]
    assert sorted(got) == sorted(expected) and 0 < len(expected) < 31


def profile_rows(spark, rows):
    return spark.createDataFrame(
        [(f"t{k}", f"s{k}", "r", T0, *row) for k, row in enumerate(rows)],
        "transaction_id string, sender_id string, receiver_id string, timestamp timestamp_ntz, "
        "mcc_code int, sender_occupation string, amount double",
    )


def test_integration_mismatch(spark):
    df = profile_rows(spark, [(5944, "Student", 2000.0), (5944, "Student", 1999.99), (5411, "Student", 5000.0)])
    assert [r.transaction_id for r in typologies.mcc_mismatches(df, CFG).collect()] == ["t0"]


def test_mismatch_wins_over_u_turn(spark, skew):
    df = payments(spark, [("A", "B", 3000.0, T0), ("A", "C", 1.0, T0), ("B", "A", 1.0, seconds(60))])
    df = df.withColumn("mcc_code", F.when(F.col("amount") > 5, 5944).otherwise(1)).withColumn("sender_occupation", F.lit("Student"))
    scored = typologies.score_typologies(df, CFG).orderBy("transaction_id").collect()
    assert [r.behavioral_raw for r in scored] == [90, 80, 0]
    assert [r.structuring_raw for r in scored] == [0, 0, 0]


def test_hub_rows_on_both_sides(spark, skew):
    rows = [(f"s{k}", "H", 100.0, T0) for k in range(12)] + [("H", "x", 1200.0, T0), ("q", "z", 1.0, T0)]
    df = payments(spark, rows).withColumn("mcc_code", F.lit(1)).withColumn("sender_occupation", F.lit("Clerk"))
    scored = typologies.score_typologies(df, CFG).orderBy("transaction_id").collect()
    assert [r.structuring_raw for r in scored] == [100.0] * 13 + [0.0]


def test_fan_out(spark):
    df = payments(spark, [("a", f"r{k % 10}", 1.0, T0) for k in range(30)] + [("b", f"r{k}", 1.0, T0) for k in range(9)])
    assert [tuple(r) for r in typologies.fan_out(df, CFG).collect()] == [("a", 10)]
