import random
import statistics
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from riskweave.config import RiskConfig
from riskweave.operators import windows
from riskweave.operators.sliding import trailing_sums
from tests.conftest import at, payments

CFG = RiskConfig()
T0 = at("2026-01-01 00:00:00")


@pytest.mark.parametrize("inclusive", [True, False])
def test_trailing_sums_against_brute_force(spark, skew, inclusive):
    rnd = random.Random(5)
    points = {(rnd.choice("aaab"), rnd.randint(0, 400)): rnd.randint(-5, 9) for _ in range(150)}
    df = spark.createDataFrame([(k, t, v) for (k, t), v in points.items()], "k string, at long, v long")
    got = {(r.k, r["at"]): r.trailing_v for r in trailing_sums(df, "k", "at", 50, ["v"], inclusive).collect()}
    expected = {
        (k, t): sum(v for (k2, t2), v in points.items() if k2 == k and t - 50 <= t2 and (t2 <= t if inclusive else t2 < t))
        for k, t in points
    }
    assert got == expected


def random_payments(seed, n, accounts, days):
    rnd = random.Random(seed)
    names = ["hot"] * accounts + [f"a{k}" for k in range(accounts)]
    return [
        (rnd.choice(names), rnd.choice(names), round(rnd.uniform(1, 4000), 2), T0 + timedelta(seconds=600 * rnd.randint(0, days * 144)))
        for _ in range(n)
    ]


def test_velocity_and_aggregation(spark, skew):
    rows = random_payments(1, 250, 6, 3)
    df = payments(spark, rows)
    cfg = CFG.with_options({"hourly_limit": 2})
    fast = {(r.sender_id, r.timestamp): r.txns_last_hour for r in windows.hourly_velocity(df, cfg).collect()}
    expected = {}
    for s, _, _, t in rows:
        n = sum(1 for s2, _, _, t2 in rows if s2 == s and t - timedelta(hours=1) <= t2 <= t)
        if n > 2:
            expected[(s, t)] = n
    assert fast == expected and expected
    got = {(r.sender_id, r.timestamp): (r.window_txns, round(r.window_amount, 2)) for r in windows.aggregation(df, CFG).collect()}
    expected = {}
    for s, _, _, t in rows:
        inside = [a for s2, _, a, t2 in rows if s2 == s and t - timedelta(hours=24) <= t2 <= t]
        if len(inside) >= 5 and round(sum(inside), 4) >= 10000:
            expected[(s, t)] = (len(inside), round(sum(inside), 2))
    assert got == expected and expected


def test_rapid_movement(spark, skew):
    rows = [("x", "m", 1000.0, T0), ("m", "y", 950.0, T0 + timedelta(minutes=30)), ("m", "y", 1.0, T0 + timedelta(minutes=61))]
    got = [(r.account_id, r.received, r.paid) for r in windows.rapid_movement(payments(spark, rows), CFG).collect()]
    assert got == [("m", 1000.0, 950.0)]
    slow = [rows[0], ("m", "y", 949.99, T0 + timedelta(minutes=30))]
    assert windows.rapid_movement(payments(spark, slow), CFG).count() == 0


def test_first_payment_to_a_counterparty(spark):
    rows = [("a", "b", 6000.0, T0 + timedelta(hours=1)), ("a", "b", 10.0, T0), ("a", "c", 5000.0, T0), ("a", "d", 4999.99, T0)]
    got = [(r.receiver_id, r.amount) for r in windows.new_counterparties(payments(spark, rows), CFG).collect()]
    assert got == [("c", 5000.0)]


@pytest.mark.parametrize("days,hit", [(timedelta(days=180), True), (timedelta(days=180) - timedelta(seconds=1), False)])
def test_dormancy(spark, days, hit):
    rows = [("a", "b", 1.0, T0), ("a", "b", 1.0, T0 + days), ("a", "b", 1.0, T0 + days + timedelta(seconds=1))]
    got = windows.dormant_reactivations(payments(spark, rows), CFG).collect()
    assert [r.active_again for r in got] == ([T0 + days] if hit else [])


def test_rolling_baseline_leaves_the_moment_out(spark, skew):
    rows = [r for r in random_payments(4, 160, 4, 200) if r[0] != "a1"]
    got = {(r.sender_id, r.timestamp): r for r in windows.rolling_baseline(payments(spark, rows), CFG).collect()}
    for s, _, _, t in rows:
        past = [a for s2, _, a, t2 in rows if s2 == s and t - timedelta(days=90) <= t2 < t]
        r = got[(s, t)]
        assert r.prior_count == len(past)
        if past:
            assert r.prior_mean == pytest.approx(statistics.mean(past))
        if len(past) > 1:
            assert r.prior_std == pytest.approx(statistics.stdev(past), abs=1e-6)


def test_equal_amounts_have_no_spread(spark):
    rows = [("a", "b", 1234567.89, T0 + timedelta(hours=k)) for k in range(30)]
    last = windows.rolling_baseline(payments(spark, rows), CFG).orderBy(F.desc("timestamp")).first()
    assert (last.prior_count, last.prior_mean, last.prior_std) == (29, 1234567.89, 0.0)
