from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from riskweave.config import RiskConfig
from riskweave.operators.behavior import entity_baselines
from riskweave.plans.run import run
from riskweave.sources import baselines, state, transactions
from riskweave.sources.testdata import labelled_transactions
from riskweave.sources.testdata import transactions as derived
from tests.conftest import SF, at, payments

CFG = RiskConfig(forest_trees=10)
T0 = at("2026-01-01 00:00:00")


def test_delta_is_strict(spark):
    df = payments(spark, [("a", "b", 1.0, t) for t in (T0 - timedelta(seconds=1), T0, T0 + timedelta(seconds=1), None)])
    assert [r.timestamp for r in state.delta(df, T0).collect()] == [T0 + timedelta(seconds=1)]


def test_state_life_cycle(spark, tmp_path):
    path = str(tmp_path / "state")
    assert state.load_state(spark, path).last_run_timestamp == state.EPOCH
    assert state.advance_state(spark, path, None, 0).total_processed_to_date == 0
    state.advance_state(spark, path, T0, 5)
    after = state.advance_state(spark, path, T0 + timedelta(days=1), 2)
    assert (after.last_run_timestamp, after.total_processed_to_date) == (T0 + timedelta(days=1), 7)
    (tmp_path / "state" / "part-broken.json").write_text("{not json\n")
    assert state.load_state(spark, path) == after
    assert state.reset_state(spark, path).last_run_timestamp == state.EPOCH
    assert state.load_state(spark, path).total_processed_to_date == 0


def test_filter_reaches_the_scan(spark):
    df = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "ts")
    plan = state.delta(df, at("2024-01-02 00:00:00"), "ts")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThan(ts" in plan


def test_run_then_rerun(spark, tmp_path):
    source, out, marks = derived(spark, SF), str(tmp_path / "out"), str(tmp_path / "state")
    early = source.where(F.col("timestamp") < at("2026-01-20 00:00:00"))
    first = run(spark, early, out, marks, CFG)
    assert first.rows == early.count() and first.output
    second = run(spark, source, out, marks, CFG)
    assert first.rows + second.rows == source.count()
    third = run(spark, source, out, marks, CFG)
    assert third.rows == 0 and third.output is None and third.watermark == second.watermark
    written = spark.read.parquet(first.output)
    assert written.count() == first.rows and first.max_score == written.agg(F.max("final_risk_score")).first()[0]
    assert written.where("final_risk_score < 0 OR final_risk_score > 100").count() == 0
    bands = [r[0] for r in written.groupBy("risk_band").agg(F.min("final_risk_score").alias("s")).orderBy("s").collect()]
    assert bands == [b for b in ("LOW", "MEDIUM", "HIGH", "CRITICAL") if b in bands]


def test_a_run_repeated_before_its_state_was_written_leaves_no_copy(spark, tmp_path, monkeypatch):
    source, out, marks = derived(spark, SF), str(tmp_path / "out"), str(tmp_path / "state")
    advance = state.advance_state

    def stop(*_):
        raise RuntimeError("stopped")

    for _ in range(2):
        monkeypatch.setattr(state, "advance_state", stop)
        with pytest.raises(RuntimeError):
            run(spark, source, out, marks, CFG)
    monkeypatch.setattr(state, "advance_state", advance)
    run(spark, source, out, marks, CFG)
    assert spark.read.parquet(f"{out}/scored").count() == source.count()
    assert state.load_state(spark, marks).total_processed_to_date == source.count()


def test_csv_files_of_another_column_order_are_refused(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text("transaction_id,sender_id,receiver_id\nx,s,r\n")
    (folder / "b.csv").write_text("transaction_id,receiver_id,sender_id\ny,r,s\n")
    with pytest.raises(Exception):
        transactions.scan_csv(spark, str(folder)).collect()
    (folder / "b.csv").write_text("transaction_id,sender_id,receiver_id\ny,s,r\n")
    rows = transactions.scan_csv(spark, str(folder)).collect()
    assert {(r.sender_id, r.receiver_id) for r in rows} == {("s", "r")}


def test_failed_sink_leaves_the_watermark(spark, tmp_path):
    source, out, marks = derived(spark, SF), str(tmp_path / "out"), str(tmp_path / "state")
    (tmp_path / "out" / "scored" / "run=x").mkdir(parents=True)
    with pytest.raises(Exception):
        run(spark, source, out, marks, CFG, run_id="x")
    assert state.load_state(spark, marks).last_run_timestamp == state.EPOCH


def test_csv_round_trip(spark, tmp_path):
    rows = labelled_transactions(spark, SF)
    target = transactions.write_scored(rows, str(tmp_path / "csv"), "r1", "csv")
    back = transactions.scan_training(spark, target, "csv").select(rows.columns)
    assert back.schema["timestamp"].dataType == rows.schema["timestamp"].dataType
    assert back.exceptAll(rows).count() == 0 and back.count() == rows.count()
    with pytest.raises(Exception):
        transactions.write_scored(rows, str(tmp_path / "csv"), "r1", "csv")


def test_bad_values_become_null(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text("transaction_id,timestamp,amount,extra\nx,2026-01-01T10:00:00,NaN,q\ny,yesterday,5.5,q\n")
    x, y = transactions.scan_csv(spark, str(folder)).orderBy("transaction_id").collect()
    assert (x.timestamp, x.amount, x.extra) == (at("2026-01-01 10:00:00"), None, "q")
    assert (y.timestamp, y.amount) == (None, 5.5)
    with pytest.raises(ValueError):
        transactions.scan_training(spark, str(folder), "csv")


def test_baselines_merge_like_one_batch(spark, tmp_path):
    rows = [("a", "b", float(v), T0) for v in (1, 2, 5, 9, 11)] + [("c", "b", 4.0, T0)]
    df, path = payments(spark, rows), str(tmp_path / "stats")
    assert baselines.load_baselines(spark, path, "amount") is None
    for part in ("amount < 5", "amount >= 5"):
        baselines.update_baselines(spark, path, "amount", baselines.moments(df.where(part), "sender_id"))
    stored = baselines.as_baselines(baselines.load_baselines(spark, path, "amount"), "sender_id")
    got = {r.sender_id: tuple(r)[1:] for r in stored.collect()}
    for r in entity_baselines(df).collect():
        assert got[r.sender_id] == pytest.approx(tuple(r)[1:])
