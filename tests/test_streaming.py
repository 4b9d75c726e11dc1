from datetime import timedelta

from pyspark.sql import functions as F

from riskweave.config import RiskConfig
from riskweave.operators.behavior import entity_baselines, score_zscore
from riskweave.sources import state
from riskweave.sources.testdata import transactions
from riskweave.streaming import monitor
from tests.conftest import SF, at, payments

CFG = RiskConfig(forest_trees=10)
T0 = at("2026-01-01 00:00:00")


def arrived(spark, tmp_path, files=3):
    source = transactions(spark, SF)
    folder = str(tmp_path / "in")
    source.repartition(files).write.parquet(folder)
    return source, folder


def drain(stream, spark, name, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(300)
    return spark.table(name)


def test_row_rules_equal_batch(spark, tmp_path):
    source, folder = arrived(spark, tmp_path)
    stream = monitor.read_stream(spark, folder, source.schema, max_files=1)
    got = drain(monitor.row_rules(stream, CFG), spark, "row_rules")
    expected = monitor.row_rules(source, CFG)
    assert got.count() == expected.count() and got.exceptAll(expected).count() == 0


def test_behavior_against_stored_baselines(spark, tmp_path):
    source, folder = arrived(spark, tmp_path)
    stored = entity_baselines(source)
    stream = monitor.read_stream(spark, folder, source.schema)
    got = drain(monitor.behavior_against_baselines(stream, stored, CFG), spark, "behavior").select("transaction_id", "behavioral_raw")
    expected = score_zscore(source, CFG).select("transaction_id", "behavioral_raw")
    rounded = [d.withColumn("behavioral_raw", F.round("behavioral_raw", 6)) for d in (got, expected)]
    assert rounded[0].exceptAll(rounded[1]).count() == 0 and got.count() == source.count()


def test_velocity_windows(spark, tmp_path):
    df = payments(spark, [("a", "b", 1.0, T0 + timedelta(minutes=k)) for k in range(7)] + [("c", "b", 1.0, T0)])
    folder = str(tmp_path / "in")
    df.write.parquet(folder)
    stream = monitor.read_stream(spark, folder, df.schema)
    got = drain(monitor.velocity_windows(stream, CFG), spark, "velocity", "complete").collect()
    assert {r.sender_id for r in got} == {"a"} and max(r.n_txns for r in got) == 7


def test_micro_batches_are_scored_once(spark, tmp_path):
    source, folder = arrived(spark, tmp_path, files=2)
    out, marks, ckpt = str(tmp_path / "out"), str(tmp_path / "state"), str(tmp_path / "ckpt")

    def go(strict=False):
        stream = monitor.read_stream(spark, folder, source.schema, max_files=1)
        monitor.start_monitor(spark, stream, out, ckpt, CFG, state_path=marks, strict_highwater=strict).awaitTermination(600)
        return spark.read.parquet(out).count()

    assert go() == source.count()
    assert go() == source.count()
    assert state.load_state(spark, marks).total_processed_to_date == source.count()
    # a late file: dropped by the strict high-water mark
    source.limit(5).coalesce(1).write.mode("append").parquet(folder)
    assert go(strict=True) == source.count()


def test_state_is_made_up_for_after_a_stop_between_write_and_state(spark, tmp_path, monkeypatch):
    source = transactions(spark, SF)
    out, marks = str(tmp_path / "out"), str(tmp_path / "state")
    advance = state.advance_state

    def stop(*_):
        raise RuntimeError("stopped")

    monkeypatch.setattr(state, "advance_state", stop)
    for _ in range(2):
        try:
            monitor.score_micro_batch(spark, out, CFG, state_path=marks)(source, 3)
        except RuntimeError:
            pass
    monkeypatch.setattr(state, "advance_state", advance)
    for _ in range(2):
        monitor.score_micro_batch(spark, out, CFG, state_path=marks)(source, 3)
    after = state.load_state(spark, marks)
    assert after.total_processed_to_date == source.count() == spark.read.parquet(out).count()
    assert after.last_run_timestamp == source.agg(F.max("timestamp")).first()[0]


def test_exact_windows_equal_batch_across_files(spark, tmp_path):
    """A burst crosses file borders, a row comes late within the lateness; D1 and D3 on the stream equal the batch."""
    from datetime import timedelta as td

    from riskweave.operators import windows
    from riskweave.streaming import trailing

    cfg = RiskConfig(hourly_limit=3, aggregation_count=4, aggregation_amount=5000.0, aggregation_hours=24)
    burst = [("a", "x", 100.0, T0 + td(minutes=7 * k)) for k in range(8)]
    slow = [("b", "y", 1500.0, T0 + td(hours=5 * k, seconds=k)) for k in range(6)]
    same = [("c", "y", 10.0, T0 + td(minutes=30))] * 5
    # One watermark serves all senders: files follow time, but the rows at 21 and 28 minutes swap files (7 < 10 minutes late).
    ordered = sorted(burst + slow + same, key=lambda r: r[3])
    border = ordered.index(burst[4])
    ordered[border - 1], ordered[border] = ordered[border], ordered[border - 1]
    files = [ordered[:border], ordered[border : border + 8], ordered[border + 8 :]]
    folder = str(tmp_path / "in")
    for k, rows in enumerate(files):
        one = payments(spark, rows).withColumn("transaction_id", F.concat(F.lit(f"f{k}-"), "transaction_id")).coalesce(1)
        one.write.mode("append").parquet(folder)  # one part a file, so a file is one micro-batch
    clock = payments(spark, [("~clock", "z", 1.0, T0 + td(days=30))])
    clock.withColumn("transaction_id", F.lit("clock")).coalesce(1).write.mode("append").parquet(folder)
    schema = spark.read.parquet(folder).schema
    stream = monitor.read_stream(spark, folder, schema, max_files=1)
    sums = trailing.trailing_stream(stream, cfg)
    got = drain(sums, spark, "trailing_sums").where("sender_id != '~clock'")
    source = spark.read.parquet(folder).where("sender_id != '~clock'")
    d1, d3 = windows.hourly_velocity(source, cfg), windows.aggregation(source, cfg)
    assert d1.count() > 0 and d3.count() > 0
    for mine, batch in ((trailing.velocity_exact(got, cfg), d1), (trailing.aggregation_exact(got, cfg), d3)):
        assert mine.count() == batch.count() and mine.exceptAll(batch.select(mine.columns)).count() == 0
