"""One monitoring run: new rows in, scored rows and state out."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..config import RiskConfig
from ..operators.classifier import train_classifier
from ..operators.scoring import alert_queue, metric_columns
from ..sources import state
from ..sources.models import load_model, save_model
from ..sources.transactions import write_scored
from .score import fit_models, score_batch


@dataclass
class RunReport:
    rows: int
    alerts: int
    max_score: float | None
    watermark: datetime
    output: str | None
    metrics: dict


def ensure_model(spark: SparkSession, path: str, history: DataFrame | None, cfg: RiskConfig):
    """The stored classifier; trained from history once if there is none yet."""
    model = load_model(spark, path)
    if model is None and history is not None:
        save_model(train_classifier(history, cfg).model, path)
        model = load_model(spark, path)
    return model


def run(
    spark: SparkSession,
    source: DataFrame,
    output: str,
    state_path: str,
    cfg: RiskConfig | None = None,
    model_path: str | None = None,
    history: DataFrame | None = None,
    run_id: str | None = None,
) -> RunReport:
    """Score the rows after the stored watermark, write them and their alerts, advance the watermark.

    The figures are observed while the sink is written; the batch is not read again for them. Without a
    ``run_id`` the run is named after the state's next number: a run that stopped before its state was written is
    repeated under the same name and replaces what it left."""
    cfg = cfg or RiskConfig()
    before = state.load_state(spark, state_path)
    batch = state.delta(source, before.last_run_timestamp)
    if batch.isEmpty():
        return RunReport(0, 0, None, before.last_run_timestamp, None, {})
    classifier = ensure_model(spark, model_path, history, cfg) if model_path else None
    scored = score_batch(batch, cfg, fit_models(batch, cfg, classifier))
    seen = Observation("run_metrics")
    observed = scored.observe(
        seen, *metric_columns(scored), F.max("timestamp").cast("string").alias("max_timestamp")
    )
    mode = "errorifexists" if run_id else "overwrite"
    run_id = run_id or f"{before.seq + 1:012d}"
    target = write_scored(observed, f"{output}/scored", run_id, mode=mode)
    figures = seen.get
    write_scored(alert_queue(spark.read.parquet(target)), f"{output}/alerts", run_id, mode=mode)
    newest = figures.pop("max_timestamp")
    mark = None if newest is None else datetime.fromisoformat(newest)
    after = state.advance_state(spark, state_path, mark, figures["n_txns"])
    return RunReport(
        figures["n_txns"], figures["n_alerts"], figures["max_score"], after.last_run_timestamp, target, figures
    )
