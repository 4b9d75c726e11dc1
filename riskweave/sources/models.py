"""Model store."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from ..session import path_exists


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(spark: SparkSession, path: str) -> PipelineModel | None:
    """The stored model; None where nothing is stored. A damaged model is an error, not a zero score."""
    if not path_exists(spark, f"{path}/metadata"):
        return None
    return PipelineModel.load(path)
