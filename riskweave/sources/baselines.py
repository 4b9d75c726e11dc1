"""Stored entity statistics: count, mean and squared deviations, which merge exactly enough
to fold a new batch into years of history without reading the history again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import path_exists


def moments(df: DataFrame, key: str, value: str = "amount") -> DataFrame:
    """Per key: n, mean and the sum of squared deviations (m2)."""
    return (
        df.where(F.col(key).isNotNull() & F.col(value).isNotNull())
        .groupBy(F.col(key).alias("key"))
        .agg(
            F.count(value).alias("n"),
            F.avg(value).alias("mean"),
            (F.var_pop(value) * F.count(value)).alias("m2"),
        )
    )


def merge_moments(left: DataFrame, right: DataFrame) -> DataFrame:
    """Combine two moment tables key by key (parallel variance formula). Both sides have one
    row per key, so no key is hot."""
    a, b = left.alias("a"), right.alias("b")
    n_a, n_b = F.coalesce("a.n", F.lit(0)), F.coalesce("b.n", F.lit(0))
    n = n_a + n_b
    gap = F.coalesce(F.col("b.mean") - F.col("a.mean"), F.lit(0.0))
    return a.join(b, F.col("a.key") == F.col("b.key"), "full").select(
        F.coalesce("a.key", "b.key").alias("key"),
        n.alias("n"),
        F.when(n_a == 0, F.col("b.mean")).otherwise(F.col("a.mean") + gap * n_b / n).alias("mean"),
        (F.coalesce("a.m2", F.lit(0.0)) + F.coalesce("b.m2", F.lit(0.0)) + gap * gap * n_a * n_b / n).alias("m2"),
    )


def as_baselines(table: DataFrame, key: str) -> DataFrame:
    """Moments as the mean / sample deviation / count table the scoring joins with."""
    return table.select(
        F.col("key").alias(key),
        F.col("mean").alias("user_mean"),
        F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1))).otherwise(0.0).alias("user_std"),
        F.col("n").alias("txn_count"),
    )


def save_baselines(table: DataFrame, path: str, feature: str, version: int) -> None:
    """One folder per feature and version; a reader never sees a half-written merge."""
    table.write.mode("errorifexists").parquet(f"{path}/feature_name={feature}/version={version}")


def load_baselines(spark: SparkSession, path: str, feature: str) -> DataFrame | None:
    """The newest version of a feature's table, or None."""
    folder = f"{path}/feature_name={feature}"
    if not path_exists(spark, folder):
        return None
    stored = spark.read.parquet(folder)
    newest = stored.agg(F.max("version")).first()[0]
    return stored.where(F.col("version") == newest).drop("version")


def update_baselines(spark: SparkSession, path: str, feature: str, batch: DataFrame) -> int:
    """Merge a batch's moments into the stored table as a new version."""
    stored = load_baselines(spark, path, feature)
    if stored is None:
        save_baselines(batch, path, feature, 1)
        return 1
    version = spark.read.parquet(f"{path}/feature_name={feature}").agg(F.max("version")).first()[0] + 1
    save_baselines(merge_moments(stored, batch), path, feature, version)
    return version
