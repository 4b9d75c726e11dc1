"""Joins that stay balanced when one key holds a large share of the rows.

A key is hot from ``spark.riskweave.hotKeyRows`` rows on. There are at most rows / threshold
of them, a megabyte or so for 10^11 rows, so that list alone is broadcast; all of them are salted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shuffle_width

HOT_KEY_ROWS = 1_000_000


def hot_key_rows(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.riskweave.hotKeyRows", str(HOT_KEY_ROWS)))


def heaviest(counts: DataFrame, key: str, weight: str) -> DataFrame:
    """Hot keys out of per-key row counts."""
    floor = hot_key_rows(counts.sparkSession)
    return counts.where(F.col(key).isNotNull() & (F.col(weight) >= floor)).select(key)


def hot_keys(df: DataFrame, key: str) -> DataFrame:
    """Hot keys of a table; the count is combined map-side and reads the key column only."""
    return heaviest(df.groupBy(key).agg(F.count(F.lit(1)).alias("_rows")), key, "_rows")


def salted(left: DataFrame, key: str, spread: str | list[str], hot: DataFrame) -> DataFrame:
    """Add ``_salt``: a row hash for rows of hot keys and of no key, 0 for all others.

    Hashing the row (not drawing a random number) sends a recomputed row where it went before."""
    width = shuffle_width(left.sparkSession)
    spread = [spread] if isinstance(spread, str) else spread
    marked = left.join(F.broadcast(hot.select(key).withColumn("_hot", F.lit(True))), key, "left")
    part = F.pmod(F.xxhash64(*spread), F.lit(width))
    return marked.withColumn(
        "_salt", F.when(F.col("_hot") | F.col(key).isNull(), part).otherwise(0).cast("int")
    ).drop("_hot")


def repeated(right: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """Add ``_salt``: rows of hot keys once per shuffle partition, all others once."""
    width = shuffle_width(right.sparkSession)
    marked = right.join(F.broadcast(hot.select(key).withColumn("_hot", F.lit(True))), key, "left")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(width - 1))).otherwise(F.array(F.lit(0)))
    return marked.withColumn("_salt", F.explode(copies)).drop("_hot")


def skew_join(
    left: DataFrame, right: DataFrame, key: str, spread: str | list[str], how: str = "left", hot: DataFrame | None = None
) -> DataFrame:
    """Equi-join on one key whose hot rows on the left are spread over all shuffle partitions.

    ``spread`` names left columns that vary within a key (a row id)."""
    hot = hot_keys(left, key) if hot is None else hot
    return salted(left, key, spread, hot).join(repeated(right, key, hot), [key, "_salt"], how).drop("_salt")
