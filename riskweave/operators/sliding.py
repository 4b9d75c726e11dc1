"""Trailing time-window sums that neither self-join nor put a key into one task.

A value entering a window is an event with its amount, leaving is an event with the
amount negated; the trailing sum at a point is the running sum of events so far. The
running sum is taken inside time slices of a key and shifted by the total of the
earlier slices, so a hot key is worked on by as many tasks as it has slices. All
measures are whole numbers or decimals, which makes adding and removing exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .skew import hot_key_rows

MONEY_UNITS = 10_000


def money_units(amount: Column) -> Column:
    """Money as whole ten-thousandths."""
    return F.rint(amount * MONEY_UNITS).cast("long")


def trailing_sums(
    points: DataFrame, key: str, at: str, width_us: int, measures: list[str], inclusive: bool = True
) -> DataFrame:
    """Add ``trailing_<measure>`` over [at - width, at], or [at - width, at) when not inclusive.

    ``points`` has one row per (key, at); ``at`` is in microseconds."""
    others = [c for c in points.columns if c not in (key, at)]
    moment = F.struct(
        F.col(at).alias(at), F.lit(True).alias("_point"), *[F.col(m).alias(f"_{m}") for m in measures]
    )
    departure = F.struct(
        (F.col(at) + F.lit(width_us + (1 if inclusive else 0))).alias(at),
        F.lit(False).alias("_point"),
        *[(-F.col(m)).cast(points.schema[m].dataType).alias(f"_{m}") for m in measures],
    )
    events = points.select(key, *others, F.inline(F.array(moment, departure)))

    limit = hot_key_rows(points.sparkSession)
    spans = (
        points.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("_n"), F.min(at).alias("_from"), F.max(at).alias("_to"))
        .where(F.col("_n") >= limit)
        .select(
            key,
            "_from",
            F.ceil((F.col("_to") - F.col("_from") + width_us + 2) / F.ceil(F.col("_n") / limit * 4)).alias("_step"),
        )
    )
    sliced = events.join(F.broadcast(spans), key, "left").withColumn(
        "_slice", F.coalesce(F.floor((F.col(at) - F.col("_from")) / F.col("_step")), F.lit(0))
    )

    last = Window.currentRow if inclusive else -1
    running = Window.partitionBy(key, "_slice").orderBy(at).rangeBetween(Window.unboundedPreceding, last)
    inside = sliced.withColumns({f"_in_{m}": F.sum(f"_{m}").over(running) for m in measures}).where("_point")

    earlier = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        sliced.where(F.col("_step").isNotNull())
        .groupBy(key, "_slice")
        .agg(*[F.sum(f"_{m}").alias(f"_{m}") for m in measures])
        .select(key, "_slice", *[F.sum(f"_{m}").over(earlier).alias(f"_before_{m}") for m in measures])
    )
    total = {
        f"trailing_{m}": F.coalesce(F.col(f"_in_{m}"), F.lit(0)) + F.coalesce(F.col(f"_before_{m}"), F.lit(0))
        for m in measures
    }
    return inside.join(before, [key, "_slice"], "left").withColumns(total).select(key, at, *others, *total)
