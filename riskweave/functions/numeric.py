"""Numeric helpers with the rounding and NULL rules the scores rely on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_even(value: Column, digits: int) -> Column:
    """Scale, round to the nearest even integer, scale back: the floating-point way,
    so 1.015 (just under the tie in binary) goes down."""
    scale = F.lit(float(10**digits))
    return F.rint(value * scale) / scale


def clip(value: Column, low: float, high: float) -> Column:
    """Bounds a value; NULL stays NULL (greatest and least alone would skip it)."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high))))


def nonzero(value: Column, instead: float = 1.0) -> Column:
    """A divisor that is never zero."""
    return F.when(value == 0, F.lit(instead)).otherwise(value)


def row_max(names: list[str]) -> Column:
    """Largest non-null value across columns; no columns gives 0."""
    if not names:
        return F.lit(0.0)
    if len(names) == 1:
        return F.col(names[0]).cast("double")
    return F.greatest(*[F.col(n).cast("double") for n in names])
