"""Time expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND_US = 1_000_000
DAY_US = 86_400 * SECOND_US


def as_micros(ts: Column) -> Column:
    """Microseconds since the epoch, reading a zone-less timestamp as it stands."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def from_micros(us: Column) -> Column:
    return F.timestamp_add("MICROSECOND", us, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def is_night(ts: Column) -> Column:
    """1 from 01:00 up to and including 04:59, else 0."""
    return F.when(F.hour(ts).between(1, 4), 1).otherwise(0)


def weekday(ts: Column) -> Column:
    """Monday is 0."""
    return F.weekday(ts)
