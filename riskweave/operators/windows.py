"""Windowed rules over time: velocity, rapid movement, aggregation, new counterparties,
dormancy, trailing baselines. Each first reduces the batch to one row per key and moment,
pair or day, so no rule holds all rows of an account at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import RiskConfig
from ..functions.temporal import DAY_US, SECOND_US, as_micros, from_micros
from ..schema import entity_column
from .sliding import MONEY_UNITS, money_units, trailing_sums


def _moments(df: DataFrame, key: str) -> DataFrame:
    """One row per key and instant: transactions and money."""
    return (
        df.where(F.col(key).isNotNull() & F.col("timestamp").isNotNull())
        .groupBy(key, as_micros(F.col("timestamp")).alias("at"))
        .agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(money_units(F.col("amount"))), F.lit(0)).alias("units"))
    )


def hourly_velocity(df: DataFrame, cfg: RiskConfig) -> DataFrame:
    """Moments at which a sender has made more than the allowed transactions within the hour."""
    recent = trailing_sums(_moments(df, "sender_id"), "sender_id", "at", 3600 * SECOND_US, ["n"])
    return recent.where(F.col("trailing_n") > cfg.hourly_limit).select(
        "sender_id", from_micros(F.col("at")).alias("timestamp"), F.col("trailing_n").alias("txns_last_hour")
    )


def rapid_movement(df: DataFrame, cfg: RiskConfig) -> DataFrame:
    """Moments at which an account has passed on nearly all it received within the window."""
    units = F.coalesce(money_units(F.col("amount")), F.lit(0))

    def leg(account: str, received: bool):
        nothing = F.lit(0).cast("long")
        return F.struct(
            F.col(account).alias("account_id"),
            (units if received else nothing).alias("received"),
            (nothing if received else units).alias("paid"),
            F.lit(0 if received else 1).alias("payments"),
        )

    flows = (
        df.where(F.col("timestamp").isNotNull())
        .select(as_micros(F.col("timestamp")).alias("at"), F.inline(F.array(leg("sender_id", False), leg("receiver_id", True))))
        .where(F.col("account_id").isNotNull())
        .groupBy("account_id", "at")
        .agg(F.sum("received").alias("received"), F.sum("paid").alias("paid"), F.sum("payments").alias("payments"))
    )
    recent = trailing_sums(flows, "account_id", "at", cfg.drain_minutes * 60 * SECOND_US, ["received", "paid"])
    drained = F.col("trailing_paid") >= F.col("trailing_received") * cfg.drain_ratio
    return recent.where((F.col("payments") > 0) & (F.col("trailing_received") > 0) & drained).select(
        "account_id",
        from_micros(F.col("at")).alias("timestamp"),
        (F.col("trailing_received") / MONEY_UNITS).alias("received"),
        (F.col("trailing_paid") / MONEY_UNITS).alias("paid"),
    )


def aggregation(df: DataFrame, cfg: RiskConfig) -> DataFrame:
    """Moments at which many payments of a sender add up to a reportable sum within the window."""
    recent = trailing_sums(_moments(df, "sender_id"), "sender_id", "at", cfg.aggregation_hours * 3600 * SECOND_US, ["n", "units"])
    many = F.col("trailing_n") >= cfg.aggregation_count
    large = F.col("trailing_units") >= int(cfg.aggregation_amount * MONEY_UNITS)
    return recent.where(many & large).select(
        "sender_id",
        from_micros(F.col("at")).alias("timestamp"),
        F.col("trailing_n").alias("window_txns"),
        (F.col("trailing_units") / MONEY_UNITS).alias("window_amount"),
    )


def new_counterparties(df: DataFrame, cfg: RiskConfig) -> DataFrame:
    """First payment ever between two accounts, where it is a large one."""
    first = (
        df.where(F.col("sender_id").isNotNull() & F.col("receiver_id").isNotNull())
        .groupBy("sender_id", "receiver_id")
        .agg(F.min(F.struct("timestamp", "transaction_id", "amount")).alias("first"))
    )
    return first.select("first.transaction_id", "sender_id", "receiver_id", "first.amount").where(
        F.col("amount") >= cfg.new_counterparty_amount
    )


def dormant_reactivations(df: DataFrame, cfg: RiskConfig) -> DataFrame:
    """First activity of a sender after a long silence. A silence of whole days starts at the last
    moment of one active day and ends at the first of the next, so days are all it looks at."""
    days = (
        df.where(F.col("sender_id").isNotNull() & F.col("timestamp").isNotNull())
        .groupBy("sender_id", F.to_date("timestamp").alias("day"))
        .agg(F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
    )
    before = F.lag("last").over(Window.partitionBy("sender_id").orderBy("day"))
    silence = as_micros(F.col("first")) - as_micros(F.col("previous"))
    return (
        days.withColumn("previous", before)
        .where(silence >= cfg.dormant_days * DAY_US)
        .select("sender_id", F.col("previous").alias("silent_since"), F.col("first").alias("active_again"))
    )


def rolling_baseline(df: DataFrame, cfg: RiskConfig) -> DataFrame:
    """Count, mean and sample deviation of an entity's amounts over the days before each moment,
    that moment left out."""
    key = entity_column(df)
    units = money_units(F.col("amount"))
    moments = (
        df.where(F.col(key).isNotNull() & F.col("timestamp").isNotNull())
        .groupBy(key, as_micros(F.col("timestamp")).alias("at"))
        .agg(
            F.count("amount").alias("n"),
            F.coalesce(F.sum(units), F.lit(0)).cast("decimal(28,0)").alias("s"),
            F.coalesce(F.sum(units.cast("decimal(18,0)") * units), F.lit(0)).cast("decimal(38,0)").alias("ss"),
        )
    )
    past = trailing_sums(moments, key, "at", cfg.baseline_days * DAY_US, ["n", "s", "ss"], inclusive=False)
    n, s, ss = F.col("trailing_n"), F.col("trailing_s"), F.col("trailing_ss")
    # exact where the products fit 38 digits, floating point beyond
    exact = F.try_subtract(F.try_multiply(ss, n.cast("decimal(20,0)")), F.try_multiply(s.cast("decimal(38,0)"), s.cast("decimal(38,0)")))
    spread = F.coalesce(exact.cast("double"), ss.cast("double") * n - s.cast("double") * s.cast("double"))
    variance = F.try_divide(F.greatest(spread, F.lit(0.0)), (n * (n - 1)).cast("double"))
    return past.select(
        key,
        from_micros(F.col("at")).alias("timestamp"),
        n.alias("prior_count"),
        (F.try_divide(s.cast("double"), n) / MONEY_UNITS).alias("prior_mean"),
        F.when(n > 1, F.sqrt(variance) / MONEY_UNITS).otherwise(0.0).alias("prior_std"),
    )
