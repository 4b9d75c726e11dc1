"""Multi-party scenarios: smurfing hubs, u-turns and integration mismatches.

Hubs and u-turns are found on aggregates (one row per account, per pair and day),
never by joining transactions with transactions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import RiskConfig
from ..functions.rules import integration_mismatch
from ..functions.temporal import SECOND_US, as_micros
from ..schema import ensure_columns
from ..session import materialize, together
from .skew import heaviest, skew_join


def inflows(df: DataFrame) -> DataFrame:
    """Per receiver: distinct senders, money in, rows. De-duplicates by pair first, so a hub's
    senders are counted where they are, not in one task."""
    pairs = (
        df.where(F.col("receiver_id").isNotNull())
        .groupBy("receiver_id", "sender_id")
        .agg(F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("rows"))
    )
    return pairs.groupBy("receiver_id").agg(
        F.count("sender_id").alias("unique_senders"),
        F.coalesce(F.sum("amount"), F.lit(0.0)).alias("total_in_amt"),
        F.sum("rows").alias("in_rows"),
    )


def outflows(df: DataFrame) -> DataFrame:
    """Per sender: money out, rows."""
    return (
        df.where(F.col("sender_id").isNotNull())
        .groupBy("sender_id")
        .agg(F.coalesce(F.sum("amount"), F.lit(0.0)).alias("total_out_amt"), F.count(F.lit(1)).alias("out_rows"))
    )


def smurfing_hubs(df: DataFrame, cfg: RiskConfig) -> DataFrame:
    """Accounts fed by many senders that pass most of the money on."""
    incoming = inflows(df).where(F.col("unique_senders") >= cfg.fan_in_limit).withColumnRenamed("receiver_id", "account_id")
    outgoing = outflows(df).withColumnRenamed("sender_id", "account_id")
    passes_on = F.col("total_out_amt") >= F.col("total_in_amt") * cfg.pass_through_ratio
    return incoming.join(outgoing, "account_id").where(passes_on)


def fan_out(df: DataFrame, cfg: RiskConfig) -> DataFrame:
    """Accounts paying many distinct receivers."""
    pairs = df.where(F.col("sender_id").isNotNull() & F.col("receiver_id").isNotNull()).select("sender_id", "receiver_id")
    return (
        pairs.distinct()
        .groupBy("sender_id")
        .agg(F.count(F.lit(1)).alias("unique_receivers"))
        .where(F.col("unique_receivers") >= cfg.fan_out_limit)
    )


def u_turn_senders(df: DataFrame, cfg: RiskConfig) -> DataFrame:
    """Senders whose money came back from the same receiver within the window, and their row counts.

    With time cut into slices as long as the window, a return leg lies in the same slice,
    where it is later than the first leg, or in the next one, where it is less than a
    window later. Both are settled by the earliest and latest time per direction and slice."""
    width = cfg.u_turn_hours * 3600 * SECOND_US
    legs = (
        df.where(F.col("sender_id").isNotNull() & F.col("receiver_id").isNotNull() & F.col("timestamp").isNotNull())
        .select("sender_id", "receiver_id", as_micros(F.col("timestamp")).alias("at"))
        .groupBy("sender_id", "receiver_id", F.floor(F.col("at") / F.lit(width)).alias("slice"))
        .agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count(F.lit(1)).alias("rows"))
    )
    nothing = F.lit(None).cast("long")

    def view(sender, receiver, slice_, first, last, back_last, next_first, rows):
        return F.struct(
            F.col(sender).alias("sender_id"), F.col(receiver).alias("receiver_id"), slice_.alias("slice"),
            first.alias("first"), last.alias("last"), back_last.alias("back_last"), next_first.alias("next_first"),
            rows.alias("rows"),
        )

    slice_, first, last = F.col("slice"), F.col("first"), F.col("last")
    views = legs.select(
        F.inline(
            F.array(
                view("sender_id", "receiver_id", slice_, first, last, nothing, nothing, F.col("rows")),
                view("receiver_id", "sender_id", slice_, nothing, nothing, last, nothing, F.lit(0)),
                view("receiver_id", "sender_id", slice_ - 1, nothing, nothing, nothing, first, F.lit(0)),
            )
        )
    )
    met = views.groupBy("sender_id", "receiver_id", "slice").agg(
        F.min("first").alias("first"),
        F.max("last").alias("last"),
        F.max("back_last").alias("back_last"),
        F.min("next_first").alias("next_first"),
        F.sum("rows").alias("rows"),
    )
    returned = (F.col("back_last") > F.col("first")) | (F.col("next_first") - F.col("last") < width)
    return (
        met.groupBy("sender_id")
        .agg(F.max(F.coalesce(returned, F.lit(False))).alias("hit"), F.sum("rows").alias("out_rows"))
        .where("hit")
        .select("sender_id", "out_rows")
    )


def mcc_mismatches(df: DataFrame, cfg: RiskConfig) -> DataFrame:
    return df.where(integration_mismatch(F.col("mcc_code"), F.col("sender_occupation"), F.col("amount"), cfg))


def flag_members(df: DataFrame, column: str, flagged: DataFrame, key: str, weight: str, flag: str) -> DataFrame:
    """Add a boolean: is the row's ``column`` among ``flagged``'s ``key`` values."""
    known = flagged.select(F.col(key).alias(column), F.col(weight).alias("_weight"))
    marks = known.select(column, F.lit(True).alias(flag))
    joined = skew_join(df, marks, column, "transaction_id", "left", heaviest(known, column, "_weight"))
    return joined.withColumn(flag, F.coalesce(flag, F.lit(False)))


def typology_scores(df: DataFrame, cfg: RiskConfig, sender_hub: str, receiver_hub: str, u_turn: str) -> DataFrame:
    """Apply the scenario scores to rows that carry the flags, in one projection."""
    df = ensure_columns(df, {"structuring_raw": 0.0, "behavioral_raw": 0.0})
    mismatch = integration_mismatch(F.col("mcc_code"), F.col("sender_occupation"), F.col("amount"), cfg)
    return df.withColumns(
        {
            "structuring_raw": F.when(F.col(sender_hub) | F.col(receiver_hub), 100.0).otherwise(F.col("structuring_raw")),
            "behavioral_raw": F.when(mismatch, 90.0).when(F.col(u_turn), 80.0).otherwise(F.col("behavioral_raw")),
        }
    ).drop(sender_hub, receiver_hub, u_turn)


def score_typologies(df: DataFrame, cfg: RiskConfig) -> DataFrame:
    """Detect and apply all scenarios. Hub flags use the accounts, not the resolved entities.

    The flagged accounts are written down once: each list serves a join and its skew check."""
    hubs, returned = together(
        df.sparkSession, lambda: materialize(smurfing_hubs(df, cfg)), lambda: materialize(u_turn_senders(df, cfg))
    )
    sender_marks = materialize(
        hubs.select(F.col("account_id").alias("sender_id"), F.lit(True).alias("_hub"), F.lit(False).alias("_turn"), "out_rows")
        .unionByName(returned.select("sender_id", F.lit(False).alias("_hub"), F.lit(True).alias("_turn"), "out_rows"))
        .groupBy("sender_id")
        .agg(F.max("_hub").alias("_sender_hub"), F.max("_turn").alias("_u_turn"), F.max("out_rows").alias("_weight"))
    )
    hot = heaviest(sender_marks, "sender_id", "_weight")
    flagged = skew_join(df, sender_marks.drop("_weight"), "sender_id", "transaction_id", "left", hot)
    flagged = flagged.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("_sender_hub", "_u_turn")})
    flagged = flag_members(flagged, "receiver_id", hubs, "account_id", "in_rows", "_receiver_hub")
    return typology_scores(flagged, cfg, "_sender_hub", "_receiver_hub", "_u_turn")
