"""Accounts to entities: shared national ids first, similar names second."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import RiskConfig
from ..session import materialize
from .linking import fuzzy_link
from .skew import heaviest, hot_keys, skew_join


def link_national_id(df: DataFrame) -> DataFrame:
    """(sender_id, primary_id) for accounts sharing a national id with another account.

    The primary is the smallest account of the id. An account under several shared ids
    follows the last of them in sort order. Not transitive."""
    pairs = (
        df.where(F.col("sender_national_id").isNotNull() & F.col("sender_id").isNotNull())
        .select("sender_national_id", "sender_id")
        .distinct()
    )
    shared = (
        pairs.groupBy("sender_national_id")
        .agg(F.min("sender_id").alias("primary_id"), F.count(F.lit(1)).alias("accounts"))
        .where("accounts > 1")
    )
    hot = heaviest(shared, "sender_national_id", "accounts")
    linked = skew_join(pairs, shared.drop("accounts"), "sender_national_id", "sender_id", "inner", hot)
    return linked.groupBy("sender_id").agg(F.max_by("primary_id", "sender_national_id").alias("primary_id"))


def account_entities(df: DataFrame, cfg: RiskConfig, names: DataFrame | None = None) -> DataFrame:
    """(sender_id, global_entity_id) for every sending account.

    The name link is looked up for the account's primary, once: a link of a link is not followed."""
    accounts = df.where(F.col("sender_id").isNotNull()).select("sender_id").distinct()
    if cfg.use_national_id and "sender_national_id" in df.columns:
        accounts = accounts.join(link_national_id(df), "sender_id", "left")
    else:
        accounts = accounts.withColumn("primary_id", F.lit(None).cast("string"))
    accounts = accounts.select("sender_id", F.coalesce("primary_id", "sender_id").alias("primary_id"))
    names = fuzzy_link(df, cfg) if names is None else names
    names = names.select(F.col("sender_id").alias("primary_id"), "parent_id")
    return skew_join(accounts, names, "primary_id", "sender_id", "left", hot_keys(accounts, "primary_id")).select(
        "sender_id", F.coalesce("parent_id", "primary_id").alias("global_entity_id")
    )


def resolve_entities(df: DataFrame, cfg: RiskConfig, mapping: DataFrame | None = None) -> DataFrame:
    """Adds global_entity_id to every transaction."""
    mapping = materialize(account_entities(df, cfg)) if mapping is None else mapping
    return skew_join(df, mapping, "sender_id", "transaction_id", "left", hot_keys(df, "sender_id"))


def entity_summary(df: DataFrame) -> DataFrame:
    """Accounts, exposure and transactions per entity, largest exposure first."""
    accounts = (
        df.where(F.col("global_entity_id").isNotNull())
        .groupBy("global_entity_id", "sender_id")
        .agg(F.sum("amount").alias("amount"), F.count("transaction_id").alias("n"))
    )
    return (
        accounts.groupBy("global_entity_id")
        .agg(
            F.count("sender_id").alias("account_count"),
            F.coalesce(F.sum("amount"), F.lit(0.0)).alias("total_exposure"),
            F.sum("n").alias("txn_count"),
        )
        .orderBy(F.desc("total_exposure"), "global_entity_id")
    )
