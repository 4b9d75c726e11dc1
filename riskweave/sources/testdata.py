"""A transaction table derived from the TPC-H-like orders and customer tables.

One transaction per order. All arithmetic is on whole numbers, so another engine
computes the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values of the derived table
SEGMENT_GROUPS = {
    "AUTOMOBILE": "STUDENT",
    "BUILDING": "RETAIL",
    "FURNITURE": "SME",
    "HOUSEHOLD": "HNI",
    "MACHINERY": "CORPORATE",
}
GROUP_AVERAGE = {"STUDENT": 40, "RETAIL": 150, "SME": 2500, "HNI": 8000, "CORPORATE": 45000}
GROUP_DEVIATION = {"STUDENT": 25, "RETAIL": 90, "SME": 1200, "HNI": 3500, "CORPORATE": 20000}
MCC_CODES = [5411, 5812, 5944, 6011, 6211, 7995]
OCCUPATIONS = [
    "Software Engineer",
    "Business Owner",
    "Unemployed",
    "Student",
    "Chief Executive",
    "Consultant",
    "Art Dealer",
]
COUNTRIES = [
    "US", "CA", "GB", "DE", "SG", "KY", "PA", "CH", "AE", "HK", "FR", "JP", "AU",
    "BR", "IN", "ZA", "NG", "RU", "KE", "IT", "ES", "NL", "SE", "NO", "MX",
]


def _pick(values: list, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _lookup(table: dict, key: Column) -> Column:
    chain = F
    for name, value in table.items():
        chain = chain.when(key == name, F.lit(value))
    return chain


def _account(prefix: str, number: Column, width: int) -> Column:
    return F.concat(F.lit(prefix), F.lpad(number.cast("string"), width, "0"))


def _name(s: Column) -> Column:
    base = F.when((s % 10).isin(1, 2), s - s % 10).otherwise(s)
    letters = F.translate(F.md5(base.cast("string").cast("binary")), "0123456789", "ghijklmnop")
    first, last = F.substring(letters, 1, 6), F.substring(letters, 7, 8)
    full = F.concat_ws(" ", first, last)
    return F.when(s % 10 == 1, F.concat_ws(" ", last, first)).when(s % 10 == 2, F.substring(full, 1, 14)).otherwise(full)


# fixed values: the columns used, so that no job is spent on finding the schema
COLUMNS = {
    "customer": "c_custkey bigint, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint",
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(COLUMNS[name]).parquet(f"{sf_dir}/{name}.parquet")


def labelled_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived history, with the label."""
    customer = read_table(spark, sf_dir, "customer")
    # row count from the file footers; used as a constant of the id arithmetic
    n = F.lit(customer.count())
    ok, s = F.col("o_orderkey"), F.col("o_custkey")
    mix = ok * 7919
    drawn = (
        F.when(ok % 10 == 0, F.lit(0))
        .when(ok % 7 == 3, n - 1 - s)
        .when(ok % 11 == 5, (s + F.floor(n / 3)) % n)
        .otherwise((s * 31 + ok * 17) % n)
    )
    orders = (
        read_table(spark, sf_dir, "orders")
        .join(customer, F.col("o_custkey") == F.col("c_custkey"), "left")
        .withColumns({"peer_group": _lookup(SEGMENT_GROUPS, F.col("c_mktsegment")), "_r0": drawn.cast("long")})
        .withColumn("_r", F.when(F.col("_r0") == s, (F.col("_r0") + 1) % n).otherwise(F.col("_r0")))
        .withColumn("_avg", _lookup(GROUP_AVERAGE, F.col("peer_group")))
    )
    r, avg, group = F.col("_r"), F.col("_avg"), F.col("peer_group")
    cents = (
        F.when(ok % 120 == 0, 980_000 + mix % 19_950)
        .when(ok % 70 == 0, 5_000_000 + mix % 10_000_000)
        .otherwise(avg * (20 + mix % 161))
    )
    age = (1 + (s * 37) % 3650).cast("int")
    reported = ((ok % 120 == 0) & (F.floor(ok / 120) % 10 < 7)) | ((ok % 70 == 0) & (age < 30))
    return orders.select(
        _account("TXN-", ok, 12).alias("transaction_id"),
        F.timestamp_add("SECOND", mix % 2_592_000, F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")).alias("timestamp"),
        _account("USR-", s, 8).alias("sender_id"),
        _account("USR-", r, 8).alias("receiver_id"),
        (cents / 100.0).alias("amount"),
        _pick(COUNTRIES, (r * 7) % len(COUNTRIES)).alias("receiver_country"),
        _name(s).alias("sender_name"),
        _pick(MCC_CODES, ok % len(MCC_CODES)).alias("mcc_code"),
        F.lpad((s - F.when(s % 25 == 1, 1).otherwise(0)).cast("string"), 9, "0").alias("sender_national_id"),
        _pick(OCCUPATIONS, s % len(OCCUPATIONS)).alias("sender_occupation"),
        age.alias("account_age_days"),
        (1 + (s * 53) % 100).cast("int").alias("user_risk_score"),
        group,
        (avg * 8).cast("double").alias("expected_monthly_vol"),
        avg.cast("double").alias("historical_avg_txn"),
        _lookup(GROUP_DEVIATION, group).cast("double").alias("historical_std_dev"),
        ((s * 29) % 51).cast("int").alias("known_counterparties"),
        F.when(reported, 1).otherwise(0).alias("is_sar_filed"),
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived live batch."""
    return labelled_transactions(spark, sf_dir).drop("is_sar_filed")
