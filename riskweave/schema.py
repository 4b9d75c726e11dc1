"""Transaction schema and the column defaults that stand in for missing inputs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRANSACTION = T.StructType(
    [
        T.StructField("transaction_id", T.StringType()),
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("sender_id", T.StringType()),
        T.StructField("receiver_id", T.StringType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("currency", T.StringType()),
        T.StructField("device_id", T.StringType()),
        T.StructField("ip_address", T.StringType()),
        T.StructField("lat_long", T.StringType()),
        T.StructField("receiver_bank_code", T.StringType()),
        T.StructField("receiver_country", T.StringType()),
        T.StructField("channel", T.StringType()),
        T.StructField("sender_name", T.StringType()),
        T.StructField("sender_contact_id", T.StringType()),
        T.StructField("sender_phone", T.StringType()),
        T.StructField("receiver_name", T.StringType()),
        T.StructField("receiver_contact_id", T.StringType()),
        T.StructField("transaction_type", T.StringType()),
        T.StructField("mcc_code", T.IntegerType()),
        T.StructField("transaction_status", T.StringType()),
        T.StructField("receiver_risk_score", T.IntegerType()),
        T.StructField("sender_national_id", T.StringType()),
        T.StructField("sender_occupation", T.StringType()),
        T.StructField("sender_address", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("account_age_days", T.IntegerType()),
        T.StructField("user_risk_score", T.IntegerType()),
        T.StructField("peer_group", T.StringType()),
        T.StructField("expected_monthly_vol", T.DoubleType()),
        T.StructField("historical_avg_txn", T.DoubleType()),
        T.StructField("historical_std_dev", T.DoubleType()),
        T.StructField("known_counterparties", T.IntegerType()),
    ]
)

LABEL = "is_sar_filed"
LABELLED_TRANSACTION = T.StructType(TRANSACTION.fields + [T.StructField(LABEL, T.IntegerType())])


def nan_to_null(df: DataFrame) -> DataFrame:
    """Doubles without NaN. In Spark NaN beats every threshold; NULL beats none."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None)) for c in doubles})


def ensure_columns(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Add each absent column with its default; present ones stay as they are."""
    missing = {name: F.lit(value) for name, value in defaults.items() if name not in df.columns}
    return df.withColumns(missing) if missing else df


def entity_column(df: DataFrame, preferred: str = "global_entity_id") -> str:
    """The resolved entity where there is one, else the sending account."""
    return preferred if preferred in df.columns else "sender_id"
