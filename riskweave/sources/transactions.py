"""Transaction scans and the scored-batch sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import LABEL, LABELLED_TRANSACTION, TRANSACTION, nan_to_null


def _lenient(schema: T.StructType) -> T.StructType:
    """Timestamps read as text, so one malformed value becomes NULL instead of failing the scan."""
    return T.StructType(
        [T.StructField(f.name, T.StringType()) if isinstance(f.dataType, T.TimestampNTZType) else f for f in schema.fields]
    )


def parse_timestamp(df: DataFrame, name: str = "timestamp") -> DataFrame:
    """ISO text to a zone-less timestamp; what does not parse becomes NULL. A table without the column stays as it is."""
    if name not in df.columns or df.schema[name].dataType != T.StringType():
        return df
    return df.withColumn(name, F.expr(f"try_cast({name} AS TIMESTAMP_NTZ)"))


def scan_csv(spark: SparkSession, path: str, labelled: bool = False) -> DataFrame:
    """CSV with a header. Columns are matched by the header, absent ones are left out.

    All files must have the same header: values are read by place, so another order is refused, not mixed up."""
    schema = LABELLED_TRANSACTION if labelled else TRANSACTION
    header = spark.read.option("header", True).option("enforceSchema", False).csv(path).columns
    known = {f.name: f for f in _lenient(schema).fields}
    found = T.StructType([known.get(c, T.StructField(c, T.StringType())) for c in header])
    df = spark.read.schema(found).option("header", True).option("enforceSchema", False).option("nanValue", "NaN").csv(path)
    return nan_to_null(parse_timestamp(df))


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    return nan_to_null(parse_timestamp(spark.read.parquet(path)))


def scan_training(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Labelled history; a table without labels is refused here rather than after a long fit."""
    df = scan_csv(spark, path, labelled=True) if fmt == "csv" else scan_parquet(spark, path)
    if LABEL not in df.columns:
        raise ValueError(f"{path} has no {LABEL} column")
    return df


def write_scored(df: DataFrame, path: str, run_id: str, fmt: str = "parquet", mode: str = "errorifexists") -> str:
    """Write one run to its own folder, so a repeated run never mixes with an earlier one."""
    target = f"{path}/run={run_id}"
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(target)
    return target
