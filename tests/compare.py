"""Run a named query on Spark and its SQL on DuckDB and compare the two row by row."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def kind(series: pd.Series) -> str:
    if pd.api.types.is_bool_dtype(series):
        return "bool"
    if pd.api.types.is_integer_dtype(series):
        return "int"
    if pd.api.types.is_float_dtype(series):
        return "float"
    if pd.api.types.is_datetime64_any_dtype(series):
        return "time"
    return "text"


def normal(df: pd.DataFrame) -> pd.DataFrame:
    out = df[sorted(df.columns)].copy()
    for c in out.columns:
        if isinstance(out[c].dtype, pd.Int64Dtype) and out[c].isna().any():
            # Spark's toPandas gives a nullable long as float64 with NaN; compare both sides in that form
            out[c] = out[c].astype("float64")
        if kind(out[c]) == "time":
            out[c] = out[c].astype("datetime64[us]")
    return out.sort_values(list(out.columns), ignore_index=True, na_position="first")


def difference(spark_result: pd.DataFrame, sql_result: pd.DataFrame) -> str | None:
    """None if both hold the same rows, else what differs."""
    a, b = normal(spark_result), normal(sql_result)
    if list(a.columns) != list(b.columns):
        return f"columns {list(a.columns)} / {list(b.columns)}"
    if len(a) != len(b):
        return f"rows {len(a)} / {len(b)}"
    for c in a.columns:
        if len(a) and kind(a[c]) != kind(b[c]):
            return f"type of {c}: {a[c].dtype} / {b[c].dtype}"
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        if not same.all():
            k = same.idxmin()
            return f"{c}: {(~same).sum()} rows differ, first {a.loc[k].to_dict()} / {b.loc[k].to_dict()}"
    return None
