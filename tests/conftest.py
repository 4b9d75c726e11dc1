from __future__ import annotations

import sys
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("riskweave-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(params=["even", "skewed"])
def skew(request, spark):
    """Runs a test twice: as usual, and with every key treated as hot and no partition merged."""
    if request.param == "skewed":
        spark.conf.set("spark.riskweave.hotKeyRows", "2")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield request.param
    spark.conf.unset("spark.riskweave.hotKeyRows")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def at(text: str) -> datetime:
    return datetime.fromisoformat(text)


def payments(spark, rows):
    """(sender, receiver, amount, time) rows as a transaction table."""
    data = [(f"t{k:05d}", s, r, float(a) if a is not None else None, t) for k, (s, r, a, t) in enumerate(rows)]
    return spark.createDataFrame(
        data, "transaction_id string, sender_id string, receiver_id string, amount double, timestamp timestamp_ntz"
    )
