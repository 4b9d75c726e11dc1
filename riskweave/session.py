"""What the operators need to know about the running Spark session."""

from __future__ import annotations

import sys
import tempfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from threading import Lock
from typing import Any

from pyspark import cloudpickle, inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


_planner = Lock()


def send_by_value(module: str) -> None:
    """Ship a module's functions inside the task, so executors need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage. Only local mode may fall back to a temp folder."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current is not None:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="riskweave-")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def materialize(df: DataFrame, partitioned_by: list[str] | None = None) -> DataFrame:
    """Write the rows to the checkpoint folder and continue from there.

    Survives executor loss, and stops an iteration's plan from growing. With
    ``partitioned_by`` the rows are hash-partitioned first, and later joins and groupings
    on those columns find them in place. The adaptive planner would hide that layout, so
    it is off while such a table is written."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    if partitioned_by is None:
        return df.checkpoint(eager=True)
    with _planner:
        adaptive = spark.conf.get("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            return df.repartition(shuffle_width(spark), *partitioned_by).checkpoint(eager=True)
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def together(spark: SparkSession, *work: Callable[[], Any]) -> list[Any]:
    """Submit independent jobs at the same time, so one fills the cores another leaves idle."""
    with ThreadPoolExecutor(len(work)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(w)) for w in work]]


def path_exists(spark: SparkSession, path: str) -> bool:
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark._jsc.hadoopConfiguration()).exists(location)


def remove_folder(spark: SparkSession, path: str) -> None:
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    location.getFileSystem(spark._jsc.hadoopConfiguration()).delete(location, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
