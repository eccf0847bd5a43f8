"""Spark session with the settings the operators assume, and shared scratch space."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(name: str = "tapegrid", cores: int | None = None, shuffle: int | None = None, shared: str | None = None) -> SparkSession:
    """Local session for tests and bench. On a cluster the given session is used as it is.

    ``shared``: folder for stages kept between jobs, used where the environment's Spark settings name none.
    """
    n = cores or os.cpu_count() or 4
    spark = (SparkSession.builder.master(f"local[{n}]").appName(name)
            .config("spark.sql.shuffle.partitions", str(shuffle or n))
            .config("spark.sql.adaptive.enabled", "true")
            .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
            .config("spark.sql.adaptive.skewJoin.enabled", "true")
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.sql.execution.arrow.pyspark.enabled", "true")
            .config("spark.driver.memory", "8g")
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .getOrCreate())
    if shared and not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", shared)
    return spark


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder below the shared one named by ``spark.checkpoint.dir``.

    On a cluster a session that names none gets an error: executors must all see the folder. Only a local
    master, whose executors are the driver itself, sets a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and spark.sparkContext.master.split("[")[0] == "local":
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str = "stage", partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write to the shared scratch folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, label)
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
