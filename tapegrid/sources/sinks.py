"""Sinks: partition-wise overwrite, compressed CSV cache, resumable builds, append-only logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tapegrid.functions.market import side_label


def write_sessions(df: DataFrame, path: str, sort: tuple[str, ...] = ("ts",)) -> None:
    """Replace exactly the sessions present in ``df``; other partitions stay.

    The rebalance hint groups rows by (session, symbol) and lets adaptive execution split a hot pair into
    several tasks and files.
    """
    keys = ["session_date", "symbol"] if "symbol" in df.columns else ["session_date"]
    (df.hint("rebalance", *keys).sortWithinPartitions("session_date", *[c for c in sort if c in df.columns])
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_date").parquet(path))


def write_csv_cache(df: DataFrame, path: str) -> None:
    """One folder for each session; the rebalance hint brings a session's rows together and splits a hot one."""
    df.hint("rebalance", "session_date").write.mode("overwrite").partitionBy("session_date").option("compression", "gzip").option("header", True).csv(path)


def read_csv_cache(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Cached prints; buy/sell labels of old files become ask/bid on the way in."""
    d = spark.read.option("header", True).schema(schema).csv(path)
    return d.withColumn("side", side_label(F.col("side"))) if "side" in d.columns else d


def pending_sessions(wanted: DataFrame, done: list[DataFrame]) -> DataFrame:
    """Sessions whose outputs do not all exist yet."""
    full = done[0].select("session_date").distinct()
    for d in done[1:]:
        full = full.join(d.select("session_date").distinct(), "session_date", "left_semi")
    return wanted.join(full, "session_date", "left_anti")


def append_log(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Append-only log: csv for predictions, json for orders and build records."""
    w = df.write.mode("append")
    (w.option("header", True).csv(path) if fmt == "csv" else w.json(path))


def write_metrics(df: DataFrame, path: str) -> None:
    """Small metrics document: an aggregate of one row written as one JSON record."""
    df.write.mode("overwrite").json(path)
