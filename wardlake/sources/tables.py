"""Scans of the base Parquet tables (A2)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy Parquet scan; projections and filters written on top of it are
    pushed into the scan by Catalyst (ReadSchema / PushedFilters)."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, least: int = 0) -> DataFrame:
    """Split a scan that yields fewer partitions than the cluster has cores
    (a single small file with few row groups).  Row-heavy text work then uses
    every core; a large table already has many more partitions and is
    returned unchanged, so no shuffle is added at scale.  Nor is one added for
    fewer than ``least`` rows (counted by the files' metadata), which one core
    has worked through before a shuffle is done."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores and (not least or df.count() >= least):
        return df.repartition(cores)
    return df


#: Rows that a task sorts or joins.
TASK_ROWS = 500_000


def parts_for(df: DataFrame) -> int:
    """Partitions in which to shuffle ``df``: as many as the session says, or more, so that a task's rows do not
    grow with the table.  ``df`` is a table as it is stored: its rows are counted by the files' metadata."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(df.count() / TASK_ROWS))


def data_version(df: DataFrame) -> tuple:
    """Names, sizes and times of the files behind ``df``: differs once they change."""
    m = F.col("_metadata")
    files = df.select(m["file_path"].alias("p"), m["file_size"].alias("s"),
                      m["file_modification_time"].cast("string").alias("t")).distinct()
    n, mark = files.agg(F.count(F.lit(1)), F.sum(F.xxhash64("p", "s", "t").cast("decimal(38,0)"))).first()
    return n, str(mark)
