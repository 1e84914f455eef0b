"""Plain table reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Read a Parquet table; Spark plans its splits (``spark.sql.files.maxPartitionBytes``)."""
    return spark.read.parquet(path)
