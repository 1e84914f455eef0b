"""Shared scratch storage: where plans are cut and intermediate tables live."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, from ``spark.checkpoint.dir``.

    Where the session names none, a folder below the warehouse is used, which
    every executor reaches as well; never a temporary folder of one machine.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if not named:
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        spark.conf.set(CHECKPOINT_CONF, named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    context = spark.sparkContext
    context._stowage_scratch = [*getattr(context, "_stowage_scratch", []), path]
    return path


def settle(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where a costly column (a content hash) feeds several branches: the
    rows are then read from Parquet, columns pruned, rather than recomputed,
    and a lost executor costs a re-read instead of the whole lineage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hadoop_path(spark: SparkSession, path: str):
    """Hadoop's file system and path object of a path."""
    inner = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return inner.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), inner


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names directly in a folder; empty if there is no such folder."""
    system, inner = hadoop_path(spark, path)
    return [s.getPath().getName() for s in system.listStatus(inner)] if system.exists(inner) else []


def release(spark: SparkSession) -> None:
    """Delete the scratch tables of this application; tables that read them are void afterwards."""
    context = spark.sparkContext
    for path in getattr(context, "_stowage_scratch", []):
        system, inner = hadoop_path(spark, path)
        system.delete(inner, True)
    context._stowage_scratch = []
