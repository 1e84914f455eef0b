"""Exports by the time written in their archive names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import export_time
from ..functions.dates import EXPORT_PREFIX


def dated_exports(archives: DataFrame, prefix: str = EXPORT_PREFIX) -> DataFrame:
    """One row per archive whose name carries a valid export time."""
    return (
        archives.select("archive")
        .distinct()
        .withColumn("export_time", export_time("archive", prefix))
        .filter(F.col("export_time").isNotNull())
    )


def latest_export(exports: DataFrame) -> DataFrame:
    """One row: dated archives, distinct dates, oldest and newest export, next start date."""
    day = F.to_date("export_time")
    # One row per day first: counting days then needs no distinct expansion.
    first, last = F.struct("export_time", "archive"), F.struct("export_time", "archive")
    days = exports.groupBy(day.alias("day")).agg(
        F.count("*").alias("n"), F.min(first).alias("lo"), F.max(last).alias("hi")
    )
    return days.agg(
        F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("archives"),
        F.count("*").alias("export_dates"),
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
    ).select(
        "archives",
        "export_dates",
        F.col("lo.export_time").alias("oldest_time"),
        F.col("lo.archive").alias("oldest_archive"),
        F.col("hi.export_time").alias("newest_time"),
        F.col("hi.archive").alias("newest_archive"),
        F.to_date("hi.export_time").alias("next_start"),
    )


def exports_by_date(exports: DataFrame) -> DataFrame:
    """Archives per export date."""
    return (
        exports.groupBy(F.to_date("export_time").alias("export_date"))
        .agg(F.count("*").alias("archives"))
        .orderBy("export_date")
    )
