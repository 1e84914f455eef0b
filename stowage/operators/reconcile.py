"""Reconciling a manifest with an output directory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import attach

STATUSES = ("extracted", "pending", "source_missing")


def reconcile(
    manifest: DataFrame, existing: DataFrame, archives: DataFrame, hot_rows: int | None = None
) -> DataFrame:
    """Manifest rows with ``status``.

    ``existing`` holds (file_size, content_key) of the output directory and
    ``archives`` the archives still present; keys on both sides must come from
    one strategy.
    """
    spread_by = ["source_zip", "source_path"]
    present = existing.select("content_key", "file_size").distinct().withColumn("_extracted", F.lit(True))
    sources = archives.select(F.col("archive").alias("source_zip")).distinct().withColumn("_kept", F.lit(True))
    checked = attach(manifest, present, ["content_key", "file_size"], spread_by, None, hot_rows)
    # One archive may hold a third of the manifest: its rows are counted on the manifest alone.
    sizes = manifest.groupBy("source_zip").agg(F.count("*").alias("_entries"))
    known = sizes.join(sources, "source_zip", "left").select("source_zip", "_entries", "_kept")
    checked = attach(checked, known, ["source_zip"], spread_by, "_entries", hot_rows)
    status = (
        F.when(F.col("_extracted").isNotNull(), F.lit("extracted"))
        .when(F.col("_kept").isNull(), F.lit("source_missing"))
        .otherwise(F.lit("pending"))
    )
    return checked.select(*manifest.columns, status.alias("status"))


def reconcile_summary(reconciled: DataFrame) -> DataFrame:
    """Count and share per status; always one row for each of the three."""
    counts = reconciled.agg(
        F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    )
    listed = F.explode(
        F.array(*[F.struct(F.lit(s).alias("status"), F.col(s).alias("files")) for s in STATUSES])
    )
    share = F.when(F.col("total") == 0, F.lit(0.0)).otherwise(F.col("row.files") * 100.0 / F.col("total"))
    return counts.select("total", listed.alias("row")).select(
        "row.status", "row.files", share.cast("double").alias("pct")
    )


def pending_by_year(reconciled: DataFrame) -> DataFrame:
    """Pending files and bytes per year, newest first, undated ones as ``Unknown``."""
    year = F.coalesce(F.date_format("date", "yyyy"), F.lit("Unknown"))
    return (
        reconciled.filter(F.col("status") == "pending")
        .groupBy(year.alias("year"))
        .agg(F.count("*").alias("files"), F.sum("file_size").alias("bytes"))
        .orderBy(F.desc("year"))
    )


def missing_sources(reconciled: DataFrame) -> DataFrame:
    """Vanished archives and how many manifest files they held."""
    return (
        reconciled.filter(F.col("status") == "source_missing")
        .groupBy("source_zip")
        .agg(F.count("*").alias("files"))
        .orderBy("source_zip")
    )
