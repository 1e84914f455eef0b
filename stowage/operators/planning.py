"""Planning an extraction: what is new, what is there, which archives are spent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import file_type, human_size
from ..storage import settle
from .skew import attach


def skip_existing(
    catalog: DataFrame,
    existing: DataFrame,
    add_key: Callable[[DataFrame], DataFrame],
    order_cols=("archive", "entry_ix"),
    hot_rows: int | None = None,
) -> DataFrame:
    """Mark each member ``already_present`` and ``to_extract``.

    Only originals with a proposed location are looked up. Pass 1 compares
    sizes; only members whose size occurs in the library go to ``add_key``,
    which adds ``library_key`` from their content. Pass 2 compares keys.
    A NULL key (unreadable member) counts as new. ``existing`` holds
    (file_size, content_key) of the library under the same key strategy.
    """
    order_cols = list(order_cols)
    columns = catalog.columns
    wanted = ~F.col("is_duplicate") & F.col("proposed_location").isNotNull()
    sizes = existing.select("file_size").distinct().withColumn("_size_known", F.lit(True))
    planned = catalog.filter(wanted)
    sized = settle(attach(planned, sizes, ["file_size"], order_cols, None, hot_rows), "sized")
    keys = (
        existing.select("file_size", F.col("content_key").alias("library_key"))
        .distinct()
        .withColumn("_found", F.lit(True))
    )
    # Written once: the keys cost a read of the content, and the look-up reads them twice.
    hashed = add_key(sized.filter(F.col("_size_known").isNotNull()).drop("_size_known"))
    probed = settle(hashed.withColumn("library_key", F.coalesce("library_key", F.lit(""))), "probed")
    checked = attach(probed, keys, ["library_key", "file_size"], order_cols, None, hot_rows).select(
        *columns, F.col("_found").isNotNull().alias("already_present")
    )
    new_size = sized.filter(F.col("_size_known").isNull()).select(
        *columns, F.lit(False).alias("already_present")
    )
    rest = catalog.filter(~wanted).select(*columns, F.lit(False).alias("already_present"))
    return (
        checked.unionByName(new_size)
        .withColumn("to_extract", ~F.col("already_present"))
        .unionByName(rest.withColumn("to_extract", F.lit(False)))
    )


def archive_plan(plan: DataFrame) -> DataFrame:
    """Per archive: members, to extract, already there, duplicates, and whether it is spent."""
    original = ~F.col("is_duplicate")
    return (
        plan.groupBy("archive")
        .agg(
            F.count("*").alias("total"),
            F.count_if(original & ~F.col("already_present")).alias("needs_extraction"),
            F.count_if(F.col("already_present")).alias("already_extracted"),
            F.count_if(F.col("is_duplicate")).alias("duplicates"),
        )
        .withColumn(
            "is_redundant",
            (F.col("needs_extraction") == 0) & (F.col("duplicates") > 0) & (F.col("already_extracted") == 0),
        )
        .withColumn(
            "is_fully_extracted", (F.col("needs_extraction") == 0) & (F.col("already_extracted") > 0)
        )
    )


def plan_totals(plan: DataFrame) -> DataFrame:
    """One row: files, to extract and their bytes, already there, duplicates."""
    zero = F.lit(0).cast("bigint")
    return plan.agg(
        F.count("*").alias("total_files"),
        F.count_if("to_extract").alias("to_extract"),
        F.coalesce(F.sum(F.when(F.col("to_extract"), F.col("file_size"))), zero).alias("bytes_to_extract"),
        F.count_if("already_present").alias("already_present"),
    ).withColumn("duplicates", F.col("total_files") - F.col("to_extract") - F.col("already_present"))


def deletable_archives(per_archive: DataFrame, archive_sizes: DataFrame) -> DataFrame:
    """Archives free to delete, with why, how many files decided it, and their bytes.

    A list only; nothing is deleted. ``archive_sizes``: archive, archive_bytes.
    """
    full = F.col("is_fully_extracted")
    return (
        per_archive.filter(full | F.col("is_redundant"))
        .join(archive_sizes, "archive", "left")
        .select(
            "archive",
            F.when(full, F.lit("fully_extracted")).otherwise(F.lit("all_duplicates")).alias("status"),
            F.when(full, F.col("already_extracted")).otherwise(F.col("duplicates")).alias("files"),
            F.coalesce("archive_bytes", F.lit(0).cast("bigint")).alias("archive_bytes"),
        )
        .orderBy("archive")
    )


def deletable_total(deletable: DataFrame) -> DataFrame:
    return deletable.agg(
        F.count("*").alias("archives"),
        F.coalesce(F.sum("archive_bytes"), F.lit(0).cast("bigint")).alias("bytes"),
    )


def plan_by_type(plan: DataFrame) -> DataFrame:
    """Files to extract and their bytes by type, most frequent first."""
    return (
        plan.filter("to_extract")
        .groupBy(file_type("file_path").alias("file_type"))
        .agg(F.count("*").alias("files"), F.sum("file_size").alias("bytes"))
        .withColumn("size_text", human_size("bytes"))
        .orderBy(F.desc("files"), "file_type")
    )


def extraction_batches(plan: DataFrame) -> DataFrame:
    """Planned files and bytes per archive, in archive order."""
    return (
        plan.filter("to_extract")
        .groupBy("archive")
        .agg(F.count("*").alias("files"), F.sum("file_size").alias("bytes"))
        .orderBy("archive")
    )


def extract_by_year(plan: DataFrame) -> DataFrame:
    """Extracted files and bytes per year, newest first, undated ones as ``Unknown``."""
    year = F.coalesce(F.date_format("file_date", "yyyy"), F.lit("Unknown"))
    return (
        plan.filter("to_extract")
        .groupBy(year.alias("year"))
        .agg(F.count("*").alias("files"), F.sum("file_size").alias("bytes"))
        .withColumn("size_text", human_size("bytes"))
        .orderBy(F.desc("year"))
    )
