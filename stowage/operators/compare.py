"""Comparing archives with directories, and directories with each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import folder_label, human_size, metadata_key
from .dedup import dedup, directory_index, originals
from .skew import attach

FOLDERS_SHOWN = 20


def require_same_strategy(left: str, right: str) -> None:
    """Keys of different strategies never match; refuse to compare them."""
    if left != right:
        raise ValueError(f"content keys differ in strategy: {left!r} against {right!r}")


def match(
    left: DataFrame, right: DataFrame, spread_by: list[str], hot_rows: int | None = None
) -> DataFrame:
    """Left rows with ``match_path``, the first right file of equal content, or NULL."""
    index = directory_index(right).select(
        F.col("content_key").alias("_match_key"), F.col("first_path").alias("match_path")
    )
    # Unreadable files have no key and match nothing; a made-up key each keeps them from meeting in one task.
    none = F.concat(F.lit("\x02"), F.xxhash64(*spread_by).cast("string"))
    keyed = left.withColumn("_match_key", F.coalesce("content_key", none))
    return attach(keyed, index, ["_match_key"], spread_by, None, hot_rows).drop("_match_key")


def compare_pairs(left: DataFrame, right: DataFrame, spread_by: list[str], hot_rows=None) -> DataFrame:
    """Left members that exist on the right, each with one matching file."""
    return match(left, right, spread_by, hot_rows).filter(F.col("match_path").isNotNull())


def only_left(left: DataFrame, right: DataFrame, spread_by: list[str], hot_rows=None) -> DataFrame:
    """Left rows whose content is not on the right."""
    return match(left, right, spread_by, hot_rows).filter(F.col("match_path").isNull()).drop("match_path")


def only_right(left: DataFrame, right: DataFrame, spread_by: list[str], hot_rows=None) -> DataFrame:
    """Right rows whose content is not on the left."""
    return only_left(right, left, spread_by, hot_rows)


def _per_key(df: DataFrame, side: str) -> DataFrame:
    return df.groupBy("content_key").agg(
        F.count("*").alias(f"{side}_files"), F.sum("file_size").alias(f"{side}_bytes")
    )


def compare_summary(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row of counts and bytes. Both sides shrink to one row per key before they meet."""
    both = _per_key(left, "left").join(_per_key(right, "right"), "content_key", "full")
    zero = F.lit(0).cast("bigint")
    matched = F.col("left_files").isNotNull() & F.col("right_files").isNotNull()
    new = F.col("left_files").isNotNull() & F.col("right_files").isNull()
    extra = F.col("left_files").isNull()
    return both.agg(
        F.coalesce(F.sum("left_files"), zero).alias("total_left"),
        F.coalesce(F.sum("right_files"), zero).alias("total_right"),
        F.coalesce(F.sum(F.when(matched, F.col("left_files"))), zero).alias("duplicate_count"),
        F.coalesce(F.sum(F.when(matched, F.col("left_bytes"))), zero).alias("duplicate_bytes"),
        F.coalesce(F.sum(F.when(new, F.col("left_files"))), zero).alias("unique_left_count"),
        F.coalesce(F.sum(F.when(new, F.col("left_bytes"))), zero).alias("unique_left_bytes"),
        F.coalesce(F.sum(F.when(extra, F.col("right_files"))), zero).alias("unique_right_count"),
    )


def diff(source: DataFrame, target: DataFrame, spread_by: list[str], hot_rows=None) -> DataFrame:
    """Source rows with ``present``: whether the target holds their content."""
    matched = match(source, target, spread_by, hot_rows)
    return matched.withColumn("present", F.col("match_path").isNotNull()).drop("match_path")


def diff_archives(
    entries: DataFrame, target: DataFrame, order_cols=("archive", "entry_ix"), hot_rows=None
) -> DataFrame:
    """Unique archive members against a directory, by size and CRC on both sides."""
    keyed = entries.withColumn("content_key", metadata_key())
    unique = originals(dedup(keyed, order_cols=order_cols, hot_rows=hot_rows))
    return diff(unique, target, list(order_cols), hot_rows)


def diff_summary(source: DataFrame, target: DataFrame) -> DataFrame:
    """Source files and bytes, present and missing, and the share present (0 when empty)."""
    keys = target.select("content_key").distinct().withColumn("present", F.lit(True))
    per_key = _per_key(source, "source").join(keys, "content_key", "left")
    zero = F.lit(0).cast("bigint")
    here, gone = F.col("present").isNotNull(), F.col("present").isNull()
    totals = per_key.agg(
        F.coalesce(F.sum("source_files"), zero).alias("source_files"),
        F.coalesce(F.sum("source_bytes"), zero).alias("source_bytes"),
        F.coalesce(F.sum(F.when(here, F.col("source_files"))), zero).alias("present_files"),
        F.coalesce(F.sum(F.when(gone, F.col("source_files"))), zero).alias("missing_files"),
        F.coalesce(F.sum(F.when(gone, F.col("source_bytes"))), zero).alias("missing_bytes"),
    )
    share = F.when(F.col("source_files") == 0, F.lit(0.0)).otherwise(
        F.col("present_files") * 100.0 / F.col("source_files")
    )
    return totals.withColumn("present_pct", share.cast("double"))


def missing_by_folder(diffed: DataFrame, shown: int = FOLDERS_SHOWN) -> DataFrame:
    """Missing files per folder: the first folders by name, then one row counting the others."""
    folders = (
        diffed.filter(~F.col("present"))
        .groupBy(folder_label("file_path").alias("folder"))
        .agg(F.count("*").alias("files"), F.sum("file_size").alias("bytes"))
    )
    none = F.lit(0).cast("bigint")
    first = folders.orderBy("folder").limit(shown).select(
        "folder", "files", "bytes", human_size("bytes").alias("size_text"), none.alias("more_folders")
    )
    rest = folders.agg(F.count("*").alias("_all")).filter(F.col("_all") > shown).select(
        F.lit("...").alias("folder"), none.alias("files"), none.alias("bytes"), F.lit("").alias("size_text"),
        (F.col("_all") - shown).alias("more_folders"),
    )
    return first.unionByName(rest)


def diff_manifest(diffed: DataFrame) -> DataFrame:
    """Missing files in the diff-manifest shape."""
    return diffed.filter(~F.col("present")).select(
        F.col("file_path").alias("path"), "file_size", "content_key"
    )
