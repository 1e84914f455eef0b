"""Cached state: lookups, upserts, refresh."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import DATE_CACHE, HASH_CACHE, SCAN_LOG
from .logtable import LogTable

# Fixed value: a file is unchanged when its size is equal and its time within a second.
MTIME_TOLERANCE = "INTERVAL '1' SECOND"

DATE_KEYS = ["archive", "file_path"]
HASH_KEYS = ["root", "file_path"]
SCAN_KEYS = ["root"]


def upsert(old: DataFrame, new: DataFrame, keys: list[str], latest: str | None = "created_at") -> DataFrame:
    """Rows of ``old`` with those of ``new`` put in their place, one row per key.

    New rows always replace old ones; among new rows of a key the ``latest``
    wins. Only keys of the new rows are looked up, so a small update joins
    the old snapshot without shuffling it when the planner can broadcast them.
    """
    columns = old.columns
    row = F.struct(*columns)
    order = F.struct(latest, *[c for c in columns if c != latest]) if latest else row
    fresh = new.select(*columns).groupBy(*keys).agg(F.max_by(row, order).alias("_row")).select("_row.*")
    kept = old.join(fresh.select(*keys), keys, "left_anti")
    return kept.unionByName(fresh)


class CatalogState:
    """The three tables a catalog keeps between runs."""

    def __init__(self, spark: SparkSession, path: str):
        base = path.rstrip("/")
        self.dates = LogTable(spark, f"{base}/date_cache", DATE_CACHE, DATE_KEYS)
        self.hashes = LogTable(spark, f"{base}/hash_cache", HASH_CACHE, HASH_KEYS)
        self.scans = LogTable(spark, f"{base}/scan_log", SCAN_LOG, SCAN_KEYS)

    def clear(self) -> None:
        """Empty all three together, so that no scan is believed without its keys."""
        for table in (self.dates, self.hashes, self.scans):
            table.clear()

    def clear_directory(self, root: str) -> None:
        spark = self.hashes.spark
        gone = spark.createDataFrame([(root,)], "root STRING")
        self.hashes.delete(gone)
        self.scans.delete(gone)


def fresh_directories(listing: DataFrame, scan_log: DataFrame) -> DataFrame:
    """Per root: whether its last scan still holds (same file count, no file newer)."""
    now = listing.groupBy("root").agg(F.count("*").alias("files"), F.max("mtime").alias("newest"))
    fresh = (F.col("files") == F.col("file_count")) & (F.col("newest") < F.col("last_scanned"))
    return now.join(scan_log, "root", "left").select(
        "root", "files", "newest", F.coalesce(fresh, F.lit(False)).alias("is_fresh")
    )


def _unchanged() -> Column:
    lag = F.abs(F.col("mtime") - F.col("_mtime"))
    return (F.col("file_size") == F.col("_size")) & (lag < F.expr(MTIME_TOLERANCE))


def cached_keys(listing: DataFrame, hash_cache: DataFrame) -> DataFrame:
    """Listing with ``content_key`` from the cache where the file is unchanged, else NULL."""
    known = hash_cache.select(
        *HASH_KEYS, F.col("file_size").alias("_size"), F.col("mtime").alias("_mtime"),
        F.col("content_key").alias("_key"),
    )
    columns = [c for c in listing.columns if c != "content_key"]
    return listing.join(known, HASH_KEYS, "left").select(
        *columns, F.when(_unchanged(), F.col("_key")).alias("content_key")
    )


def refresh_hashes(listing: DataFrame, hash_cache: DataFrame, add_key) -> DataFrame:
    """Current listing with keys: reused where unchanged, else from ``add_key``.

    Files that are gone drop out. ``add_key`` receives only new and changed
    files and must return them with ``content_key``.
    """
    looked_up = cached_keys(listing, hash_cache)
    columns = ["root", "file_path", "file_size", "mtime", "content_key"]
    reused = looked_up.filter(F.col("content_key").isNotNull()).select(*columns, F.lit(True).alias("reused"))
    stale = looked_up.filter(F.col("content_key").isNull()).drop("content_key")
    hashed = add_key(stale).select(*columns, F.lit(False).alias("reused"))
    return reused.unionByName(hashed)


def keys_by_size(files: DataFrame) -> DataFrame:
    """Distinct (file_size, content_key) of a directory."""
    return files.select("file_size", "content_key").distinct()
