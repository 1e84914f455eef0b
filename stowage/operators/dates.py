"""Date resolution: cache, sidecar, image tag, stored date, archive time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import archive_time, exif_date, file_name, file_stem, parent_dir, sidecar_date, zip_date
from .skew import attach

# Fixed values.
PREFIX_CHARS = 40
SOURCES = ("json", "exif", "zip", "fallback")

ENTRY_KEY = ["archive", "file_path", "file_size", "file_crc"]


def sidecar_dates(sidecars: DataFrame) -> DataFrame:
    """Sidecars with a usable taken-time: archive, json_path, taken."""
    return (
        sidecars.filter(F.col("json_path").endswith(".json"))
        .select("archive", "json_path", sidecar_date("json_text").alias("taken"))
        .filter(F.col("taken").isNotNull())
        .groupBy("archive", "json_path")
        .agg(F.max("taken").alias("taken"))
    )


def _prefix_dates(entries: DataFrame, dated: DataFrame) -> DataFrame:
    """Least matching sidecar per (archive, 40-character prefix), with its number of users."""
    name = file_name("file_path")
    users = (
        entries.filter(F.length(name) > PREFIX_CHARS)
        .groupBy("archive", F.left(name, F.lit(PREFIX_CHARS)).alias("_prefix"))
        .agg(F.count("*").alias("_users"))
    )
    json_name = file_name("json_path")
    offered = (
        dated.filter(F.length(json_name) >= PREFIX_CHARS)
        .groupBy("archive", F.left(json_name, F.lit(PREFIX_CHARS)).alias("_prefix"))
        .agg(F.min(F.struct("json_path", "taken")).alias("_best"))
    )
    return users.join(offered, ["archive", "_prefix"]).select(
        "archive", "_prefix", "_users", F.col("_best.taken").alias("_by_prefix")
    )


def with_sidecar_date(
    entries: DataFrame,
    sidecars: DataFrame,
    spread_by: list[str],
    hot_rows: int | None = None,
    catalog: DataFrame | None = None,
) -> DataFrame:
    """Add ``sidecar_date``: ``path.json``, then ``folder/stem.json``, then a long-name prefix match.

    Sidecars are looked up inside the same archive, and the first candidate
    with a usable time wins. Every lookup is many-to-one. ``catalog``: the plain
    table behind ``entries``, to count the users of a prefix on, where
    ``entries`` is costly to evaluate twice.
    """
    dated = sidecar_dates(sidecars)
    stem_json = F.concat(file_stem("file_path"), F.lit(".json"))
    folder = parent_dir("file_path")
    name = file_name("file_path")
    filler = F.concat(F.lit("\x02"), F.pmod(F.xxhash64(*spread_by), F.lit(8192)).cast("string"))
    probing = entries.select(
        "*",
        F.concat("file_path", F.lit(".json")).alias("_exact"),
        F.when(folder == ".", stem_json).otherwise(F.concat(folder, F.lit("/"), stem_json)).alias("_stem"),
        # Short names have no prefix candidate; their rows scatter instead of meeting on one key.
        F.when(F.length(name) > PREFIX_CHARS, F.left(name, F.lit(PREFIX_CHARS))).otherwise(filler).alias("_prefix"),
    )
    exact = dated.select("archive", F.col("json_path").alias("_exact"), F.col("taken").alias("_by_exact"))
    stem = dated.select("archive", F.col("json_path").alias("_stem"), F.col("taken").alias("_by_stem"))
    found = probing.join(exact, ["archive", "_exact"], "left").join(stem, ["archive", "_stem"], "left")
    found = attach(
        found, _prefix_dates(entries if catalog is None else catalog, dated), ["_prefix", "archive"], spread_by, "_users", hot_rows
    )
    return found.select(
        *entries.columns, F.coalesce("_by_exact", "_by_stem", "_by_prefix").alias("sidecar_date")
    )


def with_exif_date(entries: DataFrame, exif_tags: DataFrame) -> DataFrame:
    """Add ``exif_date`` from the tag table (one row per member)."""
    tags = exif_tags.groupBy("archive", "file_path").agg(F.min(F.struct("dto", "dt")).alias("_tags"))
    return entries.join(tags, ["archive", "file_path"], "left").select(
        *entries.columns,
        exif_date("file_path", "file_size", "_tags.dto", "_tags.dt").alias("exif_date"),
    )


def cached_dates(entries: DataFrame, cache: DataFrame) -> DataFrame:
    """Add ``cached_date``; a hit needs equal path, size and CRC and a known date."""
    known = cache.filter(F.col("extracted_date").isNotNull()).select(
        *ENTRY_KEY, F.col("extracted_date").alias("cached_date")
    )
    return entries.join(known, ENTRY_KEY, "left").select(*entries.columns, "cached_date")


def date_cache_hits(entries: DataFrame, cache: DataFrame) -> DataFrame:
    return cached_dates(entries, cache).filter(F.col("cached_date").isNotNull())


def date_cache_misses(entries: DataFrame, cache: DataFrame) -> DataFrame:
    return cached_dates(entries, cache).filter(F.col("cached_date").isNull()).drop("cached_date")


def resolve_dates(
    entries: DataFrame,
    sidecars: DataFrame | None = None,
    exif_tags: DataFrame | None = None,
    cache: DataFrame | None = None,
    order_cols=("archive", "entry_ix"),
    use_sidecar: bool = True,
    hot_rows: int | None = None,
    catalog: DataFrame | None = None,
) -> DataFrame:
    """Add ``file_date`` and ``date_source``.

    Priority: sidecar, image tag, stored date, archive time. With a cache,
    only members it does not know are looked up. ``use_sidecar=False`` is the
    single-file rule, which never looks at sidecars. ``catalog`` as in
    :func:`with_sidecar_date`.
    """
    no_date = F.lit(None).cast("timestamp_ntz")
    spread_by = list(order_cols)
    columns = entries.columns
    todo, hits = entries, None
    if cache is not None:
        probed = cached_dates(entries, cache)
        hits = probed.filter(F.col("cached_date").isNotNull()).select(
            *columns, F.col("cached_date").alias("file_date"), F.lit("cache").alias("date_source")
        )
        todo = probed.filter(F.col("cached_date").isNull()).drop("cached_date")
    if use_sidecar and sidecars is not None:
        todo = with_sidecar_date(todo, sidecars, spread_by, hot_rows, catalog)
    else:
        todo = todo.withColumn("sidecar_date", no_date)
    todo = with_exif_date(todo, exif_tags) if exif_tags is not None else todo.withColumn("exif_date", no_date)
    todo = todo.withColumn("_zip_date", zip_date()).withColumn("_archive_date", archive_time())
    ranked = dict(zip(SOURCES, ["sidecar_date", "exif_date", "_zip_date", "_archive_date"], strict=True))
    source = F.coalesce(
        *[F.when(F.col(column).isNotNull(), F.lit(label)) for label, column in ranked.items()]
    )
    resolved = todo.select(
        *columns, F.coalesce(*ranked.values()).alias("file_date"), source.alias("date_source")
    )
    return resolved if hits is None else hits.unionByName(resolved)


def date_source_counts(resolved: DataFrame) -> DataFrame:
    """Per archive: members dated by each source, and JSON members."""
    return resolved.groupBy("archive").agg(
        *[F.count_if(F.col("date_source") == s).alias(f"{s}_count") for s in SOURCES],
        F.count_if(F.col("date_source") == "cache").alias("cache_count"),
        F.count_if(F.col("file_path").endswith(".json")).alias("json_members"),
    )


def cache_rows(resolved: DataFrame, created_at) -> DataFrame:
    """Freshly resolved dates in the shape of the date cache."""
    return resolved.filter(F.col("date_source") != "cache").select(
        *ENTRY_KEY,
        F.col("file_date").alias("extracted_date"),
        F.lit(created_at).cast("timestamp_ntz").alias("created_at"),
    )
