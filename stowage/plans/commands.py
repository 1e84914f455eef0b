"""The six entry points over real archives and directories."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import content_key, crc_key, metadata_key, partial_key, propose_location, reroot
from ..functions.keys import PARTIAL_HEX
from ..operators import compare as cmp
from ..operators.dates import cache_rows, resolve_dates
from ..operators.exports import EXPORT_PREFIX, dated_exports, exports_by_date, latest_export
from ..operators.library import (
    extraction_metrics,
    library_rows,
    read_library,
    require_library,
    resolve_destinations,
    write_library,
)
from ..operators.planning import (
    archive_plan,
    deletable_archives,
    deletable_total,
    extract_by_year,
    extraction_batches,
    plan_by_type,
    plan_totals,
    skip_existing,
)
from ..operators.reconcile import missing_sources, pending_by_year, reconcile_summary
from ..operators.reconcile import reconcile as reconcile_rows
from ..operators.report import build_report
from ..operators.state import HASH_KEYS, CatalogState, fresh_directories, keys_by_size, refresh_hashes
from ..sources.archives import list_archives, read_archives, read_entry_content, read_entry_keys, read_sidecars
from ..sources.directories import hash_files, list_directory, scan_directory
from ..sources.manifests import manifest, write_diff_manifest, write_manifest
from ..storage import settle
from .analyze import analyze as analyze_entries


def _now() -> str:
    # UTC, as file times are.
    return datetime.now(UTC).replace(tzinfo=None).isoformat(timespec="microseconds")


def _catalog(
    spark: SparkSession, input_dir: str, exif_tags: DataFrame | None, state: CatalogState | None
) -> DataFrame:
    entries = settle(read_archives(spark, input_dir).withColumn("content_key", metadata_key()), "entries")
    sidecars = settle(read_sidecars(entries), "sidecars")
    cache = state.dates.read() if state else None
    catalog = settle(analyze_entries(entries, sidecars, exif_tags, cache, cut=settle), "catalog")
    if state:
        state.dates.upsert(cache_rows(catalog, _now()))
    return catalog


def analyze(
    spark: SparkSession,
    input_dir: str,
    manifest_path: str | None = None,
    exif_tags: DataFrame | None = None,
    state: CatalogState | None = None,
) -> dict[str, DataFrame]:
    """Scan archives and build all report tables, ``catalog`` among them."""
    catalog = _catalog(spark, input_dir, exif_tags, state)
    if manifest_path:
        write_manifest(manifest(catalog), manifest_path, _now())
    return {"catalog": catalog, **build_report(catalog)}


def _strategy_of() -> Column:
    """The strategy a content key was made with, by the length of its fingerprint."""
    length = F.length(F.substring_index("content_key", "_", -1))
    return F.when(length == 64, "full").when(length == PARTIAL_HEX, "size_partial").otherwise("size_crc")


def library_index(
    spark: SparkSession, output_dir: str, state: CatalogState | None = None, strategy: str = "full"
) -> DataFrame:
    """Keyed files of the output directory, reusing cached keys of the same strategy where files are unchanged."""
    # Before the listing starts, so that a change made meanwhile is newer than the scan.
    started = _now()
    listing = settle(list_directory(spark, output_dir), "listing")
    if state is None:
        return hash_files(listing, strategy)
    base = state.hashes.version()
    cached = state.hashes.read(base)
    cache = cached.filter(_strategy_of() == strategy)
    roots = listing.select("root").distinct()
    # One row per directory scanned, hence one row here.
    fresh = not fresh_directories(listing, state.scans.read()).filter("is_fresh").isEmpty()
    whole = cached.join(roots, "root", "left_semi").filter(_strategy_of() != strategy).isEmpty()
    if fresh and whole:
        return cache.join(roots, "root", "left_semi").select(*listing.columns, "content_key")
    files = settle(refresh_hashes(listing, cache, lambda df: hash_files(df, strategy)), "library")
    created = F.lit(started).cast("timestamp_ntz")
    # Only what changed is written; another writer's commit since the read raises and loses nothing.
    state.hashes.upsert(files.filter("NOT reused").drop("reused").withColumn("created_at", created), base)
    gone = cached.join(roots, "root", "left_semi").join(files, HASH_KEYS, "left_anti").select(*HASH_KEYS)
    state.hashes.delete(gone)
    state.scans.upsert(
        files.groupBy("root").agg(created.alias("last_scanned"), F.count("*").alias("file_count"))
    )
    return files.drop("reused")


def extract(
    spark: SparkSession,
    input_dir: str,
    output_dir: str,
    library_path: str | None = None,
    exif_tags: DataFrame | None = None,
    state: CatalogState | None = None,
    strategy: str = "full",
) -> dict[str, DataFrame]:
    """Plan an extraction, and write it when ``library_path`` is given (else a dry run).

    ``output_dir`` is the existing directory to compare with; what earlier runs
    wrote to ``library_path`` counts as there too. Files of both occupy their
    names. Only members whose size occurs there are read, and by default the
    whole content decides; ``size_crc`` (stored checksums, no archive is read)
    and ``size_partial`` (three samples) are for those who accept that files
    which differ elsewhere count as present.
    """
    catalog = _catalog(spark, input_dir, exif_tags, state)
    library = settle(library_index(spark, output_dir, state, strategy), "library")
    existing, taken = _existing(spark, library, output_dir, library_path, strategy)

    def add_key(df: DataFrame) -> DataFrame:
        if strategy == "size_crc":
            return df.withColumn("library_key", metadata_key())
        return read_entry_keys(df, strategy, "library_key")

    plan = settle(skip_existing(catalog, existing, add_key), "plan")
    per_archive = archive_plan(plan)
    sizes = list_archives(spark, input_dir).select("archive", "archive_bytes")
    deletable = deletable_archives(per_archive, sizes)
    totals = plan_totals(plan)
    tables = {
        "plan": plan,
        "archive_plan": per_archive,
        "plan_totals": totals,
        "deletable_archives": deletable,
        "deletable_total": deletable_total(deletable),
        "plan_by_type": plan_by_type(plan),
        "extraction_batches": extraction_batches(plan),
        "extract_by_year": extract_by_year(plan),
    }
    if library_path:
        located = plan.filter("to_extract").withColumn("location", reroot("proposed_location", output_dir))
        placed = settle(resolve_destinations(located, taken), "placed")
        summary = write_library(placed, library_path, lambda df: read_entry_content(df, keep_layout=True))
        tables["summary"] = summary
        tables["metrics"] = extraction_metrics(summary, totals)
    return tables


def _existing(
    spark: SparkSession, library: DataFrame, output_dir: str, library_path: str | None, strategy: str
) -> tuple[DataFrame, DataFrame]:
    """(file_size, content_key) and destinations of the directory and of the written library."""
    keys = keys_by_size(library)
    taken = library.select(F.concat(F.lit(output_dir.rstrip("/") + "/"), "file_path").alias("destination"))
    if library_path:
        rows = library_rows(spark, library_path)
        if strategy == "full":
            key = F.concat(F.col("file_size").cast("string"), F.lit("_"), "sha256")
            keys = keys.unionByName(rows.select("file_size", key.alias("content_key")))
        elif require_library(spark, library_path):
            made = crc_key() if strategy == "size_crc" else partial_key()
            content = spark.read.schema("file_size BIGINT, content BINARY, error STRING").parquet(library_path)
            keys = keys.unionByName(read_library(content).select("file_size", made.alias("content_key")))
        taken = taken.unionByName(rows.select("destination"))
    return keys.distinct(), taken.distinct()


def reconcile(
    spark: SparkSession, entries: DataFrame, output_keys: DataFrame, archives: DataFrame,
    manifest_strategy: str, output_strategy: str,
) -> dict[str, DataFrame]:
    """Status of every manifest row against keyed output files and existing archives."""
    cmp.require_same_strategy(manifest_strategy, output_strategy)
    rows = settle(reconcile_rows(entries, output_keys, archives), "reconciled")
    return {
        "status": rows,
        "summary": reconcile_summary(rows),
        "pending_by_year": pending_by_year(rows),
        "missing_sources": missing_sources(rows),
    }


def reconcile_directory(
    spark: SparkSession, manifest_rows: DataFrame, output_dir: str, input_dir: str
) -> dict[str, DataFrame]:
    """Reconcile a metadata-keyed manifest: the output is keyed by size and CRC as well."""
    output = scan_directory(spark, output_dir, "size_crc")
    return reconcile(spark, manifest_rows, output, list_archives(spark, input_dir), "size_crc", "size_crc")


def compare(
    spark: SparkSession, input_dir: str, directory: str, strategy: str = "size_partial"
) -> dict[str, DataFrame]:
    """Archives against a directory under one key strategy."""
    members = read_archives(spark, input_dir)
    keyed = content_key(members, strategy) if strategy == "size_crc" else read_entry_keys(members, strategy)
    left, right = settle(keyed, "left"), settle(scan_directory(spark, directory, strategy), "right")
    order = ["archive", "entry_ix"]
    return {
        "pairs": cmp.compare_pairs(left, right, order),
        "only_left": cmp.only_left(left, right, order),
        "only_right": cmp.only_right(left, right, ["root", "file_path"]),
        "summary": cmp.compare_summary(left, right),
    }


def import_new(
    spark: SparkSession,
    only_left: DataFrame,
    output_dir: str,
    library_path: str,
    sidecars: DataFrame | None = None,
    exif_tags: DataFrame | None = None,
    taken: DataFrame | None = None,
) -> DataFrame:
    """Write the archive members a comparison found to be new; returns the outcome per archive."""
    dated = resolve_dates(only_left, sidecars, exif_tags)
    located = dated.withColumn("proposed_location", propose_location("file_path", "file_date")).withColumn(
        "location", reroot("proposed_location", output_dir)
    )
    wanted = located.filter(F.col("location").isNotNull())
    there = library_rows(spark, library_path).select("destination")
    occupied = there if taken is None else taken.select("destination").unionByName(there)
    placed = settle(resolve_destinations(wanted, occupied), "placed")
    return write_library(placed, library_path, lambda df: read_entry_content(df, keep_layout=True))


def _diff_tables(diffed: DataFrame, source: DataFrame, target: DataFrame, manifest_path: str | None, **header):
    tables = {
        "files": diffed,
        "summary": cmp.diff_summary(source, target),
        "missing_by_folder": cmp.missing_by_folder(diffed),
    }
    if manifest_path:
        total = source.count()
        write_diff_manifest(cmp.diff_manifest(diffed), manifest_path, _now(), total, **header)
    return tables


def diff(
    spark: SparkSession, source_dir: str, target_dir: str, strategy: str = "size_partial",
    manifest_path: str | None = None,
) -> dict[str, DataFrame]:
    """Files of one directory that another lacks."""
    source = settle(scan_directory(spark, source_dir, strategy), "source")
    target = settle(scan_directory(spark, target_dir, strategy), "target")
    diffed = settle(cmp.diff(source, target, ["root", "file_path"]), "diff")
    return _diff_tables(diffed, source, target, manifest_path, source_dir=source_dir, dest_dir=target_dir)


def diff_archives(
    spark: SparkSession, input_dir: str, target_dir: str, manifest_path: str | None = None
) -> dict[str, DataFrame]:
    """Unique archive members that a directory lacks, by size and CRC."""
    entries = settle(read_archives(spark, input_dir), "entries")
    target = settle(scan_directory(spark, target_dir, "size_crc"), "target")
    diffed = settle(cmp.diff_archives(entries, target), "diff")
    source = diffed.drop("present")
    return _diff_tables(diffed, source, target, manifest_path, source_dir=input_dir, dest_dir=target_dir)


def latest(spark: SparkSession, directory: str, prefix: str = EXPORT_PREFIX) -> dict[str, DataFrame]:
    """Newest and oldest export below a directory, and archives per date."""
    exports = dated_exports(list_archives(spark, directory), prefix)
    return {"latest": latest_export(exports), "by_date": exports_by_date(exports)}
