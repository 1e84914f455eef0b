"""Registered queries: one per operator, over whole test tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as fx
from ..operators import compare as cmp
from ..operators import dates as dt
from ..operators import dedup as dd
from ..operators import exports as ex
from ..operators import library as lib
from ..operators import planning as pl
from ..operators import reconcile as rc
from ..operators import report as rp
from ..operators import state as st
from ..plans import commands
from ..plans.analyze import analyze
from ..session import ship
from ..sources import archives as ar
from ..sources import directories as di
from ..sources import extraction as xt
from ..sources import fingerprints as fp
from ..sources import manifests as mf
from ..storage import scratch_path, settle
from ..streaming.ingest import ingest_stream, read_ingested
from ..streaming.two_stage import read_two_stage
from . import views as v
from .exports import export_archives, export_files

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

PARTIAL_SAMPLE = 1024
MEMBER = ["archive", "entry_ix"]


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        ship(spark)
        return fn(spark, sf_dir)

    REGISTRY[fn.__name__] = run
    return run


# Inputs -----------------------------------------------------------------


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return v.doc_entries(spark, sf)


def _docs2(spark: SparkSession, sf: str) -> DataFrame:
    return v.doc_entries_with_copies(spark, sf)


def _docs_deduped(spark: SparkSession, sf: str) -> DataFrame:
    return dd.dedup(_docs2(spark, sf).drop("content"))


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return v.line_entries(spark, sf)


def _lines_deduped(spark: SparkSession, sf: str) -> DataFrame:
    return dd.dedup(_lines(spark, sf), order_cols=v.LINE_ORDER)


def _catalog(spark: SparkSession, sf: str) -> DataFrame:
    entries = _docs2(spark, sf).drop("content")
    return analyze(entries, v.sidecars(spark, sf), v.exif_tags(spark, sf))


def _plan(spark: SparkSession, sf: str) -> DataFrame:
    """The extraction plan of the document catalog against the library, written once."""
    catalog = settle(_catalog(spark, sf).drop("content"), "catalog")
    contents = _docs2(spark, sf).select("archive", "entry_ix", "content")

    def add_key(members: DataFrame) -> DataFrame:
        read = members.join(contents, MEMBER)
        return read.withColumn("library_key", fx.partial_key()).drop("content")

    library = v.library_files(spark, sf).select("file_size", fx.partial_key().alias("content_key"))
    return settle(pl.skip_existing(catalog, st.keys_by_size(library), add_key), "plan")


# Expressions ------------------------------------------------------------


@query
def content_key_full(spark, sf):
    return fx.content_key(_docs(spark, sf), "full").select(*MEMBER, "content_key")


@query
def content_key_partial(spark, sf):
    keyed = fx.content_key(_docs(spark, sf), "size_partial", PARTIAL_SAMPLE)
    return keyed.select(*MEMBER, "content_key")


@query
def content_key_crc(spark, sf):
    keyed = fx.content_key(_lines(spark, sf), "size_crc")
    return keyed.select(*v.LINE_ORDER, "content_key")


@query
def normalize_name(spark, sf):
    docs = _docs(spark, sf).select("file_path")
    both = docs.unionByName(_lines(spark, sf).select("file_path"))
    return both.select("file_path", fx.normalized_name("file_path").alias("norm_name"))


@query
def path_parts(spark, sf):
    return v.page_paths(spark, sf).select(
        "page_id",
        fx.file_name("file_path").alias("name"),
        fx.parent_dir("file_path").alias("parent"),
        fx.file_stem("file_path").alias("stem"),
        fx.file_suffix("file_path").alias("suffix"),
    )


@query
def file_type(spark, sf):
    return _lines(spark, sf).select(*v.LINE_ORDER, fx.file_type("file_path").alias("file_type"))


@query
def size_text(spark, sf):
    size = F.col("file_size") * (F.col("l_orderkey") % 100000 + 1) * (F.col("l_suppkey") % 100000 + 1)
    return _lines(spark, sf).select(
        *v.LINE_ORDER,
        fx.human_size(size).alias("plan_text"),
        fx.human_size(size * 100, "TB").alias("report_text"),
    )


@query
def display_fields(spark, sf):
    location = fx.propose_location("file_path", "archive_mtime")
    return _docs(spark, sf).select(
        *MEMBER,
        fx.display_path("archive", "file_path").alias("display"),
        fx.short_hash("content_key").alias("short_key"),
        fx.archive_label(F.concat(F.lit("a_long_prefix_for_the_label_"), "archive")).alias("label"),
        fx.folder_label(fx.file_name("file_path")).alias("folder"),
        fx.reroot(location, "out/photos").alias("target"),
    )


@query
def propose_location(spark, sf):
    dated = dt.resolve_dates(_docs(spark, sf).drop("content"))
    return dated.select(*MEMBER, fx.propose_location("file_path", "file_date").alias("proposed_location"))


@query
def zip_dates(spark, sf):
    return _docs(spark, sf).select(*MEMBER, fx.zip_date().alias("zip_date"))


@query
def exif_dates(spark, sf):
    tags = v.exif_tags(spark, sf)
    images = _docs(spark, sf).select(*MEMBER, "file_path", "file_size").unionByName(v.order_members(spark, sf))
    return dt.with_exif_date(images, tags).select(*MEMBER, "exif_date")


@query
def sidecar_dates(spark, sf):
    return dt.sidecar_dates(v.sidecars(spark, sf))


@query
def export_times(spark, sf):
    return ex.dated_exports(_lines(spark, sf), v.EXPORT_PREFIX)


# Dedup ------------------------------------------------------------------


DEDUP_COLUMNS = ["is_duplicate", "group_size", "original_archive", "original_path"]


@query
def dedup_entries(spark, sf):
    return _lines_deduped(spark, sf).select(*v.LINE_ORDER, *DEDUP_COLUMNS)


@query
def dedup_documents(spark, sf):
    return _docs_deduped(spark, sf).select(*MEMBER, *DEDUP_COLUMNS)


@query
def dedup_content_only(spark, sf):
    found = dd.dedup(_docs2(spark, sf).drop("content"), mode="content_only")
    return found.select(*MEMBER, *DEDUP_COLUMNS)


@query
def dedup_candidates(spark, sf):
    found = dd.split_candidates(_lines(spark, sf), v.LINE_ORDER)
    return found.select(*v.LINE_ORDER, "is_candidate")


@query
def dup_groups(spark, sf):
    return dd.duplicate_groups(_docs_deduped(spark, sf)).select(*MEMBER, "content_key", "group_size")


@query
def originals(spark, sf):
    return dd.originals(_docs_deduped(spark, sf)).select(*MEMBER, "file_path", "group_size")


@query
def dedup_counts(spark, sf):
    return dd.entry_counts(_lines(spark, sf))


@query
def directory_index(spark, sf):
    return dd.directory_index(v.library_files(spark, sf))


# Dates and state --------------------------------------------------------


@query
def resolve_dates(spark, sf):
    dated = dt.resolve_dates(_docs2(spark, sf).drop("content"), v.sidecars(spark, sf), v.exif_tags(spark, sf))
    return dated.select(*MEMBER, "file_date", "date_source")


@query
def resolve_dates_cached(spark, sf):
    dated = dt.resolve_dates(
        _docs2(spark, sf).drop("content"), v.sidecars(spark, sf), v.exif_tags(spark, sf), v.date_cache(spark, sf)
    )
    return dated.select(*MEMBER, "file_date", "date_source")


@query
def resolve_dates_single(spark, sf):
    dated = dt.resolve_dates(
        _docs(spark, sf).drop("content"), v.sidecars(spark, sf), v.exif_tags(spark, sf), use_sidecar=False
    )
    return dated.select(*MEMBER, "file_date", "date_source")


@query
def date_source_counts(spark, sf):
    dated = dt.resolve_dates(_docs2(spark, sf).drop("content"), v.sidecars(spark, sf), v.exif_tags(spark, sf))
    return dt.date_source_counts(dated)


@query
def date_cache_hits(spark, sf):
    hits = dt.date_cache_hits(_docs(spark, sf).drop("content"), v.date_cache(spark, sf))
    return hits.select(*MEMBER, "cached_date")


@query
def date_cache_upsert(spark, sf):
    dated = dt.resolve_dates(
        _docs(spark, sf).drop("content"), v.sidecars(spark, sf), v.exif_tags(spark, sf), v.date_cache(spark, sf)
    )
    fresh = dt.cache_rows(dated, "2024-07-01 00:00:00")
    return st.upsert(v.date_cache(spark, sf), fresh, st.DATE_KEYS)


@query
def hash_cache_refresh(spark, sf):
    listing = v.library_files(spark, sf).select("root", "file_path", "file_size", "mtime")
    contents = v.library_files(spark, sf).select("root", "file_path", "content")

    def add_key(stale: DataFrame) -> DataFrame:
        return fx.content_key(stale.join(contents, ["root", "file_path"]), "full").drop("content")

    return st.refresh_hashes(listing, v.hash_cache(spark, sf), add_key)


@query
def fresh_directories(spark, sf):
    listing = v.library_files(spark, sf).withColumn("root", F.substring_index("file_path", "/", 1))
    return st.fresh_directories(listing, v.scan_log(spark, sf))


@query
def keys_by_size(spark, sf):
    return st.keys_by_size(v.library_files(spark, sf))


def _hash_state(spark: SparkSession, sf: str) -> st.CatalogState:
    """State that holds the cached hashes, one scan per folder and the cached dates."""
    state = st.CatalogState(spark, scratch_path(spark, "state"))
    state.hashes.upsert(v.hash_cache(spark, sf))
    return state


@query
def cache_delete(spark, sf):
    # Two deltas on top of each other: the toxic documents' files go, then the labelled good ones get new keys.
    state = _hash_state(spark, sf)
    cached = settle(state.hashes.read(), "cached")
    listed = v.library_files(spark, sf).select("root", "file_path", F.col("file_size").alias("listed"))
    toxic = cached.join(listed, st.HASH_KEYS).filter("file_size <> listed").select(*st.HASH_KEYS)
    state.hashes.delete(toxic)
    even = cached.filter("file_size % 2 = 0").withColumn("content_key", F.concat(F.lit("new_"), "content_key"))
    state.hashes.upsert(even)
    return state.hashes.read().select("root", "file_path", "file_size", "content_key")


@query
def cache_clear(spark, sf):
    state = _hash_state(spark, sf)
    state.dates.upsert(v.date_cache(spark, sf))
    state.scans.upsert(v.scan_log(spark, sf))
    state.clear_directory("en")
    tables = (("dates", state.dates), ("hashes", state.hashes), ("scans", state.scans))
    one = [table.read().agg(F.count("*").alias("rows")).select(F.lit(f"en cleared: {name}").alias("step"), "rows") for name, table in tables]
    state.clear()
    all_ = [table.read().agg(F.count("*").alias("rows")).select(F.lit(f"all cleared: {name}").alias("step"), "rows") for name, table in tables]
    return reduce(DataFrame.unionByName, [*one, *all_])


@query
def incremental_ingest(spark, sf):
    entries = _docs2(spark, sf).drop("content")
    landing, path = scratch_path(spark, "landing"), scratch_path(spark, "ingested")
    entries.repartitionByRange(6, "archive").write.parquet(landing)
    stream = ingest_stream(
        spark, landing, path, scratch_path(spark, "progress"), entries.schema, files_per_batch=2
    )
    stream.awaitTermination()
    return read_ingested(spark, path, entries.schema).select("content_key", "file_size")


@query
def incremental_two_stage(spark, sf):
    entries = _docs2(spark, sf).drop("content")
    landing, path = scratch_path(spark, "landing"), scratch_path(spark, "ingested")
    # Spread by position, so that name-mates and equal contents arrive in different batches.
    entries.repartition(3, "entry_ix").write.parquet(landing)
    stream = ingest_stream(
        spark, landing, path, scratch_path(spark, "progress"), entries.schema, mode="two_stage", files_per_batch=1
    )
    stream.awaitTermination()
    return read_two_stage(spark, path, entries.schema).select(*MEMBER, *DEDUP_COLUMNS)


# Reports ----------------------------------------------------------------


@query
def analyze_catalog(spark, sf):
    return _catalog(spark, sf).select(
        *MEMBER, "is_duplicate", "group_size", "original_archive", "original_path", "file_date",
        "date_source", "proposed_location",
    )


@query
def summary_stats(spark, sf):
    return rp.summary_stats(_docs_deduped(spark, sf))


@query
def summary_stats_lines(spark, sf):
    return rp.entry_summary(_lines(spark, sf))


@query
def archive_stats(spark, sf):
    return rp.archive_stats(_docs_deduped(spark, sf))


@query
def archive_stats_lines(spark, sf):
    return rp.archive_stats(_lines_deduped(spark, sf))


@query
def archive_dup_class(spark, sf):
    return rp.archive_dup_class(rp.archive_stats(_docs_deduped(spark, sf)))


@query
def redundant_archives(spark, sf):
    return rp.redundant_archives(rp.archive_stats(_docs_deduped(spark, sf)))


@query
def redundant_total(spark, sf):
    return rp.redundant_total(rp.archive_stats(_docs_deduped(spark, sf)))


@query
def identical_archives(spark, sf):
    return rp.identical_archives(_docs2(spark, sf))


@query
def identical_totals(spark, sf):
    return rp.identical_totals(rp.identical_archives(_docs2(spark, sf)))


@query
def original_locations(spark, sf):
    return rp.original_locations(_docs_deduped(spark, sf))


@query
def type_breakdown(spark, sf):
    return rp.type_breakdown(_lines(spark, sf))


@query
def year_timeline(spark, sf):
    return rp.year_timeline(_lines_deduped(spark, sf))


@query
def month_timeline(spark, sf):
    return rp.month_timeline(_lines(spark, sf))


@query
def dup_by_type(spark, sf):
    return rp.dup_by_type(_lines_deduped(spark, sf))


@query
def largest_files(spark, sf):
    return rp.largest_files(_lines(spark, sf), v.LINE_ORDER)


@query
def report_rows(spark, sf):
    return rp.report_rows(_catalog(spark, sf))


@query
def archives_by_date(spark, sf):
    return rp.archives_by_date(rp.archive_stats(_docs_deduped(spark, sf)))


@query
def recent_archives(spark, sf):
    return rp.recent_archives(rp.archive_stats(_docs_deduped(spark, sf)))


BROWSE = {"search": "DOC", "file_type": "image", "status": "unique"}


@query
def browse_page(spark, sf):
    rows = rp.report_rows(_catalog(spark, sf))
    page = rp.browse(rows, **BROWSE, sort="file_size", ascending=False, page=0, page_size=100)
    return page.select("archive", "file_path", "file_size", "size_text", "file_date")


@query
def browse_page_two(spark, sf):
    rows = rp.report_rows(_catalog(spark, sf))
    page = rp.browse(rows, sort="file_size", page=2, page_size=100)
    return page.select("archive", "entry_ix", "file_path", "file_size")


@query
def browse_after(spark, sf):
    # The same page, found from the last row of the one before it.
    rows = settle(rp.report_rows(_catalog(spark, sf)).select("archive", "entry_ix", "file_path", "file_size"), "rows")
    last = rp.browse(rows, sort="file_size", page=1, page_size=100).tail(1)
    page = rp.browse(rows, sort="file_size", page_size=100, after=last[0].asDict() if last else None)
    return page if last else page.limit(0)


@query
def browse_count(spark, sf):
    return rp.browse_count(rp.report_rows(_catalog(spark, sf)), page_size=100, **BROWSE)


# Compare, diff, reconcile -----------------------------------------------


@query
def compare_pairs(spark, sf):
    left = _docs2(spark, sf).drop("content")
    pairs = cmp.compare_pairs(left, v.library_files(spark, sf), MEMBER)
    return pairs.select(*MEMBER, "file_size", "match_path")


@query
def compare_only_left(spark, sf):
    left = _docs2(spark, sf).drop("content")
    return cmp.only_left(left, v.library_files(spark, sf), MEMBER).select(*MEMBER, "file_path", "file_size")


@query
def compare_only_right(spark, sf):
    # The other way round: the library on the left, the members on the right.
    left, right = v.library_files(spark, sf).drop("content"), _docs2(spark, sf).drop("content")
    return cmp.only_right(left, right, MEMBER).select(*MEMBER, "file_size")


@query
def compare_summary(spark, sf):
    return cmp.compare_summary(_docs2(spark, sf), v.library_files(spark, sf))


@query
def diff_files(spark, sf):
    source = _docs(spark, sf).drop("content")
    return cmp.diff(source, v.library_files(spark, sf), MEMBER).select(*MEMBER, "file_path", "present")


@query
def diff_archives(spark, sf):
    entries = _docs2(spark, sf).withColumn("file_crc", F.crc32("content")).drop("content")
    target = v.library_files(spark, sf).select(
        "root", "file_path", "file_size", fx.crc_key().alias("content_key")
    )
    return cmp.diff_archives(entries, target).select(*MEMBER, "present")


@query
def diff_summary(spark, sf):
    return cmp.diff_summary(_docs(spark, sf), v.library_files(spark, sf))


@query
def missing_by_folder(spark, sf):
    source = _docs(spark, sf).drop("content").withColumn(
        "file_path", F.concat(F.regexp_replace("archive", ".zip", ""), F.lit("/"), "file_path")
    )
    return cmp.missing_by_folder(cmp.diff(source, v.library_files(spark, sf), MEMBER))


@query
def diff_manifest(spark, sf):
    diffed = cmp.diff(_docs(spark, sf).drop("content"), v.library_files(spark, sf), MEMBER)
    path = scratch_path(spark, "diff-manifest")
    mf.write_diff_manifest(cmp.diff_manifest(diffed), path, "2024-01-01T00:00:00", 0)
    return mf.read_diff_manifest(spark, path)


@query
def manifest(spark, sf):
    return mf.manifest(_catalog(spark, sf))


@query
def manifest_read_back(spark, sf):
    path = scratch_path(spark, "manifest")
    mf.write_manifest(mf.manifest(_catalog(spark, sf)), path, "2024-01-01T00:00:00")
    return mf.read_manifest(spark, path)


@query
def csv_report(spark, sf):
    path = scratch_path(spark, "csv")
    mf.write_csv_report(_catalog(spark, sf), path)
    schema = ", ".join(f"`{c}` STRING" for c in mf.CSV_COLUMNS)
    rows = spark.read.option("header", True).option("escape", '"').schema(schema).csv(path)
    return rows.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c.replace(" ", "_").lower()) for c in mf.CSV_COLUMNS])


def _reconciled(spark: SparkSession, sf: str) -> DataFrame:
    rows = settle(mf.manifest(_catalog(spark, sf)), "manifest")
    return rc.reconcile(rows, v.library_files(spark, sf), v.kept_archives(spark, sf))


@query
def reconcile_status(spark, sf):
    return _reconciled(spark, sf).select("source_zip", "source_path", "file_crc", "status")


@query
def reconcile_summary(spark, sf):
    return rc.reconcile_summary(_reconciled(spark, sf))


@query
def pending_by_year(spark, sf):
    return rc.pending_by_year(_reconciled(spark, sf))


@query
def missing_sources(spark, sf):
    return rc.missing_sources(_reconciled(spark, sf))


# Planning and writing ---------------------------------------------------


@query
def skip_existing(spark, sf):
    return _plan(spark, sf).select(*MEMBER, "is_duplicate", "already_present", "to_extract")


@query
def archive_plan(spark, sf):
    return pl.archive_plan(_plan(spark, sf))


@query
def plan_totals(spark, sf):
    return pl.plan_totals(_plan(spark, sf))


@query
def deletable_archives(spark, sf):
    sizes = _docs2(spark, sf).groupBy("archive").agg(F.sum("file_size").alias("archive_bytes"))
    return pl.deletable_archives(pl.archive_plan(_plan(spark, sf)), sizes)


@query
def deletable_total(spark, sf):
    sizes = _docs2(spark, sf).groupBy("archive").agg(F.sum("file_size").alias("archive_bytes"))
    return pl.deletable_total(pl.deletable_archives(pl.archive_plan(_plan(spark, sf)), sizes))


@query
def plan_by_type(spark, sf):
    return pl.plan_by_type(_plan(spark, sf))


@query
def extraction_batches(spark, sf):
    return pl.extraction_batches(_plan(spark, sf))


@query
def extract_by_year(spark, sf):
    return pl.extract_by_year(_plan(spark, sf))


def _located(spark: SparkSession, sf: str) -> DataFrame:
    """Every line item as a file to place; few names, so most of them collide."""
    name = F.concat(
        F.lit("IMG_"), F.col("l_partkey").cast("string"), F.lit("x"),
        F.col("l_linenumber").cast("string"), F.lit(".jpg"),
    )
    return _lines(spark, sf).withColumn(
        "location", F.concat(F.lit("out/"), F.date_format("file_date", "yyyy/MM/"), name)
    )


@query
def resolve_destination(spark, sf):
    taken = v.occupied_names(spark, sf)
    placed = lib.resolve_destinations(_located(spark, sf), taken, v.LINE_ORDER)
    return placed.select(*v.LINE_ORDER, "location", "destination")


@query
def resolve_destination_families(spark, sf):
    # Names that end in numbers: "part_7.jpg" stands beside numbered copies of "part.jpg".
    name = F.when(F.col("l_linenumber") > 3, F.lit("part.jpg")).otherwise(
        F.concat(F.lit("part_"), (F.col("l_partkey") % 50).cast("string"), F.lit(".jpg"))
    )
    rows = _lines(spark, sf).withColumn(
        "location", F.concat(F.lit("out/"), F.date_format("file_date", "yyyy/MM/"), name)
    )
    return lib.resolve_destinations(rows, None, v.LINE_ORDER).select(*v.LINE_ORDER, "location", "destination", "error")


def _written(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    plan = _plan(spark, sf)
    located = plan.filter("to_extract").withColumn("location", fx.reroot("proposed_location", "out"))
    placed = settle(lib.resolve_destinations(located), "placed")
    contents = _docs2(spark, sf).select("archive", "entry_ix", "content")
    summary = lib.write_library(placed.join(contents, MEMBER), scratch_path(spark, "library"))
    return plan, summary


@query
def write_library(spark, sf):
    summary = _written(spark, sf)[1]
    return summary.select("archive", "total_files", "extracted", "errors", "bytes_extracted")


@query
def extraction_metrics(spark, sf):
    plan, summary = _written(spark, sf)
    return lib.extraction_metrics(summary, pl.plan_totals(plan))


# Exports ----------------------------------------------------------------


@query
def latest_export(spark, sf):
    return ex.latest_export(ex.dated_exports(_lines(spark, sf), v.EXPORT_PREFIX))


@query
def exports_by_date(spark, sf):
    return ex.exports_by_date(ex.dated_exports(_lines(spark, sf), v.EXPORT_PREFIX))


# Sources over files that Spark writes from the tables ---------------------


def _archived(spark: SparkSession, sf: str) -> str:
    path = scratch_path(spark, "archives")
    export_archives(_docs(spark, sf), path)
    return path


@query
def archive_scan(spark, sf):
    entries = ar.read_archives(spark, _archived(spark, sf))
    return entries.select(
        fx.file_name("archive").alias("archive"), "entry_ix", "file_path", "file_size", "zip_y", "zip_mo", "zip_d"
    )


@query
def archive_content(spark, sf):
    entries = ar.read_archives(spark, _archived(spark, sf), with_content=True)
    return entries.select(
        fx.file_name("archive").alias("archive"), "entry_ix", F.sha2("content", 256).alias("content_hash")
    )


@query
def archive_blocks(spark, sf):
    # Small blocks, so that most members have several.
    blocks = xt.read_entry_blocks(ar.read_archives(spark, _archived(spark, sf)), block_bytes=1000)
    return blocks.groupBy(fx.file_name("archive").alias("archive"), "entry_ix").agg(
        F.count("*").alias("blocks"), F.sum(F.octet_length("data")).alias("bytes"),
        F.max(F.when(F.col("is_last"), F.col("sha256"))).alias("content_hash"),
    )


def _extracted(spark: SparkSession, sf: str) -> tuple[DataFrame, str]:
    """Every archive's members and one more that it lacks, extracted to files."""
    entries = ar.read_archives(spark, _archived(spark, sf)).select("archive", "entry_ix", "file_path", "file_size")
    missing = entries.groupBy("archive").agg(F.max("entry_ix").alias("ix")).select(
        "archive", (F.col("ix") + 1).alias("entry_ix"), F.lit("lost.jpg").alias("file_path"), F.lit(0).cast("bigint").alias("file_size")
    )
    name = F.concat(F.col("entry_ix").cast("string"), F.lit("_"), fx.file_name("file_path"))
    wanted = entries.unionByName(missing).withColumn(
        "destination", F.concat(F.lit("out/"), fx.file_name("archive"), F.lit("/"), name)
    )
    root = scratch_path(spark, "files")
    return xt.extract_files(wanted.withColumn("error", F.lit(None).cast("string")), root), root


@query
def extract_files(spark, sf):
    written, _ = _extracted(spark, sf)
    summary = lib.write_summary(written)
    return summary.select(
        fx.file_name("archive").alias("archive"), "total_files", "extracted", "errors", "bytes_extracted",
        F.concat_ws("; ", "first_errors").alias("first_errors"),
    )


@query
def extracted_content(spark, sf):
    _, root = _extracted(spark, sf)
    return di.scan_directory(spark, root, "full").groupBy(
        F.element_at(F.split("file_path", "/"), 2).alias("archive"), "content_key"
    ).agg(F.count("*").alias("files"))


@query
def crc_key_content(spark, sf):
    # The key made from the bytes that come back from an archive, beside that of the archive's own checksum.
    entries = ar.read_archives(spark, _archived(spark, sf), with_content=True)
    return entries.select(
        fx.file_name("archive").alias("archive"), "entry_ix", (fx.crc_key() == fx.metadata_key()).alias("same"),
        F.regexp_extract(fx.crc_key(), "^(.*)_[0-9a-f]{8}$", 1).cast("bigint").alias("bytes"),
    )


@query
def import_new(spark, sf):
    tree = scratch_path(spark, "tree")
    export_files(v.library_files(spark, sf), tree)
    left = settle(ar.read_entry_keys(ar.read_archives(spark, _archived(spark, sf)), "full"), "left")
    right = di.scan_directory(spark, tree, "full")
    new = settle(cmp.only_left(left, right, MEMBER), "new")
    done = commands.import_new(spark, new, "out", scratch_path(spark, "imported"))
    return done.select(fx.file_name("archive").alias("archive"), "total_files", "extracted", "errors", "bytes_extracted")


@query
def archive_keys(spark, sf):
    entries = ar.read_archives(spark, _archived(spark, sf))
    keyed = ar.read_entry_keys(entries, "full")
    return keyed.select(fx.file_name("archive").alias("archive"), "entry_ix", "content_key")


@query
def directory_scan(spark, sf):
    path = scratch_path(spark, "tree")
    export_files(v.library_files(spark, sf), path)
    return di.scan_directory(spark, path, "full").select("file_path", "file_size", "content_key")


@query
def fingerprints(spark, sf):
    # Small samples, so that files go through every level.
    path = scratch_path(spark, "tree")
    export_files(v.library_files(spark, sf), path)
    listed = di.list_directory(spark, path).select("root", "file_path", "file_size")
    return fp.fingerprint(listed, sample=64).select("file_path", "copies", (F.col("bytes_read") > 0).alias("was_read"))


@query
def directory_hash_selected(spark, sf):
    # Only files without a cached key are opened.
    path = scratch_path(spark, "tree")
    export_files(v.library_files(spark, sf), path)
    cached = v.hash_cache(spark, sf).select("file_path")
    listed = di.list_directory(spark, path).join(cached, "file_path", "left_anti")
    return di.hash_files(listed, "full").select("file_path", "file_size", "content_key")
