"""Report tables over a deduplicated, dated catalog.

Input columns: archive, archive_mtime, file_path, file_size, content_key,
is_duplicate, original_archive, original_path, and file_date where a table
needs it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import archive_label, display_path, file_name, file_type, human_size, short_hash
from ..functions.paths import TYPE_NAMES
from .dedup import entry_totals
from .skew import attach

# Fixed values.
LARGEST_SHOWN = 20
ARCHIVES_SHOWN = 10
MONTHS_SHOWN = 24
NAMES_SHOWN = 10
PAGE_SIZES = (100, 250, 500, 1000)
GIB = 1024.0**3
MIB = 1024.0**2
# share of duplicates in percent, class, label
DUPLICATE_CLASSES = [(100, "danger", "REDUNDANT"), (80, "warning", "Mostly duplicates"), (50, "warning", "")]



def _zero() -> Column:
    return F.lit(0).cast("bigint")


def _sum_if(condition: Column, value: str) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col(value))), _zero())


def summary_stats(deduped: DataFrame) -> DataFrame:
    """One row: files, unique, duplicates, bytes, wasted bytes, archives."""
    dup = F.col("is_duplicate")
    # Per archive first, so that counting archives needs no distinct expansion of the rows.
    per_archive = deduped.groupBy("archive").agg(
        F.count("*").alias("files"),
        F.count_if(dup).alias("dups"),
        F.sum("file_size").alias("bytes"),
        _sum_if(dup, "file_size").alias("wasted"),
    )
    return per_archive.agg(
        F.coalesce(F.sum("files"), _zero()).alias("total_files"),
        F.coalesce(F.sum(F.col("files") - F.col("dups")), _zero()).alias("unique_files"),
        F.coalesce(F.sum("dups"), _zero()).alias("duplicate_files"),
        F.coalesce(F.sum("bytes"), _zero()).alias("total_bytes"),
        F.coalesce(F.sum("wasted"), _zero()).alias("wasted_bytes"),
        F.count("*").alias("archives"),
    )


def entry_summary(entries: DataFrame, mode: str = "two_stage") -> DataFrame:
    """:func:`summary_stats` of undeduplicated entries, from counts alone."""
    totals = entry_totals(entries, mode).withColumn("archives", _zero())
    archives = entries.groupBy("archive").agg(F.count("*").alias("_rows")).agg(F.count("*").alias("archives"))
    rows = totals.unionByName(archives, allowMissingColumns=True)
    return rows.agg(*[F.sum(c).alias(c) for c in totals.columns]).select(
        F.col("files").alias("total_files"), (F.col("files") - F.col("duplicates")).alias("unique_files"),
        F.col("duplicates").alias("duplicate_files"), F.col("bytes").alias("total_bytes"), "wasted_bytes", "archives",
    )


def archive_stats(deduped: DataFrame) -> DataFrame:
    """Per archive: files, bytes, duplicates, unique, members of each type, share of duplicates."""
    dup = F.col("is_duplicate")
    typed = deduped.select(
        "archive", "archive_mtime", "file_size", "is_duplicate", file_type("file_path").alias("_type")
    )
    grouped = typed.groupBy("archive").agg(
        F.max("archive_mtime").alias("download_date"),
        F.count("*").alias("files"),
        F.sum("file_size").alias("bytes"),
        F.count_if(dup).alias("duplicate_files"),
        _sum_if(dup, "file_size").alias("duplicate_bytes"),
        F.count_if(~dup).alias("unique_files"),
        *[F.count_if(F.col("_type") == t).alias(f"n_{t}") for t in TYPE_NAMES],
    )
    return grouped.withColumn(
        "duplicate_pct", (F.col("duplicate_files") * 100.0 / F.col("files")).cast("double")
    ).withColumn("is_all_duplicate", F.col("duplicate_files") == F.col("files"))


def archive_dup_class(stats: DataFrame) -> DataFrame:
    """Archives with the class and label of their duplicate share, newest first."""
    pct = F.col("duplicate_pct")

    def pick(position: int, default: str) -> Column:
        chain = None
        for row in DUPLICATE_CLASSES:
            value = F.lit(row[position])
            chain = F.when(pct >= row[0], value) if chain is None else chain.when(pct >= row[0], value)
        return chain.otherwise(F.lit(default))

    return stats.select(
        "archive", "download_date", "files", "bytes", "duplicate_bytes", "duplicate_pct",
        pick(1, "success").alias("dup_class"), pick(2, "").alias("dup_label"),
    ).orderBy(F.desc("download_date"), "archive")


def redundant_archives(stats: DataFrame) -> DataFrame:
    """Archives that hold duplicates only, largest first."""
    return (
        stats.filter("is_all_duplicate")
        .select("archive", "download_date", "files", "bytes")
        .orderBy(F.desc("bytes"), "archive")
    )


def redundant_total(stats: DataFrame) -> DataFrame:
    """One row: redundant archives and the bytes they waste."""
    return stats.filter("is_all_duplicate").agg(
        F.count("*").alias("archives"), F.coalesce(F.sum("bytes"), _zero()).alias("wasted_bytes")
    )


def identical_archives(entries: DataFrame) -> DataFrame:
    """Archives with equal sets of content keys; the oldest download of each group is kept.

    A set is compared through its size and two independent order-free sums of
    64-bit hashes, so an archive of any length needs constant memory.
    """
    per_key = entries.groupBy("archive", "content_key").agg(
        F.count("*").alias("_files"),
        F.sum("file_size").alias("_bytes"),
        F.max("archive_mtime").alias("_date"),
    )
    first, second = F.xxhash64("content_key"), F.xxhash64(F.lit("second"), F.col("content_key"))
    archives = per_key.groupBy("archive").agg(
        F.max("_date").alias("download_date"),
        F.sum("_files").alias("files"),
        F.sum("_bytes").alias("bytes"),
        F.count("*").alias("_keys"),
        F.bit_xor(first).alias("_xor"),
        F.sum(first.cast("decimal(20,0)")).alias("_sum"),
        F.sum(second.cast("decimal(20,0)")).alias("_sum2"),
    )
    signature = ["_keys", "_xor", "_sum", "_sum2"]
    groups = (
        archives.groupBy(*signature)
        .agg(
            F.count("*").alias("group_archives"),
            F.min(F.struct("download_date", "archive", "bytes")).alias("_kept"),
        )
        .filter(F.col("group_archives") > 1)
    )
    return archives.join(groups, signature).select(
        F.col("_kept.archive").alias("kept_archive"),
        "archive",
        "download_date",
        "files",
        "bytes",
        "group_archives",
        (F.col("archive") == F.col("_kept.archive")).alias("is_kept"),
        (F.col("_kept.bytes") * (F.col("group_archives") - 1)).alias("wasted_bytes"),
    )


def identical_totals(identical: DataFrame) -> DataFrame:
    """One row: groups of identical archives and the bytes they waste."""
    return identical.filter("is_kept").agg(
        F.count("*").alias("groups"), F.coalesce(F.sum("wasted_bytes"), _zero()).alias("wasted_bytes")
    )


def original_locations(
    deduped: DataFrame, order_cols=("archive", "entry_ix"), names: int = NAMES_SHOWN
) -> DataFrame:
    """Where the originals of each all-duplicate archive are, with the first names per place.

    The names are limited inside each map task before they are shuffled, so an
    archive of any size sends at most ``names`` rows per task.
    """
    whole = (
        deduped.groupBy("archive")
        .agg(F.count("*").alias("_files"), F.count_if(F.col("is_duplicate")).alias("_dups"))
        .filter(F.col("_files") == F.col("_dups"))
        .select("archive", "_files")
    )
    # Only the members of those archives are ranked.
    dups = attach(deduped.filter(F.col("is_duplicate")), whole, ["archive"], list(order_cols), "_files").filter("_files IS NOT NULL")
    places = dups.groupBy("archive", "original_archive").agg(F.count("*").alias("files"))
    first_names = Window.partitionBy("archive", "original_archive").orderBy(*order_cols)
    listed = (
        dups.select("archive", "original_archive", "file_path", *[c for c in order_cols if c != "archive"])
        .withColumn("_rank", F.row_number().over(first_names))
        .filter(F.col("_rank") <= names)
        .groupBy("archive", "original_archive")
        .agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("_rank", file_name("file_path").alias("name")))),
                lambda x: x["name"],
            ).alias("names")
        )
    )
    shown = places.join(listed, ["archive", "original_archive"])
    return shown.select(
        "archive", "original_archive", "files", F.array_join("names", "|").alias("first_names"),
        F.greatest(F.col("files") - names, _zero()).alias("more_names"),
    )


def type_breakdown(entries: DataFrame) -> DataFrame:
    """Files and bytes per type."""
    return entries.groupBy(file_type("file_path").alias("file_type")).agg(
        F.count("*").alias("files"), F.sum("file_size").alias("bytes")
    )


def year_timeline(dated: DataFrame) -> DataFrame:
    """Per year: files and GiB, unique and duplicate."""
    dup = F.col("is_duplicate")
    return (
        dated.filter(F.col("file_date").isNotNull())
        .groupBy(F.year("file_date").alias("year"))
        .agg(
            F.count("*").alias("files"),
            F.sum("file_size").alias("bytes"),
            F.count_if(~dup).alias("unique_files"),
            _sum_if(~dup, "file_size").alias("unique_bytes"),
            F.count_if(dup).alias("duplicate_files"),
            _sum_if(dup, "file_size").alias("duplicate_bytes"),
        )
        .withColumn("gib", F.col("bytes") / GIB)
        .withColumn("unique_gib", F.col("unique_bytes") / GIB)
        .withColumn("duplicate_gib", F.col("duplicate_bytes") / GIB)
        .orderBy("year")
    )


def month_timeline(dated: DataFrame, months: int = MONTHS_SHOWN) -> DataFrame:
    """Files per month, for the last months that have any."""
    return (
        dated.filter(F.col("file_date").isNotNull())
        .groupBy(F.date_format("file_date", "yyyy-MM").alias("month"))
        .agg(F.count("*").alias("files"))
        .orderBy(F.desc("month"))
        .limit(months)
        .orderBy("month")
    )


def dup_by_type(deduped: DataFrame) -> DataFrame:
    """Duplicates and their bytes by the type of the original."""
    return (
        deduped.filter(F.col("is_duplicate"))
        .groupBy(file_type("original_path").alias("file_type"))
        .agg(F.count("*").alias("files"), F.sum("file_size").alias("bytes"))
    )


def largest_files(entries: DataFrame, order_cols=("archive", "entry_ix"), shown: int = LARGEST_SHOWN) -> DataFrame:
    """The largest files; ties in scan order."""
    return entries.orderBy(F.desc("file_size"), *order_cols).limit(shown).select(
        "archive", "file_path", file_name("file_path").alias("name"),
        file_type("file_path").alias("file_type"), "file_size",
        human_size("file_size", "TB").alias("size_text"),
    )


def report_rows(deduped: DataFrame) -> DataFrame:
    """One row per member with everything the file table shows.

    Unsorted: sort at the sink (``file_date`` descending), where a page or a
    partition is written.
    """
    dup = F.col("is_duplicate")
    return deduped.select(
        file_name("archive").alias("archive_name"),
        "archive",
        "entry_ix",
        "file_path",
        file_name("file_path").alias("name"),
        short_hash("content_key").alias("short_key"),
        "content_key",
        "is_duplicate",
        F.when(dup, display_path("original_archive", "original_path")).otherwise("").alias("duplicate_of"),
        "file_date",
        F.year("file_date").alias("year"),
        F.date_format("archive_mtime", "yyyy-MM-dd").alias("download_date"),
        "proposed_location",
        file_type("file_path").alias("file_type"),
        "file_size",
        human_size("file_size", "TB").alias("size_text"),
    )


def archives_by_date(stats: DataFrame) -> DataFrame:
    """Archives, newest download first."""
    return stats.select("archive", "download_date", "files", "bytes").orderBy(
        F.desc("download_date"), "archive"
    )


def recent_archives(stats: DataFrame, shown: int = ARCHIVES_SHOWN) -> DataFrame:
    """The newest downloads: label, files and MiB."""
    newest = stats.orderBy(F.desc("download_date"), "archive").limit(shown)
    return newest.select(
        "archive", archive_label(file_name("archive")).alias("label"), "download_date", "files",
        (F.col("bytes") / MIB).alias("mib"),
    )


def browse(
    rows: DataFrame,
    search: str = "",
    file_type: str = "",
    status: str = "",
    sort: str = "file_date",
    ascending: bool = False,
    page: int = 0,
    page_size: int = 100,
    tie: tuple[str, ...] = ("archive", "entry_ix"),
    after: dict | None = None,
) -> DataFrame:
    """One page of the file table after filtering and sorting.

    ``tie`` makes the order total. ``after`` holds the sort and tie values of
    the last row of the page before, and ``page`` then counts from there: any
    depth costs a filter and a top-k, where a page number alone has to rank all
    rows before it.
    """
    if page_size not in PAGE_SIZES:
        raise ValueError(f"page size must be one of {PAGE_SIZES}")
    found = browse_filter(rows, search, file_type, status)
    key = F.asc_nulls_first(sort) if ascending else F.desc_nulls_last(sort)
    if after is not None:
        found = found.filter(_behind(found, sort, ascending, tie, after))
    return found.orderBy(key, *tie).offset(page * page_size).limit(page_size)


def _behind(rows: DataFrame, sort: str, ascending: bool, tie: tuple[str, ...], after: dict) -> Column:
    """Rows that come after the given one; nulls sort first when ascending, else last."""
    last = F.lit(after[sort]).cast(rows.schema[sort].dataType)
    beyond = F.lit(False)
    for column in reversed(tie):
        value = F.lit(after[column]).cast(rows.schema[column].dataType)
        beyond = (F.col(column) > value) | ((F.col(column) == value) & beyond)
    if ascending:
        later = (F.col(sort) > last) if after[sort] is not None else F.col(sort).isNotNull()
    else:
        later = (F.col(sort) < last) | F.col(sort).isNull() if after[sort] is not None else F.lit(False)
    return F.coalesce(later, F.lit(False)) | (F.col(sort).eqNullSafe(last) & beyond)


def browse_filter(rows: DataFrame, search: str = "", file_type: str = "", status: str = "") -> DataFrame:
    """Rows whose name contains ``search`` and whose type and status are as asked."""
    if status not in ("", "unique", "duplicate"):
        raise ValueError("status is 'unique', 'duplicate' or empty")
    found = rows
    if search:
        found = found.filter(F.lower("name").contains(search.lower()))
    if file_type:
        found = found.filter(F.col("file_type") == file_type)
    if status:
        found = found.filter(F.col("is_duplicate") == (status == "duplicate"))
    return found


def browse_count(rows: DataFrame, page_size: int = 100, **filters) -> DataFrame:
    """One row: matching files and pages."""
    return browse_filter(rows, **filters).agg(F.count("*").alias("files")).withColumn(
        "pages", F.ceil(F.col("files") / page_size).cast("bigint")
    )


def build_report(catalog: DataFrame, order_cols=("archive", "entry_ix")) -> dict[str, DataFrame]:
    """All report tables by name. ``catalog`` should be a written (or cached) table."""
    stats = archive_stats(catalog)
    identical = identical_archives(catalog)
    return {
        "summary_stats": summary_stats(catalog),
        "archive_stats": stats,
        "archive_dup_class": archive_dup_class(stats),
        "redundant_archives": redundant_archives(stats),
        "redundant_total": redundant_total(stats),
        "identical_archives": identical,
        "identical_totals": identical_totals(identical),
        "original_locations": original_locations(catalog, order_cols),
        "type_breakdown": type_breakdown(catalog),
        "year_timeline": year_timeline(catalog),
        "month_timeline": month_timeline(catalog),
        "dup_by_type": dup_by_type(catalog),
        "largest_files": largest_files(catalog, order_cols),
        "archives_by_date": archives_by_date(stats),
        "recent_archives": recent_archives(stats),
        "report_rows": report_rows(catalog),
    }
