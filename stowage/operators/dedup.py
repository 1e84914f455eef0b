"""Duplicate detection on catalog metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import file_type, metadata_key, normalized_name
from .skew import attach

ORDER = ("archive", "entry_ix")
MODES = ("two_stage", "content_only")


def with_key(entries: DataFrame) -> DataFrame:
    """The entries with ``content_key``, from metadata where they have none."""
    if "content_key" in entries.columns:
        return entries
    return entries.withColumn("content_key", metadata_key())


def name_key() -> Column:
    """The normalized name of ``file_path``."""
    # Never NULL, so that joins on it need no not-null filter, which would evaluate it twice.
    return F.coalesce(normalized_name("file_path"), F.lit(""))


def name_groups(entries: DataFrame, order_cols=ORDER) -> DataFrame:
    """Groups of equal size and normalized name with at least two members.

    One row per group: its count and its first member in scan order.
    """
    return (
        entries.select(
            "file_size", name_key().alias("norm_name"), F.struct(*order_cols).alias("_ord")
        )
        .groupBy("file_size", "norm_name")
        .agg(F.count("*").alias("_n"), F.min("_ord").alias("_group_first"))
        .filter(F.col("_n") > 1)
    )


def _stage_one(entries: DataFrame, order_cols, hot_rows: int | None) -> DataFrame:
    named = entries.withColumn("norm_name", name_key())
    return attach(
        named, name_groups(entries, order_cols), ["file_size", "norm_name"], list(order_cols), "_n", hot_rows
    )


def split_candidates(entries: DataFrame, order_cols=ORDER, hot_rows: int | None = None) -> DataFrame:
    """Flag members that share size and normalized name with another (``is_candidate``)."""
    staged = _stage_one(entries, order_cols, hot_rows)
    return staged.withColumn("is_candidate", F.col("_n").isNotNull()).drop("_n", "_group_first")


def _order_text(order_cols) -> Column:
    return F.concat_ws("/", F.lit("u"), *[F.col(c).cast("string") for c in order_cols])


def _described(order_cols: list[str]) -> Column:
    """A member as its place in scan order and its path, with the archive where the place does not name it."""
    named = ["file_path"] if "archive" in order_cols else ["archive", "file_path"]
    return F.struct(F.struct(*order_cols).alias("place"), *named)


#: Hash values that stand for name groups of more than one content; bounds a broadcast.
MIXED_SLOTS = 1 << 18


def _cell_facts(keyed: DataFrame, order_cols: list[str], hot_rows: int | None) -> DataFrame:
    """For every (file_size, norm_name, content_key) of name groups with a mate: members, and size and first of the key.

    The members of a name group mostly hold the same content; then the group's
    own aggregate says all that is needed of it. Members of the other groups are
    counted by content as well, after a look at a short list of hash values, so
    that only they, and chance equals, are shuffled again. What keys have in
    common is worked out on these cells; members are joined to it once.
    """
    first = _described(order_cols)
    # The condition that the joins below put on their keys stands here, before all uses, so that their plans are equal.
    members = keyed.filter("file_size IS NOT NULL").select("file_size", name_key().alias("norm_name"), "content_key", first.alias("_least"))
    name = ["file_size", "norm_name"]
    # The last condition always holds; with it every use needs all aggregates, and they share one exchange.
    groups = members.groupBy(*name).agg(
        F.count("*").alias("_n"), F.min("_least").alias("_least"), F.count("content_key").alias("_known"),
        F.min("content_key").alias("content_key"), F.max("content_key").alias("_high"),
    ).filter((F.col("_n") > 1) & F.col("_least").isNotNull())
    even = F.coalesce((F.col("content_key") == F.col("_high")) & (F.col("_known") == F.col("_n")), F.lit(False))
    columns = [*name, "content_key", "_n", "_group_first", "_least"]
    same = groups.filter(even).withColumn("_group_first", F.col("_least.place")).select(*columns)

    slot = F.coalesce(F.pmod(F.xxhash64(*name), F.lit(MIXED_SLOTS)), F.lit(0)).alias("_slot")
    mixed = groups.filter(~even)
    slots = mixed.select(slot).distinct()
    perhaps = members.filter("content_key IS NOT NULL").withColumn("_slot", slot).join(F.broadcast(slots), "_slot", "left_semi")
    counted = perhaps.groupBy(*name, "content_key").agg(F.count("*").alias("_n"), F.min("_least").alias("_least"))
    leads = mixed.select(*name, F.col("_n").alias("_mates"), F.col("_least.place").alias("_group_first"))
    several = attach(counted, leads, name, ["content_key"], "_mates", hot_rows).filter("_mates IS NOT NULL").select(*columns)

    cells = same.unionByName(several)
    rank = F.struct("_group_first", "_least.place").alias("rank")
    keys = cells.groupBy("content_key").agg(
        F.sum("_n").alias("_size"), F.min(F.struct(rank, F.col("_least"))).alias("_first"), F.count("*").alias("_cells")
    ).select("content_key", "_size", F.col("_first._least").alias("_first"), "_cells")
    facts = attach(cells.select(*name, "content_key", "_n"), keys, ["content_key"], name, "_cells", hot_rows)
    return facts.select(*name, "content_key", "_n", "_size", "_first")


def dedup(
    entries: DataFrame,
    mode: str = "two_stage",
    order_cols=ORDER,
    hot_rows: int | None = None,
) -> DataFrame:
    """Find duplicates and the original of each.

    ``two_stage``: members alone in their (size, normalized name) group are
    unique; the others are equal when their content keys are, across names.
    ``content_only``: equal content keys alone decide.

    The original is the first member, ordered by the first member of its name
    group and then by ``order_cols``, which must be unique. Adds ``dedup_key``,
    ``is_duplicate``, ``group_size``, ``original_archive``, ``original_path``.
    """
    if mode not in MODES:
        raise ValueError(f"unknown dedup mode {mode!r}")
    order_cols = list(order_cols)
    keyed = with_key(entries)
    place = F.struct(*order_cols)
    if mode == "two_stage":
        # A member without a key meets no other; it takes a spread key that no cell has.
        filler = F.concat(F.lit("\x02"), F.pmod(F.xxhash64(*order_cols), F.lit(8192)).cast("string"))
        rows = keyed.withColumn("norm_name", name_key()).withColumn("_key", F.coalesce("content_key", filler))
        facts = _cell_facts(keyed, order_cols, hot_rows).withColumnRenamed("content_key", "_key")
        found = attach(rows, facts, ["file_size", "norm_name", "_key"], order_cols, "_n", hot_rows)
        own = F.when(F.col("_size").isNotNull(), F.col("content_key"))
    else:
        rows = keyed.withColumn("_key", F.coalesce("content_key", _order_text(order_cols)))
        groups = (
            rows.select("_key", _described(order_cols).alias("_member"))
            .groupBy("_key")
            .agg(F.count("*").alias("_size"), F.min("_member").alias("_first"))
            .filter(F.col("_size") > 1)
        )
        found = attach(rows, groups, ["_key"], order_cols, "_size", hot_rows)
        own = F.col("content_key")
    grouped = F.coalesce(F.col("_size") > 1, F.lit(False))
    return found.select(
        *[F.col(c) for c in keyed.columns],
        F.coalesce(own, _order_text(order_cols)).alias("dedup_key"),
        F.coalesce(grouped & (place != F.col("_first.place")), F.lit(False)).alias("is_duplicate"),
        F.coalesce("_size", F.lit(1).cast("bigint")).alias("group_size"),
        F.when(grouped, F.col("_first.place.archive" if "archive" in order_cols else "_first.archive")).otherwise(F.col("archive")).alias("original_archive"),
        F.when(grouped, F.col("_first.file_path")).otherwise(F.col("file_path")).alias("original_path"),
    )


def duplicate_groups(deduped: DataFrame) -> DataFrame:
    """Members of groups with more than one member."""
    return deduped.filter(F.col("group_size") > 1)


def originals(deduped: DataFrame) -> DataFrame:
    return deduped.filter(~F.col("is_duplicate"))


def duplicates(deduped: DataFrame) -> DataFrame:
    return deduped.filter(F.col("is_duplicate"))


def dedup_counts(deduped: DataFrame) -> DataFrame:
    """One row: unique keys and duplicates."""
    return deduped.agg(
        F.count_if(~F.col("is_duplicate")).alias("unique_keys"),
        F.count_if(F.col("is_duplicate")).alias("duplicates"),
    )


def entry_totals(entries: DataFrame, mode: str = "two_stage") -> DataFrame:
    """One row: files, bytes, duplicates and their bytes, as :func:`dedup` would find them, from counts alone.

    A content key's candidates are its members without those that are alone in
    their name group; all but one of them are duplicates. So two aggregations,
    both combined before their shuffle, replace the joins that say which
    member is which.
    """
    if mode not in MODES:
        raise ValueError(f"unknown dedup mode {mode!r}")
    keyed = with_key(entries)
    known, none = F.col("content_key").isNotNull(), F.lit(0).cast("bigint")
    # Members without a key equal no other; they count as files only.
    keys = keyed.groupBy("content_key").agg(
        F.count("*").alias("files"), F.sum("file_size").alias("bytes"), F.max("file_size").alias("_size")
    ).withColumn("_members", F.when(known, F.col("files")).otherwise(0))
    if mode == "two_stage":
        alone = (
            keyed.select("file_size", name_key().alias("norm_name"), "content_key")
            .groupBy("file_size", "norm_name")
            .agg(F.count("*").alias("_n"), F.max("content_key").alias("content_key"))
            .filter((F.col("_n") == 1) & known)
            .select("content_key", none.alias("files"), none.alias("bytes"), F.col("file_size").alias("_size"), F.lit(-1).alias("_members"))
        )
        keys = keys.unionByName(alone).groupBy("content_key").agg(
            *[F.sum(c).alias(c) for c in ("files", "bytes", "_members")], F.max("_size").alias("_size")
        )
    extra = F.greatest(F.col("_members") - 1, F.lit(0))
    sums = {"files": F.col("files"), "bytes": F.col("bytes"), "duplicates": extra, "wasted_bytes": extra * F.col("_size")}
    return keys.agg(*[F.coalesce(F.sum(c), none).cast("bigint").alias(name) for name, c in sums.items()])


def entry_counts(entries: DataFrame, mode: str = "two_stage") -> DataFrame:
    """:func:`dedup_counts` of undeduplicated entries."""
    return entry_totals(entries, mode).select((F.col("files") - F.col("duplicates")).alias("unique_keys"), "duplicates")


def directory_index(files: DataFrame) -> DataFrame:
    """Directory files per content key: count and first path."""
    return files.groupBy("content_key").agg(
        F.count("*").alias("file_count"), F.min("file_path").alias("first_path")
    )


def with_types(deduped: DataFrame) -> DataFrame:
    """Add the type of each member and of its original."""
    return deduped.withColumn("file_type", file_type("file_path")).withColumn(
        "original_type", file_type("original_path")
    )
