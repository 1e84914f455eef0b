"""Destinations without collisions, and writing the library."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import file_name, parent_dir
from ..functions.paths import exact_suffix, file_stem
from ..sources.archives import TASKS_PER_CORE
from ..sources.extraction import by_bytes
from ..storage import names_in, settle
from .numbering import passed_over, served
from .prefix import crowded, slotted
from .skew import attach

# Numbered names end in _1, _2 and so on; a number has no leading zero.
NUMBER_TAIL = r"_[1-9]\d{0,17}$"
NUMBER_CHAIN = r"((?:_[1-9]\d{0,17})+)$"


def _crowded(location: Column) -> Column:
    return F.concat(F.lit("Too many collisions for "), location)


def _numbered(folder: str, name: str, number: Column) -> Column:
    return F.concat(
        F.col(folder), F.lit("/"), file_stem(name), F.lit("_"), number.cast("string"), exact_suffix(name)
    )


def _claims(wants: DataFrame, taken: DataFrame | None) -> DataFrame:
    """Every want of a (folder, name), and the names on disk."""
    claims = wants.select("_folder", "_name", F.lit(1).alias("_want"), F.lit(False).alias("_on_disk"))
    if taken is None:
        return claims
    return claims.unionByName(taken.select("_folder", "_name", F.lit(0).alias("_want"), F.lit(True).alias("_on_disk")))


def _names(claims: DataFrame) -> DataFrame:
    """One row per (folder, name): files that want it, and whether it is on disk."""
    names = claims.groupBy("_folder", "_name").agg(
        F.sum("_want").alias("_want"), F.bool_or("_on_disk").alias("_on_disk")
    )
    return names.select("*", file_stem("_name").alias("_stem"), exact_suffix("_name").alias("_suffix"))


def _numbered_names(tailed: DataFrame, claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The names that stand beside a wanted name as its numbered copies, with their place in the family; the wanted names.

    ``a_1_2.jpg`` can meet the numbered names of ``a_1.jpg`` only if some file
    wants ``a_1.jpg``, and those of ``a.jpg`` only through it. So the family
    is found by cutting numbers off the end for as long as each shorter name
    is wanted by a file: ``_level`` times. ``_parent`` is the name one number
    shorter, ``_number`` that number, ``_family`` the topmost name.
    """
    names = tailed.columns
    chain = F.regexp_extract("_stem", NUMBER_CHAIN, 1)
    depth = F.length(chain) - F.length(F.regexp_replace(chain, "_", ""))
    parts = F.split("_stem", "_")
    steps = (
        tailed.select(*names, parts.alias("_parts"), F.explode(F.sequence(F.lit(1), depth)).alias("_level"))
        .select(
            *names,
            "_level",
            F.concat(
                F.array_join(F.slice("_parts", F.lit(1), F.size("_parts") - F.col("_level")), "_"), F.col("_suffix")
            ).alias("_above"),
        )
    )
    # Written first, so that few names above are sent to the claims, not all claims to them.
    above = settle(steps.select("_folder", F.col("_above").alias("_name")).distinct(), "above")
    wanted = settle(_names(claims).join(above, ["_folder", "_name"], "left_semi").filter("_want > 0"), "wanted")
    reached = (
        steps.join(wanted.select("_folder", F.col("_name").alias("_above")), ["_folder", "_above"])
        .groupBy(*names)
        .agg(F.map_from_entries(F.collect_list(F.struct("_level", "_above"))).alias("_tops"))
    )
    # Highest level reached without a gap; at most one entry per number in a name.
    climbed = F.aggregate(
        F.sequence(F.lit(1), F.size("_tops")),
        F.lit(0),
        lambda got, level: F.when(
            (got == level - 1) & F.map_contains_key("_tops", level), level
        ).otherwise(got),
    )
    numbered = reached.withColumn("_level", climbed).filter("_level > 0").select(
        *names,
        "_level",
        F.element_at("_tops", F.col("_level")).alias("_family"),
        F.element_at("_tops", F.lit(1)).alias("_parent"),
        F.element_at(parts, -1).try_cast("bigint").alias("_number"),
    )
    return settle(numbered, "numbered"), wanted


def _mixed(claims: DataFrame, hot_rows: int | None) -> DataFrame | None:
    """The names of families of several names in which some name is wanted twice, or wanted and on disk."""
    busy = F.col("_want") + F.col("_on_disk").cast("bigint") > 1
    tailed = settle(_names(claims.filter(file_stem("_name").rlike(NUMBER_TAIL))), "tailed")
    if tailed.isEmpty():
        return None
    numbered, wanted = _numbered_names(tailed, claims)
    family = numbered.groupBy("_folder", F.col("_family").alias("_name")).agg(
        F.count("*").alias("_below"), F.max(busy).alias("_busy_below")
    )
    tops = wanted.join(family, ["_folder", "_name"]).filter(busy | F.col("_busy_below")).select(
        *tailed.columns, F.lit(0).alias("_level"), F.lit(None).cast("string").alias("_parent"),
        F.lit(None).cast("bigint").alias("_number"), "_below",
    )
    tops = settle(tops, "tops")
    clash = tops.select("_folder", F.col("_name").alias("_family"), "_below", F.lit(True).alias("_clash"))
    below = attach(numbered, clash, ["_family", "_folder"], ["_name"], "_below", hot_rows).filter("_clash")
    columns = [*tailed.columns, "_level", "_parent", "_number"]
    mixed = settle(tops.select(*columns).unionByName(below.select(*columns)), "names")
    return None if mixed.isEmpty() else mixed


def _marks(
    wants: DataFrame, mixed: DataFrame, hot: DataFrame | None, order_cols: list[str], hot_rows: int | None
) -> DataFrame:
    """Per name wanted beside its parent, the files that want the parent before the first that wants the name: ``_earlier``."""
    beside = mixed.filter("_level > 0 AND _want > 0 AND NOT _on_disk").select("_folder", "_name", "_parent")
    first = (
        wants.filter(file_stem("_name").rlike(NUMBER_TAIL))
        .groupBy("_folder", "_name")
        .agg(F.min(F.struct(*order_cols)).alias("_first"))
        .join(beside, ["_folder", "_name"])
        .select("_folder", F.col("_parent").alias("_name"), "_first.*", F.col("_name").alias("_child"))
    )
    first = settle(first, "first")
    parents = mixed.filter("_want > 0").select("_folder", "_name", "_want").join(
        first.select("_folder", "_name").distinct().withColumn("_is_parent", F.lit(True)), ["_folder", "_name"]
    )
    files = attach(wants, settle(parents, "parents"), ["_name", "_folder"], order_cols, "_want", hot_rows).filter("_is_parent")
    events = files.select(*wants.columns, F.lit(1).alias("_file")).unionByName(
        first.withColumn("_file", F.lit(0)), allowMissingColumns=True
    )
    so_far = Window.partitionBy("_folder", "_name", "_slot").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
    counted = slotted(events, hot, ["_folder", "_name"], order_cols).withColumn(
        "_earlier", F.col("_before") + F.sum("_file").over(so_far)
    )
    return settle(counted.filter("_child IS NOT NULL").select("_folder", "_child", "_earlier"), "marks")


def resolve_destinations(
    planned: DataFrame,
    taken: DataFrame | None = None,
    order_cols=("archive", "entry_ix"),
    hot_rows: int | None = None,
    last_number: int | None = None,
) -> DataFrame:
    """Give every file a free name at its ``location``: adds ``destination`` and ``error``.

    Files are served in ``order_cols`` order, which names each file. A name that
    is free is taken as it is, else the smallest free ``stem_N.ext``.
    ``last_number`` bounds N; files beyond it get an error. Without it every
    file gets a name. ``taken`` holds the ``destination`` paths already on disk.

    The files go through one shuffle by name, in which their rank is the number;
    names that are gone stand among them as rows of their own. Only files of a
    name with numbered names in the way go through a second, by rank, which
    adds the numbers passed over (:mod:`.numbering`). Names of very many files
    are cut into slots (:mod:`.prefix`).
    """
    order_cols, name = list(order_cols), ["_folder", "_name"]
    # Never NULL, so that they can be keys.
    rows = planned.withColumn("_folder", F.coalesce(parent_dir("location"), F.lit(""))).withColumn(
        "_name", F.coalesce(file_name("location"), F.lit(""))
    )
    wants = rows.select(*name, *order_cols)
    gone = None if taken is None else taken.select(
        F.coalesce(parent_dir("destination"), F.lit("")).alias("_folder"),
        F.coalesce(file_name("destination"), F.lit("")).alias("_name"),
    )
    hot = crowded(wants, name, order_cols, hot_rows)
    mixed, steps = _mixed(_claims(wants, gone), hot_rows), None
    if mixed is not None:
        lost, steps = served(mixed, _marks(wants, mixed, hot, order_cols, hot_rows), last_number, hot_rows)
        gone = lost if gone is None else gone.unionByName(lost)

    # What is known of a name, as rows before its files.
    no, yes = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    known = None if gone is None else gone.select(*name, yes.alias("_gone"), no.alias("_stepped"))
    if steps is not None:
        stepped = steps.select(*name).distinct().select(*name, no.alias("_gone"), yes.alias("_stepped"))
        known = stepped if known is None else known.unionByName(stepped)
    files = rows.withColumn("_file", F.lit(1))
    if hot is not None and known is not None:
        facts = known.join(F.broadcast(hot.select(*name)), name).groupBy(*name).agg(
            F.max("_gone").alias("_gone"), F.max("_stepped").alias("_stepped")
        )
        hot = hot.join(settle(facts, "facts"), name, "left")
    files = slotted(files, hot, name, order_cols)
    if known is not None:
        files = files.unionByName(
            known.withColumns({"_file": F.lit(0), "_slot": F.lit(0), "_before": no}), allowMissingColumns=True
        )
    else:
        files = files.withColumns({"_gone": no, "_stepped": no})
    so_far = Window.partitionBy(*name, "_slot").orderBy("_file", *order_cols).rowsBetween(Window.unboundedPreceding, 0)
    # Rank 0 is the name itself; it is not given if the name is gone.
    rank = F.col("_before") + F.sum("_file").over(so_far) - 1 + F.coalesce(F.max("_gone").over(so_far), no)
    ranked = files.select(
        *planned.columns, *name, "_file", rank.alias("_rank"), F.coalesce(F.max("_stepped").over(so_far), no).alias("_stepped")
    ).filter("_file = 1").drop("_file")
    if steps is None:
        numbered = ranked.withColumn("_number", F.col("_rank"))
    else:
        passed = passed_over(ranked.filter("_stepped = 1"), steps, hot_rows)
        number = F.when(F.col("_rank") > 0, F.col("_rank") + F.col("_skipped")).otherwise(F.col("_rank"))
        numbered = ranked.filter("_stepped = 0").withColumn("_number", F.col("_rank")).unionByName(
            passed.withColumn("_number", number).drop("_skipped")
        )
    too_far = F.lit(False) if last_number is None else F.col("_number") > last_number
    return numbered.select(
        *planned.columns,
        F.when(too_far, F.lit(None))
        .when(F.col("_number") == 0, F.col("location"))
        .otherwise(_numbered("_folder", "_name", F.col("_number")))
        .alias("destination"),
        F.when(too_far, _crowded(F.col("location"))).alias("error"),
    )


def write_library(
    planned: DataFrame,
    path: str,
    read_content: Callable[[DataFrame], DataFrame] | None = None,
    order_cols=("archive", "entry_ix"),
    partitions: int | None = None,
    run_id: str | None = None,
) -> DataFrame:
    """Add planned files with their content to a library, partitioned by run, year and month.

    Every call writes a run of its own below ``path`` and touches nothing that
    is there; a folder that holds anything but runs is refused. Each file's
    SHA-256 is kept beside it, so later runs know it without reading content.

    The plan (metadata only) is cut by month and archive into ranges of about
    equal bytes first; content is then read in the task that writes it, so bytes are never
    shuffled, a month of any size spans many tasks, and each task opens few
    files. Returns the outcome per archive (see :func:`write_summary`).

    Errors of the plan and members whose content is NULL are kept as rows
    with ``error`` set and no content.
    """
    spark = planned.sparkSession
    require_library(spark, path)
    run = f"{path.rstrip('/')}/run_id={run_id or uuid.uuid4().hex}"
    month = F.coalesce(F.date_format("file_date", "yyyy"), F.lit("Unknown"))
    dated = planned.withColumn("year", month).withColumn(
        "month", F.coalesce(F.date_format("file_date", "MM"), F.lit("00"))
    )
    ranges = [F.col("year"), F.col("month"), *[F.col(c) for c in order_cols]]
    # An explicit number: adaptive execution would merge partitions by their few metadata bytes.
    parts = partitions or TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    # Content given with the rows stays where it is; content still to be read is dealt out by its bytes.
    laid = dated.repartitionByRange(parts, *ranges) if read_content is None else by_bytes(dated, ["year", "month", *order_cols], parts)
    filled = read_content(laid) if read_content is not None else laid
    error = F.coalesce(F.col("error"), F.when(F.col("content").isNull(), F.lit("unreadable member")))
    content = F.when(F.col("error").isNull(), F.col("content"))
    outcome = (
        filled.withColumn("error", error)
        .withColumn("content", content)
        .withColumn("sha256", F.sha2("content", 256))
    )
    outcome.write.mode("errorifexists").partitionBy("year", "month").parquet(run)
    return write_summary(spark.read.schema(outcome.schema).parquet(run), order_cols)


def require_library(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` holds a library; raises if it holds anything else."""
    names = [n for n in names_in(spark, path) if n != "_SUCCESS"]
    foreign = [n for n in names if not n.startswith("run_id=")]
    if foreign:
        raise ValueError(f"{path} is not a library: it holds {foreign[0]!r}")
    return bool(names)


def library_rows(spark: SparkSession, path: str) -> DataFrame:
    """Files of a written library: destination, file_size, sha256, run_id. Content is not read."""
    schema = "destination STRING, file_size BIGINT, sha256 STRING, error STRING, run_id STRING"
    if not require_library(spark, path):
        return spark.createDataFrame([], schema).drop("error")
    written = spark.read.schema(schema).parquet(path)
    return read_library(written).select("destination", "file_size", "sha256", F.col("run_id").cast("string"))


def read_library(df: DataFrame) -> DataFrame:
    """The rows of a written library that hold a file."""
    return df.filter(F.col("error").isNull())


def write_summary(written: DataFrame, order_cols=("archive", "entry_ix"), shown: int = 3) -> DataFrame:
    """Per archive: files, extracted, errors, bytes, and the first errors."""
    good = F.col("error").isNull()
    counts = written.groupBy("archive").agg(
        F.count("*").alias("total_files"),
        F.count_if(good).alias("extracted"),
        F.count_if(~good).alias("errors"),
        F.coalesce(F.sum(F.when(good, F.col("file_size"))), F.lit(0).cast("bigint")).alias("bytes_extracted"),
    )
    first = Window.partitionBy("archive").orderBy(*order_cols)
    texts = (
        written.filter(~good)
        .select("archive", *[c for c in order_cols if c != "archive"],
                F.concat("file_path", F.lit(": "), "error").alias("_text"))
        .withColumn("_rank", F.row_number().over(first))
        .filter(F.col("_rank") <= shown)
        .groupBy("archive")
        .agg(F.array_sort(F.collect_list(F.struct("_rank", "_text"))).alias("_texts"))
        .select("archive", F.transform("_texts", lambda x: x["_text"]).alias("first_errors"))
    )
    return counts.join(texts, "archive", "left").select(
        *counts.columns, F.coalesce("first_errors", F.array().cast("array<string>")).alias("first_errors")
    )


def extraction_metrics(summary: DataFrame, totals: DataFrame) -> DataFrame:
    """One row: extracted, bytes, errors, already there, duplicates."""
    done = summary.agg(
        F.coalesce(F.sum("extracted"), F.lit(0).cast("bigint")).alias("extracted"),
        F.coalesce(F.sum("bytes_extracted"), F.lit(0).cast("bigint")).alias("bytes_extracted"),
        F.coalesce(F.sum("errors"), F.lit(0).cast("bigint")).alias("errors"),
    ).withColumn("_one", F.lit(1))
    planned = totals.select("already_present", "duplicates", F.lit(1).alias("_one"))
    return done.join(F.broadcast(planned), "_one").drop("_one")
