"""Manifests and report sinks."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import display_path, file_name
from ..schemas import DIFF_MANIFEST, MANIFEST
from ..storage import names_in

# Fixed values.
VERSION = "1.0"
DATE_FORMAT = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"
CSV_DATE = "yyyy-MM-dd HH:mm:ss"
CSV_COLUMNS = [
    "Zip File", "File Path in Zip", "File Hash", "Is Duplicate", "Duplicate Of", "Extracted Date",
    "Proposed Location",
]


def manifest(catalog: DataFrame) -> DataFrame:
    """One row per original: key, size, CRC, date, location, source and number of duplicates."""
    return catalog.filter(~F.col("is_duplicate")).select(
        "content_key",
        "file_size",
        "file_crc",
        F.col("file_date").alias("date"),
        F.coalesce("proposed_location", F.lit("")).alias("proposed_location"),
        F.col("archive").alias("source_zip"),
        F.col("file_path").alias("source_path"),
        (F.col("group_size") - 1).alias("duplicate_count"),
    )


#: What Spark's writers leave in a folder, crc files included.
_WRITTEN = r"part-|_|\."


def require_own(spark: SparkSession, path: str, names: str = _WRITTEN) -> None:
    """Raise if a folder about to be written anew holds anything that is not ours; ``names``: pattern of what is."""
    foreign = [n for n in names_in(spark, path) if not re.match(names, n)]
    if foreign:
        raise ValueError(f"{path} holds {foreign[0]!r}: not written by this library, so not replaced")


def _with_header(files: DataFrame, path: str, count: str, labels: dict[str, Any]) -> None:
    """Write rows and, beside them, one row of labels and how many there are; the rows are evaluated once."""
    spark = files.sparkSession
    require_own(spark, path, rf"(files|header)$|{_WRITTEN}")
    for part in ("files", "header"):
        require_own(spark, f"{path}/{part}")
    files.write.mode("overwrite").option("timestampNTZFormat", DATE_FORMAT).json(f"{path}/files")
    written = spark.read.schema("content_key STRING").json(f"{path}/files").agg(F.count("*").alias(count))
    header = written.select(*[F.lit(v).alias(k) for k, v in labels.items()], count)
    header.write.mode("overwrite").json(f"{path}/header")


def write_manifest(files: DataFrame, path: str, generated: str, **header: str) -> None:
    """Write manifest rows as JSON lines, and a one-row header table beside them.

    An earlier manifest at ``path`` is replaced; a folder that holds anything else is refused.
    """
    _with_header(files, path, "total_unique_files", {"version": VERSION, "generated": generated, **header})


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a manifest written here."""
    reader = spark.read.schema(MANIFEST).option("timestampNTZFormat", DATE_FORMAT)
    return reader.json(f"{path}/files")


def read_manifest_header(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(f"{path}/header")


def read_manifest_document(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a manifest kept as one JSON document with a ``files`` array."""
    files = MANIFEST.simpleString()
    reader = spark.read.schema(f"version STRING, generated STRING, files ARRAY<{files}>")
    document = reader.option("multiLine", True).option("timestampNTZFormat", DATE_FORMAT).json(path)
    return document.select(F.explode("files").alias("f")).select("f.*")


def write_diff_manifest(missing: DataFrame, path: str, generated: str, source_files: int, **header: str) -> None:
    """Write missing files (path, file_size, content_key) and a header with the counts; see :func:`write_manifest`."""
    total = F.lit(source_files).cast("bigint")
    _with_header(missing, path, "missing_count", {"generated": generated, **header, "total_source_files": total})


def read_diff_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DIFF_MANIFEST).json(f"{path}/files")


def csv_rows(catalog: DataFrame) -> DataFrame:
    """The seven columns of the CSV report."""
    dup = F.col("is_duplicate")
    values = [
        file_name("archive"),
        F.col("file_path"),
        F.col("content_key"),
        F.when(dup, "Yes").otherwise("No"),
        F.when(dup, display_path("original_archive", "original_path")).otherwise(""),
        F.date_format("file_date", CSV_DATE),
        F.coalesce("proposed_location", F.lit("")),
    ]
    return catalog.select(*[v.alias(c) for v, c in zip(values, CSV_COLUMNS, strict=True)])


def write_csv_report(catalog: DataFrame, path: str) -> None:
    """Write the CSV report; an earlier one at ``path`` is replaced, a folder that holds anything else is refused."""
    require_own(catalog.sparkSession, path)
    csv_rows(catalog).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_report(tables: dict[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    """Write every report table to its own folder."""
    for name, df in tables.items():
        require_own(df.sparkSession, f"{path}/{name}")
        df.write.mode("overwrite").format(fmt).save(f"{path}/{name}")
