"""Zip archives as tables: members from the central directory, content on demand."""

from __future__ import annotations

import lzma
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from contextlib import ExitStack
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.keys import check_strategy
from ..schemas import ENTRIES
from ..session import ship
from .content import open_fs, stream_key
from .directories import TASKS_PER_CORE, list_directory

MEMBERS_PER_CHUNK = 512
#: Content handed on at a time. A worker holds it as values, as a column and as Arrow.
BATCH_BYTES = 4 << 20
ROWS_PER_BATCH = 10_000
# What a damaged, encrypted or unknown archive raises. Anything else (memory, network) fails the task, which is tried again.
BROKEN = (
    zipfile.BadZipFile, zipfile.LargeZipFile, zlib.error, lzma.LZMAError, struct.error, EOFError, NotImplementedError,
    RuntimeError, ValueError, LookupError, FileNotFoundError, PermissionError,
)


def list_archives(spark: SparkSession, root: str) -> DataFrame:
    """Archives below ``root``: archive, archive_mtime, archive_bytes."""
    return (
        list_directory(spark, root)
        .filter(F.col("file_path").endswith(".zip"))
        .select(
            F.concat_ws("/", F.rtrim("root", F.lit("/")), "file_path").alias("archive"),
            F.col("mtime").alias("archive_mtime"),
            F.col("file_size").alias("archive_bytes"),
        )
    )


def _members(archive: str, mtime: Any) -> Iterator[tuple]:
    system, path = open_fs(archive)
    with system.open_input_file(path) as raw, zipfile.ZipFile(raw) as opened:
        for position, info in enumerate(opened.infolist()):
            if not info.is_dir():
                yield (archive, mtime, position, info.filename, info.file_size, info.CRC, *info.date_time, None)


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [*ENTRIES.fieldNames(), "error"]
    for pdf in batches:
        for archive, mtime in zip(pdf["archive"], pdf["archive_mtime"], strict=True):
            rows: list[tuple] = []
            try:
                for row in _members(archive, mtime):
                    rows.append(row)
                    if len(rows) == ROWS_PER_BATCH:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
            except BROKEN as e:
                lost = dict.fromkeys(names) | {"archive": archive, "archive_mtime": mtime, "error": str(e) or repr(e)}
                rows.append(tuple(lost[n] for n in names))
            if rows:
                # Object columns keep whole numbers whole beside the empty cells of an error row.
                yield pd.DataFrame(rows, columns=names, dtype=object)


def scan_archives(archives: DataFrame, partitions: int | None = None) -> DataFrame:
    """Members of listed archives, and one row with ``error`` per unreadable archive.

    Each archive is opened once, in one task; only its central directory is read.
    """
    ship(archives.sparkSession)
    parts = partitions or TASKS_PER_CORE * archives.sparkSession.sparkContext.defaultParallelism
    spread = archives.select("archive", "archive_mtime").repartition(parts, "archive")
    return spread.mapInPandas(_scan, StructType([*ENTRIES.fields, StructField("error", StringType())]))


def read_archives(spark: SparkSession, root: str, with_content: bool = False) -> DataFrame:
    """One row per member of every readable archive below ``root``."""
    entries = scan_archives(list_archives(spark, root)).filter(F.col("error").isNull()).drop("error")
    return read_entry_content(entries) if with_content else entries


def read_archive_errors(spark: SparkSession, root: str) -> DataFrame:
    """Archives below ``root`` that could not be read, and why."""
    failed = scan_archives(list_archives(spark, root)).filter(F.col("error").isNotNull())
    return failed.select("archive", "error")


def _spread(wanted: DataFrame, partitions: int | None) -> DataFrame:
    # Runs of members, not whole archives, so that one huge archive fills many tasks;
    # within a task the archive is opened once per run.
    parts = partitions or TASKS_PER_CORE * wanted.sparkSession.sparkContext.defaultParallelism
    run = F.floor(F.col("entry_ix") / MEMBERS_PER_CHUNK)
    return wanted.repartition(parts, F.col("archive"), run).sortWithinPartitions("archive", "entry_ix")


def opened_member(stack: ExitStack) -> Callable[[str, int], Any]:
    """Function that opens a member as a stream; the archive stays open for the next member of it."""
    current: dict[str, Any] = {"archive": None}

    def open_member(archive: str, position: int) -> Any:
        if archive != current["archive"]:
            stack.close()
            current.update(archive=None)
            system, path = open_fs(archive)
            raw = stack.enter_context(system.open_input_file(path))
            opened = stack.enter_context(zipfile.ZipFile(raw))
            current.update(archive=archive, opened=opened, members=opened.infolist())
        if position >= len(current["members"]):
            raise LookupError(f"no member {position}")
        return current["opened"].open(current["members"][position])

    return open_member


def _per_member(read: Callable[[zipfile.ZipFile, zipfile.ZipInfo], Any], column: str):
    """Batch function that adds ``read(archive, member)``, NULL where that fails."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ExitStack() as stack:
            current, opened, members = None, None, []
            for pdf in batches:
                values: list[Any] = []
                start = held = 0
                for at, (archive, position) in enumerate(zip(pdf["archive"], pdf["entry_ix"], strict=True)):
                    if archive != current:
                        stack.close()
                        current, opened, members = archive, None, []
                        try:
                            system, path = open_fs(archive)
                            raw = stack.enter_context(system.open_input_file(path))
                            opened = stack.enter_context(zipfile.ZipFile(raw))
                            members = opened.infolist()
                        except BROKEN:
                            opened = None
                    try:
                        value = read(opened, members[position]) if opened else None
                    except BROKEN:
                        value = None
                    values.append(value)
                    held += len(value) if value is not None else 0
                    if held >= BATCH_BYTES:
                        yield pdf.iloc[start : at + 1].assign(**{column: values})
                        start, held, values = at + 1, 0, []
                if values:
                    yield pdf.iloc[start:].assign(**{column: values})

    return run


def read_entry_content(
    wanted: DataFrame, partitions: int | None = None, keep_layout: bool = False
) -> DataFrame:
    """Add ``content`` to catalog rows (archive, entry_ix); NULL for unreadable members.

    ``keep_layout`` reads in the partitioning the rows already have.
    """
    ship(wanted.sparkSession)
    rows = wanted if keep_layout else _spread(wanted, partitions)
    schema = rows.withColumn("content", F.lit(None).cast("binary")).schema
    return rows.mapInPandas(_per_member(lambda z, m: z.read(m), "content"), schema)


def read_entry_keys(
    wanted: DataFrame, strategy: str = "size_partial", column: str = "content_key", partitions: int | None = None
) -> DataFrame:
    """Add the content key of catalog rows, hashed inside the reader.

    Bytes never become column values, so members of any size are fine.
    """
    check_strategy(strategy)
    ship(wanted.sparkSession)

    def key_of(archive: zipfile.ZipFile, member: zipfile.ZipInfo) -> str:
        with archive.open(member) as stream:
            return stream_key(stream, member.file_size, strategy)

    schema = wanted.withColumn(column, F.lit(None).cast("string")).schema
    return _spread(wanted, partitions).mapInPandas(_per_member(key_of, column), schema)


def read_sidecars(entries: DataFrame) -> DataFrame:
    """JSON members as sidecars: archive, json_path, json_text."""
    found = read_entry_content(entries.filter(F.col("file_path").endswith(".json")))
    return found.filter(F.col("content").isNotNull()).select(
        "archive", F.col("file_path").alias("json_path"), F.decode("content", "UTF-8").alias("json_text")
    )
