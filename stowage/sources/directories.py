"""Directory trees as tables."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator
from datetime import datetime, timedelta
from functools import partial
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import check_strategy
from ..session import ship
from ..storage import settle
from .content import open_fs, stream_key

LISTING = "root STRING, file_path STRING, file_size BIGINT, mtime TIMESTAMP_NTZ"
ENTRY = "path STRING, is_folder BOOLEAN, file_size BIGINT, mtime TIMESTAMP_NTZ"
#: Entries of one folder handed on at a time, and folders listed per task at most.
PAGE_ROWS, FOLDERS_PER_TASK = 10_000, 64
TASKS_PER_CORE = 8


def _inside(system: fs.FileSystem, folder: str) -> Iterator[tuple[str, bool, int | None, datetime | None]]:
    """What lies directly in a folder. A mounted folder is read entry by entry, however many there are."""
    if isinstance(system, fs.LocalFileSystem):
        with os.scandir(folder) as entries:
            for entry in entries:
                path = f"{folder.rstrip('/')}/{entry.name}"
                try:
                    status = entry.stat()
                except OSError:  # gone meanwhile, or a link to nothing
                    continue
                if stat.S_ISDIR(status.st_mode):
                    if not entry.is_symlink():  # else a link to a folder above would never end
                        yield (path, True, None, None)
                elif stat.S_ISREG(status.st_mode):
                    yield (path, False, status.st_size, _EPOCH + timedelta(microseconds=status.st_mtime_ns // 1000))
        return
    for info in system.get_file_info(fs.FileSelector(folder)):
        if info.type == fs.FileType.Directory:
            yield (info.path, True, None, None)
        elif info.type == fs.FileType.File:
            yield (info.path, False, info.size, info.mtime.replace(tzinfo=None) if info.mtime else None)


_EPOCH = datetime(1970, 1, 1)
_PAGE = pa.schema([("path", pa.string()), ("is_folder", pa.bool_()), ("file_size", pa.int64()), ("mtime", pa.timestamp("us"))])


def _list_folders(root: str, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    system, _ = open_fs(root)
    for batch in it:
        for folder in batch.column("path").to_pylist():
            try:
                inside = _inside(system, folder)
                while page := list(islice(inside, PAGE_ROWS)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*page, strict=True), _PAGE, strict=True)], schema=_PAGE)
            except (PermissionError, FileNotFoundError):  # a folder that cannot be read holds nothing
                continue


def list_directory(spark: SparkSession, root: str) -> DataFrame:
    """One row per file below ``root``: root, relative path, size, time. Reads no content.

    A frontier search: each level of the tree is a Spark stage that lists the
    folders found by the level before, so the driver opens none of them, and a
    wide or lopsided tree spreads over all tasks. The entries of a folder come
    in pages; each level is a table in the shared folder. All files are listed,
    names starting with a dot or underscore too; folders that cannot be read
    count as empty. Links to files are followed, links to folders are not.
    """
    ship(spark)
    system, base = open_fs(root)
    if system.get_file_info(base).type != fs.FileType.Directory:
        return spark.createDataFrame([], LISTING)
    base = base.rstrip("/") or "/"
    folders, found, n = spark.createDataFrame([(base,)], "path STRING"), None, 1
    while n:
        tasks = max(1, min(-(-n // FOLDERS_PER_TASK), TASKS_PER_CORE * spark.sparkContext.defaultParallelism))
        spread = folders.repartition(tasks, "path") if n > 1 else folders
        level = settle(spread.mapInArrow(partial(_list_folders, root), ENTRY), "level")
        files = level.filter("NOT is_folder")
        found = files if found is None else found.unionByName(files)
        folders = level.filter("is_folder").select("path")
        n = folders.count()
    below = 1 if base == "/" else len(base) + 1
    return found.select(F.lit(base).alias("root"), F.expr(f"substr(path, {below + 1})").alias("file_path"), "file_size", "mtime")


def hash_files(files: DataFrame, strategy: str = "size_partial", partitions: int | None = None) -> DataFrame:
    """Add ``content_key`` to listed files; see :func:`hash_or_error` for those that cannot be read."""
    hashed = hash_or_error(files, strategy, partitions)
    return hashed.filter(F.col("content_key").isNotNull()).drop("error")


def unreadable_files(hashed: DataFrame) -> DataFrame:
    """The files of :func:`hash_or_error` that could not be read, and why."""
    return hashed.filter(F.col("content_key").isNull()).select("root", "file_path", "error")


def hash_or_error(files: DataFrame, strategy: str = "size_partial", partitions: int | None = None) -> DataFrame:
    """Add ``content_key`` to listed files, and ``error`` where a file cannot be read.

    Only the files given are opened: filter the listing first. Work is spread
    by path over an explicit number of tasks, since the listing itself is tiny.
    """
    check_strategy(strategy)
    ship(files.sparkSession)
    columns = [c for c in files.columns if c not in ("content_key", "error")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys, errors = [], []
            for root, path, size in zip(pdf["root"], pdf["file_path"], pdf["file_size"], strict=True):
                try:
                    system, base = open_fs(root)
                    with system.open_input_file(f"{base.rstrip('/')}/{path}") as stream:
                        keys.append(stream_key(stream, size, strategy))
                        errors.append(None)
                except OSError as e:
                    keys.append(None)
                    errors.append(str(e) or repr(e))
            yield pdf.assign(content_key=keys, error=errors)

    parts = partitions or TASKS_PER_CORE * files.sparkSession.sparkContext.defaultParallelism
    rows = files.select(*columns)
    none = F.lit(None).cast("string")
    out = rows.withColumns({"content_key": none, "error": none}).schema
    spread = rows.repartition(parts, "root", "file_path")
    return spread.mapInPandas(run, out)


def scan_directory(spark: SparkSession, root: str, strategy: str = "size_partial") -> DataFrame:
    """All files below ``root`` with their content keys."""
    return hash_files(list_directory(spark, root), strategy)
