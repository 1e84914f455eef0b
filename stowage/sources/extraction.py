"""Members of any size: content as ordered blocks, and extraction to files in two phases.

A member is read and written block by block, so a task holds one block however
large the member is. Files are first written below a staging folder under names
of their own. What a finished task has staged is settled as a table, which
holds one attempt per task; only then are those files moved to their places, in
a second Spark job that may be run again. So a lost executor, a second attempt
or a job that dies midway leaves no half-written file in the library.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from contextlib import ExitStack
from functools import partial
from typing import Any

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from ..storage import settle
from .archives import BROKEN, TASKS_PER_CORE, _spread, opened_member
from .content import open_fs

BLOCK_BYTES = 4 << 20
BLOCKS = "archive STRING, entry_ix BIGINT, block BIGINT, data BINARY, bytes BIGINT, sha256 STRING, crc BIGINT, is_last BOOLEAN, error STRING"
_BLOCKS = pa.schema(
    [("archive", pa.string()), ("entry_ix", pa.int64()), ("block", pa.int64()), ("data", pa.binary()), ("bytes", pa.int64()),
     ("sha256", pa.string()), ("crc", pa.int64()), ("is_last", pa.bool_()), ("error", pa.string())]
)


class Sums:
    """Bytes, SHA-256 and CRC-32 of the blocks so far."""

    def __init__(self) -> None:
        self.bytes, self.crc, self.digest = 0, 0, hashlib.sha256()

    def add(self, block: bytes) -> None:
        self.bytes += len(block)
        self.crc = zlib.crc32(block, self.crc)
        self.digest.update(block)


def _blocks_of(stream: Any, size: int) -> Iterator[bytes]:
    while block := stream.read(size):
        yield block


def _read_blocks(size: int, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def batch(*row: Any) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _BLOCKS, strict=True)], schema=_BLOCKS)

    with ExitStack() as stack:
        open_member = opened_member(stack)
        for part in it:
            for archive, position in zip(part.column("archive").to_pylist(), part.column("entry_ix").to_pylist(), strict=True):
                sums, n = Sums(), 0
                try:
                    with open_member(archive, position) as stream:
                        held = stream.read(size)
                        while True:
                            # One block ahead, so that the last is known, and the stored checksum has been compared by then.
                            following = stream.read(size) if held else b""
                            sums.add(held)
                            yield batch(archive, position, n, held, sums.bytes, sums.digest.hexdigest(), sums.crc, not following, None)
                            if not following:
                                break
                            held, n = following, n + 1
                except BROKEN as e:
                    yield batch(archive, position, n, None, sums.bytes, None, None, True, str(e) or repr(e))


def read_entry_blocks(wanted: DataFrame, block_bytes: int = BLOCK_BYTES, partitions: int | None = None) -> DataFrame:
    """Content of catalog rows (archive, entry_ix) as ordered blocks, each with the sums up to its end.

    ``bytes``, ``sha256`` and ``crc`` of the row marked ``is_last`` are those
    of the whole member. An empty member is one empty block. A member that
    cannot be read ends with a row that has ``error`` and no data; blocks
    before it are void.
    """
    ship(wanted.sparkSession)
    rows = _spread(wanted.select("archive", F.col("entry_ix").cast("bigint").alias("entry_ix")), partitions)
    return rows.mapInArrow(partial(_read_blocks, block_bytes), BLOCKS)


def _stage(staging: str, size: int, it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    system, base = open_fs(staging)
    system.create_dir(base)
    attempt = uuid.uuid4().hex
    with ExitStack() as stack:
        open_member = opened_member(stack)
        for pdf in it:
            staged: list[tuple] = []
            for archive, position, error in zip(pdf["archive"], pdf["entry_ix"], pdf["error"], strict=True):
                if error is not None:
                    staged.append((None, None, None, error))
                    continue
                name, sums = f"{base.rstrip('/')}/{attempt}-{uuid.uuid4().hex}", Sums()
                try:
                    with open_member(archive, position) as stream, system.open_output_stream(name) as out:
                        for block in _blocks_of(stream, size):
                            sums.add(block)
                            out.write(block)
                    staged.append((name, sums.digest.hexdigest(), sums.bytes, None))
                except BROKEN as e:
                    if system.get_file_info(name).is_file:
                        system.delete_file(name)
                    staged.append((None, None, None, f"unreadable member: {str(e) or repr(e)}"))
            yield pdf.assign(**dict(zip(("staged", "sha256", "bytes", "error"), map(list, zip(*staged, strict=True)), strict=True))).astype(
                {"bytes": "Int64"}
            )


def _move(root: str, it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    system, base = open_fs(root)
    for pdf in it:
        errors = []
        for staged, destination in zip(pdf["staged"], pdf["destination"], strict=True):
            final = f"{base.rstrip('/')}/{destination}"
            there, waiting = system.get_file_info(final).is_file, system.get_file_info(staged).is_file
            if there and waiting:
                errors.append("destination exists")
                continue
            if waiting:  # else an earlier attempt of this task has moved it
                system.create_dir(final.rsplit("/", 1)[0])
                system.move(staged, final)
            errors.append(None if waiting or there else "staged file is gone")
        yield pdf.assign(error=errors)


def extract_files(
    planned: DataFrame, root: str, order_cols=("archive", "entry_ix"), block_bytes: int = BLOCK_BYTES, partitions: int | None = None
) -> DataFrame:
    """Write planned members as files below ``root``; returns every row with ``sha256``, ``bytes`` and ``error``.

    ``planned`` has archive, entry_ix, ``destination`` (relative to ``root``)
    and ``error``; rows with an error are passed on unwritten. No file that
    exists is replaced. Rows are spread by cumulative bytes (``file_size``), so
    that tasks write about equally much.
    """
    spark = planned.sparkSession
    ship(spark)
    staging = f"{root.rstrip('/')}/.staging-{uuid.uuid4().hex}"
    columns = [c for c in planned.columns if c not in ("staged", "sha256", "bytes", "_share")]
    laid = by_bytes(planned.select(*columns), list(order_cols), partitions)
    added = {"error": "string", "staged": "string", "sha256": "string", "bytes": "bigint"}
    typed = laid.drop("error").withColumns({name: F.lit(None).cast(kind) for name, kind in added.items()})
    staged = settle(laid.mapInPandas(partial(_stage, staging, block_bytes), typed.schema), "staged")
    good = staged.filter("error IS NULL")
    moved = settle(good.mapInPandas(partial(_move, root), staged.schema), "moved")
    system, base = open_fs(staging)
    if system.get_file_info(base).type == fs.FileType.Directory:
        system.delete_dir(base)
    return moved.unionByName(staged.filter("error IS NOT NULL")).drop("staged")


def by_bytes(rows: DataFrame, order_cols: list[str], partitions: int | None = None, size: str = "file_size") -> DataFrame:
    """``rows`` in partitions of about equal bytes, neighbours in order together.

    Range slices give each row the bytes before it; that figure divided by the
    bytes per task is its task. One member is never split, so a task holds at
    most its share and one member more.
    """
    spark = rows.sparkSession
    parts = partitions or TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    weight = F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)) + 1  # a file of no bytes costs something too
    sliced = settle(rows.repartitionByRange(*order_cols).withColumn("_slice", F.spark_partition_id()), "laid")
    sums = sliced.groupBy("_slice").agg(F.sum(weight).alias("_bytes"))
    total = sums.agg(F.sum("_bytes")).first()[0] or 1
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # one row per slice
    sums = sums.select("_slice", F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_slice").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("_before") + F.coalesce(F.sum(weight).over(inside), F.lit(0))
    placed = sliced.join(F.broadcast(sums), "_slice").withColumn("_task", F.floor(at * parts / total).cast("int"))
    return placed.repartitionById(parts, "_task").sortWithinPartitions("_task", *order_cols).drop("_slice", "_before", "_task")
