"""Writing test-table rows out as real archives and files, for the source queries.

Runs as a Spark job: each task writes its own bounded runs of rows.
"""

from __future__ import annotations

import zipfile
from collections.abc import Callable, Iterator
from contextlib import ExitStack

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.content import open_fs

MEMBERS_PER_ARCHIVE = 256
BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def export_archives(entries: DataFrame, path: str) -> None:
    """Write members as zips below ``path``, a long archive as several part files."""
    parted = entries.withColumn(
        "_part",
        F.concat(
            F.regexp_replace("archive", r"\.zip$", ""), F.lit("-"),
            F.floor(F.col("entry_ix") / (MEMBERS_PER_ARCHIVE * 20)).cast("string"), F.lit(".zip"),
        ),
    )
    columns = ["_part", "file_path", "content", "zip_y", "zip_mo", "zip_d", "zip_h", "zip_mi", "zip_s"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = open_fs(path)
        system.create_dir(base)
        with ExitStack() as stack:
            current, zipped = None, None
            for batch in batches:
                for name, member, content, *stamp in zip(*(batch.column(c) for c in columns), strict=True):
                    if name.as_py() != current:
                        stack.close()
                        current = name.as_py()
                        raw = stack.enter_context(system.open_output_stream(f"{base}/{current}"))
                        zipped = stack.enter_context(zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED))
                    info = zipfile.ZipInfo(member.as_py(), date_time=tuple(int(v.as_py()) for v in stamp))
                    zipped.writestr(info, bytes(content.as_py()))
                yield batch.select(["_part"])

    # The members of an archive come one after another, so that a task holds one batch, however large the archive is.
    sorted_parts = parted.repartition("_part").sortWithinPartitions("_part", "entry_ix").select(*columns)
    _run(sorted_parts, write, "_part string")


def export_files(files: DataFrame, path: str) -> None:
    """Write (file_path, content) rows as files below ``path``."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = open_fs(path)
        for batch in batches:
            for name, content in zip(batch.column("file_path"), batch.column("content"), strict=True):
                target = f"{base}/{name.as_py()}"
                system.create_dir(target.rsplit("/", 1)[0])
                with system.open_output_stream(target) as out:
                    out.write(bytes(content.as_py()))
            yield batch.select(["file_path"])

    _run(files.select("file_path", "content"), write, "file_path string")


def _run(rows: DataFrame, write: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> None:
    """Run a writing pass now, over batches bounded by their bytes as well as by their rows."""
    conf = rows.sparkSession.conf
    before = conf.get(BATCH_CONF)
    conf.set(BATCH_CONF, str(BATCH_BYTES))
    try:
        rows.mapInArrow(write, schema).write.format("noop").mode("overwrite").save()
    finally:
        conf.set(BATCH_CONF, before)
