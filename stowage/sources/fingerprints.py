"""Escalating fingerprints: read more of a file only while something else still looks the same.

Partition refinement: files are grouped by size, then by their first bytes, then
by samples, then by their whole content. A file that is alone in its group is
told apart from all others and is not opened again; a file that a level has read
whole needs no further one. What is left at the end is equal byte for byte (by
SHA-256), so the classes are those of ``full`` keys at a fraction of the bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import SAMPLE_BYTES
from ..operators.skew import attach
from ..session import ship
from ..storage import settle
from .content import open_fs, stream_key
from .directories import TASKS_PER_CORE

LEVELS = ("head", "size_partial", "full")


def reach(level: str, sample: int) -> float:
    """Files up to this size are read whole by a level."""
    return {"head": sample, "size_partial": 2 * sample, "full": float("inf")}[level]


def _hash_level(level: str, sample: int, it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in it:
        keys, read = [], []
        for root, path, size in zip(pdf["root"], pdf["file_path"], pdf["file_size"], strict=True):
            try:
                system, base = open_fs(root)
                with system.open_input_file(f"{base.rstrip('/')}/{path}") as stream:
                    if level == "head":
                        keys.append(hashlib.sha256(stream.read(sample)).hexdigest())
                    else:
                        keys.append(stream_key(stream, size, level, sample))
                read.append(size if size <= reach(level, sample) else min(size, (1 if level == "head" else 3) * sample))
            except OSError:
                keys.append(None)
                read.append(0)
        yield pdf[["root", "file_path"]].assign(_key=keys, _read=read)


def fingerprint(files: DataFrame, sample: int = SAMPLE_BYTES, hot_rows: int | None = None) -> DataFrame:
    """Adds ``fingerprint``, ``copies`` (files of equal content, itself included) and ``bytes_read`` to listed files.

    ``files`` has root, file_path and file_size, one row per file. Two files
    have one fingerprint exactly if their contents are equal. A file that
    cannot be read has none, and no copies. Each level opens the files whose
    group still has several, spread over all tasks.
    """
    spark = files.sparkSession
    ship(spark)
    by, tasks = ["root", "file_path"], TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    first = F.concat(F.lit("size_"), F.col("file_size").cast("string"))
    # Files of no bytes are equal as they are.
    state = files.withColumn("_print", first).withColumn("_done", F.col("file_size") == 0).withColumn("bytes_read", F.lit(0).cast("bigint"))
    for level in LEVELS:
        sizes = state.groupBy("_print").agg(F.count("*").alias("_n"))
        state = settle(attach(state, sizes, ["_print"], by, "_n", hot_rows), level)
        undecided = ~F.col("_done") & (F.col("_n") > 1)
        opened = state.filter(undecided)
        if opened.isEmpty():
            state = state.drop("_n")
            break
        keys = opened.select(*by, "file_size").repartition(tasks, *by).mapInPandas(
            partial(_hash_level, level, sample), "root string, file_path string, _key string, _read bigint"
        )
        told = opened.join(settle(keys, level), by).select(
            *files.columns,
            # Unreadable files are told apart from all by their place.
            F.coalesce(F.concat(F.col("file_size").cast("string"), F.lit(f"_{level}_"), "_key"), F.concat(F.lit("lost_"), F.concat_ws("/", *by))).alias("_print"),
            (F.col("_key").isNull() | (F.col("file_size") <= reach(level, sample))).alias("_done"),
            (F.col("bytes_read") + F.col("_read")).alias("bytes_read"),
        )
        state = state.filter(~undecided).drop("_n").unionByName(told)
    sizes = state.groupBy("_print").agg(F.count("*").alias("copies"))
    found = attach(state, sizes, ["_print"], by, "copies", hot_rows)
    lost = F.col("_print").startswith("lost_")
    return found.select(
        *files.columns, F.when(~lost, F.col("_print")).alias("fingerprint"), F.when(~lost, F.col("copies")).alias("copies"), "bytes_read"
    )
