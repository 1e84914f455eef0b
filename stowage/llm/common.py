"""What the operators of this subpackage share: batches, words, shared tables."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.session import ship
from stowage.storage import scratch_path

#: The word separators of every contract: space and \x09-\x0D.
BLANKS = " \t\n\x0b\x0c\r"
#: Rows and bytes of one Arrow batch, so that a batch of long texts stays small.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Send the package to the workers and bound the Arrow batches."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the given tables."""
    return prepare(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the folder all executors share and read it back."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus, F.lit(-1))


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch, null as the empty text."""
    return ["" if t is None else t for t in batch.column(column).to_pylist()]


def rows(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    """A record batch from Python or numpy columns."""
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


class WordHashes(dict):
    """64-bit hashes of words, remembered per worker up to ``limit`` words."""

    limit = 400_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter((self[w] for w in words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over a 64-bit word."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def odd_numbers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words; with fewer words, of the whole sequence as one."""
    if not len(words):
        return words
    k = min(n, len(words))
    total = np.full(len(words) - k + 1, k, np.uint64)
    for i, c in enumerate(odd_numbers(k, 7)):
        total = total + words[i : len(words) - k + 1 + i] * c
    return mix(total)


def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches that hold rows."""
    return (b for b in it if b.num_rows)
