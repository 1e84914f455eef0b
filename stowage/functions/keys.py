"""Content keys: ``{size}_{fingerprint}`` under three strategies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
STRATEGIES = ("size_partial", "size_crc", "full")
SAMPLE_BYTES = 64 * 1024
PARTIAL_HEX = 16


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _keyed(size: Column, fingerprint: Column) -> Column:
    return F.concat(size.cast("string"), F.lit("_"), fingerprint)


def _crc_hex(crc: Column) -> Column:
    # At least eight digits; longer values keep all of theirs.
    digits = F.lower(F.hex(crc))
    return F.concat(F.repeat(F.lit("0"), F.lit(8) - F.length(digits)), digits)


def metadata_key(size: Column | str = "file_size", crc: Column | str = "file_crc") -> Column:
    """Key from catalog metadata alone: size and stored CRC-32."""
    return _keyed(_col(size), _crc_hex(_col(crc)))


def crc_key(content: Column | str = "content") -> Column:
    """Key from bytes, equal to :func:`metadata_key` of the same member."""
    c = _col(content)
    return _keyed(F.octet_length(c), _crc_hex(F.crc32(c)))


def partial_key(content: Column | str = "content", sample: int = SAMPLE_BYTES) -> Column:
    """Key from a first, middle and last sample of the bytes."""
    c = _col(content)
    size = F.octet_length(c)
    nothing = F.lit(b"")
    middle = F.when(
        size > 2 * sample, F.substring(c, F.floor(size / 2).cast("int") + 1, F.lit(sample))
    ).otherwise(nothing)
    last = F.when(size > sample, F.substring(c, size - sample + 1, F.lit(sample))).otherwise(nothing)
    picked = F.concat(F.substring(c, 1, sample), middle, last)
    return _keyed(size, F.left(F.sha2(picked, 256), F.lit(PARTIAL_HEX)))


def full_key(content: Column | str = "content") -> Column:
    """Key from all bytes: SHA-256."""
    c = _col(content)
    return _keyed(F.octet_length(c), F.sha2(c, 256))


def check_strategy(strategy: str) -> str:
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown key strategy {strategy!r}; expected one of {', '.join(STRATEGIES)}")
    return strategy


def content_key(df: DataFrame, strategy: str = "size_partial", sample: int = SAMPLE_BYTES) -> DataFrame:
    """Add ``content_key`` under the named strategy.

    ``size_crc`` uses the stored CRC where the table has one, so archive
    metadata never forces its content to be read.
    """
    check_strategy(strategy)
    if strategy == "size_crc":
        key = metadata_key() if "file_crc" in df.columns else crc_key()
    elif strategy == "size_partial":
        key = partial_key(sample=sample)
    else:
        key = full_key()
    return df.withColumn("content_key", key)
