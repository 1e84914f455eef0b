"""Table schemas shared by sources, operators and sinks."""

from __future__ import annotations

from pyspark.sql.types import (
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

_TYPES = {
    "STRING": StringType(), "BIGINT": LongType(), "INT": IntegerType(), "TIMESTAMP_NTZ": TimestampNTZType(),
}


def _table(columns: str) -> StructType:
    pairs = (c.split() for c in columns.split(","))
    return StructType([StructField(name, _TYPES[kind]) for name, kind in pairs])


ENTRIES = _table(
    "archive STRING, archive_mtime TIMESTAMP_NTZ, entry_ix BIGINT, file_path STRING, "
    "file_size BIGINT, file_crc BIGINT, zip_y INT, zip_mo INT, zip_d INT, zip_h INT, "
    "zip_mi INT, zip_s INT"
)
FILES = _table(
    "root STRING, file_path STRING, file_size BIGINT, mtime TIMESTAMP_NTZ, content_key STRING"
)
MANIFEST = _table(
    "content_key STRING, file_size BIGINT, file_crc BIGINT, date TIMESTAMP_NTZ, "
    "proposed_location STRING, source_zip STRING, source_path STRING, duplicate_count BIGINT"
)
DIFF_MANIFEST = _table("path STRING, file_size BIGINT, content_key STRING")
DATE_CACHE = _table(
    "archive STRING, file_path STRING, file_size BIGINT, file_crc BIGINT, "
    "extracted_date TIMESTAMP_NTZ, created_at TIMESTAMP_NTZ"
)
HASH_CACHE = _table(
    "root STRING, file_path STRING, file_size BIGINT, mtime TIMESTAMP_NTZ, "
    "content_key STRING, created_at TIMESTAMP_NTZ"
)
SCAN_LOG = _table("root STRING, last_scanned TIMESTAMP_NTZ, file_count BIGINT")
SIDECARS = _table("archive STRING, json_path STRING, json_text STRING")
EXIF_TAGS = _table("archive STRING, file_path STRING, dto STRING, dt STRING")
