"""Column expressions: paths, content keys, dates and display text."""

from .dates import archive_time, exif_date, export_time, sidecar_date, zip_date
from .keys import STRATEGIES, content_key, crc_key, full_key, metadata_key, partial_key
from .paths import (
    display_path,
    file_name,
    file_stem,
    file_suffix,
    file_type,
    folder_label,
    normalized_name,
    parent_dir,
    propose_location,
    reroot,
)
from .text import archive_label, human_size, short_hash

__all__ = [
    "STRATEGIES", "archive_label", "archive_time", "content_key", "crc_key", "display_path",
    "exif_date", "export_time", "file_name", "file_stem", "file_suffix", "file_type",
    "folder_label", "full_key", "human_size", "metadata_key", "normalized_name", "parent_dir",
    "partial_key", "propose_location", "reroot", "short_hash", "sidecar_date", "zip_date",
]
