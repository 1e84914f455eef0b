"""Date expressions. All results are zone-less wall time (TIMESTAMP_NTZ)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import file_name, file_suffix

# Fixed values.
FIRST_VALID_YEAR = 1981
EXIF_SUFFIXES = [".jpg", ".jpeg", ".tiff", ".tif"]
EXIF_FORMAT = "yyyy:M:d H:m:s"
SIDECAR_FIELD = "$.photoTakenTime.timestamp"
EXPORT_PREFIX = "takeout"
EXPORT_FORMAT = "yyyyMMdd'T'HHmmss"
EPOCH_RANGE = (-62135596800, 253402300799)  # years 1 to 9999


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def zip_date(prefix: str = "zip_") -> Column:
    """Member date from its six stored parts; NULL before 1981 or when invalid."""
    y, mo, d, h, mi, s = (F.col(prefix + part) for part in ("y", "mo", "d", "h", "mi", "s"))
    usable = (y >= FIRST_VALID_YEAR) & (s < 60)
    return F.when(usable, F.try_make_timestamp_ntz(y, mo, d, h, mi, s.cast("decimal(16,6)")))


def _parse(text: Column, fmt: str) -> Column:
    return F.try_to_timestamp(text, F.lit(fmt)).cast("timestamp_ntz")


def exif_date(
    path: Column | str, size: Column | str, dto: Column | str = "dto", dt: Column | str = "dt"
) -> Column:
    """Date from the original-date tag, or from the general one if the first is absent.

    An unreadable original-date tag gives NULL; the second is not tried.
    """
    original, general = _col(dto), _col(dt)
    parsed = F.when(original.isNotNull(), _parse(original, EXIF_FORMAT)).otherwise(
        _parse(general, EXIF_FORMAT)
    )
    return F.when(file_suffix(path).isin(EXIF_SUFFIXES) & (_col(size) > 0), parsed)


def sidecar_date(json_text: Column | str) -> Column:
    """Taken-time of a JSON sidecar; NULL for broken, missing or out-of-range values."""
    seconds = F.get_json_object(_col(json_text), SIDECAR_FIELD).try_cast("bigint")
    valid = seconds.between(*EPOCH_RANGE)
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    return epoch + F.make_dt_interval(secs=F.when(valid, seconds).cast("decimal(18,6)"))


def archive_time(mtime: Column | str = "archive_mtime") -> Column:
    """Archive modification time as wall time."""
    return _col(mtime).cast("timestamp_ntz")


def export_time(archive: Column | str, prefix: str = EXPORT_PREFIX) -> Column:
    """Export time written in an archive's name (``prefix-YYYYMMDDThhmmssZ``)."""
    stamp = F.regexp_extract(file_name(archive), rf"\Q{prefix}\E-(\d{{8}}T\d{{6}})Z", 1)
    return _parse(F.when(stamp != "", stamp), EXPORT_FORMAT)
