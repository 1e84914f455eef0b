"""Path and file-name expressions (slash-separated paths)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The extensions of each file type.
FILE_TYPES = {
    "image": [".jpg", ".jpeg", ".png", ".gif", ".bmp", ".webp", ".heic", ".raw", ".tiff", ".svg"],
    "video": [".mp4", ".mov", ".avi", ".mkv", ".wmv", ".flv", ".webm", ".m4v", ".3gp"],
    "audio": [".mp3", ".wav", ".flac", ".aac", ".ogg", ".wma", ".m4a"],
    "document": [".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".txt", ".rtf", ".odt"],
    "data": [".json", ".xml", ".csv", ".html", ".htm"],
}
TYPE_NAMES = [*FILE_TYPES, "other"]

# The copy marker "(N)" counts only directly before the last
# extension or at the end of the name.
COPY_MARKER = r"\(\p{Nd}+\)(?=\.[^.]+$|$)"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def file_name(path: Column | str) -> Column:
    """Last path component."""
    return F.substring_index(_col(path), "/", -1)


def parent_dir(path: Column | str) -> Column:
    """Everything before the last component; ``.`` when there is none."""
    p = _col(path)
    name = file_name(p)
    above = F.substring(p, F.lit(1), F.length(p) - F.length(name) - 1)
    return (
        F.when(F.length(name) == F.length(p), F.lit("."))
        .when(above == "", F.lit("/"))
        .otherwise(above)
    )


def folder_label(path: Column | str) -> Column:
    """Parent folder for display, ``(root)`` for files at the top."""
    parent = parent_dir(path)
    return F.when(parent == ".", F.lit("(root)")).otherwise(parent)


def file_suffix(path: Column | str) -> Column:
    """Lower-case extension with its dot; empty for dot-files and trailing dots."""
    return F.lower(exact_suffix(path))


def file_stem(path: Column | str) -> Column:
    """File name without its extension."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]+\z", "")


def exact_suffix(path: Column | str) -> Column:
    """Extension in its original case."""
    return F.regexp_extract(_col(path), r"[^/](\.[^./]+)\z", 1)


def normalized_name(path: Column | str) -> Column:
    """Lower-case file name without copy markers; folders are ignored."""
    name = file_name(path)
    stripped = F.when(name.contains("("), F.regexp_replace(name, COPY_MARKER, "")).otherwise(name)
    return F.lower(stripped)


def file_type(path: Column | str) -> Column:
    """image / video / audio / document / data / other, by extension."""
    known = [F.lit(v) for label, exts in FILE_TYPES.items() for ext in exts for v in (ext, label)]
    return F.coalesce(F.try_element_at(F.create_map(*known), file_suffix(path)), F.lit("other"))


def display_path(archive: Column | str, path: Column | str) -> Column:
    """``archive:member`` with the archive's base name."""
    return F.concat(file_name(archive), F.lit(":"), _col(path))


def propose_location(path: Column | str, date: Column | str, base: str = "extracted") -> Column:
    """``base/yyyy/MM/name``; NULL when the date is NULL."""
    d = _col(date)
    return F.concat(F.lit(base + "/"), F.date_format(d, "yyyy/MM/"), file_name(path))


def reroot(location: Column | str, output_dir: str) -> Column:
    """Replace the first component of a location with the output directory."""
    loc = _col(location)
    cut = F.instr(loc, "/")
    tail = F.substring(loc, cut + 1, F.length(loc))
    return F.concat(F.lit(output_dir.rstrip("/") + "/"), tail)
