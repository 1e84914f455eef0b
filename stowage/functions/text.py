"""Display text: sizes and shortened labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
UNITS = ["B", "KB", "MB", "GB", "TB", "PB"]
HASH_CHARS = 12
LABEL_CHARS = 30


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def human_size(size: Column | str, max_unit: str = "PB") -> Column:
    """One-decimal size text; ``max_unit`` is ``PB`` for plans, ``TB`` for reports.

    Ties round half to even.
    """
    units = UNITS[: UNITS.index(max_unit) + 1]
    value = _col(size).cast("double")

    def text(power: int) -> Column:
        scaled = value / F.lit(float(1024**power))
        return F.format_string(f"%.1f {units[power]}", F.bround(scaled, 1))

    last = len(units) - 1
    chain = F.when(value < 1024, text(0))
    for power in range(1, last):
        chain = chain.when(value < float(1024 ** (power + 1)), text(power))
    return chain.otherwise(text(last))


def short_hash(key: Column | str, chars: int = HASH_CHARS) -> Column:
    """Key cut to a few characters and an ellipsis."""
    k = _col(key)
    return F.when(F.length(k) > chars, F.concat(F.left(k, F.lit(chars)), F.lit("..."))).otherwise(k)


def archive_label(name: Column | str, chars: int = LABEL_CHARS) -> Column:
    """Chart label of an archive."""
    return F.left(_col(name), F.lit(chars))
