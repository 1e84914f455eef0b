"""The shared analysis plan: duplicates, dates, proposed locations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..functions import propose_location
from ..operators.dates import resolve_dates
from ..operators.dedup import dedup


def analyze(
    entries: DataFrame,
    sidecars: DataFrame | None = None,
    exif_tags: DataFrame | None = None,
    cache: DataFrame | None = None,
    mode: str = "two_stage",
    order_cols=("archive", "entry_ix"),
    base: str = "extracted",
    hot_rows: int | None = None,
    cut: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Catalog with duplicates found, dates resolved and locations proposed.

    Feeds every report and plan; write it once (``storage.settle``) when more
    than one of them is needed. ``cut`` writes the deduplicated catalog before
    dates are looked up, which pays when a date cache splits it in two.
    """
    found = dedup(entries, mode, order_cols, hot_rows)
    if cut is not None:
        found = cut(found)
    dated = resolve_dates(
        found, sidecars, exif_tags, cache, order_cols, hot_rows=hot_rows, catalog=entries
    )
    return dated.withColumn("proposed_location", propose_location("file_path", "file_date", base))
