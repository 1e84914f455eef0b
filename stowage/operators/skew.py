"""Skew-safe lookup: attach one-row-per-key facts to rows whose keys may be hot.

A plain shuffle join sends all rows of a key to one task, and one key may hold
a third of the catalog (empty files, boiler-plate sidecars, one big archive).
Here the few hot keys travel to the rows instead: their facts are broadcast,
and the rows that found them take a spread key in the shuffle join, so that
they scatter over all tasks. Every other key holds fewer than ``hot_rows`` rows.

The broadcast is bounded twice: only keys with at least ``hot_rows`` rows
qualify, and at most ``hot_keys`` of them are taken. The hot list is only about
speed: a key left out of it is joined through the shuffle, with equal results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

HOT_ROWS = 1_000_000
HOT_KEYS = 10_000
SPREAD = 8192


def heavy_keys(
    counted: DataFrame, keys: list[str], count: str, hot_rows: int = HOT_ROWS, hot_keys: int = HOT_KEYS
) -> DataFrame:
    """The heaviest keys of a per-key table, at most ``hot_keys`` rows."""
    order = [F.desc(count), *[F.col(k) for k in keys]]
    return counted.filter(F.col(count) >= hot_rows).orderBy(*order).limit(hot_keys)


def _spread_key(rows: DataFrame, lead: str, spread_by: list[str]) -> Column:
    # A value the lead key never has: sizes and ids are not negative, and no
    # content key, name or archive starts with the control character.
    slot = F.pmod(F.xxhash64(*spread_by), F.lit(SPREAD))
    if isinstance(rows.schema[lead].dataType, StringType):
        return F.concat(F.lit("\x01"), slot.cast("string"))
    return (-1 - slot).cast(rows.schema[lead].dataType)


def attach(
    rows: DataFrame,
    facts: DataFrame,
    keys: list[str],
    spread_by: list[str],
    weight: str | None = None,
    hot_rows: int | None = None,
    hot_keys: int | None = None,
) -> DataFrame:
    """Left-join ``facts`` (unique per ``keys``) to ``rows`` without hot tasks.

    ``weight`` names the column of ``facts`` that counts the rows of each key,
    where the caller has it; otherwise the rows are counted per key first
    (map-side combined, keys only). ``spread_by`` are row columns with many
    distinct values. Keys must not be NULL.
    """
    hot_rows = HOT_ROWS if hot_rows is None else hot_rows
    hot_keys = HOT_KEYS if hot_keys is None else hot_keys
    values = [c for c in facts.columns if c not in keys]
    # Stated here, below both uses of the facts, so that the join's own not-null
    # filter on one of them does not make their plans differ: they share one exchange.
    for key in keys:
        facts = facts.filter(F.col(key).isNotNull())
    if weight is not None:
        hot = heavy_keys(facts, keys, weight, hot_rows, hot_keys)
    else:
        counted = rows.groupBy(*keys).agg(F.count("*").alias("_rows"))
        heavy = heavy_keys(counted, keys, "_rows", hot_rows, hot_keys).drop("_rows")
        # At most ``hot_keys`` facts pass the semi-join; a hot key without facts
        # stays in the list, with NULLs, so that its rows are spread too.
        known = facts.join(F.broadcast(heavy), keys, "left_semi")
        hot = heavy.join(F.broadcast(known), keys, "left")

    lead, others = keys[0], keys[1:]
    hot_side = hot.select(
        *[F.col(k).alias(f"_hot_{k}") for k in keys],
        *[F.col(v).alias(f"_hot_{v}") for v in values],
        F.lit(True).alias("_is_hot"),
    )
    on_hot = [F.col(k) == F.col(f"_hot_{k}") for k in keys]
    marked = rows.join(F.broadcast(hot_side), on_hot, "left").withColumn(
        "_probe",
        F.when(F.col("_is_hot"), _spread_key(rows, lead, spread_by)).otherwise(F.col(lead)),
    )
    cold_side = facts.select(
        *[F.col(k).alias(f"_key_{k}") for k in keys], *[F.col(v).alias(f"_cold_{v}") for v in values]
    )
    on_cold = [F.col("_probe") == F.col(f"_key_{lead}")] + [
        F.col(k) == F.col(f"_key_{k}") for k in others
    ]
    joined = marked.join(cold_side, on_cold, "left")
    return joined.select(
        *[F.col(c) for c in rows.columns],
        *[
            F.when(F.col("_is_hot"), F.col(f"_hot_{v}")).otherwise(F.col(f"_cold_{v}")).alias(v)
            for v in values
        ],
    )

