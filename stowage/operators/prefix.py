"""Running sums and maxima within keys of any size.

A window sends all rows of a key to one task. Here rows are range-partitioned
by key and order, so a crowded key spans many slices; a window runs inside
each slice, and what the slices before hold is added. A slice border splits
one key at most, so there are fewer of those additions than slices, which
bounds their broadcast.

Where rows are wide, :func:`slotted` spares them the range shuffle: only keys
of very many rows are cut, at bounds drawn from their rows, and what lies
before each cut is counted without moving a row. Keys and slots then go
through one hash shuffle, in which a window runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import settle
from .skew import HOT_ROWS, heavy_keys

SUM, MAX = F.sum, F.max
#: Rows are counted in that many groups of keys before the keys of crowded groups are counted.
BUCKETS = 1 << 16
#: Slots of one key at most, and rows drawn for each.
SLOTS, DRAWS = 256, 16


def sliced(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``rows`` cut into ranges of key and order, written once, with the number of the range as ``_slice``."""
    return settle(rows.repartitionByRange(*keys, *order).withColumn("_slice", F.spark_partition_id()), "sliced")


def running(
    ranged: DataFrame,
    keys: list[str],
    order: list[str],
    values: dict[str, tuple[Callable[[Column], Column], Column]],
    inclusive: bool = True,
) -> DataFrame:
    """Adds, per name, the sum or maximum of a column over the rows of the key up to this one.

    ``ranged`` comes from :func:`sliced`, with the same keys and an order that
    has no ties. ``inclusive`` counts the row itself. Sums start from 0, maxima
    from NULL.
    """
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy(*keys, "_slice").agg(*[agg(column).alias(name) for name, (agg, column) in values.items()])
    carried = (
        parts.select(
            *keys,
            "_slice",
            F.count("*").over(earlier).alias("_slices"),
            *[agg(F.col(name)).over(earlier).alias(f"_carried{name}") for name, (agg, _) in values.items()],
        )
        .filter("_slices > 0")
        .drop("_slices")
    )
    inside = (
        Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    here = ranged.select("*", *[agg(column).over(inside).alias(f"_here{name}") for name, (agg, column) in values.items()])
    joined = here.join(F.broadcast(carried), [*keys, "_slice"], "left")

    def total(name: str, agg) -> Column:
        here, carried = F.col(f"_here{name}"), F.col(f"_carried{name}")
        if agg is SUM:
            return F.coalesce(here, F.lit(0)) + F.coalesce(carried, F.lit(0))
        return F.greatest(here, carried)

    return joined.select(*ranged.columns, *[total(name, agg).alias(name) for name, (agg, _) in values.items()])


def crowded(rows: DataFrame, keys: list[str], order: list[str], hot_rows: int | None = None) -> DataFrame | None:
    """Keys with at least ``hot_rows`` rows: ``_bounds`` that cut them into slots, and the rows ``_before`` each slot.

    None if no key has as many. Bounds are drawn at random and written once;
    any bounds are right, since the rows between them are counted. Keys must not be NULL.
    """
    hot_rows = HOT_ROWS if hot_rows is None else hot_rows
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).alias("_bucket")
    full = rows.groupBy(bucket).agg(F.count("*").alias("_rows")).filter(F.col("_rows") >= hot_rows).select("_bucket")
    full = settle(full, "buckets")
    if full.isEmpty():
        return None
    inside = rows.select(*keys, bucket).join(F.broadcast(full), "_bucket")
    names = settle(heavy_keys(inside.groupBy(*keys).agg(F.count("*").alias("_rows")), keys, "_rows", hot_rows), "crowded")
    if names.isEmpty():
        return None
    slots = F.least(F.lit(SLOTS), F.ceil(F.col("_rows") * 2 / hot_rows)).cast("int")
    hot = names.withColumn("_slots", slots)
    drawn = (
        rows.select(*keys, *order)
        .join(F.broadcast(hot), keys)
        .filter(F.rand(0) * F.col("_rows") < F.col("_slots") * DRAWS)
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct(*order))).alias("_drawn"))
    )
    nth = F.transform(
        F.sequence(F.lit(1), F.col("_slots") - 1),
        lambda k: F.get("_drawn", F.floor(k * F.size("_drawn") / F.col("_slots")).cast("int")),
    )
    cut = hot.join(drawn, keys, "left").select(*keys, F.when(F.size("_drawn") > 0, nth).alias("_bounds"))
    cut = settle(cut.filter(F.col("_bounds").isNotNull()), "bounds")
    here = rows.select(*keys, *order).join(F.broadcast(cut), keys).groupBy(*keys, _slot(order).alias("_slot")).agg(
        F.count("*").alias("_rows")
    )
    every = cut.select(*keys, F.explode(F.sequence(F.lit(0), F.size("_bounds"))).alias("_slot"))
    earlier = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    sums = every.join(here, [*keys, "_slot"], "left").select(
        *keys, "_slot", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_sum")
    )
    before = sums.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_slot", "_sum")))["_sum"].alias("_before"))
    return settle(cut.join(before, keys), "slots")


def _slot(order: list[str]) -> Column:
    return F.size(F.filter("_bounds", lambda bound: bound <= F.struct(*order)))


def slotted(rows: DataFrame, hot: DataFrame | None, keys: list[str], order: list[str]) -> DataFrame:
    """Adds ``_slot`` and ``_before``, the rows counted in earlier slots of the key; ``hot`` comes from :func:`crowded`.

    Other columns of ``hot`` are added too, NULL for keys that have one slot.
    """
    if hot is None:
        return rows.withColumns({"_slot": F.lit(0), "_before": F.lit(0).cast("bigint")})
    cut = rows.join(F.broadcast(hot.withColumnRenamed("_before", "_sums")), keys, "left").withColumn(
        "_slot", F.when(F.col("_bounds").isNull(), F.lit(0)).otherwise(_slot(order))
    )
    before = F.coalesce(F.get("_sums", F.col("_slot")), F.lit(0).cast("bigint"))
    return cut.withColumn("_before", before).drop("_bounds", "_sums")
