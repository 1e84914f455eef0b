"""Numbered names where numbered names already stand: rank and select over occupied numbers.

Claims on a name that is gone take ``stem_1``, ``stem_2`` and so on, in order.
A number is skipped if it is occupied when its turn comes: by a file on disk,
or by a file of the plan that wanted that very name and came first. Numbers
given out only rise, so the j-th claim takes the j-th number that is not
skipped, and all that has to be found is which occupied numbers are skipped.

With ``r`` claims before the moment number ``n`` is wanted for itself, and
``k`` skipped numbers below ``n``, it is skipped exactly if ``k < n - r``: else
one of those ``r`` claims has taken it. Sums of the numbers surely skipped and
possibly skipped below bound ``k``, which decides most numbers at once; the
rest go through further rounds. Names whose numbers are themselves wanted more
than once are served level by level: a name's claims are known once it is
known whether its parent's claims took it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import settle
from .prefix import MAX, SUM, running, sliced
from .skew import HOT_ROWS, attach

#: Rounds of bounds before the numbers still open are counted through one after another.
ROUNDS = 6
PARENT = ["_folder", "_parent"]


def decide_skips(occupied: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Adds ``_skip`` and ``_below`` (numbers skipped below) to occupied numbers.

    ``occupied`` has ``_folder, _parent, _number`` (unique) and ``_slack``, n - r
    as above, NULL for files on disk, which are skipped always.
    """
    on_disk = F.col("_slack").isNull()
    state = sliced(occupied.withColumn("_skip", F.when(on_disk, F.lit(True))), PARENT, ["_number"])
    for _ in range(rounds):
        bounds = running(
            state, PARENT, ["_number"],
            {
                "_sure": (SUM, F.col("_skip").isNotNull().cast("bigint") * F.coalesce("_skip", F.lit(False)).cast("bigint")),
                "_open": (SUM, F.col("_skip").isNull().cast("bigint")),
                "_disk": (SUM, on_disk.cast("bigint")),
                "_most": (MAX, F.col("_slack")),
            },
            inclusive=False,
        )
        # A number that is not on disk never lifts the count above its own slack.
        most = F.least(F.col("_sure") + F.col("_open"), F.col("_disk") + F.greatest(F.lit(0), F.coalesce("_most", F.lit(0))))
        skip = F.when(F.col("_skip").isNotNull(), F.col("_skip")).when(most < F.col("_slack"), True).when(
            F.col("_sure") >= F.col("_slack"), False
        )
        state = settle(bounds.withColumn("_skip", skip).select(*state.columns), "skips")
        if state.filter("_skip IS NULL").isEmpty():
            break
    else:
        state = _counted(state)
    return running(state, PARENT, ["_number"], {"_below": (SUM, F.col("_skip").cast("bigint"))}, inclusive=False)


def _counted(state: DataFrame) -> DataFrame:
    """Decides what bounds left open by going through the numbers of those parents; one count is all that is held."""
    left = state.filter("_skip IS NULL").select(*PARENT).distinct()
    closed = state.join(left, PARENT, "left_anti")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in state.schema)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parent, k = None, 0
        for pdf in batches:
            out = []
            for folder, name, slack in zip(pdf["_folder"], pdf["_parent"], pdf["_slack"], strict=True):
                if (folder, name) != parent:
                    parent, k = (folder, name), 0
                out.append(bool(pd.isna(slack) or k < slack))
                k += out[-1]
            yield pdf.assign(_skip=out)

    counted = (
        state.join(left, PARENT, "left_semi")
        .repartition(*PARENT)
        .sortWithinPartitions(*PARENT, "_number")
        .mapInPandas(count, schema)
    )
    return settle(closed.unionByName(counted.select(*state.columns)), "skips")


def served(
    names: DataFrame, marks: DataFrame, last_number: int | None, hot_rows: int | None
) -> tuple[DataFrame, DataFrame | None]:
    """The names of mixed families that claims on the name above take away, and the numbers each name's claims pass over.

    ``names``: the names, with ``_level`` (0: no wanted name above), ``_parent``
    and ``_number`` (which numbered name of the parent it is). ``marks``: per
    child, how many files want the parent before the first one wants the child
    (``_earlier``). The second table has ``_folder, _name, _rank, _passed``:
    from the claim of that rank on, ``_passed`` numbers have been passed over;
    and ``_rivals``, the claims on the name.
    """
    depth = names.agg(F.max("_level")).first()[0] or 0
    children = names.filter("_level > 0").join(
        marks.select("_folder", F.col("_child").alias("_name"), "_earlier"), ["_folder", "_name"], "left"
    )
    gone = names.filter("_level = 0 AND _want > 0").select("_folder", "_name", "_want", F.col("_on_disk").alias("_gone"))
    lost, steps = None, None
    for level in range(depth):
        parents = gone.select(
            "_folder", F.col("_name").alias("_parent"), F.col("_want").alias("_rivals"), F.col("_gone").cast("bigint").alias("_from")
        )
        beside = attach(children.filter(F.col("_level") == level + 1), parents, ["_parent", "_folder"], ["_number"], None, hot_rows)
        before = F.greatest(F.lit(0), F.col("_earlier") - 1 + F.col("_from"))
        slack = F.when(~F.col("_on_disk"), F.col("_number") - before)
        decided = decide_skips(beside.withColumn("_slack", slack).drop("_earlier"))
        claimed = ~F.col("_skip") & (F.col("_number") - F.col("_below") <= F.col("_rivals") - 1 + F.col("_from"))
        if last_number is not None:
            claimed = claimed & (F.col("_number") <= last_number)
        decided = settle(decided.withColumn("_gone", F.col("_on_disk") | claimed), "level")
        passed = decided.filter("_skip").groupBy(
            "_folder", F.col("_parent").alias("_name"), (F.col("_number") - F.col("_below")).alias("_rank")
        ).agg(F.max(F.col("_below") + 1).alias("_passed"), F.max("_rivals").alias("_rivals"))
        steps = passed if steps is None else steps.unionByName(passed)
        gone = decided.filter("_want > 0").select("_folder", "_name", "_want", "_gone")
        taken = gone.filter("_gone").select("_folder", "_name")
        lost = taken if lost is None else lost.unionByName(taken)
    none = names.limit(0).select("_folder", "_name")
    # Ranks end at the number of claims.
    return (none if lost is None else lost), (None if steps is None else settle(steps.filter("_rank <= _rivals"), "steps"))


def passed_over(ranked: DataFrame, steps: DataFrame, hot_rows: int | None) -> DataFrame:
    """Adds ``_skipped``, the numbers passed over at ``_rank`` of the name, to files.

    Names of very many files are cut by rank; each cut starts with what the
    steps before it passed over.
    """
    share = HOT_ROWS if hot_rows is None else hot_rows
    turn = F.floor(F.col("_rank") / share)
    placed = steps.groupBy("_folder", "_name", turn.alias("_turn")).agg(F.max("_passed").alias("_passed"))
    turns = steps.groupBy("_folder", "_name").agg(F.floor(F.max("_rivals") / share).alias("_turns")).filter("_turns > 0").select(
        "_folder", "_name", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_turns"))).alias("_turn")
    )
    earlier = Window.partitionBy("_folder", "_name").orderBy("_turn").rowsBetween(Window.unboundedPreceding, -1)
    carried = turns.join(placed, ["_folder", "_name", "_turn"], "left").select(
        "_folder", "_name", "_turn", (F.col("_turn") * share).alias("_rank"), F.max("_passed").over(earlier).alias("_passed")
    )
    events = steps.select("_folder", "_name", turn.alias("_turn"), "_rank", "_passed").unionByName(carried.filter("_passed IS NOT NULL"))
    rows = ranked.withColumn("_turn", turn).withColumn("_file", F.lit(1)).unionByName(
        events.withColumn("_file", F.lit(0)), allowMissingColumns=True
    )
    so_far = Window.partitionBy("_folder", "_name", "_turn").orderBy("_rank", "_file").rowsBetween(Window.unboundedPreceding, 0)
    counted = rows.withColumn("_skipped", F.coalesce(F.max("_passed").over(so_far), F.lit(0)))
    return counted.filter("_file = 1").select(*ranked.columns, "_skipped")
