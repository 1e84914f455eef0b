"""The two-stage rule on a stream: verdicts that change as name-mates arrive.

A member alone in its (size, normalized name) group is unique; from the second
on, all members of the group are compared by content. So a late name-mate turns
a stored unique member into a candidate, and a late archive that comes first in
order moves the whole group forward. Both only ever lower the place of a content
key's first candidate, so three keyed tables are enough:

* per group: members, and the first of them;
* per group and content key: the first member;
* per content key: the first candidate, that is, the original.

A batch looks up the groups it holds and, for groups whose standing changed,
their content keys; it reads the buckets of those keys alone. Every change of an
original is written with the original it replaces, as a retraction. Group and
key rows remember what they were before the batch that wrote them, so a batch
that is run again starts from the same state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from ..operators.dedup import name_key, with_key
from ..operators.logtable import LogTable
from ..operators.skew import attach
from ..storage import settle

GROUP = ["file_size", "norm_name"]
PAIR = [*GROUP, "content_key"]
_PLACE = "STRUCT<archive: STRING, entry_ix: BIGINT>"
_FIRST = f"STRUCT<group_first: {_PLACE}, place: {_PLACE}, file_path: STRING>"


class TwoStageState:
    """The three tables of a stream, below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        def table(name: str, ddl: str, keys: list[str], bucket_by: list[str] | None = None) -> LogTable:
            return LogTable(spark, f"{path}/{name}", StructType.fromDDL(ddl), keys, bucket_by)

        size = "file_size BIGINT, norm_name STRING"
        self.groups = table("groups", f"{size}, members BIGINT, first {_PLACE}, batch BIGINT, members_before BIGINT, first_before {_PLACE}", GROUP)
        self.pairs = table("pairs", f"{size}, content_key STRING, least STRUCT<place: {_PLACE}, file_path: STRING>", PAIR, GROUP)
        self.keys = table("keys", f"content_key STRING, original {_FIRST}, batch BIGINT, original_before {_FIRST}", ["content_key"])


def two_stage_batch(batch: DataFrame, batch_id: int, path: str) -> None:
    """Take in one batch of members (archive, entry_ix, file_path, file_size, content_key or file_crc)."""
    spark, state = batch.sparkSession, TwoStageState(batch.sparkSession, path)
    keyed = with_key(batch).withColumn("norm_name", name_key())
    folder = f"{path}/members/batch_id={batch_id}"
    keyed.write.mode("overwrite").parquet(folder)
    rows = spark.read.schema(keyed.schema).parquet(folder)
    place = F.struct("archive", "entry_ix")

    fresh = settle(rows.groupBy(*GROUP).agg(F.count("*").alias("_n"), F.min(place).alias("_first")), "groups")
    again = F.col("batch") == batch_id
    before = state.groups.read(like=fresh).select(
        *GROUP,
        F.when(again, F.col("members_before")).otherwise(F.col("members")).alias("members_before"),
        F.when(again, F.col("first_before")).otherwise(F.col("first")).alias("first_before"),
    )
    groups = settle(
        fresh.join(before, GROUP, "left").select(
            *GROUP, (F.col("_n") + F.coalesce("members_before", F.lit(0))).alias("members"),
            F.least("_first", "first_before").alias("first"), F.lit(batch_id).cast("bigint").alias("batch"),
            F.coalesce("members_before", F.lit(0)).alias("members_before"), "first_before",
        ),
        "groups",
    )
    # Stored members of these groups have become candidates, or have moved forward.
    shifted = groups.filter("members_before = 1 OR (members_before > 1 AND first < first_before)").select(*GROUP)

    known = F.col("content_key").isNotNull()
    least = F.min(F.struct(place.alias("place"), "file_path")).alias("least")
    new_pairs = settle(rows.filter(known).groupBy(*PAIR).agg(least), "pairs")
    stored = state.pairs.read(like=fresh)
    same = stored.join(new_pairs.select(*PAIR), PAIR, "left_semi")
    moved = stored.join(shifted, GROUP, "left_semi")
    pairs = settle(
        new_pairs.unionByName(same).unionByName(moved).groupBy(*PAIR).agg(F.min("least").alias("least")), "pairs"
    )
    first = F.struct(F.col("first").alias("group_first"), F.col("least.place").alias("place"), F.col("least.file_path").alias("file_path"))
    offers = settle(
        pairs.join(groups.filter("members > 1").select(*GROUP, "first"), GROUP)
        .groupBy("content_key").agg(F.min(first).alias("_offer")),
        "offers",
    )
    old = state.keys.read(like=offers).select(
        "content_key", F.when(again, F.col("original_before")).otherwise(F.col("original")).alias("original_before")
    )
    keys = settle(
        offers.join(old, "content_key", "left")
        .filter("original_before IS NULL OR _offer < original_before")
        .select("content_key", F.col("_offer").alias("original"), F.lit(batch_id).cast("bigint").alias("batch"), "original_before"),
        "keys",
    )
    changes = keys.select("content_key", F.col("original_before").alias("old"), F.col("original").alias("new"))
    changes.write.mode("overwrite").parquet(f"{path}/changes/batch_id={batch_id}")
    state.pairs.upsert(pairs)
    state.keys.upsert(keys)
    state.groups.upsert(groups)  # last: until it is there, a second run starts from what was before


def read_two_stage(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All members taken in so far with the columns of :func:`..operators.dedup.dedup`."""
    state = TwoStageState(spark, path)
    stored = StructType([*schema.fields])
    for name in ("content_key", "norm_name"):
        if name not in stored.fieldNames():
            stored = stored.add(name, StringType())
    members = spark.read.schema(stored.add("batch_id", LongType())).parquet(f"{path}/members")
    by = ["archive", "entry_ix"]
    groups = state.groups.read().filter("members > 1").select(*GROUP, F.col("members").alias("_n"), F.col("first").alias("_group_first"))
    staged = attach(members, groups, GROUP, by, "_n")
    candidate = F.col("_n").isNotNull() & F.col("content_key").isNotNull()
    staged = staged.withColumn(
        "dedup_key", F.when(candidate, F.col("content_key")).otherwise(F.concat_ws("/", F.lit("u"), *[F.col(c).cast("string") for c in by]))
    )
    sizes = staged.filter(candidate).groupBy("dedup_key").agg(F.count("*").alias("_size"))
    originals = sizes.join(state.keys.read().select(F.col("content_key").alias("dedup_key"), "original"), "dedup_key")
    found = attach(staged, originals, ["dedup_key"], by, "_size")
    own = F.struct(F.col("_group_first").alias("group_first"), F.struct(*by).alias("place"), F.col("file_path"))
    grouped = F.col("original").isNotNull()
    return found.select(
        *[c for c in members.columns if c not in ("norm_name",)],
        "dedup_key",
        F.coalesce(grouped & (own != F.col("original")), F.lit(False)).alias("is_duplicate"),
        F.coalesce("_size", F.lit(1).cast("bigint")).alias("group_size"),
        F.when(grouped, F.col("original.place.archive")).otherwise(F.col("archive")).alias("original_archive"),
        F.when(grouped, F.col("original.file_path")).otherwise(F.col("file_path")).alias("original_path"),
    )
