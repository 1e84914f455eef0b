"""A keyed table kept as a log of commits: deltas in key buckets, compacted now and then.

Every change writes its rows to a folder of its own, in buckets of the key, and
then one commit file, which names the folder. An update costs what it changes,
not what the table holds. Commit files are numbered and created only if absent:
of two writers that start from the same commit, one makes the next number and
the other gets :class:`ConcurrentUpdate`, with nothing lost and nothing
overwritten. Readers take the commits there are; what they read never changes.
"""

from __future__ import annotations

import json
import os
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructType

from ..storage import hadoop_path, names_in

#: Key buckets of a table, and deltas after which it is compacted.
BUCKETS, MOST_DELTAS = 64, 8


class ConcurrentUpdate(RuntimeError):
    """Another writer committed first; read again and repeat the change."""


def create_if_absent(spark: SparkSession, path: str, content: str) -> bool:
    """Create a file whole, or not at all if it exists; False then.

    The content is written beside it first. A hard link (mounted folders) or a
    rename that does not overwrite (HDFS) makes it appear at once, and fails for
    all writers but one. The store must offer one of the two.
    """
    staged = f"{path}.{uuid.uuid4().hex}.tmp"
    system, target = hadoop_path(spark, path)
    _, source = hadoop_path(spark, staged)
    system.mkdirs(target.getParent())
    out = system.create(source, True)
    out.write(content.encode("utf-8"))
    out.close()
    try:
        if system.getUri().getScheme() == "file":
            try:
                os.link(source.toUri().getPath(), target.toUri().getPath())
            except FileExistsError:
                return False
            return True
        jvm = spark.sparkContext._jvm
        options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri()).rename(source, target, options)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True
    finally:
        system.delete(source, False)


class LogTable:
    """A table of rows unique by ``keys`` below ``path``, in buckets of ``bucket_by`` (by default the keys)."""

    COMMIT = "number BIGINT, kind STRING, data STRING"

    def __init__(
        self, spark: SparkSession, path: str, schema: StructType, keys: list[str], bucket_by: list[str] | None = None
    ):
        self.spark, self.path, self.schema, self.keys = spark, path.rstrip("/"), schema, list(keys)
        self.bucket_by = list(bucket_by or keys)
        fields = StructType([*schema.fields]).add("_deleted", BooleanType()).add("_commit", LongType())
        self._stored, self._bucketed = fields, StructType([*fields.fields]).add("_bucket", IntegerType())

    def version(self) -> int:
        """Number of the last commit; 0 before the first."""
        numbers = [int(n.split(".")[0]) for n in names_in(self.spark, f"{self.path}/commits") if n.endswith(".json")]
        return max(numbers, default=0)

    def _live(self, version: int | None = None) -> list[tuple[int, str, str]]:
        """The last whole copy up to a commit, and the deltas after it."""
        last = self.version() if version is None else version
        if not last:
            return []
        log = self.spark.read.schema(self.COMMIT).json(f"{self.path}/commits/*.json").filter(F.col("number") <= last)
        full = log.filter("kind = 'full'").agg(F.max("number")).first()[0] or 0
        return [tuple(r) for r in log.filter(F.col("number") >= full).orderBy("number").collect()]

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.bucket_by), F.lit(BUCKETS)).cast("int")

    def read(self, version: int | None = None, like: DataFrame | None = None) -> DataFrame:
        """The rows, as of a commit if one is named.

        ``like`` has the columns the table is bucketed by; only the buckets its
        rows fall into are read (their numbers, at most ``BUCKETS``, are looked
        up first).
        """
        live = self._live(version)
        if not live:
            return self.spark.createDataFrame([], self.schema)
        reader = self.spark.read.schema(self._bucketed)
        stored = reduce(DataFrame.unionByName, [reader.parquet(f"{self.path}/{data}") for _, _, data in live])
        if like is not None:
            stored = stored.filter(F.col("_bucket").isin([r[0] for r in like.select(self._bucket()).distinct().collect()]))
        columns = self.schema.fieldNames()
        if len(live) > 1:
            row = F.max_by(F.struct(*columns, "_deleted"), "_commit").alias("_row")
            stored = stored.groupBy(*self.keys).agg(row).select("_row.*")
        return stored.filter("NOT _deleted").select(*columns)

    def _commit(self, rows: DataFrame, kind: str, base: int) -> None:
        number, data = base + 1, f"data-{uuid.uuid4().hex}"
        stored = rows.withColumn("_commit", F.lit(number).cast("bigint")).withColumn("_bucket", self._bucket())
        # A bucket goes to one task and makes one file.
        stored.select(*self._bucketed.fieldNames()).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{data}")
        line = json.dumps({"number": number, "kind": kind, "data": data})
        if not create_if_absent(self.spark, f"{self.path}/commits/{number:012d}.json", line):
            raise ConcurrentUpdate(f"{self.path} has a commit {number} already")

    def replace(self, df: DataFrame, base: int | None = None) -> None:
        """Make ``df`` the whole table. ``base``: the commit the change rests on, by default the last."""
        base = self.version() if base is None else base
        self._commit(df.select(*self.schema.fieldNames(), F.lit(False).alias("_deleted")), "full", base)

    def upsert(self, new: DataFrame, base: int | None = None) -> None:
        """Put rows in place of those of their keys; of several new rows of a key the latest stays."""
        base = self.version() if base is None else base
        columns = self.schema.fieldNames()
        lead = ["created_at"] if "created_at" in columns else []
        order = F.struct(*lead, *[c for c in columns if c not in lead])
        fresh = new.select(*columns).groupBy(*self.keys).agg(F.max_by(F.struct(*columns), order).alias("_row")).select("_row.*")
        self._commit(fresh.withColumn("_deleted", F.lit(False)), "delta", base)
        self._tidy(base + 1)

    def delete(self, gone: DataFrame, base: int | None = None) -> None:
        """Drop the rows whose keys are in ``gone``, which may have some of the key columns only."""
        base = self.version() if base is None else base
        keys = [k for k in self.keys if k in gone.columns]
        whole = gone.select(*keys).distinct()
        there = self.read(base, whole if set(self.bucket_by) <= set(keys) else None)
        dropped = there.join(whole, keys, "left_semi").withColumn("_deleted", F.lit(True))
        self._commit(dropped, "delta", base)
        self._tidy(base + 1)

    def _tidy(self, version: int) -> None:
        if len(self._live(version)) > MOST_DELTAS:
            try:
                self.compact()
            except ConcurrentUpdate:
                pass  # whoever came first will compact

    def compact(self) -> None:
        """Write the rows as one whole copy; readers see no difference."""
        base = self.version()
        self.replace(self.read(base), base)

    def clear(self) -> None:
        self.replace(self.spark.createDataFrame([], self.schema))

    def count(self) -> int:
        return self.read().count()
