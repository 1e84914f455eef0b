import random
import re

import pytest
from pyspark.sql import functions as F

from stowage.operators.dedup import (
    dedup,
    dedup_counts,
    directory_index,
    duplicate_groups,
    duplicates,
    entry_counts,
    originals,
    split_candidates,
    with_types,
)
from stowage.operators import report as rp
from stowage.operators.skew import attach, heavy_keys

SCHEMA = "archive string, entry_ix bigint, file_path string, file_size bigint, file_crc bigint"


def brute_force(entries, mode):
    """Plain restatement: (archive, entry_ix) -> (is_duplicate, group_size, original)."""

    def norm(path):
        return re.sub(r"\(\d+\)(?=\.[^.]+$|$)", "", path.split("/")[-1]).lower()

    ordered = sorted(entries)
    by_name = {}
    for e in ordered:
        by_name.setdefault((e[3], norm(e[2])), []).append(e)
    groups = {}
    if mode == "two_stage":
        pool = [e for g in by_name.values() if len(g) > 1 for e in g]
        for g in by_name.values():
            if len(g) == 1:
                groups[("single", *g[0])] = g
    else:
        pool = ordered
    for e in pool:
        groups.setdefault((e[3], e[4]), []).append(e)
    out = {}
    for g in groups.values():
        for i, e in enumerate(g):
            out[e[:2]] = (i > 0, len(g), g[0][:1] + g[0][2:3])
    return out


def found(df):
    return {
        (r.archive, r.entry_ix): (r.is_duplicate, r.group_size, (r.original_archive, r.original_path))
        for r in df.collect()
    }


def random_catalog(seed):
    rng = random.Random(seed)
    names = ["a.jpg", "A(1).jpg", "b.jpg", "b(2).jpg", "x/a.jpg", "c", "c(1)", ""]
    return [
        (f"z{rng.randrange(4)}", i, rng.choice(names) or f"only{i}.txt", rng.choice([0, 0, 10, 20]), rng.randrange(3))
        for i in range(160)
    ]


@pytest.mark.parametrize("mode", ["two_stage", "content_only"])
@pytest.mark.parametrize("hot_rows", [None, 3])
@pytest.mark.parametrize("seed", [1, 2])
def test_dedup_equals_brute_force(rows, mode, hot_rows, seed):
    entries = random_catalog(seed)
    got = found(dedup(rows(entries, SCHEMA), mode, hot_rows=hot_rows))
    assert got == brute_force(entries, mode)


def test_original_follows_group_order_not_scan_order(rows):
    # Groups are laid out one after another: the later member of an earlier group comes first.
    entries = [
        ("z", 0, "a.jpg", 9, 1), ("z", 5, "b.jpg", 9, 2), ("z", 6, "b(1).jpg", 9, 2), ("z", 10, "a(1).jpg", 9, 2),
    ]
    got = found(dedup(rows(entries, SCHEMA)))
    assert [k[1] for k, r in got.items() if r[2] == ("z", "a(1).jpg")] and got[("z", 10)][0] is False
    assert got[("z", 5)] == (True, 3, ("z", "a(1).jpg")) and got[("z", 6)][0]


def test_cases(rows):
    entries = [
        ("z", 0, "one.jpg", 5, 1),  # same bytes as two.jpg, each name alone: both unique
        ("z", 1, "two.jpg", 5, 1),
        ("z", 2, "e.txt", 0, 0),  # empty files of one name
        ("y", 0, "e.txt", 0, 0),
        ("y", 1, "same.bin", 7, 7),  # equal in every field but the position
        ("y", 2, "same.bin", 7, 7),
        ("y", 3, "p.bin", 8, 1),  # same size and name, other bytes
        ("y", 4, "q/p.bin", 8, 2),
    ]
    df = dedup(rows(entries, SCHEMA))
    dups = {(r.archive, r.entry_ix) for r in duplicates(df).collect()}
    assert dups == {("z", 2), ("y", 2)}
    assert originals(df).count() == 6 and duplicate_groups(df).count() == 4
    assert tuple(dedup_counts(df).first()) == (6, 2)
    assert df.select("dedup_key").distinct().count() == 6
    flags = {(r.archive, r.entry_ix): r.is_candidate for r in split_candidates(rows(entries, SCHEMA)).collect()}
    assert not flags[("z", 0)] and flags[("y", 4)]
    assert {r.original_type for r in with_types(df).collect()} == {"image", "document", "other"}


def test_given_content_keys_are_used(rows):
    df = rows([("z", 0, "a.x", 1, "k"), ("z", 1, "b.x", 1, "k")],
              "archive string, entry_ix bigint, file_path string, file_size bigint, content_key string")
    assert duplicates(dedup(df, "content_only")).count() == 1
    assert duplicates(dedup(df)).count() == 0
    with pytest.raises(ValueError):
        dedup(df, "guess")


def test_directory_index(rows):
    df = rows([("b", "k"), ("a", "k"), ("c", "m")], "file_path string, content_key string")
    assert sorted(map(tuple, directory_index(df).collect())) == [("k", 2, "a"), ("m", 1, "c")]


@pytest.mark.parametrize("weight", [None, "n"])
def test_attach_is_a_left_join_whatever_is_hot(spark, weight):
    rows = spark.range(4000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("k"),
        "id",
    )
    facts = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top")).filter("k != 'k7'")
    want = sorted(map(tuple, rows.join(facts, "k", "left").select("k", "id", "n", "top").collect()))
    for hot_rows in (1, 100, 10**9):
        got = attach(rows, facts, ["k"], ["id"], weight, hot_rows)
        assert sorted(map(tuple, got.select("k", "id", "n", "top").collect())) == want


def test_hot_rows_leave_the_shuffle_key(spark):
    rows = spark.range(3000).select(F.lit("hot").alias("k"), "id")
    facts = rows.groupBy("k").agg(F.count("*").alias("n"))
    got = attach(rows, facts, ["k"], ["id"], "n", hot_rows=10)
    spread = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", spread)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sizes) == 3000 and max(sizes) < 1500


def test_heavy_keys_are_bounded(spark):
    counted = spark.range(100).select(F.col("id").alias("k"), (F.col("id") + 5).alias("n"))
    got = heavy_keys(counted, ["k"], "n", hot_rows=50, hot_keys=7)
    assert [r.n for r in got.collect()] == list(range(104, 97, -1))


def test_no_single_partition_exchange_and_no_content(spark, tmp_path):
    path = str(tmp_path / "entries")
    df = spark.createDataFrame([("z", 0, "a.x", 1, 1, bytearray(b"x"))], SCHEMA + ", content binary")
    df.write.parquet(path)
    plan = dedup(spark.read.parquet(path)).drop("content")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange SinglePartition" not in plan
    assert all("content:binary" not in line for line in plan.splitlines() if "ReadSchema" in line)


def test_source_is_read_once(spark, tmp_path):
    path = str(tmp_path / "entries")
    spark.createDataFrame(random_catalog(3), SCHEMA).write.parquet(path)
    found = dedup_counts(dedup(spark.read.parquet(path)))
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("ReusedExchange") >= 2 and plan.count("FileScan") <= 3


@pytest.mark.parametrize("mode", ["two_stage", "content_only"])
def test_totals_from_counts_alone(spark, mode):
    df = spark.range(3000).selectExpr(
        "'z' || id % 7 AS archive", "id AS entry_ix", "'p/f' || (id * 31 % 900) || '.jpg' AS file_path", "id * 7 % 11 AS file_size",
        "IF(id % 50 = 0, NULL, (id * 7 % 11) || '_' || (id * 13 % 5)) AS content_key",
    )
    full = dedup(df, mode)
    assert entry_counts(df, mode).collect() == dedup_counts(full).collect()
    assert rp.entry_summary(df, mode).collect() == rp.summary_stats(full).collect()
    assert tuple(entry_counts(df.limit(0), mode).first()) == (0, 0) and tuple(rp.entry_summary(df.limit(0), mode).first()) == (0, 0, 0, 0, 0, 0)


def shuffles_of(node, column):
    """Shuffles that carry a column, below a plan node."""
    names = [node.output().apply(i).name() for i in range(node.output().size())]
    below = [node.children().apply(i) for i in range(node.children().size())]
    return (node.nodeName() == "Exchange" and column in names) + sum(shuffles_of(x, column) for x in below)


def test_members_are_shuffled_once(spark, tmp_path):
    path = str(tmp_path / "entries")
    spark.createDataFrame(random_catalog(3), SCHEMA).withColumn("note", F.col("file_path")).write.parquet(path)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        noted = dedup(spark.read.parquet(path)).filter("is_duplicate").select("note")
        assert shuffles_of(noted._jdf.queryExecution().executedPlan(), "note") == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("hot_rows", [None, 3])
def test_name_groups_of_several_contents_and_of_none(rows, hot_rows):
    data = [("z", i, f"d{i}/a.jpg", 5, i % 3) for i in range(9)] + [("y", i, f"d{i}/b.jpg", 5, 1) for i in range(4)]
    df = rows(data + [("x", 0, "alone.jpg", 5, 2)], SCHEMA.split(", file_crc")[0] + ", file_crc long")
    df = df.withColumn("content_key", F.expr("IF(archive = 'z' AND entry_ix > 6, NULL, '5_' || file_crc)"))
    got = {(r.archive, r.entry_ix): r for r in dedup(df, hot_rows=hot_rows).collect()}
    # "y" comes first, and its content is one of those of the mixed group.
    assert {k: (r.group_size, r.original_archive, r.original_path) for k, r in got.items() if r.is_duplicate} == {
        **{("y", i): (6, "y", "d0/b.jpg") for i in (1, 2, 3)}, **{("z", i): (6, "y", "d0/b.jpg") for i in (1, 4)},
        **{("z", i): (3, "z", "d0/a.jpg") for i in (3, 6)}, ("z", 5): (2, "z", "d2/a.jpg"),
    }
    assert all(got[k].group_size == 1 for k in [("z", 7), ("z", 8), ("x", 0)])
