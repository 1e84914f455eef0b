import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from stowage.operators import library as lib
from stowage.operators import planning as pl
from stowage.operators.numbering import decide_skips
from stowage.operators.prefix import crowded, slotted

PLANNED = "archive string, entry_ix bigint, location string"


def in_turn(planned, taken, last):
    """Serve files one after another: smallest free number."""
    used, out, reached = set(taken), {}, {}
    for archive, ix, location in sorted(planned):
        folder, name = location.rsplit("/", 1)
        dot = name.rfind(".")
        stem, suffix = (name[:dot], name[dot:]) if 0 < dot < len(name) - 1 else (name, "")
        choice, k = location, 0
        while choice in used and (last is None or k <= last):
            k = max(k + 1, reached.get(location, 0))  # numbers below were used when they were last asked for
            choice = f"{folder}/{stem}_{k}{suffix}"
        reached[location] = k
        if last is not None and k > last:
            choice = None
        else:
            used.add(choice)
        out[(archive, ix)] = choice
    return out


def resolve(rows, planned, taken=(), last=None, hot_rows=None):
    disk = rows([(t,) for t in taken], "destination string") if taken else None
    df = lib.resolve_destinations(rows(planned, PLANNED), disk, hot_rows=hot_rows, last_number=last)
    got = df.collect()
    assert all((r.destination is None) == (r.error is not None) for r in got)
    return {(r.archive, r.entry_ix): r.destination for r in got}


def test_three_equal_names_and_a_natural_number(rows):
    planned = [("z", 0, "o/a.jpg"), ("z", 1, "o/a_1.jpg"), ("z", 2, "o/a.jpg"), ("z", 3, "o/a.jpg"), ("z", 4, "p/a.jpg")]
    got = resolve(rows, planned, ["o/a_3.jpg"])
    assert [got[("z", i)] for i in range(5)] == ["o/a.jpg", "o/a_1.jpg", "o/a_2.jpg", "o/a_4.jpg", "p/a.jpg"]


def test_name_on_disk_and_too_many(rows):
    planned = [("z", i, "o/a.jpg") for i in range(5)]
    got = resolve(rows, planned, ["o/a.jpg"], last=3)
    assert list(got.values()).count(None) == 2
    assert {v for v in got.values() if v} == {"o/a_1.jpg", "o/a_2.jpg", "o/a_3.jpg"}
    assert got[("z", 3)] is None and got[("z", 4)] is None


@pytest.mark.parametrize("seed", range(4))
def test_equals_serving_in_turn(rows, seed):
    rng = random.Random(seed)
    stems = ["a", "a_1", "a_2", "a_1_1", "a_1_2", "a_2_1_1", "b", "b_0", "b_01", "c_1", "c_1_1", "IMG_2023_1", "d.e", "d.e_1"]
    suffixes = [".jpg", ".JPG", ""]
    planned = [
        (f"z{rng.randrange(3)}", i, f"o/{rng.randrange(2)}/{rng.choice(stems)}{rng.choice(suffixes)}") for i in range(120)
    ]
    taken = sorted({f"o/{rng.randrange(2)}/{rng.choice(stems)}{rng.choice(suffixes)}" for _ in range(8)})
    last = rng.choice([2, 3, None, None])
    for hot_rows in (None, 2):
        want = in_turn(planned, taken, last)
        assert resolve(rows, planned, taken, last, hot_rows) == want


def test_one_name_wanted_by_nearly_all(rows):
    planned = [("z", i, "o/a.jpg" if i % 10 else f"o/b{i}.jpg") for i in range(400)]
    got = resolve(rows, planned, last=4, hot_rows=50)
    assert got == in_turn(planned, [], 4) and list(got.values()).count(None) == 355


def test_files_go_through_one_shuffle(spark, rows):
    planned = spark.range(3000).selectExpr("'z' AS archive", "id AS entry_ix", "'o/a' || (id % 700) || '.jpg' AS location")
    disk = rows([("o/a5.jpg",), ("o/a9.jpg",)], "destination string")
    placed = lib.resolve_destinations(planned, disk)
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    got = {(r.archive, r.entry_ix): r.destination for r in placed.collect()}
    assert got == in_turn([tuple(r) for r in planned.collect()], ["o/a5.jpg", "o/a9.jpg"], None)


def test_slots_of_a_crowded_key_keep_the_order(spark):
    order = ["a", "b"]
    df = spark.range(5000).selectExpr("IF(id % 5 = 0, concat('k', id), 'k') AS key", "nullif(id % 7, 3) AS a", "id AS b")
    hot = crowded(df, ["key"], order, 500)
    cut = slotted(df, hot, ["key"], order).filter("key = 'k'").collect()
    assert [r.key for r in hot.collect()] == ["k"] and len({r._slot for r in cut}) > 4
    cut.sort(key=lambda r: (r.a is not None, r.a or 0, r.b))
    assert [r._slot for r in cut] == sorted(r._slot for r in cut)
    first = {r._slot: i for i, r in reversed(list(enumerate(cut)))}
    assert all(r._before == first[r._slot] for r in cut)


def test_numbers_beside_one_name_wanted_by_nearly_all(spark):
    # One family of 200,000 wants: a.jpg, its numbered names wanted late and early, and some on disk.
    df = spark.range(200_000).selectExpr(
        "'z' AS archive", "id AS entry_ix",
        "'o/a' || CASE WHEN id % 4 = 0 THEN '_' || (pmod(id * 7919, 120000) + 1) WHEN id % 97 = 1 THEN '_1_' || id ELSE '' END || '.jpg' AS location",
    )
    disk = spark.range(3000).selectExpr("'o/a_' || (id * 31 + 5) || '.jpg' AS destination")
    got = {r.entry_ix: r.destination for r in lib.resolve_destinations(df, disk).collect()}
    want = in_turn([tuple(r) for r in df.collect()], [r.destination for r in disk.collect()], None)
    assert got == {i: d for (_, i), d in want.items()} and len(set(got.values())) == 200_000


@pytest.mark.parametrize("seed", range(3))
def test_skips_equal_counting_through(spark, rows, seed):
    rng = random.Random(seed)
    data, want = [], {}
    for parent in "abc":
        k = 0
        for n in sorted(rng.sample(range(1, 400), 120)):
            slack = None if rng.random() < 0.2 else n - rng.randint(0, n) if parent == "a" else n // 2 + rng.randint(-3, 3)
            skip = slack is None or k < slack
            want[parent, n] = (skip, k)
            k += skip
            data.append(("o", parent, n, slack))
    for rounds in (1, 3, 50):
        got = decide_skips(rows(data, "_folder string, _parent string, _number bigint, _slack bigint"), rounds).collect()
        assert {(r["_parent"], r["_number"]): (r["_skip"], r["_below"]) for r in got} == want


def test_write_library(spark, rows, tmp_path):
    planned = rows(
        [("z", 0, "p/a.jpg", 3, datetime(2020, 1, 5), "o/a.jpg", None, bytearray(b"abc")),
         ("z", 1, "p/b.jpg", 4, None, "o/b.jpg", None, None),
         ("y", 0, "p/c.jpg", 2, datetime(2021, 2, 5), None, "Too many", bytearray(b"xy"))],
        "archive string, entry_ix bigint, file_path string, file_size bigint, file_date timestamp_ntz, "
        "destination string, error string, content binary",
    )
    path = str(tmp_path / "library")
    got = {r.archive: r for r in lib.write_library(planned, path).collect()}
    assert (got["z"].extracted, got["z"].errors, got["z"].bytes_extracted) == (1, 1, 3)
    assert got["z"].first_errors == ["p/b.jpg: unreadable member"] and got["y"].first_errors == ["p/c.jpg: Too many"]
    written = spark.read.parquet(path)
    kept = lib.read_library(written).collect()
    assert [(r.destination, bytes(r.content), str(r.year), int(r.month)) for r in kept] == [("o/a.jpg", b"abc", "2020", 1)]
    totals = rows([(2, 5)], "already_present bigint, duplicates bigint")
    metrics = lib.extraction_metrics(lib.write_library(planned, path + "2"), totals).first()
    assert tuple(metrics) == (1, 3, 2, 2, 5)


CATALOG = (
    "archive string, entry_ix bigint, file_path string, file_size bigint, is_duplicate boolean, "
    "proposed_location string, file_date timestamp_ntz, bytes_key string"
)


@pytest.mark.parametrize("hot_rows", [None, 1])
def test_plan(rows, hot_rows):
    day = datetime(2020, 1, 1)
    catalog = rows(
        [("full", 0, "a.jpg", 1, False, "e/a.jpg", day, "k1"), ("full", 1, "b.jpg", 1, True, "e/b.jpg", day, "k1"),
         ("dups", 0, "c.jpg", 1, True, "e/c.jpg", day, "k1"),
         ("mixed", 0, "d.mp4", 2, False, "e/d.mp4", day, "k2"), ("mixed", 1, "e.jpg", 1, False, "e/e.jpg", day, "other"),
         ("new", 0, "f.pdf", 9, False, "e/f.pdf", None, "k9"), ("new", 1, "g.pdf", 2, False, None, None, "k2"),
         ("lost", 0, "h.pdf", 2, False, "e/h.pdf", day, None)],
        CATALOG,
    )
    existing = rows([(1, "k1"), (2, "k2"), (2, "k7")], "file_size bigint, content_key string")
    asked = []

    def add_key(df):
        asked.append(df)
        return df.withColumn("library_key", F.col("bytes_key"))

    plan = pl.skip_existing(catalog, existing, add_key, hot_rows=hot_rows)
    flags = {(r.archive, r.entry_ix): (r.already_present, r.to_extract) for r in plan.collect()}
    assert flags == {
        ("full", 0): (True, False), ("full", 1): (False, False), ("dups", 0): (False, False),
        ("mixed", 0): (True, False), ("mixed", 1): (False, True), ("new", 0): (False, True),
        ("new", 1): (False, False), ("lost", 0): (False, True),
    }
    assert sorted({r.file_size for r in asked[0].collect()}) == [1, 2]
    per = {r.archive: r for r in pl.archive_plan(plan).collect()}
    assert per["full"].is_fully_extracted and not per["full"].is_redundant
    assert per["dups"].is_redundant and not per["dups"].is_fully_extracted
    assert (per["mixed"].needs_extraction, per["mixed"].already_extracted) == (1, 1)
    assert tuple(pl.plan_totals(plan).first()) == (8, 3, 12, 2, 3)
    sizes = rows([("full", 100)], "archive string, archive_bytes bigint")
    deletable = pl.deletable_archives(pl.archive_plan(plan), sizes)
    assert [tuple(r) for r in deletable.collect()] == [
        ("dups", "all_duplicates", 1, 0), ("full", "fully_extracted", 1, 100),
    ]
    assert tuple(pl.deletable_total(deletable).first()) == (2, 100)
    assert [(r.file_type, r.files) for r in pl.plan_by_type(plan).collect()] == [("document", 2), ("image", 1)]
    assert [r.archive for r in pl.extraction_batches(plan).collect()] == ["lost", "mixed", "new"]
    assert [(r.year, r.files) for r in pl.extract_by_year(plan).collect()] == [("Unknown", 1), ("2020", 2)]
