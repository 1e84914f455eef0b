from datetime import datetime

import pytest

from stowage.operators import compare as cmp
from stowage.operators.reconcile import missing_sources, pending_by_year, reconcile, reconcile_summary
from stowage.schemas import MANIFEST

SIDE = "archive string, entry_ix bigint, file_path string, file_size bigint, content_key string"
FILES = "root string, file_path string, file_size bigint, content_key string"


@pytest.fixture
def sides(rows):
    left = rows(
        [("z", 0, "a/x", 1, "k1"), ("z", 1, "y", 1, "k1"), ("z", 2, "b/z", 5, "k2"), ("z", 3, "w", 7, "k3")], SIDE
    )
    right = rows([("d", "q", 1, "k1"), ("d", "p", 1, "k1"), ("d", "o", 9, "k9")], FILES)
    return left, right


@pytest.mark.parametrize("hot_rows", [None, 1])
def test_compare(sides, hot_rows):
    left, right = sides
    pairs = cmp.compare_pairs(left, right, ["entry_ix"], hot_rows).collect()
    assert sorted((r.entry_ix, r.match_path) for r in pairs) == [(0, "p"), (1, "p")]
    assert sorted(r.entry_ix for r in cmp.only_left(left, right, ["entry_ix"], hot_rows).collect()) == [2, 3]
    assert [r.file_path for r in cmp.only_right(left, right, ["file_path"], hot_rows).collect()] == ["o"]
    assert tuple(cmp.compare_summary(left, right).first()) == (4, 3, 2, 2, 2, 12, 1)


def test_compare_with_an_empty_side(sides, rows):
    left, right = sides
    none = rows([], FILES)
    assert cmp.compare_pairs(left, none, ["entry_ix"]).count() == 0
    assert cmp.only_left(left, none, ["entry_ix"]).count() == 4
    assert tuple(cmp.compare_summary(left, none).first()) == (4, 0, 0, 0, 4, 14, 0)
    assert tuple(cmp.diff_summary(none, right).first()) == (0, 0, 0, 0, 0, 0.0)


def test_diff(sides):
    left, right = sides
    diffed = cmp.diff(left, right, ["entry_ix"])
    assert {r.entry_ix: r.present for r in diffed.collect()} == {0: True, 1: True, 2: False, 3: False}
    assert tuple(cmp.diff_summary(left, right).first()) == (4, 14, 2, 2, 12, 50.0)
    folders = cmp.missing_by_folder(diffed).collect()
    assert [(r.folder, r.files, r.bytes, r.size_text) for r in folders] == [
        ("(root)", 1, 7, "7.0 B"), ("b", 1, 5, "5.0 B"),
    ]
    assert cmp.missing_by_folder(diffed, shown=1).orderBy("more_folders").collect()[-1].more_folders == 1
    assert sorted(r.path for r in cmp.diff_manifest(diffed).collect()) == ["b/z", "w"]


def test_diff_of_archives_uses_unique_members_and_crc(rows):
    entries = rows(
        [("z", 0, "a.x", 3, 0x352441C2), ("z", 1, "a(1).x", 3, 0x352441C2), ("z", 2, "b.x", 1, 9)],
        "archive string, entry_ix bigint, file_path string, file_size bigint, file_crc bigint",
    )
    target = rows([("d", "t", 3, "3_352441c2")], FILES)
    got = {r.entry_ix: r.present for r in cmp.diff_archives(entries, target).collect()}
    assert got == {0: True, 2: False}


def test_strategies_must_agree():
    with pytest.raises(ValueError):
        cmp.require_same_strategy("full", "size_crc")


def manifest_rows(spark):
    data = [
        ("k1", 5, 1, datetime(2020, 1, 1), "l", "z1", "a", 0),
        ("k2", 6, 1, datetime(2021, 1, 1), "l", "z1", "b", 0),
        ("k3", 7, 1, None, "", "z1", "c", 0),
        ("k4", 8, 1, datetime(2021, 1, 1), "l", "gone", "d", 0),
        ("k1", 9, 1, datetime(2021, 5, 1), "l", "z1", "e", 0),
    ]
    return spark.createDataFrame(data, MANIFEST)


@pytest.mark.parametrize("hot_rows", [None, 1])
def test_reconcile(spark, rows, hot_rows):
    existing = rows([("k1", 5), ("k1", 5)], "content_key string, file_size bigint")
    archives = rows([("z1",), ("z1",), ("z9",)], "archive string")
    df = reconcile(manifest_rows(spark), existing, archives, hot_rows)
    assert {r.source_path: r.status for r in df.collect()} == {
        "a": "extracted", "b": "pending", "c": "pending", "d": "source_missing", "e": "pending",
    }
    summary = {r.status: (r.files, r.pct) for r in reconcile_summary(df).collect()}
    assert summary == {"extracted": (1, 20.0), "pending": (3, 60.0), "source_missing": (1, 20.0)}
    assert [tuple(r) for r in pending_by_year(df).collect()] == [("Unknown", 1, 7), ("2021", 2, 15)]
    assert [tuple(r) for r in missing_sources(df).collect()] == [("gone", 1)]


def test_empty_manifest(spark, rows):
    df = reconcile(
        spark.createDataFrame([], MANIFEST), rows([], "content_key string, file_size bigint"), rows([], "archive string")
    )
    assert sorted(map(tuple, reconcile_summary(df).collect())) == [
        ("extracted", 0, 0.0), ("pending", 0, 0.0), ("source_missing", 0, 0.0),
    ]
