import os
import zipfile

import pytest

from stowage.functions.keys import SAMPLE_BYTES
from stowage.operators import library as lib
from stowage.plans import commands


def archive(path, members):
    with zipfile.ZipFile(path, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)


@pytest.fixture
def folders(tmp_path):
    for name in ("exports", "photos"):
        (tmp_path / name).mkdir()
    return tmp_path


def run(spark, folders, **more):
    return commands.extract(spark, str(folders / "exports"), str(folders / "photos"), str(folders / "library"), **more)


def test_later_runs_add_to_the_library_and_skip_what_is_there(spark, folders):
    archive(folders / "exports" / "a.zip", {f"p/{i}.jpg": f"picture {i}" for i in range(6)})
    assert run(spark, folders)["metrics"].first().extracted == 6
    again = run(spark, folders)
    assert again["plan_totals"].first().already_present == 6 and again["metrics"].first().extracted == 0
    archive(folders / "exports" / "b.zip", {"p/0.jpg": "another picture of the name"})
    assert run(spark, folders)["metrics"].first().extracted == 1
    rows = lib.library_rows(spark, str(folders / "library")).collect()
    assert len(rows) == 7 and len({r.destination for r in rows}) == 7 and len({r.run_id for r in rows}) == 2
    for strategy in ("size_crc", "size_partial"):
        assert run(spark, folders, strategy=strategy)["plan_totals"].first().already_present == 7


def test_foreign_folders_are_refused(spark, folders):
    archive(folders / "exports" / "a.zip", {"p/a.jpg": "x"})
    (folders / "library").mkdir()
    (folders / "library" / "mine.txt").write_text("keep")
    with pytest.raises(ValueError, match="not a library"):
        run(spark, folders)
    assert (folders / "library" / "mine.txt").read_text() == "keep"


def test_files_that_differ_outside_the_samples(spark, folders):
    n = 5 * SAMPLE_BYTES
    one, two = bytearray(n), bytearray(n)
    two[SAMPLE_BYTES + 10] = 1
    (folders / "photos" / "old.bin").write_bytes(one)
    archive(folders / "exports" / "a.zip", {"p/new.jpg": bytes(two)})
    assert run(spark, folders)["metrics"].first().extracted == 1


def test_file_times_and_scans_share_a_clock(monkeypatch):
    import time

    before = commands._now()
    monkeypatch.setenv("TZ", "Asia/Tokyo")
    time.tzset()
    try:
        after = commands._now()
    finally:
        monkeypatch.undo()
        time.tzset()
    assert before[:13] == after[:13]


def test_a_name_wanted_more_often_than_any_limit(spark, rows):
    planned = spark.range(10_060).selectExpr("'z' AS archive", "id AS entry_ix", "'o/a.jpg' AS location")
    got = lib.resolve_destinations(planned).collect()
    assert len({r.destination for r in got}) == 10_060
    by_ix = {r.entry_ix: r.destination for r in got}
    assert by_ix[0] == "o/a.jpg" and by_ix[10_059] == "o/a_10059.jpg"


def test_unreadable_files_are_recorded(spark, tmp_path):
    from stowage.sources import directories as di

    (tmp_path / "a.txt").write_text("a")
    os.symlink(tmp_path / "nowhere", tmp_path / "b.txt")
    files = spark.createDataFrame([(str(tmp_path), "a.txt", 1), (str(tmp_path), "b.txt", 1)], "root string, file_path string, file_size bigint")
    hashed = di.hash_or_error(files, "full")
    assert [r.file_path for r in di.unreadable_files(hashed).collect()] == ["b.txt"]
    assert di.hash_files(files, "full").count() == 1
