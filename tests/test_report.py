from datetime import datetime

import pytest

from stowage.functions.dates import EXPORT_PREFIX
from stowage.operators import exports as ex
from stowage.operators import report as rp
from stowage.operators.dedup import dedup
from stowage.plans.analyze import analyze

ENTRIES = (
    "archive string, archive_mtime timestamp_ntz, entry_ix bigint, file_path string, file_size bigint, "
    "file_crc bigint, zip_y int, zip_mo int, zip_d int, zip_h int, zip_mi int, zip_s int"
)


def entry(archive, day, ix, path, size, crc, year=2010, month=1):
    return (archive, datetime(2024, 1, day), ix, path, size, crc, year, month, 1, 0, 0, 0)


@pytest.fixture
def catalog(rows):
    entries = [
        entry("a.zip", 2, 0, "p/x.jpg", 10, 1), entry("a.zip", 2, 1, "p/y.mp4", 30, 2, 2011),
        entry("b.zip", 3, 0, "q/x.jpg", 10, 1), entry("b.zip", 3, 1, "q/y.mp4", 30, 2, 2011, 2),
        entry("c.zip", 1, 0, "x(1).jpg", 10, 1), entry("c.zip", 1, 1, "new.pdf", 5, 7, 2012),
        entry("c.zip", 1, 2, "x.jpg", 10, 1), entry("c.zip", 1, 3, "z/y.mp4", 30, 2),
    ]
    return analyze(rows(entries, ENTRIES))


def test_summary_and_archives(catalog):
    assert tuple(rp.summary_stats(catalog).first()) == (8, 3, 5, 135, 90, 3)
    stats = rp.archive_stats(catalog)
    b = stats.filter("archive = 'b.zip'").first()
    assert (b.files, b.bytes, b.duplicate_files, b.duplicate_bytes, b.unique_files) == (2, 40, 2, 40, 0)
    assert (b.n_image, b.n_video, b.n_other, b.duplicate_pct, b.is_all_duplicate) == (1, 1, 0, 100.0, True)
    classes = [(r.archive, r.dup_class, r.dup_label) for r in rp.archive_dup_class(stats).collect()]
    assert classes == [("b.zip", "danger", "REDUNDANT"), ("a.zip", "success", ""), ("c.zip", "warning", "")]
    assert [r.archive for r in rp.redundant_archives(stats).collect()] == ["b.zip"]
    assert tuple(rp.redundant_total(stats).first()) == (1, 40)
    assert [r.archive for r in rp.archives_by_date(stats).collect()] == ["b.zip", "a.zip", "c.zip"]
    assert [r.archive for r in rp.recent_archives(stats, 2).collect()] == ["b.zip", "a.zip"]


def test_identical_archives_compare_key_sets(catalog):
    got = {r.archive: r for r in rp.identical_archives(catalog).collect()}
    assert set(got) == {"a.zip", "b.zip"}
    assert got["a.zip"].is_kept and not got["b.zip"].is_kept
    assert {r.kept_archive for r in got.values()} == {"a.zip"} and got["b.zip"].wasted_bytes == 40
    assert tuple(rp.identical_totals(rp.identical_archives(catalog)).first()) == (1, 40)


def test_multiplicity_does_not_matter_for_identity(rows):
    df = rows(
        [("a", datetime(2024, 1, 1), "k", 1), ("b", datetime(2024, 1, 1), "k", 1), ("b", datetime(2024, 1, 1), "k", 1)],
        "archive string, archive_mtime timestamp_ntz, content_key string, file_size bigint",
    )
    assert rp.identical_archives(df).count() == 2


def test_original_locations(catalog):
    got = rp.original_locations(catalog).collect()
    assert [(r.archive, r.original_archive, r.files, r.first_names, r.more_names) for r in got] == [
        ("b.zip", "a.zip", 2, "x.jpg|y.mp4", 0)
    ]
    assert rp.original_locations(catalog, names=1).first().more_names == 1


def test_names_are_limited_before_the_shuffle(catalog):
    plan = rp.original_locations(catalog)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_breakdowns(catalog):
    types = {r.file_type: (r.files, r.bytes) for r in rp.type_breakdown(catalog).collect()}
    assert types == {"image": (4, 40), "video": (3, 90), "document": (1, 5)}
    dups = {r.file_type: (r.files, r.bytes) for r in rp.dup_by_type(catalog).collect()}
    assert dups == {"image": (3, 30), "video": (2, 60)}
    years = [(r.year, r.files, r.unique_files, r.duplicate_files) for r in rp.year_timeline(catalog).collect()]
    assert years == [(2010, 5, 1, 4), (2011, 2, 1, 1), (2012, 1, 1, 0)]
    months = [tuple(r) for r in rp.month_timeline(catalog, 2).collect()]
    assert months == [("2011-02", 1), ("2012-01", 1)]


def test_largest_files_break_ties_by_order(catalog):
    got = [(r.archive, r.name, r.size_text) for r in rp.largest_files(catalog, shown=4).collect()]
    assert got == [
        ("a.zip", "y.mp4", "30.0 B"), ("b.zip", "y.mp4", "30.0 B"), ("c.zip", "y.mp4", "30.0 B"), ("a.zip", "x.jpg", "10.0 B"),
    ]
    plan = rp.largest_files(catalog)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_rows_and_browsing(catalog):
    rows = rp.report_rows(catalog)
    dup = rows.filter("archive = 'b.zip' and name = 'x.jpg'").first()
    assert dup.duplicate_of == "a.zip:p/x.jpg" and dup.proposed_location == "extracted/2010/01/x.jpg"
    assert dup.download_date == "2024-01-03" and dup.year == 2010
    page = rp.browse(rows, search="X", sort="name", ascending=True)
    assert [r.name for r in page.collect()] == ["x(1).jpg", "x.jpg", "x.jpg", "x.jpg"]
    assert rp.browse(rows, file_type="video", status="unique").count() == 1
    assert tuple(rp.browse_count(rows, status="duplicate").first()) == (5, 1)
    assert rp.browse(rows, page=1).count() == 0
    for sort in ("file_size", "proposed_location"):
        for ascending in (True, False):
            order = rp.browse(rows, sort=sort, ascending=ascending).collect()
            for k, last in enumerate(order):
                rest = rp.browse(rows, sort=sort, ascending=ascending, after=last.asDict()).collect()
                assert rest == order[k + 1 :]
    with pytest.raises(ValueError):
        rp.browse(rows, page_size=7)
    with pytest.raises(ValueError):
        rp.browse(rows, status="maybe")


def test_report_holds_every_table(catalog):
    tables = rp.build_report(catalog)
    assert len(tables) == 16 and all(df.columns for df in tables.values())


def test_empty_catalog(rows):
    found = dedup(rows([], ENTRIES))
    assert tuple(rp.summary_stats(found).first()) == (0, 0, 0, 0, 0, 0)


def test_exports(rows):
    p = EXPORT_PREFIX
    names = [f"{p}-20240115T120000Z-001.zip", f"{p}-20240115T120000Z-002.zip", f"{p}-20240301T000000Z-001.zip",
             f"{p}-20249901T000000Z-001.zip", "holiday.zip"]
    dated = ex.dated_exports(rows([(n,) for n in names], "archive string"))
    r = ex.latest_export(dated).first()
    assert (r.archives, r.export_dates, str(r.next_start)) == (3, 2, "2024-03-01")
    assert (r.oldest_archive, r.newest_archive) == (names[0], names[2])
    assert [(str(x.export_date), x.archives) for x in ex.exports_by_date(dated).collect()] == [
        ("2024-01-15", 2), ("2024-03-01", 1),
    ]
