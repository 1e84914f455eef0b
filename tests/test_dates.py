from datetime import datetime

import pytest

from stowage.operators.dates import cache_rows, date_cache_hits, date_cache_misses, date_source_counts, resolve_dates

ENTRIES = (
    "archive string, archive_mtime timestamp_ntz, entry_ix bigint, file_path string, file_size bigint, "
    "file_crc bigint, zip_y int, zip_mo int, zip_d int, zip_h int, zip_mi int, zip_s int"
)
MTIME = datetime(2024, 9, 9)
LONG = "a" * 45


def entry(ix, path, size=5, year=2010, archive="z", crc=1, month=1):
    return (archive, MTIME, ix, path, size, crc, year, month, 1, 0, 0, 0)


def side(path, seconds, archive="z"):
    return (archive, path, '{"photoTakenTime": {"timestamp": "%s"}}' % seconds)


def at(seconds):
    return datetime(1970, 1, 1, 0, 0, seconds)


def resolve(rows, entries, sidecars=(), exif=(), cache=None, **kw):
    df = resolve_dates(
        rows(entries, ENTRIES),
        rows(list(sidecars), "archive string, json_path string, json_text string"),
        rows(list(exif), "archive string, file_path string, dto string, dt string"),
        None if cache is None else rows(cache, CACHE),
        **kw,
    )
    return {r.entry_ix: (r.file_date, r.date_source) for r in df.collect()}


CACHE = (
    "archive string, file_path string, file_size bigint, file_crc bigint, extracted_date timestamp_ntz, "
    "created_at timestamp_ntz"
)


@pytest.mark.parametrize("hot_rows", [None, 1])
def test_sidecar_candidates(rows, hot_rows):
    entries = [
        entry(0, "d/x.jpg"), entry(1, "d/y.jpg"), entry(2, "d/w.jpg"), entry(3, "top.jpg"),
        entry(4, f"d/{LONG}.jpg"), entry(5, "d/x.jpg", archive="other"), entry(6, "d/self.json"),
        entry(7, "d/case.jpg"), entry(8, f"d/{'a' * 36}.jpg"),
    ]
    sidecars = [
        side("d/x.jpg.json", 1), side("d/x.json", 2), side("d/y.jpg.json", "broken"), side("d/y.json", 3),
        side("top.json", 4), side(f"e/{'a' * 43}.json", 6), side(f"b/{'a' * 41}.json", 5), side(f"a/{'a' * 42}.json", "bad"),
        side("d/self.json", 7), side("d/case.jpg.JSON", 8), side("else/w.jpg.json", 9),
    ]
    got = resolve(rows, entries, sidecars, hot_rows=hot_rows)
    zip_date = (datetime(2010, 1, 1), "zip")
    assert got == {
        0: (at(1), "json"), 1: (at(3), "json"), 2: zip_date, 3: (at(4), "json"), 4: (at(5), "json"), 5: zip_date,
        6: (at(7), "json"), 7: zip_date, 8: zip_date,
    }


def test_priority_and_fallbacks(rows):
    entries = [
        entry(0, "a.jpg"), entry(1, "b.jpg"), entry(2, "c.jpg", year=1980), entry(3, "d.jpg", month=0),
        entry(4, "e.mp4"), entry(5, "f.jpg", size=0),
    ]
    exif = [
        ("z", "a.jpg", "2001:01:01 00:00:00", None), ("z", "b.jpg", "nonsense", "2002:02:02 00:00:00"),
        ("z", "e.mp4", "2003:01:01 00:00:00", None), ("z", "f.jpg", "2003:01:01 00:00:00", None),
    ]
    got = resolve(rows, entries, [side("a.jpg.json", 9)], exif)
    assert got == {
        0: (at(9), "json"), 1: (datetime(2010, 1, 1), "zip"), 2: (MTIME, "fallback"), 3: (MTIME, "fallback"),
        4: (datetime(2010, 1, 1), "zip"), 5: (datetime(2010, 1, 1), "zip"),
    }
    single = resolve(rows, entries, [side("a.jpg.json", 9)], exif, use_sidecar=False)
    assert single[0] == (datetime(2001, 1, 1), "exif")


def test_cache_needs_path_size_and_crc(rows):
    entries = [entry(0, "a.jpg"), entry(1, "b.jpg"), entry(2, "c.jpg"), entry(3, "d.jpg")]
    old, made = datetime(1999, 1, 1), datetime(2024, 1, 1)
    cache = [
        ("z", "a.jpg", 5, 1, old, made), ("z", "b.jpg", 6, 1, old, made), ("z", "c.jpg", 5, 2, old, made),
        ("z", "d.jpg", 5, 1, None, made),
    ]
    got = resolve(rows, entries, cache=cache)
    assert got[0] == (old, "cache") and {got[i][1] for i in (1, 2, 3)} == {"zip"}
    table, known = rows(entries, ENTRIES), rows(cache, CACHE)
    assert date_cache_hits(table, known).count() == 1 and date_cache_misses(table, known).count() == 3


def test_cached_dates_equal_recomputed_ones(rows):
    entries = [entry(i, f"f{i}.jpg", year=2000 + i) for i in range(6)]
    sidecars = [side("f1.jpg.json", 50)]
    plain = resolve(rows, entries, sidecars)
    first = resolve_dates(
        rows(entries, ENTRIES), rows(sidecars, "archive string, json_path string, json_text string")
    )
    cached = resolve_dates(rows(entries, ENTRIES), cache=cache_rows(first, "2024-01-01 00:00:00"))
    assert {r.entry_ix: r.file_date for r in cached.collect()} == {k: d for k, (d, _) in plain.items()}
    assert {r.date_source for r in cached.collect()} == {"cache"}


def test_source_counts(rows):
    df = resolve_dates(
        rows([entry(0, "a.jpg"), entry(1, "b.json", year=1980), entry(2, "c.jpg", archive="y")], ENTRIES),
        rows([side("a.jpg.json", 9)], "archive string, json_path string, json_text string"),
    )
    got = {r.archive: r.asDict() for r in date_source_counts(df).collect()}
    assert (got["z"]["json_count"], got["z"]["fallback_count"], got["z"]["json_members"]) == (1, 1, 1)
    assert (got["y"]["zip_count"], got["y"]["json_members"]) == (1, 0)
