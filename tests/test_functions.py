import hashlib
import zlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from stowage import functions as fx
from stowage.functions.dates import EXPORT_PREFIX


def column(df, expr):
    return [r[0] for r in df.select(expr).collect()]


@pytest.mark.parametrize(
    "path,name,parent,stem,suffix,norm",
    [
        ("d/IMG_1234(1).jpg", "IMG_1234(1).jpg", "d", "IMG_1234(1)", ".jpg", "img_1234.jpg"),
        ("photo(2).PNG", "photo(2).PNG", ".", "photo(2)", ".png", "photo.png"),
        ("video(1)(2).mp4", "video(1)(2).mp4", ".", "video(1)(2)", ".mp4", "video(1).mp4"),
        ("a(1).b(2)", "a(1).b(2)", ".", "a(1)", ".b(2)", "a.b"),
        ("x/notes(3)", "notes(3)", "x", "notes(3)", "", "notes"),
        (".bashrc", ".bashrc", ".", ".bashrc", "", ".bashrc"),
        ("trail.", "trail.", ".", "trail.", "", "trail."),
        ("q/r/UP.JPEG", "UP.JPEG", "q/r", "UP", ".jpeg", "up.jpeg"),
        ("/abs.txt", "abs.txt", "/", "abs", ".txt", "abs.txt"),
        ("a(1)b.txt", "a(1)b.txt", ".", "a(1)b", ".txt", "a(1)b.txt"),
    ],
)
def test_path_parts(rows, path, name, parent, stem, suffix, norm):
    df = rows([(path,)], "p string").select(
        fx.file_name("p"), fx.parent_dir("p"), fx.file_stem("p"), fx.file_suffix("p"), fx.normalized_name("p")
    )
    assert tuple(df.first()) == (name, parent, stem, suffix, norm)


def test_file_type_and_folder(rows):
    df = rows([("a.JPG",), ("b/c.mkv",), ("x.tif",), ("x.m4a",), ("x.odt",), ("x.htm",), ("none",)], "p string")
    assert column(df, fx.file_type("p")) == ["image", "video", "other", "audio", "document", "data", "other"]
    assert column(df, fx.folder_label("p"))[:2] == ["(root)", "b"]


def test_locations(rows):
    df = rows([("a/b.jpg", datetime(2020, 3, 4)), ("c.jpg", None)], "p string, d timestamp_ntz")
    location = fx.propose_location("p", "d")
    assert column(df, location) == ["extracted/2020/03/b.jpg", None]
    assert column(df, fx.reroot(location, "out/lib/")) == ["out/lib/2020/03/b.jpg", None]
    assert column(df, fx.display_path(F.lit("x/y.zip"), "p"))[0] == "y.zip:a/b.jpg"


SIZES = [0, 10, 65536, 65537, 131072, 131073, 300001]


def expected_partial(data, sample=65536):
    parts = [data[:sample]]
    if len(data) > 2 * sample:
        parts.append(data[len(data) // 2 :][:sample])
    if len(data) > sample:
        parts.append(data[-sample:])
    return f"{len(data)}_{hashlib.sha256(b''.join(parts)).hexdigest()[:16]}"


def test_content_keys_match_hashlib(rows):
    blobs = [bytes((i * 7 + n) % 251 for i in range(n)) for n in SIZES]
    df = rows([(i, bytearray(b)) for i, b in enumerate(blobs)], "i int, content binary")
    for r in df.select("i", fx.partial_key().alias("p"), fx.crc_key().alias("c"), fx.full_key().alias("f")).collect():
        data = blobs[r.i]
        assert r.p == expected_partial(data)
        assert r.c == f"{len(data)}_{zlib.crc32(data):08x}"
        assert r.f == f"{len(data)}_{hashlib.sha256(data).hexdigest()}"


def test_stream_key_equals_column_keys():
    import io

    from stowage.sources.content import stream_key

    for n in SIZES:
        data = bytes((i * 7 + n) % 251 for i in range(n))
        assert stream_key(io.BytesIO(data), n, "size_partial") == expected_partial(data)
        assert stream_key(io.BytesIO(data), n, "size_crc") == f"{n}_{zlib.crc32(data):08x}"
        assert stream_key(io.BytesIO(data), n, "full") == f"{n}_{hashlib.sha256(data).hexdigest()}"


def test_metadata_key_pads_and_never_cuts(rows):
    df = rows([(5, 0), (5, 255), (5, 2**32 - 1), (5, 2**36)], "file_size bigint, file_crc bigint")
    assert column(df, fx.metadata_key()) == ["5_00000000", "5_000000ff", "5_ffffffff", "5_1000000000"]


def test_unknown_strategy_is_refused(rows):
    with pytest.raises(ValueError):
        fx.content_key(rows([(b"x",)], "content binary"), "md5")


@pytest.mark.parametrize(
    "size,plan,report",
    [
        (0, "0.0 B", "0.0 B"),
        (1023, "1023.0 B", "1023.0 B"),
        (1024, "1.0 KB", "1.0 KB"),
        (1280, "1.2 KB", "1.2 KB"),
        (1792, "1.8 KB", "1.8 KB"),
        (5 * 1024**4, "5.0 TB", "5.0 TB"),
        (3 * 1024**5, "3.0 PB", "3072.0 TB"),
    ],
)
def test_human_size(rows, size, plan, report):
    df = rows([(size,)], "s bigint").select(fx.human_size("s"), fx.human_size("s", "TB"))
    assert tuple(df.first()) == (plan, report)


def test_short_text(rows):
    df = rows([("123456789012",), ("1234567890123",)], "k string")
    assert column(df, fx.short_hash("k")) == ["123456789012", "123456789012..."]
    assert column(df, fx.archive_label(F.repeat("k", F.lit(4))))[0] == "123456789012" * 2 + "123456"


def test_zip_date(rows):
    data = [
        (2022, 5, 6, 7, 8, 58), (1980, 1, 1, 0, 0, 0), (2021, 0, 1, 1, 1, 1), (2020, 2, 30, 0, 0, 0),
        (2022, 5, 6, 7, 8, 60), (2022, 5, 6, 24, 8, 1), (None, None, None, None, None, None),
    ]
    df = rows(data, "zip_y int, zip_mo int, zip_d int, zip_h int, zip_mi int, zip_s int")
    assert column(df, fx.zip_date()) == [datetime(2022, 5, 6, 7, 8, 58)] + [None] * 6


def test_exif_date(rows):
    data = [
        ("a.JPG", 4, "2020:01:02 03:04:05", None),
        ("a.jpg", 4, "bad", "2020:01:02 03:04:05"),
        ("a.tif", 4, None, "2020:1:2 3:4:5"),
        ("a.jpg", 0, "2020:01:02 03:04:05", None),
        ("a.png", 4, "2020:01:02 03:04:05", None),
        ("a.jpg", 4, "2020:02:31 00:00:00", None),
        ("a.jpg", 4, None, None),
    ]
    df = rows(data, "p string, s bigint, dto string, dt string")
    want = datetime(2020, 1, 2, 3, 4, 5)
    assert column(df, fx.exif_date("p", "s")) == [want, None, want, None, None, None, None]


def test_sidecar_date(rows):
    texts = [
        '{"photoTakenTime": {"timestamp": "1700000000"}}',
        '{"photoTakenTime": {"timestamp": 1700000000}}',
        '{"photoTakenTime": {"timestamp": "soon"}}',
        '{"photoTakenTime": {"timestamp": "99999999999999999"}}',
        '{"photoTakenTime": {"timestamp": "1"',
        '{"creationTime": {"timestamp": "1"}}',
        "[]",
        "",
    ]
    got = column(rows([(t,) for t in texts], "t string"), fx.sidecar_date("t"))
    assert got == [datetime(2023, 11, 14, 22, 13, 20)] * 2 + [None] * 6


def test_export_time(rows):
    p = EXPORT_PREFIX
    names = [
        f"a/{p}-20240115T120000Z-001.zip", f"{p}-20241315T120000Z-001.zip", "other.zip", f"my-{p}-20240116T000001Z.zip",
    ]
    got = column(rows([(n,) for n in names], "a string"), fx.export_time("a"))
    assert got == [datetime(2024, 1, 15, 12), None, None, datetime(2024, 1, 16, 0, 0, 1)]
