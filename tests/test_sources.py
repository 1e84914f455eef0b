import hashlib
import json
import os
import tracemalloc
import zipfile
import zlib
from datetime import datetime, timedelta

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stowage.functions import partial_key
from stowage.plans import commands
from stowage.operators.state import CatalogState
from stowage.sources import archives as ar
from stowage.sources import directories as di
from stowage.sources import extraction as ex
from stowage.sources import fingerprints as fp
from stowage.sources import manifests as mf
from stowage.schemas import MANIFEST

BIG = bytes(i % 253 for i in range(200_000))


def write_zip(path, members):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data, stamp in members:
            z.writestr(zipfile.ZipInfo(name, date_time=stamp), data)


SIDE = json.dumps({"photoTakenTime": {"timestamp": "1000000000"}})


@pytest.fixture(scope="module")
def exports(tmp_path_factory):
    base = str(tmp_path_factory.mktemp("exports"))
    one, two = (2015, 3, 4, 5, 6, 8), (1980, 1, 1, 0, 0, 0)
    write_zip(f"{base}/a.zip", [
        ("p/", b"", one), ("p/x.jpg", b"picture", one), ("p/x.jpg.json", SIDE, one), ("p/empty.txt", b"", one),
        ("p/big.bin", BIG, one),
    ])
    write_zip(f"{base}/deep/er/b.zip", [("x(1).jpg", b"picture", two), ("p/x.jpg", b"picture", two), ("n.txt", b"new", two)])
    with open(f"{base}/broken.zip", "wb") as f:
        f.write(b"not a zip")
    with open(f"{base}/notes.txt", "w") as f:
        f.write("no archive")
    return base


@pytest.fixture(scope="module")
def library(tmp_path_factory):
    base = str(tmp_path_factory.mktemp("library"))
    for name, data in [("2015/03/big.bin", BIG), ("_DSC1.jpg", b"one"), (".hidden", b"two"), ("s p/a.txt", b"picture")]:
        os.makedirs(os.path.dirname(f"{base}/{name}"), exist_ok=True)
        with open(f"{base}/{name}", "wb") as f:
            f.write(data)
    return base


def test_archive_scan(spark, exports):
    got = ar.read_archives(spark, exports)
    members = {(os.path.basename(r.archive), r.entry_ix): r for r in got.collect()}
    assert sorted(members) == [("a.zip", 1), ("a.zip", 2), ("a.zip", 3), ("a.zip", 4), ("b.zip", 0), ("b.zip", 1), ("b.zip", 2)]
    x = members[("a.zip", 1)]
    assert (x.file_path, x.file_size, x.file_crc, x.zip_y, x.zip_s) == ("p/x.jpg", 7, zlib.crc32(b"picture"), 2015, 8)
    bad = ar.read_archive_errors(spark, exports).collect()
    assert [os.path.basename(r.archive) for r in bad] == ["broken.zip"] and bad[0].error
    assert ar.list_archives(spark, exports).count() == 3


def test_missing_folder_is_empty(spark, tmp_path):
    assert ar.read_archives(spark, str(tmp_path / "nothing")).count() == 0


def test_archive_content_and_keys(spark, exports, monkeypatch):
    entries = ar.read_archives(spark, exports)
    content = {r.file_path: bytes(r.content) for r in ar.read_entry_content(entries).collect() if "a.zip" in r.archive}
    assert content["p/big.bin"] == BIG and content["p/empty.txt"] == b""
    with_content = ar.read_archives(spark, exports, with_content=True)
    want = {(r.archive, r.entry_ix): r.k for r in with_content.select("archive", "entry_ix", partial_key().alias("k")).collect()}
    got = {(r.archive, r.entry_ix): r.content_key for r in ar.read_entry_keys(entries).collect()}
    assert got == want
    lost = entries.withColumn("archive", F.concat("archive", F.lit(".gone")))
    assert {r.content for r in ar.read_entry_content(lost).collect()} == {None}
    beyond = entries.withColumn("entry_ix", F.col("entry_ix") + 100)
    assert {r.content_key for r in ar.read_entry_keys(beyond).collect()} == {None}


def test_directory_scan(spark, library):
    listed = di.list_directory(spark, library)
    assert {r.file_path for r in listed.collect()} == {"2015/03/big.bin", "_DSC1.jpg", ".hidden", "s p/a.txt"}
    keys = {r.file_path: r.content_key for r in di.scan_directory(spark, library, "size_crc").collect()}
    assert keys["s p/a.txt"] == f"7_{zlib.crc32(b'picture'):08x}"
    gone = listed.withColumn("file_path", F.concat("file_path", F.lit("x")))
    assert di.hash_files(gone).count() == 0


def test_listing_by_levels(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(di, "PAGE_ROWS", 100)
    flat, deep = tmp_path / "flat", tmp_path
    flat.mkdir()
    for i in range(2500):
        (flat / f"f{i}").write_bytes(b"x" * (i % 3))
    want = {f"flat/f{i}": i % 3 for i in range(2500)}
    for i in range(6):
        deep = deep / f"d{i}"
        deep.mkdir()
        (deep / "a b.txt").write_text("12345")
        want[f"{deep.relative_to(tmp_path)}/a b.txt"] = 5
    (deep / "empty").mkdir()
    (deep / "up").symlink_to(tmp_path)
    (tmp_path / "link").symlink_to(deep / "a b.txt")
    (tmp_path / "lost").symlink_to(tmp_path / "nowhere")
    want["link"] = 5
    for root in (str(tmp_path), f"file://{tmp_path}/"):
        got = di.list_directory(spark, root).collect()
        assert {r.file_path: r.file_size for r in got} == want and len(got) == len(want)
        assert {r.root for r in got} == {str(tmp_path)}
    stamp = os.stat(flat / "f7").st_mtime_ns // 1000
    one = next(r for r in got if r.file_path == "flat/f7")
    assert (one.mtime - datetime(1970, 1, 1)) // timedelta(microseconds=1) == stamp


def test_manifest_round_trip(spark, tmp_path):
    data = [("k", 1, 2**32 - 1, datetime(2020, 1, 2, 3, 4, 5), "e/2020/01/a", "z", "a", 3), ("m", 1, 0, None, "", "z", "b", 0)]
    df = spark.createDataFrame(data, MANIFEST)
    path = str(tmp_path / "m")
    mf.write_manifest(df, path, "2024-01-01T00:00:00")
    assert sorted(map(tuple, mf.read_manifest(spark, path).collect())) == data
    header = mf.read_manifest_header(spark, path).first()
    assert (header.version, header.total_unique_files) == ("1.0", 2)
    document = {
        "version": "1.0", "generated": "now", "total_unique_files": 1,
        "files": [{"content_key": "k", "file_size": 1, "file_crc": 7, "date": "2020-01-02T03:04:05", "proposed_location": "l",
                   "source_zip": "z", "source_path": "a", "duplicate_count": 3}],
    }
    (tmp_path / "doc.json").write_text(json.dumps(document, indent=2))
    row = mf.read_manifest_document(spark, str(tmp_path / "doc.json")).first()
    assert (row.date, row.file_crc, row.duplicate_count) == (datetime(2020, 1, 2, 3, 4, 5), 7, 3)


def test_commands(spark, exports, library, tmp_path):
    state = CatalogState(spark, str(tmp_path / "state"))
    tables = commands.analyze(spark, exports, str(tmp_path / "manifest"), state=state)
    assert tuple(tables["summary_stats"].first())[:3] == (7, 5, 2)
    dates = {r.file_path: r.date_source for r in tables["catalog"].collect() if r.archive.endswith("/a.zip")}
    assert dates == {"p/x.jpg": "json", "p/x.jpg.json": "json", "p/empty.txt": "zip", "p/big.bin": "zip"}
    assert state.dates.count() == 7

    plan = commands.extract(spark, exports, library, str(tmp_path / "written"), state=state)
    assert tuple(plan["plan_totals"].first()) == (7, 3, 3 + len(SIDE), 2, 2)
    assert {r.date_source for r in plan["plan"].collect()} == {"cache"}
    assert tuple(plan["metrics"].first())[:3] == (3, 3 + len(SIDE), 0)
    assert state.hashes.count() == 4 and state.scans.count() == 1
    again = commands.library_index(spark, library, state)
    assert again.count() == 4

    rows = mf.read_manifest(spark, str(tmp_path / "manifest"))
    status = {r.status: r.files for r in commands.reconcile_directory(spark, rows, library, exports)["summary"].collect()}
    assert status == {"extracted": 2, "pending": 3, "source_missing": 0}

    compared = commands.compare(spark, exports, library)
    assert tuple(compared["summary"].first())[:4] == (7, 4, 4, 3 * 7 + len(BIG))
    done = commands.import_new(spark, compared["only_left"], "out", str(tmp_path / "imported")).collect()
    assert sum(r.extracted for r in done) == 3

    diff = commands.diff_archives(spark, exports, library, str(tmp_path / "diff"))
    assert tuple(diff["summary"].first())[:4] == (5, 7 + len(SIDE) + len(BIG) + 3, 2, 3)
    assert mf.read_diff_manifest(spark, str(tmp_path / "diff")).count() == 3
    assert commands.diff(spark, library, library)["summary"].first().present_pct == 100.0
    assert commands.latest(spark, exports)["latest"].first().archives == 0


def test_csv_and_report_sinks(spark, exports, tmp_path):
    tables = commands.analyze(spark, exports)
    mf.write_csv_report(tables["catalog"], str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.columns == mf.CSV_COLUMNS and back.filter("`Is Duplicate` = 'Yes'").count() == 2
    assert {r[0] for r in back.filter("`Is Duplicate` = 'Yes'").select("Duplicate Of").collect()} == {"a.zip:p/x.jpg"}
    mf.write_report({"types": tables["type_breakdown"]}, str(tmp_path / "report"))
    assert spark.read.parquet(str(tmp_path / "report" / "types")).count() == tables["type_breakdown"].count()


def test_blocks_of_members(spark, exports):
    entries = ar.read_archives(spark, exports)
    blocks = ex.read_entry_blocks(entries, block_bytes=1000).collect()
    parts = {}
    for r in sorted(blocks, key=lambda r: (r.archive, r.entry_ix, r.block)):
        parts.setdefault((r.archive, r.entry_ix), []).append(r)
    content = {(r.archive, r.entry_ix): bytes(r.content) for r in ar.read_entry_content(entries).collect()}
    assert parts.keys() == content.keys()
    for member, rows in parts.items():
        data = b"".join(bytes(r.data) for r in rows)
        assert data == content[member] and [r.block for r in rows] == list(range(len(rows)))
        assert [r.is_last for r in rows] == [False] * (len(rows) - 1) + [True]
        assert (rows[-1].sha256, rows[-1].crc, rows[-1].bytes) == (hashlib.sha256(data).hexdigest(), zlib.crc32(data), len(data))
        for k, r in enumerate(rows):
            assert r.crc == zlib.crc32(data[: 1000 * (k + 1)])


def test_a_large_member_is_streamed(tmp_path):
    # 300 MB, read and written by one task; what it holds is traced.
    path, block = str(tmp_path / "big.zip"), bytes(1 << 20)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z, z.open(zipfile.ZipInfo("big.bin"), "w", force_zip64=True) as out:
        for _ in range(300):
            out.write(block)
    pdf = pd.DataFrame({"archive": [path], "entry_ix": [0], "error": [None]})
    tracemalloc.start()
    row = next(ex._stage(str(tmp_path / "staging"), 1 << 20, iter([pdf]))).iloc[0]
    wanted = pa.RecordBatch.from_pydict({"archive": [path], "entry_ix": [0]})
    last = None
    for batch in ex._read_blocks(1 << 20, iter([wanted])):
        last = batch.to_pylist()[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert row["bytes"] == last["bytes"] == 300 << 20 and row["sha256"] == last["sha256"] and peak < 32 << 20


def test_extraction_in_two_phases(spark, exports, tmp_path):
    root = str(tmp_path / "files")
    entries = ar.read_archives(spark, exports).withColumn("destination", F.concat(F.lit("o/"), "entry_ix", F.lit("/"), F.substring_index("archive", "/", -1)))
    planned = entries.select("archive", "entry_ix", "file_path", "file_size", "destination", F.when(F.col("entry_ix") == 2, "no room").alias("error"))
    planned = planned.unionByName(planned.limit(1).withColumn("entry_ix", F.lit(99).cast("bigint")).withColumn("error", F.lit(None).cast("string")).withColumn("destination", F.lit("o/x")))
    got = {(os.path.basename(r.archive), r.entry_ix): r for r in ex.extract_files(planned, root).collect()}
    content = {(os.path.basename(r.archive), r.entry_ix): bytes(r.content) for r in ar.read_entry_content(entries).collect()}
    for member, r in got.items():
        if member[1] == 2:
            assert r.error == "no room" and r.sha256 is None
        elif member[1] == 99:
            assert r.error.startswith("unreadable member")
        else:
            assert r.error is None and r.sha256 == hashlib.sha256(content[member]).hexdigest() and r.bytes == len(content[member])
            with open(f"{root}/{r.destination}", "rb") as f:
                assert f.read() == content[member]
    assert sorted(os.listdir(root)) == ["o"]  # the staging folder is gone
    again = ex.extract_files(planned, root).collect()
    assert {r.error for r in again if r.entry_ix not in (2, 99)} == {"destination exists"}
    # A task that is run again finds its files moved, and says so without error.
    pdf = pd.DataFrame({"staged": [f"{root}/.gone"], "destination": [next(r.destination for r in got.values() if r.error is None)]})
    assert next(ex._move(root, iter([pdf])))["error"].tolist() == [None]


def test_tasks_of_about_equal_bytes(spark):
    rows = spark.range(2000).selectExpr("'z' AS archive", "id AS entry_ix", "IF(id < 100, 100000, 10) AS file_size").repartition(5)
    tasks = {}
    for r in ex.by_bytes(rows, ["archive", "entry_ix"], 8).withColumn("task", F.spark_partition_id()).collect():
        tasks[r.task] = tasks.get(r.task, 0) + r.file_size
    sizes = list(tasks.values())
    assert len(sizes) == 8 and max(sizes) <= 2 * sorted(sizes)[4]


def test_fingerprints_read_only_what_is_needed(spark, tmp_path):
    base = bytes(range(256)) * 4  # 1,024 bytes; samples of 100
    data = {
        "alone": b"x" * 77, "a": base, "a2": base, "early": b"!" + base[1:], "middle": base[:600] + b"!" + base[601:], "late": base[:-1] + b"!",
        "hidden": base[:300] + b"!" + base[301:], "s1": b"short", "s2": b"short", "s3": b"shirt", "e1": b"", "e2": b"", "m1": b"y" * 150, "m2": b"y" * 149 + b"z",
    }
    for name, content in data.items():
        (tmp_path / name).write_bytes(content)
    listed = di.list_directory(spark, str(tmp_path)).select("root", "file_path", "file_size")
    lost = listed.limit(1).withColumn("file_path", F.lit("gone")).withColumn("file_size", F.lit(1024).cast("bigint"))
    for hot_rows in (None, 2):
        got = {r.file_path: r for r in fp.fingerprint(listed.unionByName(lost), sample=100, hot_rows=hot_rows).collect()}
        assert got.pop("gone")[3:5] == (None, None) and got.keys() == data.keys()
        for x in data:
            assert got[x].copies == sum(c == data[x] for c in data.values())
            assert all((got[x].fingerprint == got[y].fingerprint) == (data[x] == data[y]) for y in data)
        read = {x: r.bytes_read for x, r in got.items()}
        # Nothing of lone sizes and empty files; the head; head and samples; and the whole only where those agree.
        assert read == {
            "alone": 0, "e1": 0, "e2": 0, "s1": 5, "s2": 5, "s3": 5, "early": 100, "middle": 400, "late": 400, "m1": 250, "m2": 250,
            "a": 1424, "a2": 1424, "hidden": 1424,
        }


def test_folders_of_others_are_not_replaced(spark, tmp_path):
    df = spark.createDataFrame([("k", 1, 1, None, "", "z", "a", 0)], MANIFEST)
    path = tmp_path / "m"
    for _ in range(2):  # an own manifest is replaced
        mf.write_manifest(df, str(path), "now")
    assert mf.read_manifest_header(spark, str(path)).first().total_unique_files == 1
    for place in (path / "files", path):
        (place / "photo.jpg").write_bytes(b"x")
        with pytest.raises(ValueError, match="photo.jpg"):
            mf.write_manifest(df, str(path), "now")
        (place / "photo.jpg").unlink()
    (tmp_path / "r" / "types").mkdir(parents=True)
    (tmp_path / "r" / "types" / "mine.txt").write_text("x")
    with pytest.raises(ValueError):
        mf.write_report({"types": df}, str(tmp_path / "r"))


def test_content_goes_on_in_small_batches(tmp_path):
    # A worker that holds 32 MB of content as values, column and Arrow needs a multiple of it.
    path = str(tmp_path / "a.zip")
    with zipfile.ZipFile(path, "w") as z:
        for i in range(24):
            z.writestr(f"{i}.bin", bytes(1 << 20))
    pdf = pd.DataFrame({"archive": path, "entry_ix": range(24)})
    batches = list(ar._per_member(lambda z, m: z.read(m), "content")(iter([pdf])))
    assert sum(map(len, batches)) == 24 and max(b["content"].map(len).sum() for b in batches) <= 6 << 20


def test_exports_hold_one_small_batch(spark, tmp_path):
    from stowage.suite import exports

    rows = spark.range(0, 40, 1, 1).selectExpr(
        "concat('z', id % 2, '.zip') AS archive", "id AS entry_ix", "concat('p/', id) AS file_path", "cast(repeat(id, 500000) AS binary) AS content",
        "2020 AS zip_y", "1 AS zip_mo", "2 AS zip_d", "3 AS zip_h", "4 AS zip_mi", "6 AS zip_s",
    )
    held = str(tmp_path / "held")

    def write(batches):
        with open(held, "a") as out:
            for batch in batches:
                out.write(f"{batch.nbytes}\n")
                yield batch.select(["file_path"])

    before = spark.conf.get(exports.BATCH_CONF)
    exports._run(rows, write, "file_path string")
    sizes = [int(line) for line in open(held)]
    assert len(sizes) > 2 and max(sizes) < 8 << 20 and spark.conf.get(exports.BATCH_CONF) == before
    exports.export_archives(rows, str(tmp_path / "zips"))
    got = {(r.archive.rsplit("/", 1)[1], r.file_path): r for r in ar.read_archives(spark, str(tmp_path / "zips"), with_content=True).collect()}
    assert len(got) == 40 and all(bytes(r.content) == name[2:].encode() * 500_000 for (_, name), r in got.items())
    assert {zipped for zipped, _ in got} == {"z0-0.zip", "z1-0.zip"} and got["z1-0.zip", "p/39"].entry_ix == 19
