import os
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from stowage.operators import state as st
from stowage.operators.dedup import dedup, originals
from stowage.operators.logtable import ConcurrentUpdate, LogTable, create_if_absent
from stowage.schemas import HASH_CACHE
from stowage.streaming.ingest import ingest_batch, ingest_stream, read_ingested
from stowage.streaming.two_stage import read_two_stage, two_stage_batch

import pytest

T0 = datetime(2024, 1, 1)
LISTING = "root string, file_path string, file_size bigint, mtime timestamp_ntz"
CACHE = LISTING + ", content_key string, created_at timestamp_ntz"


def test_upsert_last_write_wins(rows):
    schema = "archive string, file_path string, v int, created_at timestamp_ntz"
    old = rows([("z", "a", 1, datetime(2030, 1, 1)), ("z", "b", 1, T0)], schema)
    new = rows([("z", "a", 2, T0), ("z", "a", 3, T0 + timedelta(1)), ("z", "c", 4, T0)], schema)
    got = {r.file_path: r.v for r in st.upsert(old, new, st.DATE_KEYS).collect()}
    assert got == {"a": 3, "b": 1, "c": 4}


def test_snapshots(spark, rows, tmp_path):
    state = st.CatalogState(spark, str(tmp_path / "s"))
    assert state.hashes.count() == 0
    state.hashes.upsert(rows([("r", "a", 1, T0, "k", T0), ("r", "b", 1, T0, "k", T0), ("q", "a", 1, T0, "k", T0)], CACHE))
    before = state.hashes.read()
    state.hashes.upsert(rows([("r", "a", 2, T0, "m", T0)], CACHE))
    assert before.filter("file_path = 'a' and root = 'r'").first().content_key == "k"
    assert state.hashes.read().filter("file_path = 'a' and root = 'r'").first().content_key == "m"
    state.hashes.delete(rows([("r", "b")], "root string, file_path string"))
    assert state.hashes.count() == 2
    state.scans.upsert(rows([("r", T0, 2), ("q", T0, 1)], "root string, last_scanned timestamp_ntz, file_count bigint"))
    state.clear_directory("q")
    assert (state.hashes.count(), state.scans.count()) == (1, 1)
    state.clear()
    assert (state.dates.count(), state.hashes.count(), state.scans.count()) == (0, 0, 0)


def test_two_writers_and_compaction(spark, rows, tmp_path, monkeypatch):
    def row(name, key):
        return rows([("r", name, 1, T0, key, T0)], CACHE)

    table = LogTable(spark, str(tmp_path / "t"), HASH_CACHE, st.HASH_KEYS)
    table.upsert(row("a", "k"))
    base, before = table.version(), table.read()
    table.upsert(row("b", "first"), base)
    for late in (lambda: table.upsert(row("b", "second"), base), lambda: table.replace(row("c", "x"), base), lambda: table.delete(row("a", ""), base)):
        with pytest.raises(ConcurrentUpdate):
            late()
    assert {r.file_path: r.content_key for r in table.read().collect()} == {"a": "k", "b": "first"}
    assert [r.file_path for r in before.collect()] == ["a"] and table.version() == 2
    assert {r.file_path for r in table.read(1).collect()} == {"a"}
    assert {r.file_path for r in table.read(like=row("b", "")).filter("file_path = 'b'").collect()} == {"b"}
    monkeypatch.setattr("stowage.operators.logtable.MOST_DELTAS", 2)
    table.delete(row("b", ""))
    assert table._live()[0][1] == "full" and [r.file_path for r in table.read().collect()] == ["a"]
    assert not create_if_absent(spark, str(tmp_path / "t" / "commits" / "000000000001.json"), "x")
    assert sorted(os.listdir(tmp_path / "t" / "commits"))[-1].endswith("4.json")


def test_directory_freshness(rows):
    listing = rows([("a", "x", 1, T0), ("a", "y", 1, T0), ("b", "x", 1, T0), ("c", "x", 1, T0), ("d", "x", 1, T0)], LISTING)
    later = T0 + timedelta(1)
    log = rows([("a", later, 2), ("b", later, 2), ("c", T0, 1)], "root string, last_scanned timestamp_ntz, file_count bigint")
    got = {r.root: r.is_fresh for r in st.fresh_directories(listing, log).collect()}
    assert got == {"a": True, "b": False, "c": False, "d": False}


def test_file_freshness(rows):
    def moved(seconds):
        return T0 + timedelta(seconds=seconds)

    listing = rows(
        [("r", "same", 1, T0), ("r", "half", 1, moved(0.5)), ("r", "late", 1, moved(1.5)), ("r", "early", 1, moved(-1)),
         ("r", "size", 2, T0), ("r", "new", 1, T0)], LISTING)
    cache = rows(
        [("r", n, 1, T0, "old", T0) for n in ("same", "half", "late", "early", "size", "deleted")], CACHE)
    got = st.refresh_hashes(listing, cache, lambda df: df.withColumn("content_key", F.lit("hashed")))
    assert {r.file_path: (r.content_key, r.reused) for r in got.collect()} == {
        "same": ("old", True), "half": ("old", True), "late": ("hashed", False), "early": ("hashed", False),
        "size": ("hashed", False), "new": ("hashed", False),
    }
    assert st.keys_by_size(got).count() == 3


ENTRIES = "archive string, entry_ix bigint, file_path string, file_size bigint, file_crc bigint"


def test_stream_takes_in_what_a_batch_would(spark, rows, tmp_path):
    data = [(f"z{i % 4}", i, f"f{i % 9}.jpg", i % 5, i % 3) for i in range(60)]
    entries = rows(data, ENTRIES)
    landing, path = str(tmp_path / "landing"), str(tmp_path / "catalog")
    entries.repartition(4, "archive").write.parquet(landing)
    for _ in range(2):  # a second run finds nothing new
        ingest_stream(spark, landing, path, str(tmp_path / "progress"), entries.schema).awaitTermination()
    got = read_ingested(spark, path, entries.schema)
    want = originals(dedup(entries, "content_only"))
    keys = sorted(r.content_key for r in got.collect())
    assert keys == sorted(r.content_key for r in want.collect()) and len(set(keys)) == len(keys)


def test_batches_can_be_run_again(spark, rows, tmp_path):
    path = str(tmp_path / "catalog")
    first = rows([("a", 0, "x", 1, 1), ("a", 1, "y", 1, 1)], ENTRIES)
    second = rows([("b", 0, "x", 1, 1), ("b", 1, "z", 1, 2)], ENTRIES)
    for batch, n in [(first, 0), (second, 1), (second, 1), (first, 0), (second, 1)]:
        ingest_batch(batch, n, path, ["archive", "entry_ix"])
    got = {(r.archive, r.entry_ix, r.batch_id) for r in read_ingested(spark, path, first.schema).collect()}
    assert got == {("a", 0, 0), ("b", 1, 1)}


def verdicts(df):
    return sorted((r.archive, r.entry_ix, r.is_duplicate, r.group_size, r.original_archive, r.original_path) for r in df.collect())


def test_two_stage_batches_in_any_order(spark, rows, tmp_path):
    rng = random.Random(1)
    data = [(f"z{rng.randrange(5)}", i, f"{rng.choice('ab')}/f{rng.randrange(12)}.jpg", rng.randrange(2), rng.randrange(3)) for i in range(40)]
    data += [("z9", 100, None, 7, None), ("y0", 101, "b/f0.jpg", 0, 0)]
    batches = [[] for _ in range(4)]
    for row in data:
        rng.choice(batches).append(row)
    path = str(tmp_path / "two")
    for n, batch in enumerate(batches):
        for _ in range(1 + (n % 2)):  # every other batch is run twice
            two_stage_batch(rows(batch, ENTRIES), n, path)
        seen = [row for b in batches[: n + 1] for row in b]
        if n in (1, 3):
            assert verdicts(read_two_stage(spark, path, rows(data, ENTRIES).schema)) == verdicts(dedup(rows(seen, ENTRIES)))
    # Each change names the original it replaces: played back, they give the last originals.
    current = {}
    for r in sorted(spark.read.parquet(f"{path}/changes").collect(), key=lambda r: r.batch_id):
        assert current.get(r.content_key) == (r.old and tuple(r.old.place))
        current[r.content_key] = tuple(r.new.place)
    assert current


def test_a_batch_reads_only_its_buckets(spark, rows, tmp_path):
    table = LogTable(spark, str(tmp_path / "t"), HASH_CACHE, st.HASH_KEYS)
    table.upsert(rows([("r", f"f{i}", 1, T0, "k", T0) for i in range(500)], CACHE))
    plan = table.read(like=rows([("r", "f1", 1, T0, "k", T0)], CACHE))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(_bucket" in plan or "PartitionFilters: [(_bucket" in plan
    files = table.read(like=rows([("r", "f1", 1, T0, "k", T0)], CACHE)).inputFiles()
    assert len(table.read().inputFiles()) > 50 and all("_bucket=" in f for f in files)


def test_stream_refuses_unknown_modes(spark, tmp_path):
    with pytest.raises(ValueError):
        ingest_stream(spark, str(tmp_path), str(tmp_path), str(tmp_path), spark.range(1).schema, mode="three_stage")
