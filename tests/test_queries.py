import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_queries import TABLES, canonical

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "content_key_partial", "normalize_name", "size_text", "dedup_entries", "dedup_documents", "resolve_dates_cached",
    "analyze_catalog", "archive_stats", "identical_archives", "compare_summary", "reconcile_summary", "archive_plan",
    "resolve_destination", "resolve_destination_families", "incremental_ingest", "archive_scan",
]


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    own = {q for q in entry.queries() if not (q == "pipeline" or q.startswith("op"))}
    assert own <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, con, name):
    got = entry.queries()[name](spark, SF).toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
