import re

import duckdb
import pytest

import __spark_entry__ as entry
from stowage.llm.queries import ORACLES, REGISTRY
from tools.check_queries import TABLES, canonical

SF = "/root/testdata/sf0.001"


def test_one_query_per_operator():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in REGISTRY) == list(range(1, 14))
    assert set(REGISTRY) | {"pipeline"} <= set(entry.queries())
    assert set(ORACLES) <= set(REGISTRY) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF).toPandas()
    want = con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)
