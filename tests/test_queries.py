import os

import duckdb
import pytest

import __spark_entry__ as contract
from tools.check import rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for table in os.listdir(SF):
        con.sql(f"CREATE VIEW {table.split('.')[0]} AS SELECT * FROM '{SF}/{table}'")
    return con


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["motif_name", "chain_key", "matched_edges", "completed_at", "confidence"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query_equals_sql(spark, con, name):
    df = contract.queries()[name](spark, SF)
    got = df.collect()
    if name not in contract.oracle_sql():
        return
    want = con.sql(contract.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, got) == rows(want.columns, want.fetchall())
