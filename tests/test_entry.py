"""The entry module and every SQL-checked query on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_contract(spark):
    names, sql = set(entry.queries()), set(entry.oracle_sql())
    assert sql <= names and {"p1_found", "p5_found"} <= names
    if os.path.isdir(SMALL):
        assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(SMALL):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SMALL}/{f}'")
    want = con.execute(entry.oracle_sql()[name])
    columns = sorted(d[0] for d in want.description)
    at = [[d[0] for d in want.description].index(c) for c in columns]
    flat = lambda x: f"{float(x):.6g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else "" if x is None else str(x)
    expected = sorted(tuple(flat(r[i]) for i in at) for r in want.fetchall())
    df = entry.queries()[name](spark, SMALL)
    assert sorted(df.columns) == columns
    assert sorted(tuple(flat(r[c]) for c in columns) for r in df.collect()) == expected
