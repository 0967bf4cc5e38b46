"""Every query with SQL gives what DuckDB gives on the same tables."""

import glob
import os

import duckdb
import pytest

from oppflow.plans import registry


@pytest.fixture(scope="module")
def oracle(data):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def rows(columns, values):
    plain = lambda v: round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(plain(r[i])) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows(spark, data, oracle, name):
    df = registry.QUERIES[name](spark, data)
    want = oracle.execute(registry.SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, want.fetchall())


def test_pages(spark, data):
    got = registry.QUERIES["page_texts"](spark, data).collect()
    assert got and all(r.prepared_chars > 0 for r in got)
