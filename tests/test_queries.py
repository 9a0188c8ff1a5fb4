"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from corpusloom.plans.catalog import ORACLE_SQL, QUERIES

DATA = Path("/root/testdata/sf0.001")


def cell(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v):.6f}"
    return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f if f.is_file() else f'{f}/*.parquet'}'")
    return con


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, str(DATA))
    data = [tuple(r) for r in got.collect()]
    if name in ORACLE_SQL:
        want = duck.sql(ORACLE_SQL[name])
        assert rows(got.columns, data) == rows(want.columns, want.fetchall())
