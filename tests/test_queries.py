"""Every query with SQL against DuckDB on the smallest tables."""

import datetime
from pathlib import Path

import duckdb
import pytest

from tidemark.plans import all_queries

SF = Path("/root/testdata/sf0.001")
QUERIES, SQL = all_queries()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def canon(columns, rows):
    """Rows in order of their exact values, then of their numbers."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(v):
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return float(v)
        return v.isoformat() if isinstance(v, datetime.datetime) else str(v)

    key = lambda r: ([x for x in r if isinstance(x, str)], [x for x in r if isinstance(x, float)])
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=key)


@pytest.mark.skipif(not SF.exists(), reason="needs the given tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, str(SF))
    want = duck.execute(SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    got, want = canon(df.columns, df.collect()), canon(columns, want.fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(x == y if isinstance(x, str) else isinstance(y, float) and abs(x - y) < 3e-6 for x, y in zip(a, b, strict=True)), (a, b)
