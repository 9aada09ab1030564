"""Queries of the training-data operators against their SQL."""

from pathlib import Path

import duckdb
import pytest

from tidemark.llm import registry

SF = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not SF.exists(), reason="needs the given tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    want = con.execute(registry.ORACLES[name])
    columns = [d[0] for d in want.description]
    df = registry.QUERIES[name](spark, str(SF))
    assert sorted(df.columns) == sorted(columns)
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    assert sorted(map(tuple, df.select(*columns).collect()), key=key) == sorted(want.fetchall(), key=key)
