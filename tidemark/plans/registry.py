"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.domain import Tables, with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def steady(df: DataFrame) -> DataFrame:
    """Doubles to six places, so that sums in another order compare equal; widths of integers unified."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.floor(c * 1e6 + 0.5).cast("double") / 1e6
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None, doubles: str = ""):
    """Registers ``f(tables) -> DataFrame`` under ``name``. ``doubles``: columns of the SQL that are doubles."""

    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: steady(f(Tables(spark, sf_dir)))
        if sql:
            text = with_tables(sql)
            if doubles:
                text = f"select * replace ({', '.join(f'floor({c} * 1e6 + 0.5) / 1e6 as {c}' for c in doubles.split())}) from ({text}) r"
            ORACLES[name] = text
        return f

    return register
