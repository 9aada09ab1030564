"""Exact quantiles of groups of any size, by distributed selection.

No group's values ever meet in one task. Each round counts the values of every wanted rank's range by cell, takes the
one cell that holds the rank, and narrows the range to that cell's own least and largest value. The first cells follow
sign and order of magnitude, the later ones are equal parts, so a dozen digits are told apart every three or four rounds.
Once ranges hold few values, those alone are sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.stores import written

#: Cells of a range, and how many values of a range are sorted.
CELLS, FEW = 4096, 20_000


def _magnitude(v: str):
    """A cell for any double, that grows with it: twos of magnitude above and below zero."""
    size = F.floor(F.least(F.log2(F.greatest(F.abs(v), F.lit(5e-324))), F.lit(1090.0))).cast("int") + 1100
    return F.when(F.col(v) > 0, size).when(F.col(v) < 0, -size).otherwise(0)


def _part():
    width = F.col("_hi") / 2 - F.col("_lo") / 2  # half the range, which cannot overflow
    equal = F.least(F.lit(CELLS - 1), F.floor(F.try_divide(F.col("_v") / 2 - F.col("_lo") / 2, width) * CELLS).cast("int"))
    return F.when(width > 0, equal).otherwise((F.col("_v") > F.col("_lo")).cast("int"))


def ranked_values(df: DataFrame, by: Sequence[str], column: str, ranks: DataFrame, few: int = FEW) -> DataFrame:
    """(by, _rank, _value) of (by, _rank): the value at that place (from 0) of the group's values in order; nulls and NaN have none."""
    by = list(by)
    rows = df.select(*by, F.col(column).cast("double").alias("_v")).filter("_v is not null and not isnan(_v)")
    key = [*by, "_rank"]
    whole = rows.groupBy(*by).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_n"))
    left = written(_joined(whole, ranks.select(*key), by).withColumn("_below", F.lit(0).cast("long")), "ranges")
    cell = _magnitude("_v")
    while not left.filter((F.col("_lo") < F.col("_hi")) & (F.col("_n") > few)).isEmpty():
        inside = _joined(rows, left.filter((F.col("_lo") < F.col("_hi")) & (F.col("_n") > few)), by).filter("_v between _lo and _hi")
        counted = inside.groupBy(*key, "_below", cell.alias("_cell")).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        upto = F.sum("_n").over(Window.partitionBy(*key).orderBy("_cell"))  # as many rows as there are cells
        found = counted.withColumn("_upto", F.col("_below") + upto).filter((F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_n")))
        found = found.select(*key, "_lo", "_hi", "_n", (F.col("_upto") - F.col("_n")).alias("_below"))
        rest = left.filter((F.col("_lo") == F.col("_hi")) | (F.col("_n") <= few)).select(*found.columns)
        left, cell = written(found.unionByName(rest), "ranges"), _part()
    done = left.filter("_lo = _hi").select(*key, F.col("_lo").alias("_value"))
    inside = _joined(rows, left.filter("_lo < _hi"), by).filter("_v between _lo and _hi")
    at = F.col("_below") + F.row_number().over(Window.partitionBy(*key).orderBy("_v")) - 1
    return inside.withColumn("_at", at).filter("_at = _rank").select(*key, F.col("_v").alias("_value")).unionByName(done)


def _joined(rows: DataFrame, ranges: DataFrame, by: list[str]) -> DataFrame:
    return rows.join(ranges, by) if by else rows.crossJoin(F.broadcast(ranges))  # without groups: a row a rank


def quantiles(df: DataFrame, by: Sequence[str], column: str, shares: Sequence[float], how: str = "linear", few: int = FEW) -> DataFrame:
    """(by, n, q0, q1, ...): a column a share. ``linear`` goes between the two nearest ranks, ``nearest`` takes
    the value at rank round((n - 1) share), halves up. Groups without a value are left out."""
    by = list(by)
    rows = written(df.select(*by, F.col(column).cast("double").alias("_v")).filter("_v is not null and not isnan(_v)"), "values")  # read once a round
    n = rows.groupBy(*by).agg(F.count("*").alias("_n"))
    places = n.select(*by, "_n", F.posexplode(F.array(*[F.lit(float(s)) for s in shares])).alias("_q", "_share")).withColumn("_h", (F.col("_n") - 1) * F.col("_share"))
    ends = F.array(F.floor(F.col("_h") + 0.5)) if how == "nearest" else F.array_distinct(F.array(F.floor("_h"), F.ceil("_h")))
    places = places.select(*by, "_n", "_q", "_h", F.explode(ends).alias("_rank"))
    values = ranked_values(rows, by, "_v", places.select(*by, "_rank").distinct(), few)
    got = places.join(values, [*by, "_rank"]).groupBy(*by, "_n", "_q", "_h").agg(F.min("_value").alias("_a"), F.max("_value").alias("_b"))
    value = F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_h") - F.floor("_h")) if how == "linear" else F.col("_a")
    return got.groupBy(*by, F.col("_n").alias("n")).agg(*[F.max(F.when(F.col("_q") == k, value)).alias(f"q{k}") for k in range(len(shares))])
