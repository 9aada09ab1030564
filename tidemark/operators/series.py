"""Time-series operators over a panel: every function takes the window's partition and order columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def w(by: str | Sequence[str], order: str | Sequence[str]) -> Window:
    by, order = (list(x) if isinstance(x, (list, tuple)) else [x] for x in (by, order))
    return Window.partitionBy(*by).orderBy(*order)


def rolling(column: str | Column, window, size: int, how: str = "avg", least: int | None = None) -> Column:
    """avg, sum, stddev_samp, ... of the last ``size`` rows; null until ``least`` (all of them) are known."""
    c = F.col(column) if isinstance(column, str) else column
    frame = window.rowsBetween(-(size - 1), 0)
    return F.when(F.count(c).over(frame) >= (size if least is None else least), getattr(F, how)(c).over(frame))


def ffill(column: str, window) -> Column:
    return F.last(column, ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, 0))


def bfill(column: str, window) -> Column:
    return F.first(column, ignorenulls=True).over(window.rowsBetween(0, Window.unboundedFollowing))


def pct_change(column: str, window, n: int = 1) -> Column:
    return F.try_divide(F.col(column), F.lag(column, n).over(window)) - 1


def interpolate(df: DataFrame, by: Sequence[str], order: str, column: str, out: str) -> DataFrame:
    """Linear by row position between the known values on both sides."""
    window = w(by, order)
    df = df.withColumn("_i", F.row_number().over(window)).withColumn("_k", F.when(F.col(column).isNotNull(), F.col("_i")))
    x0, x1, y0, y1 = ffill("_k", window), bfill("_k", window), ffill(column, window), bfill(column, window)
    value = F.when(x0 == x1, y0).when(x0.isNotNull() & x1.isNotNull(), y0 + (y1 - y0) * (F.col("_i") - x0) / (x1 - x0))
    return df.withColumn(out, value).drop("_i", "_k")


def cs_zscore(column: str, by: str) -> Column:
    """Cross-sectional z-score; 0 where the deviation is null or next to nothing."""
    p = Window.partitionBy(by)
    sd = F.stddev_samp(column).over(p)
    return F.when(sd.isNull() | (sd < 1e-12), F.lit(0.0)).otherwise(F.coalesce((F.col(column) - F.avg(column).over(p)) / sd, F.lit(0.0)))


def avg_rank(df: DataFrame, by: str, column: str, out: str) -> DataFrame:
    """Average rank over the number of known values of the partition."""
    p = Window.partitionBy(by)
    known = F.when(F.col(column).isNotNull(), 1)
    rank = F.rank().over(p.orderBy(F.col(column).asc_nulls_last()))
    ties = F.count(column).over(Window.partitionBy(by, column))
    return df.withColumn(out, F.when(F.col(column).isNotNull(), (rank + (ties - 1) / 2) / F.count(known).over(p)))


def compound(column: str, window) -> Column:
    """Running product of 1 + r, for r > -1."""
    return F.exp(F.sum(F.log1p(column)).over(window.rowsBetween(Window.unboundedPreceding, 0)))


def drawdown(equity: str, window) -> Column:
    peak = F.max(equity).over(window.rowsBetween(Window.unboundedPreceding, 0))
    return (F.col(equity) - peak) / peak


def spans(df: DataFrame, by: Sequence[str], order: str, state: str) -> DataFrame:
    """Runs of an unchanged state: (by, state, start, end, n)."""
    window = w(by, order)
    flip = F.when(F.lag(state).over(window).eqNullSafe(F.col(state)) & (F.row_number().over(window) > 1), 0).otherwise(1)
    runs = df.withColumn("_f", flip).withColumn("_run", F.sum("_f").over(window.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*by, "_run", state).agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("n")).drop("_run")


def numbered(df: DataFrame, by: str, order: str, block: Column, carry: Sequence[str] = ()) -> DataFrame:
    """Adds _i, the row's place (from 0) in its series, and for each column c of ``carry`` _before_c, its value in the row before.

    ``block`` must grow with ``order``: windows run within blocks, and only a row a block is summed up along the series.
    """
    x = df.withColumn("_block", block)
    inside, along = Window.partitionBy(by, "_block").orderBy(order), Window.partitionBy(by).orderBy("_block")
    ends = x.groupBy(by, "_block").agg(F.count("*").alias("_n"), *[F.max_by(c, order).alias(f"_last_{c}") for c in carry])
    ends = ends.select(
        by, "_block", F.coalesce(F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"), *[F.lag(f"_last_{c}").over(along).alias(f"_last_{c}") for c in carry]
    )
    x = x.join(ends, [by, "_block"])
    first = F.row_number().over(inside) == 1
    before = {f"_before_{c}": F.when(first, F.col(f"_last_{c}")).otherwise(F.lag(c).over(inside)) for c in carry}
    return x.withColumns({"_i": F.col("_offset") + F.row_number().over(inside) - 1, **before}).drop("_block", "_offset", *[f"_last_{c}" for c in carry])


#: How much of an older state a block of a recurrence leaves, and how many blocks back it is followed: to 1e-300.
FADED, BLOCKS = 1e-15, 20


def _recurrence(df: DataFrame, by: str, order: str, column: str, out: str, size: int, alpha: float, block: Column) -> DataFrame:
    """x[t] = x[t-1] + alpha (v[t] - x[t-1]), from the mean of the first ``size`` values; null until then and where v is null.

    Each step maps x to d x + alpha v with d = 1 - alpha. A block of steps is composed by one scaled running sum, a
    series' blocks by their last states, so its rows are dealt over as many tasks as it has blocks.
    """
    d = 1 - alpha
    known = numbered(df.filter(F.col(column).isNotNull()), by, order, block)
    if d <= 0:  # nothing is left of the state
        return known.withColumn(out, F.when(F.col("_i") >= size - 1, F.col(column))).drop("_i").unionByName(df.filter(F.col(column).isNull()).withColumn(out, F.lit(None).cast("double")))
    rows = max(1, math.ceil(math.log(FADED) / math.log(d)))
    fade = d**rows
    seed = known.filter(F.col("_i") < size).groupBy(by).agg(F.avg(column).alias("_seed"))
    t = F.col("_i") - (size - 1)
    x = known.join(seed, by).withColumns({"_b": F.floor(t / rows), "_k": F.pmod(t, F.lit(rows))})
    step = F.when(t == 0, F.col("_seed")).when(t > 0, alpha * F.col(column)).otherwise(0.0)
    inside = Window.partitionBy(by, "_b").orderBy("_k")
    x = x.withColumn("_own", F.pow(F.lit(d), "_k") * F.sum(step * F.pow(F.lit(d), -F.col("_k"))).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    ends = x.filter((F.col("_b") >= 0) & (F.col("_k") == rows - 1)).select(by, "_b", F.col("_own").alias("_end"))  # a row a full block
    along = Window.partitionBy(by).orderBy("_b")
    state = F.col("_end")
    for back in range(1, BLOCKS + 1):
        state = state + fade**back * F.coalesce(F.lag("_end", back).over(along), F.lit(0.0))
    states = ends.select(by, (F.col("_b") + 1).alias("_b"), state.alias("_state"))
    x = x.join(states, [by, "_b"], "left")
    value = F.col("_own") + F.pow(F.lit(d), F.col("_k") + 1) * F.coalesce("_state", F.lit(0.0))
    done = x.select(*df.columns, F.when(t >= 0, value).alias(out))
    return done.unionByName(df.filter(F.col(column).isNull()).withColumn(out, F.lit(None).cast("double")))


def _blocks(df: DataFrame, order: str) -> Column:
    """Months of a date or time; 1,024 steps of a number."""
    return F.floor(F.col(order) / 1024) if isinstance(df.schema[order].dataType, T.NumericType) else F.date_trunc("month", F.col(order))


def ema(df: DataFrame, by: str, order: str, column: str, out: str, size: int, block: Column | None = None) -> DataFrame:
    """``block``: a column that grows with ``order`` and cuts series into bounded parts; months of a date, or 1,024 steps of a number, by default."""
    return _recurrence(df, by, order, column, out, size, 2 / (size + 1), _blocks(df, order) if block is None else block)


def atr(df: DataFrame, by: str, order: str, out: str, size: int, block: Column | None = None) -> DataFrame:
    """Wilder's average true range of high, low, close."""
    block = _blocks(df, order) if block is None else block
    x = numbered(df, by, order, block, ["close"])
    before = F.col("_before_close")
    true_range = F.greatest(F.col("high") - F.col("low"), F.coalesce(F.abs(F.col("high") - before), F.lit(0.0)), F.coalesce(F.abs(F.col("low") - before), F.lit(0.0)))
    return _recurrence(x.select(*df.columns, true_range.alias("_tr")), by, order, "_tr", out, size, 1 / size, block).drop("_tr")


def crosses(fast: str, slow: str, window) -> Column:
    """1 where fast rises over slow, -1 where it falls under, else 0."""
    now, before = F.col(fast) - F.col(slow), F.lag(F.col(fast) - F.col(slow)).over(window)
    return F.when((before <= 0) & (now > 0), 1).when((before >= 0) & (now < 0), -1).otherwise(0)


def resample_week(df: DataFrame, by: Sequence[str], date: str, last: Sequence[str] = (), total: Sequence[str] = (), mean: Sequence[str] = ()) -> DataFrame:
    """Monday weeks: last known value, sum or mean of columns."""
    week = F.date_trunc("week", F.col(date)).cast("date").alias("week")
    aggs = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(date))).alias(c) for c in last] + [F.sum(c).alias(c) for c in total] + [F.avg(c).alias(c) for c in mean]
    return df.groupBy(*by, week).agg(*aggs)
