"""Regime signals of macro and on-chain series, of whatever columns have enough data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.series import ffill
from tidemark.operators.stores import written

#: Weeks of growth, weeks of momentum.
GROWTH, MOMENTUM = 52, 12
#: On-chain columns in order, least rows of one, and least rows of a valuation.
ONCHAIN, LEAST_ROWS, VALUATIONS, LEAST_VALUATION = ("hashrate", "active_addresses", "fees_usd", "mvrv", "nupl"), 30, ("mvrv", "nupl"), 90


def week(date: str = "date") -> Column:
    return F.date_trunc("week", date).cast("date").alias("week")


def last_known(column: str, date: str = "date") -> Column:
    return F.max_by(column, F.when(F.col(column).isNotNull(), F.col(date))).alias(column)


def zscores(df: DataFrame, parts: Mapping[str, int], out: str) -> DataFrame:
    """Adds the sum of the columns' z-scores over all rows, each with its sign."""
    stats = df.agg(*[f(c).alias(f"_{n}_{c}") for c in parts for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    total = sum((sign * (F.col(c) - F.col(f"_m_{c}")) / (F.col(f"_s_{c}") + 1e-12) for c, sign in parts.items()), F.lit(0.0))
    return df.crossJoin(F.broadcast(stats)).select(*df.columns, total.alias(out))  # one row


def momentum(weekly: DataFrame, raw: str, index: str, out: str) -> DataFrame:
    """Adds the standardised index and its change over ``MOMENTUM`` weeks."""
    stats = weekly.agg(F.avg(raw).alias("_m"), F.stddev_samp(raw).alias("_s"))
    sd = F.when(F.col("_s") > 1e-12, F.col("_s")).otherwise(1.0)
    x = weekly.crossJoin(F.broadcast(stats)).withColumn(index, (F.col(raw) - F.col("_m")) / sd).drop("_m", "_s")  # one row
    return x.withColumn(out, F.col(index) - F.lag(index, MOMENTUM).over(Window.orderBy("week")))  # a row a week


def _signal(series: DataFrame, column: str, least: int, up: str, down: str) -> DataFrame:
    """One row (signal, label): the sign of the last momentum; 0 and MISSING where rows are few or it is not known."""
    last = series.agg(F.count("*").alias("n"), F.max_by(column, "week").alias("m"))
    known = (F.col("n") > least) & F.col("m").isNotNull() & ~F.isnan("m")
    sign = F.when(~known | F.col("n").isNull(), 0).when(F.col("m") > 0, 1).otherwise(-1)
    return last.select(sign.cast("long").alias("signal"), F.when(sign == 0, "MISSING").when(sign == 1, up).otherwise(down).alias("label"))


def missing(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(0, "MISSING")], "signal long, label string")


def liquidity_series(macro: DataFrame, money: str = "m2sl", assets: str = "walcl", nominal: str = "dgs10", inflation: str = "t10yie") -> DataFrame:
    """(week, money_growth, assets_growth, real_rate_change, raw, index, momentum) of a wide daily table."""
    weekly = macro.groupBy(week()).agg(*[last_known(c) for c in (money, assets, nominal, inflation)])
    w = Window.orderBy("week")  # a row a week
    growth = lambda c: F.log(c) - F.lag(F.log(c), GROWTH).over(w)
    real = F.col(nominal) - F.col(inflation)
    x = weekly.select("week", growth(F.col(money)).alias("money_growth"), growth(F.col(assets)).alias("assets_growth"), (real - F.lag(real, GROWTH).over(w)).alias("real_rate_change")).dropna()
    x = zscores(x, {"money_growth": 1, "assets_growth": 1, "real_rate_change": -1}, "raw")
    return momentum(x, "raw", "index", "momentum")


def liquidity_signal(macro: DataFrame, **columns: str) -> DataFrame:
    """One row (signal, label) of the liquidity index; MISSING where a series is."""
    named = {"money": "m2sl", "assets": "walcl", "nominal": "dgs10", "inflation": "t10yie"} | columns
    if not set(named.values()) <= set(macro.columns):
        return missing(macro)
    return _signal(liquidity_series(macro, **named), "momentum", MOMENTUM + 5, "expanding", "contracting")


def usable(onchain: DataFrame, columns: Sequence[str] = ONCHAIN, valuations: Sequence[str] = VALUATIONS) -> tuple[DataFrame, list[str]]:
    """(rows on which all covered columns are known, carried on from before; those of them that vary).

    One aggregate of the counts of all candidates decides which are covered, a second one which vary.
    """
    there = [c for c in columns if c in onchain.columns]
    if not there:
        return onchain.limit(0), []
    counts = onchain.agg(*[F.count(c).alias(c) for c in there]).first()
    covered = [c for c in there if counts[c] >= LEAST_ROWS]
    w = Window.orderBy("date")  # a row a day
    filled = written(onchain.select("date", *[ffill(c, w).alias(c) for c in covered]).dropna(), "filled")
    if not covered:
        return filled, []
    stats = filled.agg(F.count("*").alias("_n"), *[F.stddev_samp(c).alias(c) for c in covered]).first()
    if stats["_n"] <= MOMENTUM + 5:
        return filled, []
    vary = [c for c in covered if stats[c] is not None and stats[c] > 1e-12 and (c not in valuations or stats["_n"] >= LEAST_VALUATION)]
    return filled, vary


def cycle_series(filled: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(week, raw, index, momentum): sum of the columns' z-scores by week."""
    weekly = filled.groupBy(week()).agg(*[F.max_by(c, "date").alias(c) for c in columns])
    return momentum(zscores(weekly, dict.fromkeys(columns, 1), "raw").select("week", "raw"), "raw", "index", "momentum")


def cycle_signal(onchain: DataFrame, columns: Sequence[str] = ONCHAIN, valuations: Sequence[str] = VALUATIONS) -> DataFrame:
    """One row (signal, label) of the on-chain index over the columns that are usable; the label names the first three."""
    filled, vary = usable(onchain, columns, valuations)
    if not vary:
        return missing(onchain)
    names = f"({'+'.join(vary[:3])})"
    return _signal(cycle_series(filled, vary), "momentum", MOMENTUM + 2, f"bullish mom {names}", f"bearish mom {names}")
