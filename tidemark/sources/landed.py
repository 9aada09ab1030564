"""Landed API answers to typed rows: one column of JSON texts in, rows out. What does not parse is left out."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _day(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds).cast("date")


def _number(c: Column) -> Column:
    """A double, null for what is none, or not a number."""
    v = c.try_cast("double")
    return F.when(~F.isnan(v), v)


def klines(answers: DataFrame, value: str = "value", symbol: str = "symbol", source: str = "binance") -> DataFrame:
    """(symbol, date, open, high, low, close, volume, source) of arrays [[open time in ms, open, high, low, close, volume, ...], ...]."""
    row = F.explode(F.from_json(value, "array<array<string>>")).alias("a")
    out = answers.select(F.upper(symbol).alias("symbol"), row).filter(F.size("a") >= 6)
    numbers = [_number(F.col("a")[k]).alias(n) for k, n in enumerate(("open", "high", "low", "close", "volume"), 1)]
    out = out.select("symbol", _day(F.floor(F.col("a")[0].try_cast("long") / 1000)).alias("date"), *numbers, F.lit(source).alias("source"))
    return out.dropna(subset=["date", "open", "high", "low", "close", "volume"])


def open_interest(answers: DataFrame, value: str = "value", symbol: str = "symbol", exchange: str = "binance", interval: str = "1h") -> DataFrame:
    """(symbol, timestamp, open_interest, exchange, unit, interval) of [{timestamp in ms, sumOpenInterestValue}, ...], at full hours."""
    row = F.explode(F.from_json(value, "array<struct<timestamp: string, sumOpenInterestValue: string>>")).alias("r")
    hour = F.timestamp_seconds(F.floor(F.col("r.timestamp").try_cast("long") / 3_600_000) * 3600).cast("timestamp_ntz")
    out = answers.select(F.upper(symbol).alias("symbol"), row).select("symbol", hour.alias("timestamp"), _number(F.col("r.sumOpenInterestValue")).alias("open_interest"))
    return out.dropna(subset=["timestamp", "open_interest"]).select("*", F.lit(exchange).alias("exchange"), F.lit("usd_notional").alias("unit"), F.lit(interval).alias("interval"))


def observations(answers: DataFrame, value: str = "value", series: str = "series_id", source: str = "fred") -> DataFrame:
    """(series_id, date, value, source) of {observations: [{date, value}, ...]}; a lone full stop stands for no value."""
    row = F.explode(F.from_json(value, "observations array<struct<date: string, value: string>>")["observations"]).alias("r")
    out = answers.select(F.col(series).alias("series_id"), row).select("series_id", F.col("r.date").try_cast("date").alias("date"), _number(F.col("r.value")).alias("value"))
    return out.dropna(subset=["date", "value"]).withColumn("source", F.lit(source))


def chart(answers: DataFrame, value: str = "value", metric: str = "metric", source: str = "blockchain.info") -> DataFrame:
    """(metric, date, value, source) of {values: [{x: seconds, y}, ...]}."""
    row = F.explode(F.from_json(value, "values array<struct<x: string, y: string>>")["values"]).alias("r")
    out = answers.select(F.col(metric).alias("metric"), row).select("metric", _day(F.col("r.x").try_cast("double").try_cast("long")).alias("date"), _number(F.col("r.y")).alias("value"))
    return out.dropna(subset=["date", "value"]).withColumn("source", F.lit(source))


#: Columns of the valuation answers, and the metric of each.
VALUATION = {"total_mvrv": "mvrv", "total_realized_price": "realized_price", "total_nupl": "nupl"}


def valuation(answers: DataFrame, value: str = "value", names: Mapping[str, str] = VALUATION, source: str = "bitcoinisdata") -> DataFrame:
    """(metric, date, value, source) of wide rows [{date, column: value, ...}, ...]: the last row of each date, one row a metric."""
    wide = F.from_json(value, "array<struct<date: string, " + ", ".join(f"{c}: string" for c in names) + ">>")
    rows = answers.select(F.monotonically_increasing_id().alias("answer"), F.posexplode(wide).alias("at", "r")).filter("r.date is not null")
    last = rows.groupBy(F.col("r.date").alias("d")).agg(F.max_by("r", F.struct("answer", "at")).alias("r"))
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), _number(F.col(f"r.{c}")).alias("value")) for c, m in names.items()]))
    out = last.select(F.substring("d", 1, 10).try_cast("date").alias("date"), each.alias("x")).select("x.metric", "date", "x.value")
    return out.dropna().withColumn("source", F.lit(source))
