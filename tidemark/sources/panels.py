"""Panels by name: the mart where there is one, else the raw table, else an empty one with the right columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.series import ffill, w

#: A table by name, or None where there is none.
Find = Callable[[str], DataFrame | None]


@dataclass(frozen=True)
class Panel:
    mart: str
    raw: str | None = None
    columns: str = ""  # name type, ...; empty: those of the mart, which must exist


BARS = "open double, high double, low double, close double, volume double, source string"
#: Where each panel is kept.
PANELS = {
    "daily": Panel("main_marts.fct_ohlcv_daily", "ohlcv_daily", f"symbol string, date date, {BARS}"),
    "hourly": Panel("main_marts.fct_ohlcv_hourly", "ohlcv_hourly", f"symbol string, hour timestamp_ntz, {BARS}"),
    "signals": Panel("main_marts.mart_signals_daily"),
    "wallet": Panel("main_signals.fct_wallet_signals_daily", None, "date date, chain string, smart_money_netflow double, kol_buy_count bigint, insider_netflow double, deployer_activity bigint, cluster_count bigint"),
    "tweet": Panel("main_marts.fct_tweet_mentions_daily", None, "date date, symbol string, mention_count int, kol_mention_count int, bullish_keyword_count int, bearish_keyword_count int, unique_accounts int, sentiment_net int"),
    "order_book": Panel("main_marts.fct_order_book_agg", None, "symbol string, timestamp timestamp_ntz, avg_mid double, avg_spread_bps double, avg_imbalance_bps_25 double, bid_notional_bps_25 double, ask_notional_bps_25 double"),
    "mev": Panel("main_marts.mart_mev_arb_daily", None, "symbol string, date date, avg_depth double, basis_bps double, total_value_eth double"),
}


def catalog(spark: SparkSession) -> Find:
    """Tables of the session's catalog."""
    return lambda name: spark.table(name) if spark.catalog.tableExists(name) else None


def load(spark: SparkSession, name: str, find: Find | None = None) -> DataFrame:
    """A panel; order is left to whoever writes it out."""
    panel, find = PANELS[name], find or catalog(spark)
    own = [c.split()[0] for c in panel.columns.split(", ")] if panel.columns else None
    mart = find(panel.mart)
    if mart is not None:
        return mart.select(*own) if panel.raw else mart  # marts without a raw table are taken as they are
    if own is None:
        raise LookupError(f"{panel.mart} does not exist")
    raw = find(panel.raw) if panel.raw else None
    return raw.select(*own) if raw is not None else spark.createDataFrame([], panel.columns)


def btc_macro(spark: SparkSession, find: Find | None = None) -> DataFrame:
    """Bitcoin's bars with each day's macro series, the last known value carried on."""
    find = find or catalog(spark)
    bars = load(spark, "daily", find).filter("symbol = 'BTC'")
    macro = find("main_signals.fct_macro_series")
    if macro is None:
        return bars
    series = [c for c in macro.columns if c != "date"]
    joined = bars.join(macro, "date", "left")
    return joined.select(*bars.columns, *[ffill(c, w("symbol", "date")).alias(c) for c in series])  # a row a day


def strategy_panel(spark: SparkSession, kind: str, symbols: Sequence[str] = (), find: Find | None = None) -> DataFrame:
    """The panel that a strategy names, of some symbols in any case, or of all."""
    df = btc_macro(spark, find) if kind == "btc_macro" else load(spark, "daily" if kind == "daily" else "signals", find)
    return df.filter(F.upper("symbol").isin([s.upper() for s in symbols])) if symbols else df
