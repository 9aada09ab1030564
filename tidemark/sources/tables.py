"""Schemas of the raw tables, and the staging view of each: both follow from the columns' names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import normalize_address

#: The raw tables and their columns.
RAW = {
    "assets": "rank symbol coingecko_id binance_pair coinbase_product_id active as_of_date",
    "ohlcv_daily": "symbol date open high low close volume source",
    "ohlcv_hourly": "symbol hour open high low close volume source",
    "sync_state": "symbol interval backfill_complete earliest_at latest_at last_refresh_at",
    "onchain_series": "metric date value source",
    "onchain_sync_state": "metric source latest_at last_refresh_at",
    "etf_flows_daily": "date ticker flow_usd source",
    "equity_daily": "symbol date close source",
    "open_interest": "symbol timestamp open_interest exchange unit interval",
    "order_book_snapshots": "symbol timestamp exchange mid best_bid best_ask spread_bps bid_notional_bps_10 ask_notional_bps_10 bid_notional_bps_25 ask_notional_bps_25"
    " bid_notional_bps_50 ask_notional_bps_50 imbalance_bps_25 depth_levels last_update_id fetched_at",
    "order_book_sync_state": "symbol exchange latest_at last_refresh_at",
    "dex_price_daily": "symbol date venue price_usd source",
    "mev_boost_payloads": "slot block_number builder_pubkey proposer_fee_recipient value_wei value_eth relay date source",
    "macro_series": "series_id date value source",
    "macro_sync_state": "series_id source latest_at last_refresh_at",
    "wallet_registry": "address chain label entity_type confidence source discovered_at active metadata_json",
    "wallet_transfers": "chain tx_hash transfer_index block_time from_address to_address asset_mint_or_contract asset_symbol amount amount_usd direction program_or_method source",
    "wallet_positions_daily": "address chain date asset_mint balance balance_usd source",
    "wallet_sync_state": "address chain source backfill_complete earliest_at latest_at last_refresh_at",
    "wallet_alerts": "address chain mint_or_contract action severity block_time tx_hash alerted_at metadata_json",
    "wallet_identities": "identity_id display_name category description source_url active",
    "wallet_identity_links": "address chain identity_id link_type confidence source linked_at",
    "twitter_accounts": "handle user_id display_name entity_type chains symbols_watch confidence source active metadata_json",
    "tweets": "tweet_id handle posted_at text lang is_retweet is_reply reply_to_tweet_id conversation_id like_count retweet_count reply_count import_source imported_at raw_json",
    "tweet_entities": "tweet_id entity_type entity_value",
    "tweet_sync_state": "handle earliest_at latest_at latest_tweet_id last_import_at backfill_complete",
    "tweet_signals_daily": "date symbol mention_count kol_mention_count bullish_keyword_count bearish_keyword_count unique_accounts",
    "tweet_alerts": "tweet_id handle alert_type severity symbols posted_at alerted_at metadata_json",
    "wallet_signals_daily": "date chain smart_money_netflow kol_buy_count insider_netflow deployer_activity cluster_count",
}
#: Tables without a staging view, and views that keep active rows only.
NOT_STAGED = ("etf_flows_daily", "equity_daily", "order_book_sync_state", "wallet_signals_daily")
ACTIVE_ONLY = ("wallet_registry", "twitter_accounts", "wallet_identities")
DOUBLES = "open high low close volume value flow_usd open_interest mid best_bid best_ask spread_bps price_usd value_wei value_eth confidence amount amount_usd balance balance_usd smart_money_netflow insider_netflow".split()
LONGS = "slot block_number last_update_id transfer_index like_count retweet_count reply_count".split()


def kind(table: str, column: str) -> str:
    """Type of a column, by its name."""
    if column in DOUBLES or "_bps_" in column:
        return "double"
    if column in LONGS:
        return "bigint"
    if column == "rank" or column in ("depth_levels", "unique_accounts", "deployer_activity") or column.endswith("_count"):
        return "int"
    if column in ("active", "backfill_complete") or column.startswith("is_"):
        return "boolean"
    if column in ("date", "as_of_date"):
        return "date"
    if table == "sync_state" and column in ("earliest_at", "latest_at"):
        return "string"  # days of daily and hours of hourly cursors
    return "timestamp_ntz" if column.endswith("_at") or column in ("hour", "timestamp", "block_time") else "string"


def schema(table: str) -> str:
    return ", ".join(f"`{c}` {kind(table, c)}" for c in RAW[table].split())


def scan(spark: SparkSession, table: str, path: str) -> DataFrame:
    """A raw table with its own columns and types; columns that a file does not have are null, others are not read."""
    return spark.read.schema(schema(table)).parquet(path)


def _staged(table: str, column: str) -> Column:
    c = F.col(f"`{column}`").cast(kind(table, column))
    if column == "symbol" or (table, column) == ("tweet_entities", "entity_value"):
        c = F.upper(c)
    elif column == "handle" and table != "twitter_accounts":
        c = F.lower(c)
    elif column == "address":
        c = normalize_address(c, F.col("chain"))
    return c.alias(column)


def staging(table: str, raw: DataFrame) -> DataFrame:
    """The staging view of a raw table: typed columns, symbols in upper and handles in lower case, addresses by chain."""
    if table in NOT_STAGED:
        raise ValueError(f"{table} has no staging view")
    kept = raw.filter(F.col("active").cast("boolean")) if table in ACTIVE_ONLY else raw
    own = [c for c in RAW[table].split() if not (table == "tweets" and c == "raw_json")]
    return kept.select(*[_staged(table, c) for c in own])


VIEWS = tuple(t for t in RAW if t not in NOT_STAGED)
