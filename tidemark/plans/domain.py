"""The market tables, derived from the given tables by SQL that Spark and DuckDB both run.

``Tables`` gives each as a DataFrame; ``with_tables`` puts those that a DuckDB query uses before it.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")

SQL = {
    # single trades, of several venues
    "ticks": """select event_id, ts, cast(ts as date) as date, upper(event_type) as symbol, value as price, user_id, props,
        case user_id % 4 when 0 then 'binance' when 1 then 'coinbase' when 2 then 'coingecko' else 'other' end as source from {events}""",
    # daily bars of each venue
    "bars_raw": """select symbol, date, source, min_by(price, event_id) as open, max(price) as high, min(price) as low,
        max_by(price, event_id) as close, cast(count(*) as double) as volume from {ticks} group by symbol, date, source""",
    # a panel of several years
    "panel": """select upper(o_orderpriority) as symbol, cast(o_orderdate as date) as date, min_by(o_totalprice, o_orderkey) as open, max(o_totalprice) as high,
        min(o_totalprice) as low, max_by(o_totalprice, o_orderkey) as close, cast(count(*) as double) as volume from {orders} group by upper(o_orderpriority), cast(o_orderdate as date)""",
    "macro": """select concat('M_', o_orderstatus) as series_id, cast(o_orderdate as date) as date, max_by(o_totalprice, o_orderkey) as value, 'fred' as source
        from {orders} group by concat('M_', o_orderstatus), cast(o_orderdate as date)""",
    "open_interest": """select upper(o_orderpriority) as symbol, o_orderdate as ts, o_orderstatus as exchange, max_by(o_totalprice, o_orderkey) as open_interest,
        case o_orderstatus when 'F' then 'usd_notional' when 'O' then 'coin' else 'contracts' end as unit from {orders} group by upper(o_orderpriority), o_orderdate, o_orderstatus""",
    "transfers": """select case l_suppkey % 3 when 0 then 'bitcoin' when 1 then 'ethereum' else 'solana' end as chain, cast(l_orderkey as string) as tx_hash,
        cast(l_linenumber as bigint) as transfer_index, l_shipdate as block_time, cast(l_shipdate as date) as date, concat('w', cast(l_suppkey as string)) as from_address,
        concat('w', cast(o_custkey as string)) as to_address, case when l_linestatus = 'O' then 'SOL' else 'BTC' end as asset, l_quantity as amount,
        case when l_linenumber % 3 = 0 then null else l_extendedprice end as amount_usd, case l_returnflag when 'A' then 'inflow' else 'outflow' end as direction
        from {lineitem} join {orders} on l_orderkey = o_orderkey""",
    "registry": """select concat('w', cast(s_suppkey as string)) as address, case s_suppkey % 3 when 0 then 'bitcoin' when 1 then 'ethereum' else 'solana' end as chain, s_name as label,
        case s_nationkey % 5 when 0 then 'smart_money' when 1 then 'insider' when 2 then 'exchange' when 3 then 'kol' else 'deployer' end as entity_type,
        cast(s_nationkey as double) / 25 as confidence, s_acctbal > 0 as active from {supplier}""",
    "links": """select concat('w', cast(s_suppkey as string)) as address, case s_suppkey % 3 when 0 then 'bitcoin' when 1 then 'ethereum' else 'solana' end as chain,
        concat('id', cast(s_nationkey as string)) as identity_id from {supplier}""",
    "identities": "select concat('id', cast(n_nationkey as string)) as identity_id, n_name as display_name, n_regionkey <> 0 as active from {nation}",
    "books": """select upper(event_type) as symbol, ts, concat('ex', cast(user_id % 3 as string)) as exchange, value as mid, 1 + value / 10 as spread_bps,
        value * 100 as bid_notional_bps_25, value * 90 + user_id as ask_notional_bps_25, value / 1000 - 0.05 as imbalance_bps_25, event_id from {events}""",
    "levels": """select l_orderkey as book_id, case l_linestatus when 'O' then 'bid' else 'ask' end as side, l_linenumber as level,
        case l_linestatus when 'O' then 1000 - l_discount * 100 - l_linenumber else 1000 + l_tax * 100 + l_linenumber end as price, l_quantity as qty from {lineitem}""",
    "dex": "select symbol, date, case when event_id % 2 = 0 then 'defillama' else 'amm' end as venue, max_by(price, event_id) * 0.999 as price_usd from {ticks} group by symbol, date, case when event_id % 2 = 0 then 'defillama' else 'amm' end",
    "blocks": """select o_orderkey as slot, cast(o_orderdate as date) as date, case when o_custkey % 2 = 0 then 'flashbots' else 'other' end as relay,
        o_totalprice / 1000 as value_eth from {orders}""",
    "tweets": """select event_id as tweet_id, concat('user', cast(user_id as string)) as handle, ts as posted_at, cast(ts as date) as date, user_id,
        case event_id % 5 when 0 then concat('Long $', upper(substr(event_type, 1, 4)), ' to the moon, very bullish')
            when 1 then concat('$', upper(substr(event_type, 1, 4)), ' looks weak, going short. dump?')
            when 2 then concat('pump it ', event_type, '.sol now') when 3 then 'gm' else concat('bearish on $', upper(substr(event_type, 1, 4)), ' and $ETH') end as text,
        cast(floor(value) as bigint) as like_count, user_id % 7 as retweet_count from {events}""",
    "mentions": """select event_id as tweet_id, case event_id % 4 when 0 then 'eth_address' when 1 then 'sol_address' when 2 then 'btc_address' else 'url' end as entity_type,
        concat(case when event_id % 3 = 0 then 'W' else 'w' end, cast(user_id % 40 as string)) as entity_value from {events}""",
    "calendar": """select cast(ts as date) as date, event_type as category, concat(event_type, ' ', cast(cast(ts as date) as string)) as title,
        case event_type when 'click' then 'BTC' when 'view' then 'DEFI' else 'ALL' end as scope, case when max(value) > 90 then 'positive' when max(value) > 60 then 'negative' else 'neutral' end as effect
        from {events} group by cast(ts as date), event_type""",
    "assets": """select symbol, cast(row_number() over (partition by as_of_date order by n desc, symbol) as bigint) as rank, as_of_date, symbol <> 'ERROR' as active
        from (select symbol, date as as_of_date, count(*) as n from {ticks} group by symbol, date) x""",
}


class Tables:
    """Base and derived tables as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._seen = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in SQL and name not in BASE:
            raise AttributeError(name)
        if name not in self._seen:
            self._seen[name] = self.sql(SQL[name]) if name in SQL else self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._seen[name]

    def sql(self, text: str) -> DataFrame:
        used = {n: getattr(self, n) for n in set(re.findall(r"\{(\w+)\}", text))}
        return self.spark.sql(text, **used)

    @cached_property
    def bars(self) -> DataFrame:
        from tidemark.operators.relational import dedupe_by_priority

        return dedupe_by_priority(self.bars_raw, ["symbol", "date"], "source")


BARS = """select symbol, date, open, high, low, close, volume, source from (select *, row_number() over (partition by symbol, date order by
    case source when 'binance' then 1 when 'coinbase' then 2 when 'coingecko' then 3 else 4 end, source) as rn from {bars_raw}) x where rn = 1"""


def with_tables(sql: str) -> str:
    """``sql`` for DuckDB, the derived tables it names before it."""
    all_sql = SQL | {"bars": BARS}
    order: list[str] = []

    def visit(name: str) -> None:
        for used in re.findall(r"\{(\w+)\}", all_sql[name]):
            if used in all_sql:
                visit(used)
        if name not in order:
            order.append(name)

    for name in all_sql:
        if re.search(rf"\b(?:from|join)\s+{name}\b", sql):
            visit(name)
    if not order:
        return sql
    ctes = ", ".join(f"{n} as ({re.sub(r'\{(\w+)\}', r'\1', all_sql[n])})" for n in order)
    return f"with {ctes} select * from ({sql}) q"
