"""Landed answers, raw tables with their staging views, panels, regime signals and the post pipeline."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tidemark.operators import signals as sg
from tidemark.operators import social, stores
from tidemark.plans.registry import query
from tidemark.sources import landed, panels, tables

SD = ["symbol", "date"]


def answers(rows, by, item, name="value"):
    """Landed answers: one JSON array of ``item`` for each key of ``by``, as an API would give it page by page."""
    return rows.groupBy(*by).agg(F.to_json(F.sort_array(F.collect_list(item))).alias(name))


# ---- landed answers


@query(
    "src_11_klines",
    "select symbol, date, open, high, low, close, volume, 'binance' as source from panel",
    "open high low close volume",
)
def src_11_klines(t):
    text = lambda c: F.col(c).cast("string")
    item = F.array((F.unix_date("date").cast("long") * 86_400_000).cast("string"), *[text(c) for c in ("open", "high", "low", "close", "volume")], F.lit("0"))
    return landed.klines(answers(t.panel, [F.lower("symbol").alias("symbol"), F.year("date").alias("year")], item))


@query(
    "src_11_open_interest",
    """select symbol, date_trunc('hour', ts + interval 90 minute) as timestamp, open_interest, exchange, 'usd_notional' as unit, '1h' as interval from (select symbol, cast(ts as timestamp) as ts, open_interest, 'binance' as exchange from open_interest) x""",
    "open_interest",
)
def src_11_interest(t):
    late = (F.unix_millis(F.col("ts").cast("timestamp")) + 90 * 60_000 + 7).cast("string")
    item = F.struct(late.alias("timestamp"), F.col("open_interest").cast("string").alias("sumOpenInterestValue"))
    return landed.open_interest(answers(t.open_interest, ["symbol", F.year("ts").alias("year")], item))


@query(
    "src_11_observations",
    "select series_id, date, value, 'fred' as source from macro where day(date) <> 7",
    "value",
)
def src_11_observations(t):
    value = F.when(F.dayofmonth("date") == 7, F.lit(".")).otherwise(F.col("value").cast("string"))
    each = t.macro.groupBy("series_id", F.year("date").alias("year")).agg(F.sort_array(F.collect_list(F.struct(F.col("date").cast("string").alias("date"), value.alias("value")))).alias("observations"))
    return landed.observations(each.select("series_id", F.to_json(F.struct("observations")).alias("value")))


@query(
    "src_11_chart",
    "select series_id as metric, date, value, 'blockchain.info' as source from macro where day(date) <> 7",
    "value",
)
def src_11_chart(t):
    y = F.when(F.dayofmonth("date") != 7, F.col("value"))
    each = t.macro.groupBy(F.col("series_id").alias("metric"), F.year("date").alias("year")).agg(F.sort_array(F.collect_list(F.struct((F.unix_date("date").cast("long") * 86_400 + 3).alias("x"), y.alias("y")))).alias("values"))
    return landed.chart(each.select("metric", F.to_json(F.struct("values")).alias("value")))


@query(
    "src_11_valuation",
    """select 'mvrv' as metric, date, close as value, 'bitcoinisdata' as source from panel where symbol = '1-URGENT' union all select 'realized_price', date, high, 'bitcoinisdata' from panel where symbol = '1-URGENT'
    union all select 'nupl', date, low, 'bitcoinisdata' from panel where symbol = '1-URGENT' and day(date) <> 7""",
    "value",
)
def src_11_valuation(t):
    nupl = F.when(F.dayofmonth("date") != 7, F.col("low"))
    day = F.col("date").cast("string").alias("date")
    item = F.struct(day, F.col("close").alias("total_mvrv"), F.col("high").alias("total_realized_price"), nupl.alias("total_nupl"))
    stale = F.struct(day, (-F.col("close")).alias("total_mvrv"), F.lit(0.0).alias("total_realized_price"), F.lit(float("nan")).alias("total_nupl"))  # replaced by the row after it
    one = t.panel.filter("symbol = '1-URGENT'").groupBy(F.year("date").alias("year")).agg(F.sort_array(F.collect_list(item)).alias("good"), F.sort_array(F.collect_list(stale)).alias("stale"))
    return landed.valuation(one.select(F.to_json(F.concat("stale", "good")).alias("value")))


# ---- raw tables and staging views


def raw_tables(t):
    """Raw tables of the given ones, with symbols in lower case and a column more."""
    low = lambda df: df.withColumn("symbol", F.lower("symbol")) if "symbol" in df.columns else df
    of = {
        "ohlcv_daily": t.bars_raw, "open_interest": t.open_interest.withColumnRenamed("ts", "timestamp"), "assets": t.assets.withColumn("rank", F.col("rank").cast("int")), "macro_series": t.macro,
        "wallet_registry": t.registry, "wallet_transfers": t.transfers, "dex_price_daily": t.dex, "mev_boost_payloads": t.blocks.withColumn("slot", F.col("slot").cast("long")),
        "tweet_entities": t.mentions.withColumn("tweet_id", F.col("tweet_id").cast("string")), "tweets": t.tweets.withColumn("tweet_id", F.col("tweet_id").cast("string")),
        "wallet_identities": t.identities, "wallet_identity_links": t.links,
    }
    return {name: low(df).withColumn("landed_by", F.lit("test")) for name, df in of.items()}


def scanned(t):
    out = {}
    for name, df in raw_tables(t).items():
        path = stores.scratch(t.spark, name)
        df.write.parquet(path)
        out[name] = tables.scan(t.spark, name, path)
    return out


COUNTS = {
    "ohlcv_daily": "bars_raw", "open_interest": "open_interest", "assets": "assets", "macro_series": "macro", "wallet_registry": "registry", "wallet_transfers": "transfers", "dex_price_daily": "dex",
    "mev_boost_payloads": "blocks", "tweet_entities": "mentions", "tweets": "tweets", "wallet_identities": "identities", "wallet_identity_links": "links",
}


@query(
    "src_01_raw_tables",
    " union all ".join(f"select '{name}' as name, count(*) as n, {len(tables.RAW[name].split())}::bigint as columns from {of}" for name, of in COUNTS.items()),
)
def src_01_tables(t):
    each = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n", F.lit(len(df.columns)).cast("long").alias("columns")) for name, df in scanned(t).items()]
    return reduce(lambda a, b: a.unionByName(b), each)


@query(
    "prj_01_staging_views",
    " union all ".join(f"select '{name}' as name, count(*) as n from {of}" + (" where active" if name in tables.ACTIVE_ONLY else "") for name, of in COUNTS.items()),
)
def prj_01_views(t):
    each = [tables.staging(name, df).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in scanned(t).items()]
    return reduce(lambda a, b: a.unionByName(b), each)


@query("prj_01_stg_ohlcv_daily", "select symbol, date, open, high, low, close, volume, source from bars_raw", "open high low close volume")
def prj_01_bars(t):
    return tables.staging("ohlcv_daily", raw_tables(t)["ohlcv_daily"])


@query(
    "prj_01_stg_wallet_registry",
    "select case when chain in ('arbitrum', 'ethereum') then lower(upper(address)) else upper(address) end as address, chain, label, entity_type, confidence, active from registry where active",
    "confidence",
)
def prj_01_registry(t):
    raw = t.registry.withColumn("address", F.upper("address")).select("*", *[F.lit(None).cast("string").alias(c) for c in ("source", "discovered_at", "metadata_json")])
    return tables.staging("wallet_registry", raw).select("address", "chain", "label", "entity_type", "confidence", "active")


# ---- panels


def finder(t):
    """A catalog with a daily mart, a raw hourly table and a signals mart, and nothing else."""
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("hour")
    hourly = t.ticks.groupBy("symbol", hour, "source").agg(
        F.min_by("price", "event_id").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "event_id").alias("close"), F.count("*").cast("double").alias("volume")
    )
    there = {"main_marts.fct_ohlcv_daily": t.bars, "ohlcv_daily": t.bars_raw, "ohlcv_hourly": hourly, "main_marts.mart_signals_daily": t.panel.select(*SD, "close")}
    return there.get


@query(
    "src_08_panels",
    """select 'daily' as name, count(*) as n from bars union all select 'hourly', count(*) from (select distinct symbol, source, date_trunc('hour', ts) from ticks) x
    union all select 'signals', count(*) from panel union all select unnest(['mev', 'order_book', 'tweet', 'wallet']), 0""",
)
def src_08_panels(t):
    each = [panels.load(t.spark, name, finder(t)).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name in sorted(panels.PANELS)]
    return reduce(lambda a, b: a.unionByName(b), each)


@query("src_10_dispatch", "select 'daily' as kind, symbol, date, close from bars where symbol = 'CLICK' union all select 'signals', symbol, date, close from panel where symbol in ('1-URGENT', '5-LOW')", "close")
def src_10(t):
    daily = panels.strategy_panel(t.spark, "daily", ["click"], finder(t))
    wide = panels.strategy_panel(t.spark, "signals", ["1-urgent", "5-Low"], finder(t))
    return daily.select(F.lit("daily").alias("kind"), *SD, "close").unionByName(wide.select(F.lit("signals").alias("kind"), *SD, "close"))


# ---- regime signals

WIDE = "select date, max(case when symbol = '1-URGENT' then close end) as m2sl, max(case when symbol = '2-HIGH' then close end) as walcl, max(case when symbol = '3-MEDIUM' then close end) / 1e5 as dgs10, max(case when symbol = '5-LOW' then close end) / 1e5 as t10yie from panel group by date"
LIQUIDITY = f"""select week, idx as "index", idx - lag(idx, 12) over (order by week) as momentum from (select week, (raw - avg(raw) over ()) / case when stddev_samp(raw) over () > 1e-12 then stddev_samp(raw) over () else 1 end as idx from
    (select week, (a - avg(a) over ()) / (stddev_samp(a) over () + 1e-12) + (b - avg(b) over ()) / (stddev_samp(b) over () + 1e-12) - (c - avg(c) over ()) / (stddev_samp(c) over () + 1e-12) as raw from
    (select * from (select week, ln(m2sl) - ln(lag(m2sl, 52) over o) as a, ln(walcl) - ln(lag(walcl, 52) over o) as b, (dgs10 - t10yie) - lag(dgs10 - t10yie, 52) over o as c from
    (select cast(date_trunc('week', date) as date) as week, max_by(m2sl, date) filter (m2sl is not null) as m2sl, max_by(walcl, date) filter (walcl is not null) as walcl, max_by(dgs10, date) filter (dgs10 is not null) as dgs10,
    max_by(t10yie, date) filter (t10yie is not null) as t10yie from ({WIDE}) x group by 1) y window o as (order by week)) z where a is not null and b is not null and c is not null) g) r) i"""


def wide_macro(t):
    one = lambda s, n, by=1.0: (F.max(F.when(F.col("symbol") == s, F.col("close"))) / by).alias(n)
    return t.panel.groupBy("date").agg(one("1-URGENT", "m2sl"), one("2-HIGH", "walcl"), one("3-MEDIUM", "dgs10", 1e5), one("5-LOW", "t10yie", 1e5))


@query("dp_20_liquidity_series", LIQUIDITY, '"index" momentum')
def dp_20_series(t):
    return sg.liquidity_series(wide_macro(t)).select("week", "index", "momentum")


@query(
    "dp_20_liquidity_rule",
    f"""select case when n <= 17 or m is null then 0 when m > 0 then 1 else -1 end::bigint as signal, case when n <= 17 or m is null then 'MISSING' when m > 0 then 'expanding' else 'contracting' end as label
    from (select (select count(*) from ({LIQUIDITY}) l) as n, (select momentum from ({LIQUIDITY}) k order by week desc limit 1) as m) x""",
)
def dp_20_rule(t):
    return sg.liquidity_signal(wide_macro(t))


COVERED = {"active_addresses": "1.0", "fees_usd": "walcl", "hashrate": "case when day(date) % 5 = 0 then m2sl end", "nupl": "case when date < date '1992-01-15' then dgs10 end"}


@query(
    "dp_20_cycle_columns",
    "select name from (" + " union all ".join(f"select '{n}' as name, count({c}) as n, stddev_samp({c}) as s from ({WIDE}) w_{n}" for n, c in COVERED.items()) + ") x where n >= 30 and s > 1e-12",
)
def dp_20_columns(t):
    """The columns that the cycle signal takes: covered and not constant. A valuation of a few days is not covered."""
    _, vary = sg.usable(wide_onchain(t))
    return t.spark.createDataFrame([(c,) for c in vary], "name string")


def wide_onchain(t):
    return wide_macro(t).select(
        "date", F.when(F.dayofmonth("date") % 5 == 0, F.col("m2sl")).alias("hashrate"), F.lit(1.0).alias("active_addresses"), F.col("walcl").alias("fees_usd"),
        F.when(F.col("date") < "1992-01-15", F.col("dgs10")).alias("nupl"),
    )


CYCLE_INDEX = f"""select week, idx as "index", idx - lag(idx, 12) over (order by week) as momentum from (select week, (raw - avg(raw) over ()) / stddev_samp(raw) over () as idx from (select week, (h - avg(h) over ()) / (stddev_samp(h) over () + 1e-12) + (f - avg(f) over ()) / (stddev_samp(f) over () + 1e-12) as raw from
    (select cast(date_trunc('week', date) as date) as week, max_by(h, date) as h, max_by(f, date) as f from (select date, last_value(case when day(date) % 5 = 0 then m2sl end ignore nulls) over o as h, last_value(walcl ignore nulls) over o as f from ({WIDE}) w
    window o as (order by date rows unbounded preceding)) x where h is not null and f is not null group by 1) y) z) i"""


@query("dp_20_cycle_series", CYCLE_INDEX, '"index" momentum')
def dp_20_cycle(t):
    filled, vary = sg.usable(wide_onchain(t).drop("nupl"))
    return sg.cycle_series(filled, vary).select("week", "index", "momentum")


# ---- posts

NAMED = "select tweet_id, unnest(list_distinct(regexp_extract_all(text, '\\$([A-Z]{2,10})\\b', 1))) as symbol from tweets"
UNIVERSE = "select unnest(['VIEW', 'CLIC', 'ETH']) as symbol"
KNOWN = "select concat('user', cast(c_custkey as varchar)) as handle, case when c_custkey % 3 = 0 then 'kol' else 'trader' end as entity_type from customer where c_custkey < 20"
LIKE = lambda words: " + ".join(f"case when lower(text) like '%{w}%' then 1 else 0 end" for w in words)


def social_signals():
    from tidemark.functions import text as tx

    return f"""select date, coalesce(symbol, '_all') as symbol, count(*) as mention_count, count(kol) as kol_mention_count, sum(bull)::bigint as bullish_keyword_count, sum(bear)::bigint as bearish_keyword_count, count(distinct handle) as unique_accounts
    from (select p.*, {LIKE(tx.BULLISH)} as bull, {LIKE(tx.BEARISH)} as bear, k.handle as kol, n.symbol from tweets p left join (select * from ({NAMED}) n where symbol in ({UNIVERSE})) n on n.tweet_id = p.tweet_id
    left join (select handle from ({KNOWN}) a where entity_type = 'kol') k on k.handle = p.handle) x group by 1, 2"""


NOW = "2024-01-20"


def pipeline(t):
    c = t.customer.filter("c_custkey < 20")
    known = c.select(F.concat(F.lit("user"), F.col("c_custkey").cast("string")).alias("handle"), F.when(F.col("c_custkey") % 3 == 0, "kol").otherwise("trader").alias("entity_type"))
    posts = t.tweets.select(F.col("tweet_id").cast("string").alias("tweet_id"), "handle", F.col("posted_at").cast("timestamp_ntz").alias("posted_at"), "text")
    universe = t.spark.createDataFrame([("view",), ("CLIC",), ("ETH",)], "symbol string")
    return social.run(posts, known, universe, now=F.lit(NOW).cast("timestamp_ntz"))


@query("dp_11_entities", f"select cast(tweet_id as varchar) as tweet_id, unnest(['cashtag', 'symbol']) as entity_type, symbol as entity_value from ({NAMED}) n union all select cast(tweet_id as varchar), 'sol_domain', lower(regexp_extract(text, '(?i)\\b([\\w-]{{2,32}}\\.sol)\\b', 1)) from tweets where text like '%.sol%'")
def dp_11_entities(t):
    return pipeline(t).entities


@query("dp_11_accounts", f"select distinct handle, 'trader' as entity_type, 0.3 as confidence, 'import_discovered' as source, false as active from tweets where handle not in (select handle from ({KNOWN}) k)", "confidence")
def dp_11_accounts(t):
    return pipeline(t).accounts


@query("dp_11_signals", social_signals())
def dp_11_signals(t):
    return pipeline(t).signals


@query(
    "dp_11_alerts",
    f"""with mentions_of as (select cast(p.tweet_id as varchar) as tweet_id, p.handle, p.posted_at, n.symbol from tweets p join ({NAMED}) n on n.tweet_id = p.tweet_id),
    firsts as (select symbol, min(posted_at) as posted_at from mentions_of group by 1),
    recent as (select * from mentions_of where posted_at >= timestamp '{NOW}' - interval 7 day),
    groups as (select a.symbol, a.posted_at from recent a join recent b on a.symbol = b.symbol and b.posted_at between a.posted_at and a.posted_at + interval 1 hour group by a.symbol, a.posted_at, a.tweet_id having count(distinct b.handle) >= 3),
    days as (select *, row_number() over (partition by symbol order by date desc) as r from ({social_signals()}) s where symbol <> '_all'),
    base as (select symbol, count(*) as n, avg(case when r > 1 then mention_count end) as m, stddev_pop(case when r > 1 then mention_count end) as s, max_by(mention_count, date) as latest, max(date) as date from days where r <= 30 group by 1)
    select concat('spike-', symbol, '-', cast(date as varchar)) as tweet_id, '_system' as handle, 'symbol_spike' as alert_type, case when (latest - m) / s >= 3 then 'high' else 'medium' end as severity, symbol, cast(date as timestamp) as posted_at from base where n >= 3 and s > 0 and (latest - m) / s >= 2
    union all select min(tweet_id), min_by(handle, tweet_id), 'kol_cluster_mention', 'medium', symbol, posted_at from recent where (symbol, posted_at) in (select (symbol, min(posted_at)) from groups group by symbol) group by symbol, posted_at
    union all select min(tweet_id), min_by(handle, tweet_id), 'new_token_call', 'low', symbol, posted_at from mentions_of where (symbol, posted_at) in (select (symbol, posted_at) from firsts where posted_at >= timestamp '{NOW}' - interval 7 day) group by symbol, posted_at""",
)
def dp_11_alerts(t):
    return pipeline(t).alerts
