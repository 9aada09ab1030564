"""Projections, aggregations, top-k, set operations, scalar functions, data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import relational as rel
from tidemark.operators import series as ts
from tidemark.operators.selection import quantiles
from tidemark.plans.registry import query


def sgn(direction: str = "direction"):
    return F.when(F.col(direction) == "inflow", 1).otherwise(-1)


# ---- projections and filters


@query("prj_01_staging", "select upper(event_type) as symbol, cast(ts as date) as date, cast(value as double) as price, lower(event_type) as handle from events", "price")
def prj_01(t):
    return t.events.select(F.upper("event_type").alias("symbol"), F.col("ts").cast("date").alias("date"), F.col("value").cast("double").alias("price"), F.lower("event_type").alias("handle"))


@query("prj_02_normalize_address", "select chain, case when chain in ('arbitrum', 'ethereum') then lower(upper(address)) else upper(address) end as address from registry")
def prj_02(t):
    return t.registry.select("chain", tx.normalize_address(F.upper("address"), F.col("chain")).alias("address"))


@query("prj_03_source_rank", "select source, case source when 'binance' then 1 when 'coinbase' then 2 when 'coingecko' then 3 else 4 end::bigint as rank, count(*) as n from ticks group by 1, 2")
def prj_03(t):
    return t.ticks.groupBy("source", rel.source_rank(F.col("source")).alias("rank")).agg(F.count("*").alias("n"))


@query("prj_04_active", "select address, chain from registry where active = true")
def prj_04(t):
    return t.registry.filter("active").select("address", "chain")


@query("prj_05_latest_snapshot", "select symbol, rank from assets where as_of_date = (select max(as_of_date) from assets) order by rank limit 3")
def prj_05(t):
    last = t.assets.agg(F.max("as_of_date").alias("as_of_date"))
    return t.assets.join(F.broadcast(last), "as_of_date").orderBy("rank").limit(3).select("symbol", "rank")  # one row


@query("prj_06_membership", "select symbol, date, close from bars where symbol in (select symbol from assets where active)", "close")
def prj_06(t):
    return t.bars.join(t.assets.filter("active").select("symbol"), "symbol", "left_semi").select("symbol", "date", "close")


@query("prj_07_symbol_filter", "select symbol, date, close from bars where upper(symbol) in ('CLICK', 'VIEW')", "close")
def prj_07(t):
    wanted = ["click", "View"]
    return t.bars.filter(F.upper("symbol").isin(*[s.upper() for s in wanted])).select("symbol", "date", "close")


@query("prj_08_half_open_range", "select chain, count(*) as n from transfers where block_time >= timestamp '1997-01-01' and block_time < timestamp '1997-02-01' group by chain")
def prj_08(t):
    return t.transfers.filter("block_time >= timestamp_ntz '1997-01-01' and block_time < timestamp_ntz '1997-02-01'").groupBy("chain").agg(F.count("*").alias("n"))


@query("prj_09_book_features", "select event_id, cast(ts as date) as date, date_trunc('hour', ts) as hour, bid_notional_bps_25 + ask_notional_bps_25 as depth from books", "depth")
def prj_09(t):
    return t.books.select("event_id", F.col("ts").cast("date").alias("date"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), (F.col("bid_notional_bps_25") + F.col("ask_notional_bps_25")).alias("depth"))


WATCHED = "case when direction = 'inflow' then coalesce(nullif(to_address, ''), from_address) else coalesce(nullif(from_address, ''), to_address) end"


def watched():
    side = lambda a, b: F.coalesce(F.nullif(a, F.lit("")), b)
    to, fr = F.col("to_address"), F.col("from_address")
    return F.when(F.col("direction") == "inflow", side(to, fr)).otherwise(side(fr, to))


@query("prj_10_watched_side", f"select {WATCHED} as watched, count(*) as n from transfers group by 1")
def prj_10(t):
    return t.transfers.groupBy(watched().alias("watched")).agg(F.count("*").alias("n"))


@query("prj_11_material", "select tx_hash, transfer_index, amount from transfers where amount >= 45 or amount_usd >= 90000", "amount")
def prj_11(t):
    return t.transfers.filter("amount >= 45 or amount_usd >= 90000").select("tx_hash", "transfer_index", "amount")


@query("prj_12_oi_usd", """select o.symbol, o.exchange, o.ts, case when unit = 'usd_notional' then open_interest when unit in ('coin', 'contracts') then open_interest * p.close else open_interest end as usd
    from open_interest o left join panel p on o.symbol = p.symbol and cast(o.ts as date) = p.date""", "usd")  # fmt: skip
def prj_12(t):
    o = t.open_interest.withColumn("date", F.col("ts").cast("date"))
    usd = F.when(F.col("unit").isin("coin", "contracts"), F.col("open_interest") * F.col("close")).otherwise(F.col("open_interest"))
    return o.join(t.panel.select("symbol", "date", "close"), ["symbol", "date"], "left").select("symbol", "exchange", "ts", usd.alias("usd"))


@query("prj_13_event_scope", "select distinct date from calendar where scope in ('DEFI', 'BTC') or category = 'macro'")
def prj_13(t):
    return t.calendar.filter("scope in ('DEFI', 'BTC') or category = 'macro'").select("date").distinct()


@query("prj_14_drop_null", "select tx_hash, transfer_index, amount_usd from transfers where amount_usd is not null", "amount_usd")
def prj_14(t):
    return t.transfers.dropna(subset=["amount_usd"]).select("tx_hash", "transfer_index", "amount_usd")


LEX = {"bull": tx.BULLISH, "bear": tx.BEARISH}
HITS = {k: " + ".join(f"cast(contains(lower(text), '{w}') as int)" for w in v) for k, v in LEX.items()}


@query("prj_15_net_sentiment", f"select date, sum({HITS['bull']} - ({HITS['bear']}))::bigint as net from tweets where text <> 'gm' group by date")
def prj_15(t):
    net = tx.keyword_hits(F.col("text"), tx.BULLISH) - tx.keyword_hits(F.col("text"), tx.BEARISH)
    return t.tweets.filter("text <> 'gm'").groupBy("date").agg(F.sum(net).alias("net"))


@query("prj_16_pass_through", "select address, chain, identity_id from links")
def prj_16(t):
    return t.links.select("address", "chain", "identity_id")


@query("prj_17_since_cutoff", "select tweet_id, handle, posted_at from tweets where posted_at >= timestamp '2024-01-20' order by posted_at desc, tweet_id")
def prj_17(t):
    return t.tweets.filter("posted_at >= timestamp_ntz '2024-01-20'").select("tweet_id", "handle", "posted_at").orderBy(F.desc("posted_at"), "tweet_id")


@query("prj_18_label_regex", "select address, label from registry where regexp_matches(lower(label), '(0001|supplier#.*7$)')")
def prj_18(t):
    return t.registry.filter(F.lower("label").rlike("(0001|supplier#.*7$)")).select("address", "label")


# ---- aggregations


@query("ag_01_pivot_metrics", """select date, max(case when series_id = 'M_F' then value end) as m_f, max(case when series_id = 'M_O' then value end) as m_o, max(case when series_id = 'M_P' then value end) as m_p
    from macro group by date""", "m_f m_o m_p")  # fmt: skip
def ag_01(t):
    return rel.pivot_metrics(t.macro, "date", "series_id", "value", ["M_F", "M_O", "M_P"]).select("date", F.col("M_F").alias("m_f"), F.col("M_O").alias("m_o"), F.col("M_P").alias("m_p"))


@query("ag_02_arg_max", "select symbol, cast(ts as date) as date, max_by(mid, event_id) as last_mid, avg(mid) as avg_mid, count(*) as n from books group by 1, 2", "last_mid avg_mid")
def ag_02(t):
    return t.books.groupBy("symbol", F.col("ts").cast("date").alias("date")).agg(F.max_by("mid", "event_id").alias("last_mid"), F.avg("mid").alias("avg_mid"), F.count("*").alias("n"))


@query("ag_03_flows", """select chain, date, count(*) as n, sum(case when direction = 'inflow' then 1 else 0 end)::bigint as n_in, sum(case when direction = 'inflow' then coalesce(amount_usd, amount) else 0 end) as v_in,
    sum(case when direction = 'inflow' then 1 else -1 end * coalesce(amount_usd, amount)) as net from transfers group by chain, date""", "v_in net")  # fmt: skip
def ag_03(t):
    value, into = F.coalesce("amount_usd", "amount"), F.col("direction") == "inflow"
    return t.transfers.groupBy("chain", "date").agg(F.count("*").alias("n"), F.count_if(into).alias("n_in"), F.sum(F.when(into, value).otherwise(0)).alias("v_in"), F.sum(sgn() * value).alias("net"))


@query("ag_04_entity_flows", """select f.chain, sum(case when entity_type = 'smart_money' then amount * case when direction = 'inflow' then 1 else -1 end end) as smart_net, sum(case when entity_type = 'insider' then amount end) as insider_volume,
    count(case when entity_type = 'kol' and direction = 'inflow' then 1 end) as kol_buys from transfers f join registry r on f.chain = r.chain and f.from_address = r.address group by f.chain""", "smart_net insider_volume")  # fmt: skip
def ag_04(t):
    j = t.transfers.join(t.registry.withColumnRenamed("address", "from_address"), ["chain", "from_address"])
    kind = F.col("entity_type")
    return j.groupBy("chain").agg(F.sum(F.when(kind == "smart_money", F.col("amount") * sgn())).alias("smart_net"), F.sum(F.when(kind == "insider", F.col("amount"))).alias("insider_volume"), F.count(F.when((kind == "kol") & (F.col("direction") == "inflow"), 1)).alias("kol_buys"))


@query("ag_05_shared_counterparty", """select to_address, count(distinct identity_id) as identities from transfers f join links l on f.chain = l.chain and f.from_address = l.address group by to_address having count(distinct identity_id) >= 2""")
def ag_05(t):
    j = t.transfers.join(t.links.withColumnRenamed("address", "from_address"), ["chain", "from_address"])
    return j.groupBy("to_address").agg(F.countDistinct("identity_id").alias("identities")).filter("identities >= 2")


@query("ag_06_oi_across", "select symbol, ts, count(exchange) as exchanges, sum(open_interest) as total from open_interest group by symbol, ts", "total")
def ag_06(t):
    return t.open_interest.groupBy("symbol", "ts").agg(F.count("exchange").alias("exchanges"), F.sum("open_interest").alias("total"))


@query("ag_07_book_across", "select symbol, date_trunc('hour', ts) as hour, avg(mid) as mid, avg(spread_bps) as spread, avg(imbalance_bps_25) as imbalance, sum(bid_notional_bps_25) as bids from books group by 1, 2", "mid spread imbalance bids")
def ag_07(t):
    return t.books.groupBy("symbol", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.avg("mid").alias("mid"), F.avg("spread_bps").alias("spread"), F.avg("imbalance_bps_25").alias("imbalance"), F.sum("bid_notional_bps_25").alias("bids"))


@query("ag_08_daily_blocks", "select date, count(*) as blocks, sum(value_eth) as total, avg(value_eth) as mean, max(value_eth) as top from blocks group by date", "total mean top")
def ag_08(t):
    return t.blocks.groupBy("date").agg(F.count("*").alias("blocks"), F.sum("value_eth").alias("total"), F.avg("value_eth").alias("mean"), F.max("value_eth").alias("top"))


@query("ag_09_event_flags", "select date, count(*) as events, max(case when effect = 'positive' then 1 else 0 end)::bigint as positive, max(case when effect = 'negative' then 1 else 0 end)::bigint as negative from calendar group by date")
def ag_09(t):
    flag = lambda v: F.max(F.when(F.col("effect") == v, 1).otherwise(0)).alias(v)
    return t.calendar.groupBy("date").agg(F.count("*").alias("events"), flag("positive"), flag("negative"))


@query("ag_10_account_activity", "select handle, date, count(*) as tweets, sum(like_count)::bigint as likes, sum(retweet_count)::bigint as retweets from tweets group by 1, 2")
def ag_10(t):
    return t.tweets.groupBy("handle", "date").agg(F.count("*").alias("tweets"), F.sum("like_count").alias("likes"), F.sum("retweet_count").alias("retweets"))


@query("ag_11_direction_score", """select from_address, (b - s) / nullif(n, 0) as ratio, case when (b - s) / nullif(n, 0) > 0.5 then 1.0 when (b - s) / nullif(n, 0) > 0 then 0.5 else 0.0 end as score
    from (select from_address, sum(case when direction = 'inflow' then 1 else 0 end)::double as b, sum(case when direction = 'outflow' then 1 else 0 end)::double as s, count(*) as n from transfers group by 1) x""", "ratio score")  # fmt: skip
def ag_11(t):
    g = t.transfers.groupBy("from_address").agg(F.try_divide(F.sum(sgn().cast("double")), F.count("*")).alias("ratio"))
    return g.withColumn("score", F.when(F.col("ratio") > 0.5, 1.0).when(F.col("ratio") > 0, 0.5).otherwise(0.0))


@query("ag_12_ledger", "select chain, from_address, sum(case when direction = 'inflow' then amount else -amount end) as balance from transfers where date <= date '1999-12-31' group by 1, 2 having sum(case when direction = 'inflow' then amount else -amount end) <> 0", "balance")
def ag_12(t):
    return t.transfers.filter("date <= date '1999-12-31'").groupBy("chain", "from_address").agg(F.sum(sgn() * F.col("amount")).alias("balance")).filter("balance <> 0")


@query("ag_13_counterparty_matrix", "select chain, from_address, coalesce(nullif(to_address, ''), 'unknown') as counterparty, sum(case when direction = 'inflow' then amount else 0 end) as got, sum(case when direction = 'outflow' then amount else 0 end) as sent from transfers group by 1, 2, 3", "got sent")
def ag_13(t):
    other = F.coalesce(F.nullif(F.col("to_address"), F.lit("")), F.lit("unknown")).alias("counterparty")
    side = lambda d: F.sum(F.when(F.col("direction") == d, F.col("amount")).otherwise(0.0))
    return t.transfers.groupBy("chain", "from_address", other).agg(side("inflow").alias("got"), side("outflow").alias("sent"))


@query("ag_14_mention_signals", f"""select date, symbol, count(*) as mentions, count(case when user_id % 10 = 0 then 1 end) as kol_mentions, sum(bull)::bigint as bull, sum(bear)::bigint as bear, count(distinct handle) as accounts
    from (select *, {HITS['bull']} as bull, {HITS['bear']} as bear, unnest(case when len(regexp_extract_all(text, '\\$([A-Z]{{2,10}})', 1)) = 0 then ['_ALL'] else list_distinct(regexp_extract_all(text, '\\$([A-Z]{{2,10}})', 1)) end) as symbol from tweets) x group by 1, 2""")  # fmt: skip
def ag_14(t):
    tags = F.array_distinct(F.regexp_extract_all("text", F.lit(tx.CASHTAG), F.lit(1)))
    e = t.tweets.withColumn("symbol", F.explode(F.when(F.size(tags) == 0, F.array(F.lit("_ALL"))).otherwise(tags)))
    return e.groupBy("date", "symbol").agg(F.count("*").alias("mentions"), F.count_if(F.col("user_id") % 10 == 0).alias("kol_mentions"), F.sum(tx.keyword_hits(F.col("text"), tx.BULLISH)).alias("bull"), F.sum(tx.keyword_hits(F.col("text"), tx.BEARISH)).alias("bear"), F.countDistinct("handle").alias("accounts"))


@query("ag_15_spike_table", "select symbol, date, volume, (volume - m) / s as z from bars join (select symbol, avg(volume) as m, stddev_pop(volume) as s from bars group by symbol) x using (symbol) where s > 0 and (volume - m) / s >= 1.5", "volume z")
def ag_15(t):
    stats = t.bars.groupBy("symbol").agg(F.avg("volume").alias("m"), F.stddev_pop("volume").alias("s")).filter("s > 0")
    return t.bars.join(stats, "symbol").withColumn("z", (F.col("volume") - F.col("m")) / F.col("s")).filter("z >= 1.5").select("symbol", "date", "volume", "z")


@query("ag_17_capacity_quantile", """select symbol, volume as q05 from (select symbol, volume, row_number() over (partition by symbol order by volume) - 1 as r, count(*) over (partition by symbol) as n from panel) x where r = floor((n - 1) * 0.05 + 0.5)""", "q05")
def ag_17(t):
    return quantiles(t.panel, ["symbol"], "volume", [0.05], "nearest").select("symbol", F.col("q0").alias("q05"))


@query("ag_18_weekly", "select symbol, cast(date_trunc('week', date) as date) as week, max_by(close, date) as close, sum(volume) as volume, avg(high) as high from panel group by 1, 2", "close volume high")
def ag_18(t):
    return ts.resample_week(t.panel, ["symbol"], "date", ["close"], ["volume"], ["high"])


MONTHLY = "select symbol, cast(date_trunc('month', date) as date) as month, max_by(close, date) as close, sum(volume) as volume, min_by(open, date) as open, max(high) as high, min(low) as low from panel group by 1, 2"


def monthly(t):
    return t.panel.groupBy("symbol", F.trunc("date", "month").alias("month")).agg(F.max_by("close", "date").alias("close"), F.sum("volume").alias("volume"), F.min_by("open", "date").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"))


@query("ag_19_monthly_mom", f"select symbol, month, close, close / nullif(lag(close) over (partition by symbol order by month), 0) - 1 as mom, last_day(month) > date '2001-08-02' as partial from ({MONTHLY}) x", "close mom")
def ag_19(t):
    m = monthly(t)
    return m.select("symbol", "month", "close", ts.pct_change("close", ts.w("symbol", "month")).alias("mom"), (F.last_day("month") > F.lit("2001-08-02").cast("date")).alias("partial"))


@query("ag_20_monthly_bars", MONTHLY, "close volume open high low")
def ag_20(t):
    return monthly(t)


@query("ag_21_daily_ohlc", "select symbol, date, min_by(price, event_id) as open, max(price) as high, min(price) as low, max_by(price, event_id) as close from ticks group by 1, 2", "open high low close")
def ag_21(t):
    return t.ticks.groupBy("symbol", "date").agg(F.min_by("price", "event_id").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "event_id").alias("close"))


MOM = f"select *, close / nullif(lag(close) over (partition by symbol order by month), 0) - 1 as mom, lag(volume) over (partition by symbol order by month) as before from ({MONTHLY}) x"


def symbol_mom(t):
    win = ts.w("symbol", "month")
    return monthly(t).withColumn("mom", ts.pct_change("close", win)).withColumn("before", F.lag("volume").over(win))


@query("ag_22_symbol_mom", f"select symbol, month, mom from ({MOM}) y", "mom")
def ag_22(t):
    return symbol_mom(t).select("symbol", "month", "mom")


@query("ag_23_market_mom", f"select month, avg(mom) as equal, sum(mom * before) / nullif(sum(case when mom is not null then before end), 0) as weighted, count(case when mom > 0 then 1 end) as n_up, count(case when mom < 0 then 1 end) as n_down, count(mom) as n_symbols from ({MOM}) y group by month", "equal weighted")
def ag_23(t):
    m, known = F.col("mom"), F.col("mom").isNotNull()
    return symbol_mom(t).groupBy("month").agg(F.avg(m).alias("equal"), F.try_divide(F.sum(m * F.col("before")), F.sum(F.when(known, F.col("before")))).alias("weighted"), F.count_if(m > 0).alias("n_up"), F.count_if(m < 0).alias("n_down"), F.count(m).alias("n_symbols"))


@query("ag_24_trailing_windows", f"""select symbol, case when n >= 6 then avg(case when r <= 3 then close end) end as recent, case when n >= 6 then avg(case when r between 4 and 6 then close end) end as prior
    from (select *, row_number() over (partition by symbol order by month desc) as r, count(*) over (partition by symbol) as n from ({MONTHLY}) x where last_day(month) <= date '2001-08-02') y group by symbol, n""", "recent prior")  # fmt: skip
def ag_24(t):
    full = monthly(t).filter(F.last_day("month") <= F.lit("2001-08-02").cast("date")).withColumn("r", F.row_number().over(ts.w("symbol", F.desc("month"))))
    part = lambda lo, hi: F.when(F.count("*") >= 6, F.avg(F.when(F.col("r").between(lo, hi), F.col("close"))))
    return full.groupBy("symbol").agg(part(1, 3).alias("recent"), part(4, 6).alias("prior"))


@query("ag_25_breadth", "select date, avg(case when ma is not null then case when close > ma then 1.0 else 0.0 end end) as share, count(ma) as n from (select date, close, case when count(close) over w >= 5 then avg(close) over w end as ma from bars window w as (partition by symbol order by date rows between 4 preceding and current row)) x group by date", "share")
def ag_25(t):
    ma = t.bars.withColumn("ma", ts.rolling("close", ts.w("symbol", "date"), 5))
    return ma.groupBy("date").agg(F.avg(F.when(F.col("ma").isNotNull(), (F.col("close") > F.col("ma")).cast("double"))).alias("share"), F.count("ma").alias("n"))


@query("ag_26_regime_forward_stats", """select regime, h, count(r) as n, avg(r) as mean, quantile_cont(r, 0.5) as median, quantile_cont(r, 0.25) as p25, avg(case when r > 0 then 1.0 when r is not null then 0.0 end) as hit from
    (select regime, unnest([5::bigint, 20]) as h, unnest([r5, r20]) as r from (select case when close > avg(close) over w then 'up' else 'down' end as regime, lead(close, 5) over o / close - 1 as r5, lead(close, 20) over o / close - 1 as r20 from panel
    window w as (partition by symbol order by date rows between 19 preceding and current row), o as (partition by symbol order by date)) x) y group by 1, 2""", "mean median p25 hit")  # fmt: skip
def ag_26(t):
    o = ts.w("symbol", "date")
    p = t.panel.select(F.when(F.col("close") > F.avg("close").over(o.rowsBetween(-19, 0)), "up").otherwise("down").alias("regime"), *[(F.lead("close", h).over(o) / F.col("close") - 1).alias(f"r{h}") for h in (5, 20)])
    long = p.select("regime", F.explode(F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"r{h}").alias("r")) for h in (5, 20)])).alias("x")).select("regime", "x.*")
    stats = long.groupBy("regime", "h").agg(F.count("r").alias("n"), F.avg("r").alias("mean"), F.avg(F.when(F.col("r").isNotNull(), (F.col("r") > 0).cast("double"))).alias("hit"))
    q = quantiles(long, ["regime", "h"], "r", [0.5, 0.25]).select("regime", "h", F.col("q0").alias("median"), F.col("q1").alias("p25"))
    return stats.join(q, ["regime", "h"], "left")


@query("ag_27_concentration", "select date, sum(share * share) as hhi, sum(case when r <= 3 then share else 0 end) as top3, count(*) as n from (select date, volume / sum(volume) over (partition by date) as share, row_number() over (partition by date order by volume desc, symbol) as r from bars) x group by date", "hhi top3")
def ag_27(t):
    share = F.col("volume") / F.sum("volume").over(ts.Window.partitionBy("date"))
    x = t.bars.select("date", share.alias("share"), F.row_number().over(ts.w("date", [F.desc("volume"), F.col("symbol")])).alias("r"))
    return x.groupBy("date").agg(F.sum(F.col("share") ** 2).alias("hhi"), F.sum(F.when(F.col("r") <= 3, F.col("share")).otherwise(0.0)).alias("top3"), F.count("*").alias("n"))


@query("ag_28_dominance", "select date, 100 * sum(case when symbol = 'CLICK' then close * volume else 0 end) / nullif(sum(close * volume), 0) as dominance from bars group by date", "dominance")
def ag_28(t):
    value = F.col("close") * F.col("volume")
    return t.bars.groupBy("date").agg(F.try_divide(100 * F.sum(F.when(F.col("symbol") == "CLICK", value).otherwise(0.0)), F.sum(value)).alias("dominance"))


RET = "select symbol, date, close / nullif(lag(close) over (partition by symbol order by date), 0) - 1 as r from panel"


def returns(t):
    return t.panel.withColumn("r", ts.pct_change("close", ts.w("symbol", "date")))


@query("ag_29_risk_metrics", f"select symbol, avg(r) / nullif(stddev_samp(r), 0) * sqrt(365) as sharpe, avg(r) / nullif(stddev_samp(case when r < 0 then r end), 0) * sqrt(365) as sortino, avg(case when r > 0 then 1.0 else 0.0 end) as hit from ({RET}) x where r is not null group by symbol", "sharpe sortino hit")
def ag_29(t):
    r = F.col("r")
    down = F.stddev_samp(F.when(r < 0, r))
    return returns(t).filter("r is not null").groupBy("symbol").agg((F.try_divide(F.avg(r), F.stddev_samp(r)) * 365**0.5).alias("sharpe"), (F.try_divide(F.avg(r), down) * 365**0.5).alias("sortino"), F.avg((r > 0).cast("double")).alias("hit"))


BENCH = f"select s.symbol, s.date, s.r, b.r as rb from ({RET}) s join (select date, avg(r) as r from ({RET}) y group by date) b using (date) where s.r is not null and b.r is not null"


@query("ag_30_vol_matched_ir", f"select symbol, avg(r - rb * ss / nullif(sb, 0)) / nullif(stddev_samp(r - rb * ss / nullif(sb, 0)), 0) * sqrt(365) as ir from ({BENCH}) x join (select symbol, stddev_samp(r) as ss, stddev_samp(rb) as sb from ({BENCH}) z group by symbol) y using (symbol) group by symbol", "ir")
def ag_30(t):
    r = returns(t).filter("r is not null")
    x = r.join(r.groupBy("date").agg(F.avg("r").alias("rb")), "date")
    x = x.join(x.groupBy("symbol").agg(F.try_divide(F.stddev_samp("r"), F.stddev_samp("rb")).alias("k")), "symbol").withColumn("e", F.col("r") - F.col("rb") * F.col("k"))
    return x.groupBy("symbol").agg((F.try_divide(F.avg("e"), F.stddev_samp("e")) * 365**0.5).alias("ir"))


@query("ag_31_equal_weight", f"select date, avg(r) as r from ({RET}) x group by date", "r")
def ag_31(t):
    return returns(t).groupBy("date").agg(F.avg("r").alias("r"))


@query("ag_32_cross_correlation", """select lag, corr(x, y) as c, count(*) as n from (select a.lag, a.close as x, b.close as y from (select symbol, i, close, unnest(range(-3, 4)) as lag from (select symbol, close, row_number() over (partition by symbol order by date) as i from panel) u where symbol = '1-URGENT') a
    join (select symbol, close, row_number() over (partition by symbol order by date) as i from panel) b on b.symbol = '2-HIGH' and b.i = a.i + a.lag) z group by lag""", "c")  # fmt: skip
def ag_32(t):
    i = t.panel.withColumn("i", F.row_number().over(ts.w("symbol", "date")))
    a = i.filter("symbol = '1-URGENT'").select("i", F.col("close").alias("x"), F.explode(F.sequence(F.lit(-3), F.lit(3))).alias("lag")).withColumn("j", F.col("i") + F.col("lag"))
    return a.join(i.filter("symbol = '2-HIGH'").select(F.col("i").alias("j"), F.col("close").alias("y")), "j").groupBy("lag").agg(F.corr("x", "y").alias("c"), F.count("*").alias("n"))


@query("ag_33_coverage", "select symbol, count(distinct date) as days, min(date) as first, max(date) as last from bars_raw group by symbol")
def ag_33(t):
    return t.bars_raw.groupBy("symbol").agg(F.countDistinct("date").alias("days"), F.min("date").alias("first"), F.max("date").alias("last"))


@query("ag_34_freshness", "select source, max(date) as latest, count(*) as n, date_diff('day', max(date), date '2024-02-01') > 3 as stale from bars_raw group by source")
def ag_34(t):
    return t.bars_raw.groupBy("source").agg(F.max("date").alias("latest"), F.count("*").alias("n"), (F.datediff(F.lit("2024-02-01").cast("date"), F.max("date")) > 3).alias("stale"))


@query("ag_35_table_counts", "select 'events' as name, count(*) as n from events union all select 'orders', count(*) from orders union all select 'transfers', count(*) from transfers")
def ag_35(t):
    one = lambda n: getattr(t, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n")
    return one("events").unionByName(one("orders")).unionByName(one("transfers"))


@query("ag_36_cursors", "select symbol, least(min(case when date < date '2024-01-15' then date end), min(case when date >= date '2024-01-15' then date end)) as earliest, greatest(max(case when date < date '2024-01-15' then date end), max(case when date >= date '2024-01-15' then date end)) as latest from bars group by symbol")
def ag_36(t):
    agg = lambda d, s: d.groupBy("symbol").agg(F.min("date").alias(f"lo{s}"), F.max("date").alias(f"hi{s}"))
    prior, fresh = agg(t.bars.filter("date < date '2024-01-15'"), 1), agg(t.bars.filter("date >= date '2024-01-15'"), 2)
    return prior.join(fresh, "symbol", "full").select("symbol", F.least("lo1", "lo2").alias("earliest"), F.greatest("hi1", "hi2").alias("latest"))


@query("ag_37_depth", """select book_id, mid, (ask - bid) / mid * 10000 as spread_bps, levels, sum(case when side = 'bid' and price >= mid * (1 - 0.0025) then price * qty else 0 end) as bids25, sum(case when side = 'ask' and price <= mid * (1 + 0.0025) then price * qty else 0 end) as asks25 from
    (select *, (bid + ask) / 2 as mid from (select *, max(case when side = 'bid' then price end) over b as bid, min(case when side = 'ask' then price end) over b as ask, count(*) over b as levels from levels window b as (partition by book_id)) x where bid is not null and ask is not null and bid < ask) y group by book_id, mid, bid, ask, levels""", "mid spread_bps bids25 asks25")  # fmt: skip
def ag_37(t):
    side = lambda s: F.col("side") == s
    best = t.levels.groupBy("book_id").agg(F.max(F.when(side("bid"), F.col("price"))).alias("bid"), F.min(F.when(side("ask"), F.col("price"))).alias("ask"), F.count("*").alias("levels")).filter("bid < ask").withColumn("mid", (F.col("bid") + F.col("ask")) / 2)
    near = lambda s, ok: F.sum(F.when(side(s) & ok, F.col("price") * F.col("qty")).otherwise(0.0))
    return t.levels.join(best, "book_id").groupBy("book_id", "mid", ((F.col("ask") - F.col("bid")) / F.col("mid") * 10000).alias("spread_bps"), "levels").agg(near("bid", F.col("price") >= F.col("mid") * (1 - 0.0025)).alias("bids25"), near("ask", F.col("price") <= F.col("mid") * (1 + 0.0025)).alias("asks25"))


@query("ag_38_panel_history", "select min(date) as first, max(date) as last, date_diff('day', min(date), max(date)) as span, count(distinct symbol) as symbols, date_diff('day', min(date), max(date)) >= 365 as enough from panel")
def ag_38(t):
    span = F.datediff(F.max("date"), F.min("date"))
    return t.panel.agg(F.min("date").alias("first"), F.max("date").alias("last"), span.alias("span"), F.countDistinct("symbol").alias("symbols"), (span >= 365).alias("enough"))


@query("ag_39_latest_depth", "select symbol, depth, row_number() over (order by depth desc, symbol) as place from (select symbol, max_by(bid_notional_bps_25, event_id) as depth from books group by symbol) x", "depth")
def ag_39(t):
    last = t.books.groupBy("symbol").agg(F.max_by("bid_notional_bps_25", "event_id").alias("depth"))
    return last.withColumn("place", F.row_number().over(ts.Window.orderBy(F.desc("depth"), "symbol")))  # a row a symbol


@query("ag_40_per_exchange", "select exchange, count(*) as n, count(distinct symbol) as symbols from books group by exchange")
def ag_40(t):
    return t.books.groupBy("exchange").agg(F.count("*").alias("n"), F.countDistinct("symbol").alias("symbols"))


@query("ag_41_complete", "select coalesce(bool_and(f.from_address is not null), false) as complete, count(*) as n from registry r left join (select distinct chain, from_address from transfers) f on f.chain = r.chain and f.from_address = r.address where active")
def ag_41(t):
    seen = t.transfers.select("chain", F.col("from_address").alias("address")).distinct().withColumn("seen", F.lit(True))
    return t.registry.filter("active").join(seen, ["chain", "address"], "left").agg(F.coalesce(F.bool_and(F.coalesce("seen", F.lit(False))), F.lit(False)).alias("complete"), F.count("*").alias("n"))


@query("ag_42_recent_drift", "select symbol, regr_slope(close, r) as slope from (select symbol, close, -row_number() over (partition by symbol order by date desc) as r, row_number() over (partition by symbol order by date desc) as k from panel) x where k <= 730 group by symbol", "slope")
def ag_42(t):
    k = t.panel.withColumn("k", F.row_number().over(ts.w("symbol", F.desc("date")))).filter("k <= 730")
    return k.groupBy("symbol").agg(F.regr_slope("close", -F.col("k")).alias("slope"))


# ---- top-k


@query("tk_01_top_adv", "select symbol, avg(close * volume) as adv from panel group by symbol order by adv desc, symbol limit 3", "adv")
def tk_01(t):
    return t.panel.groupBy("symbol").agg(F.avg(F.col("close") * F.col("volume")).alias("adv")).orderBy(F.desc("adv"), "symbol").limit(3)


@query("tk_02_top_months", f"select symbol, month, mom from ({MOM}) y where mom is not null order by mom desc, symbol, month limit 10", "mom")
def tk_02(t):
    return symbol_mom(t).filter("mom is not null").orderBy(F.desc("mom"), "symbol", "month").limit(10).select("symbol", "month", "mom")


WEEK = "select symbol, max_by(close, date) / nullif(max_by(close, date) filter (where date <= date '2001-07-26'), 0) - 1 as r7 from panel group by symbol"


@query("tk_03_gainers_losers", f"select symbol, r7, g, l from (select symbol, r7, row_number() over (order by r7 desc, symbol) as g, row_number() over (order by r7, symbol) as l from ({WEEK}) x) y where g <= 2 or l <= 2", "r7")
def tk_03(t):
    x = t.panel.groupBy("symbol").agg((F.try_divide(F.max_by("close", "date"), F.max_by(F.col("close"), F.when(F.col("date") <= F.lit("2001-07-26").cast("date"), F.col("date")))) - 1).alias("r7"))
    g, l = F.row_number().over(ts.Window.orderBy(F.desc("r7"), "symbol")), F.row_number().over(ts.Window.orderBy("r7", "symbol"))  # a row a symbol
    return x.withColumn("g", g).withColumn("l", l).filter("g <= 2 or l <= 2")


@query("tk_04_tightest_books", "select symbol, exchange, spread_bps from (select symbol, exchange, max_by(spread_bps, event_id) as spread_bps from books group by 1, 2) x order by spread_bps, symbol, exchange limit 5", "spread_bps")
def tk_04(t):
    return t.books.groupBy("symbol", "exchange").agg(F.max_by("spread_bps", "event_id").alias("spread_bps")).orderBy("spread_bps", "symbol", "exchange").limit(5)


@query("tk_05_largest_basis", "select symbol, date, basis from (select symbol, date, (d.price_usd / b.close - 1) * 10000 as basis from dex d join bars b using (symbol, date)) x order by abs(coalesce(basis, 0)) desc, symbol, date, basis limit 10", "basis")
def tk_05(t):
    j = t.dex.join(t.bars.select("symbol", "date", "close"), ["symbol", "date"]).select("symbol", "date", ((F.col("price_usd") / F.col("close") - 1) * 10000).alias("basis"))
    return j.orderBy(F.desc(F.abs(F.coalesce("basis", F.lit(0.0)))), "symbol", "date", "basis").limit(10)


@query("tk_06_leaders", """select symbol, c13, row_number() over (order by c13 desc, symbol) as place from (select symbol, week, close / nullif(lag(close, 13) over (partition by symbol order by week), 0) - 1 as c13, max(week) over () as latest from (select symbol, cast(date_trunc('week', date) as date) as week, max_by(close, date) as close from panel group by 1, 2) x) y where week = latest""", "c13")
def tk_06(t):
    weekly = ts.resample_week(t.panel, ["symbol"], "date", ["close"])
    c = weekly.withColumn("c13", ts.pct_change("close", ts.w("symbol", "week"), 13)).join(F.broadcast(weekly.agg(F.max("week").alias("week"))), "week")  # one row
    return c.select("symbol", "c13", F.row_number().over(ts.Window.orderBy(F.desc("c13"), "symbol")).alias("place"))


@query("tk_07_ordered_panel", "select symbol, date, close from bars order by symbol, date", "close")
def tk_07(t):
    return t.bars.select("symbol", "date", "close").orderBy("symbol", "date")


@query("tk_08_bounded_extract", "select tx_hash, transfer_index, block_time from transfers order by block_time desc, tx_hash, transfer_index limit 5000")
def tk_08(t):
    return t.transfers.select("tx_hash", "transfer_index", "block_time").orderBy(F.desc("block_time"), "tx_hash", "transfer_index").limit(5000)


@query("tk_09_nearest_holder", "select min(concat(lpad(cast(floor(abs(s_acctbal - 5000) * 100) as bigint)::varchar, 12, '0'), s_name)) as nearest from supplier where s_acctbal <> 0 and abs(s_acctbal - 5000) / greatest(abs(5000), 1) <= 0.2")
def tk_09(t):
    gap = F.abs(F.col("s_acctbal") - 5000)
    key = F.concat(F.lpad(F.floor(gap * 100).cast("long").cast("string"), 12, "0"), "s_name")
    return t.supplier.filter((F.col("s_acctbal") != 0) & (gap / 5000 <= 0.2)).agg(F.min(key).alias("nearest"))


# ---- set operations


@query("so_01_unified_cursors", "select 'bars' as domain, concat(symbol, ':', source) as entity_key, cast(max(date) as varchar) as latest from bars_raw group by symbol, source union all select 'macro', series_id, cast(max(date) as varchar) from macro group by series_id union all select 'tweets', handle, cast(max(date) as varchar) from tweets group by handle")
def so_01(t):
    part = lambda d, name, key: d.groupBy(key.alias("entity_key")).agg(F.max("date").cast("string").alias("latest")).select(F.lit(name).alias("domain"), "entity_key", "latest")
    return part(t.bars_raw, "bars", F.concat_ws(":", "symbol", "source")).unionByName(part(t.macro, "macro", F.col("series_id"))).unionByName(part(t.tweets, "tweets", F.col("handle")))


@query("so_02_spine", "select symbol, cast(ts as date) as date from books union select symbol, date from dex")
def so_02(t):
    return t.books.select("symbol", F.col("ts").cast("date").alias("date")).union(t.dex.select("symbol", "date")).distinct()


@query("so_03_tagged_union", "select 'dex' as tag, symbol, count(*) as n from dex group by symbol union all select 'bar', symbol, count(*) from bars group by symbol")
def so_03(t):
    tag = lambda d, n: d.groupBy("symbol").agg(F.count("*").alias("n")).select(F.lit(n).alias("tag"), "symbol", "n")
    return tag(t.dex, "dex").unionByName(tag(t.bars, "bar"))


@query("so_04_concat_unique", "select date from (select date from bars where date < date '2024-01-20' union all select date from bars where date > date '2024-01-10') x group by date")
def so_04(t):
    return t.bars.filter("date < date '2024-01-20'").union(t.bars.filter("date > date '2024-01-10'")).dropDuplicates(["date"]).select("date")


@query("so_05_keep_last", "select symbol, date, max_by(close, source) as close from bars_raw group by 1, 2", "close")
def so_05(t):
    return rel.keep_last(t.bars_raw.select("symbol", "date", "source", "close"), ["symbol", "date"], ["source"]).select("symbol", "date", "close")


@query("so_06_distinct", "select distinct symbol, source from bars_raw")
def so_06(t):
    return t.bars_raw.select("symbol", "source").distinct()


# ---- scalar functions


@query("sf_01_strings", "select tweet_id, lower(trim(concat(' @', handle, ' '), ' @')) as handle, substr(cast(posted_at as varchar), 1, 10) as day, upper(handle) as loud from tweets")
def sf_01(t):
    return t.tweets.select("tweet_id", tx.handle(F.concat(F.lit(" @"), "handle", F.lit(" "))).alias("handle"), F.substring(F.col("posted_at").cast("string"), 1, 10).alias("day"), F.upper("handle").alias("loud"))


@query("sf_02_entities", """select kind, value, count(*) as n from (select tweet_id, 'cashtag' as kind, unnest(list_distinct(regexp_extract_all(text, '\\$([A-Z]{2,10})\\b', 1))) as value from tweets union all
    select tweet_id, 'symbol', unnest(list_distinct(regexp_extract_all(text, '\\$([A-Z]{2,10})\\b', 1))) from tweets union all select tweet_id, 'sol_domain', unnest(list_distinct(regexp_extract_all(text, '\\b([a-zA-Z0-9_-]+\\.sol)\\b', 1))) from tweets) x group by 1, 2""")  # fmt: skip
def sf_02(t):
    return t.tweets.select(F.explode(tx.entities(F.col("text"))).alias("e")).groupBy("e.kind", "e.value").agg(F.count("*").alias("n"))


@query("sf_03_keywords", f"select tweet_id, ({HITS['bull']})::bigint as bull, ({HITS['bear']})::bigint as bear from tweets")
def sf_03(t):
    return t.tweets.select("tweet_id", tx.keyword_hits(F.col("text"), tx.BULLISH).alias("bull"), tx.keyword_hits(F.col("text"), tx.BEARISH).alias("bear"))


@query("sf_04_dates", "select distinct date, cast(date_trunc('week', date) as date) as week, cast(date_trunc('month', date) as date) as month, last_day(date) as month_end, isodow(date) - 1 as weekday, weekofyear(date) as iso_week, date_diff('day', date '1995-01-01', date) as days, cast(date_trunc('year', date) as date) as year from panel")
def sf_04(t):
    return t.panel.select("date", F.date_trunc("week", "date").cast("date").alias("week"), F.trunc("date", "month").alias("month"), F.last_day("date").alias("month_end"), F.weekday("date").alias("weekday"), F.weekofyear("date").alias("iso_week"), F.datediff("date", F.lit("1995-01-01").cast("date")).alias("days"), F.trunc("date", "year").alias("year")).distinct()


@query("sf_05_math", "select event_id, ln(value + 1) as ln, exp(value / 1000) as ex, sqrt(value) as root, greatest(10, least(50, value)) as clipped, value / nullif(user_id, 0) as ratio, value * 10000 as bps from events", "ln ex root clipped ratio bps")
def sf_05(t):
    v = F.col("value")
    return t.events.select("event_id", F.log1p(v).alias("ln"), F.exp(v / 1000).alias("ex"), F.sqrt(v).alias("root"), F.greatest(F.lit(10.0), F.least(F.lit(50.0), v)).alias("clipped"), F.try_divide(v, "user_id").alias("ratio"), (v * 10000).alias("bps"))


@query("sf_06_conditional", "select tx_hash, transfer_index, coalesce(nullif(amount_usd, 0), amount, 0) as v, case when amount > 40 then 'big' when amount > 20 then 'mid' else 'small' end as size from transfers", "v")
def sf_06(t):
    return t.transfers.select("tx_hash", "transfer_index", F.coalesce(F.nullif(F.col("amount_usd"), F.lit(0.0)), F.nanvl("amount", F.lit(0.0))).alias("v"), F.when(F.col("amount") > 40, "big").when(F.col("amount") > 20, "mid").otherwise("small").alias("size"))


@query("sf_07_arrays", "select l_orderkey, list_has_any(list(l_linenumber), [6, 7]) as any67, count(*) filter (where l_quantity > 30) as large, min(l_suppkey) filter (where l_suppkey % 2 = 1) as odd from lineitem group by 1")
def sf_07(t):
    g = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_linenumber").alias("n"), F.collect_set("l_suppkey").alias("s"), F.count_if(F.col("l_quantity") > 30).alias("large"))  # at most seven lines an order
    return g.select("l_orderkey", F.arrays_overlap("n", F.array(F.lit(6), F.lit(7))).alias("any67"), "large", F.array_min(F.filter("s", lambda x: x % 2 == 1)).alias("odd"))


@query("sf_08_json", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, concat('{\"id\":', cast(event_id as varchar), '}') as j from events")
def sf_08(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.to_json(F.struct(F.col("event_id").alias("id"))).alias("j"))


@query("sf_09_numeric_parse", "select event_id, case when event_id % 3 = 0 then -value when event_id % 3 = 1 then null else value end as v from events", "v")
def sf_09(t):
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("("), F.col("value").cast("string"), F.lit(")"))).when(F.col("event_id") % 3 == 1, "-").otherwise(F.concat(F.lit(" "), F.col("value").cast("string")))
    return t.events.select("event_id", tx.parse_number(raw).alias("v"))


HALVINGS = ["1996-01-01", "1998-01-01", "2000-01-01", "2002-01-01"]


@query("sf_10_cycle_progress", "select distinct date, date_diff('day', lo, date) / date_diff('day', lo, hi)::double as progress from panel join (values (date '1996-01-01', date '1998-01-01'), (date '1998-01-01', date '2000-01-01'), (date '2000-01-01', date '2002-01-01')) h(lo, hi) on date >= lo and date < hi", "progress")
def sf_10(t):
    d, out = F.col("date"), None
    for lo, hi in zip(HALVINGS, HALVINGS[1:], strict=False):
        lo, hi = F.lit(lo).cast("date"), F.lit(hi).cast("date")
        hit, v = (d >= lo) & (d < hi), F.datediff(d, lo) / F.datediff(hi, lo)
        out = F.when(hit, v) if out is None else out.when(hit, v)
    return t.panel.select("date", out.alias("progress")).filter("progress is not null").distinct()


@query("sf_11_lookup", "select entity_type, case entity_type when 'kol' then 'influencer' when 'exchange' then 'cex' else 'smart_money' end as kind, count(*) as n from registry group by 1, 2")
def sf_11(t):
    names = F.create_map(F.lit("kol"), F.lit("influencer"), F.lit("exchange"), F.lit("cex"))
    return t.registry.groupBy("entity_type", F.coalesce(F.try_element_at(names, F.col("entity_type")), F.lit("smart_money")).alias("kind")).agg(F.count("*").alias("n"))


@query("sf_12_tiers", "select case when v >= 50 then 'inflow' when v <= 10 then 'outflow' else 'flat' end as demand, count(*) as n from (select value as v from events) x group by 1")
def sf_12(t):
    v = F.col("value")
    return t.events.groupBy(F.when(v >= 50, "inflow").when(v <= 10, "outflow").otherwise("flat").alias("demand")).agg(F.count("*").alias("n"))


@query("sf_13_hash_id", "select s_suppkey, substr(sha256(s_name), 1, 16) as id from supplier")
def sf_13(t):
    return t.supplier.select("s_suppkey", F.substring(F.sha2("s_name", 256), 1, 16).alias("id"))


# ---- data quality: rows that break the rule


@query("dq_01_unique", "select symbol, date, count(*) as n from bars_raw group by 1, 2 having count(*) > 1")
def dq_01(t):
    return t.bars_raw.groupBy("symbol", "date").agg(F.count("*").alias("n")).filter("n > 1")


@query("dq_02_accepted_values", "select source, count(*) as n from bars_raw where source not in ('binance', 'coinbase', 'coingecko') group by source")
def dq_02(t):
    return t.bars_raw.filter(~F.col("source").isin(*rel.SOURCE_PRIORITY)).groupBy("source").agg(F.count("*").alias("n"))


@query("dq_03_accepted_range", "select s_suppkey, s_acctbal from supplier where s_acctbal < 0", "s_acctbal")
def dq_03(t):
    return t.supplier.filter("s_acctbal < 0").select("s_suppkey", "s_acctbal")


@query("dq_04_relationship", "select distinct to_address from transfers where to_address not in (select address from registry)")
def dq_04(t):
    return t.transfers.join(t.registry.select(F.col("address").alias("to_address")), "to_address", "left_anti").select("to_address").distinct()


@query("dq_05_future_dates", "select 'bars' as name, symbol as k, date from bars where date > date '2024-01-25' union all select 'panel', symbol, date from panel where date > date '2001-07-25'")
def dq_05(t):
    late = lambda d, n, day: d.filter(F.col("date") > F.lit(day).cast("date")).select(F.lit(n).alias("name"), F.col("symbol").alias("k"), "date")
    return late(t.bars, "bars", "2024-01-25").unionByName(late(t.panel, "panel", "2001-07-25"))


@query("dq_06_non_negative", "select count(case when volume < 0 then 1 end) as volume, count(case when close < 0 then 1 end) as price from panel")
def dq_06(t):
    return t.panel.agg(F.count_if(F.col("volume") < 0).alias("volume"), F.count_if(F.col("close") < 0).alias("price"))


@query("dq_07_source_freshness", "select source, case when age > 72 then 'error' when age > 36 then 'warn' else 'pass' end as status from (select source, date_diff('hour', max(ts), timestamp '2024-01-31 12:00:00') as age from ticks group by source) x")
def dq_07(t):
    age = F.expr("timestampdiff(HOUR, date_trunc('hour', max(ts)), timestamp '2024-01-31 12:00:00')")
    return t.ticks.groupBy("source").agg(age.alias("age")).select("source", F.when(F.col("age") > 72, "error").when(F.col("age") > 36, "warn").otherwise("pass").alias("status"))


@query("dq_08_in_universe", "select distinct symbol from bars where symbol not in (select symbol from assets where active)")
def dq_08(t):
    return t.bars.join(t.assets.filter("active").select("symbol"), "symbol", "left_anti").select("symbol").distinct()


# ---- sources, over data that Spark derives from the given tables


@query("src_01_typed_scan", "select o_orderkey, o_custkey, o_totalprice from orders", "o_totalprice")
def src_01(t):
    return t.spark.read.schema("o_orderkey long, o_custkey long, o_totalprice double").parquet(f"{t.sf_dir}/orders.parquet")


@query("src_06_watched_archive", "select tx_hash as signature, address, fee / 1e9 * 1000 as amount from (select f.tx_hash, max(f.amount * 1000) as fee, substr(min(concat(lpad(cast(f.transfer_index as string), 2, '0'), f.from_address)), 3) as address from transfers f where f.from_address in (select address from registry where active) group by 1) x", "amount")
def src_06(t):
    from tidemark.sources.posts import watched_archive

    watched = t.registry.filter("active").select("address")
    seen = t.transfers.join(watched.withColumnRenamed("address", "from_address"), "from_address", "left_semi")
    archive = seen.groupBy(F.col("tx_hash").alias("signature")).agg(F.max(F.col("amount") * 1000).alias("fee"), F.sort_array(F.collect_list(F.struct("transfer_index", F.col("from_address").alias("pubkey")))).alias("accounts"), F.min("block_time").alias("block_time"))
    return watched_archive(archive, watched).select("signature", "address", (F.col("amount") * 1000).alias("amount"))


@query("src_08_panel_loader", "select symbol, date, close from panel where symbol in ('1-URGENT', '5-LOW')", "close")
def src_08(t):
    return t.panel.filter(F.col("symbol").isin("1-URGENT", "5-LOW")).select("symbol", "date", "close")


@query("src_09_macro_panel", "select p.date, p.close, last_value(m.value ignore nulls) over (order by p.date rows unbounded preceding) as value from (select * from panel where symbol = '1-URGENT') p left join (select date, value from macro where series_id = 'M_P') m using (date)", "close value")
def src_09(t):
    j = t.panel.filter("symbol = '1-URGENT'").select("date", "close").join(t.macro.filter("series_id = 'M_P'").select("date", "value"), "date", "left")
    return j.select("date", "close", ts.ffill("value", ts.Window.orderBy("date")).alias("value"))  # a row a day


@query("src_11_series_normalise", "select distinct symbol, date, value from (select symbol, date, unnest(['close', 'volume']) as name, unnest([close, volume]) as value from panel) x where name = 'close'", "value")
def src_11(t):
    return t.panel.unpivot(["symbol", "date"], ["close", "volume"], "name", "value").filter("name = 'close' and not isnan(value)").select("symbol", "date", "value").distinct()


@query("src_13_universe", "select upper(event_type) as symbol, count(*) as n from events group by 1 union all select 'EXTRA', 0")
def src_13(t):
    seen = t.ticks.groupBy(F.upper("symbol").alias("symbol")).agg(F.count("*").alias("n"))
    configured = t.spark.createDataFrame([("extra", 0), ("click", 0)], "symbol string, n long").withColumn("symbol", F.upper("symbol"))  # the configuration
    return seen.unionByName(configured.join(seen.select("symbol"), "symbol", "left_anti"))
