"""Further forms of the operators: other modes, all inputs, the guards and fallbacks that the short queries leave out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import series as ts
from tidemark.operators import stores, wallet
from tidemark.operators import strategy as st
from tidemark.operators.selection import quantiles
from tidemark.plans.queries_basic import MOM, MONTHLY, RET, monthly, returns, symbol_mom
from tidemark.plans.queries_domain import DAILY, DAYS, FEAT, RANKED, REGIME, SCORE, SLEEVE, TARGET, TRADE, WEIGHT, S, macro_regime, oos_metrics, weighted
from tidemark.plans.queries_joins import OLD, SD
from tidemark.plans.registry import query

# ---- aggregations


@query(
    "ag_19_modes",
    """select symbol, month, total, total / nullif(lag(total) over o, 0) - 1 as total_mom, mean, mean / nullif(lag(mean) over o, 0) - 1 as mean_mom,
    last_day(month) > date '2001-08-02' as partial from (select symbol, cast(date_trunc('month', date) as date) as month, sum(close) as total,
    avg(close) as mean from panel group by 1, 2) x window o as (partition by symbol order by month)""",
    "total total_mom mean mean_mom",
)
def ag_19_modes(t):
    m = t.panel.groupBy("symbol", F.trunc("date", "month").alias("month")).agg(F.sum("close").alias("total"), F.avg("close").alias("mean"))
    o = ts.w("symbol", "month")
    partial = F.last_day("month") > F.lit("2001-08-02").cast("date")
    moms = [ts.pct_change(c, o).alias(f"{c}_mom") for c in ("total", "mean")]
    return m.select("symbol", "month", "total", "mean", *moms, partial.alias("partial"))


@query(
    "ag_23_volume_mom",
    f"select month, volume, volume / nullif(lag(volume) over (order by month), 0) - 1 as mom from (select month, sum(volume) as volume from ({MOM}) x where before > 0 group by month) y",
    "volume mom",
)
def ag_23_volume(t):
    """Monthly volume of the symbols that traded in their month before, and its change."""
    m = symbol_mom(t).filter("before > 0").groupBy("month").agg(F.sum("volume").alias("volume"))
    return m.withColumn("mom", ts.pct_change("volume", Window.orderBy("month")))  # a row a month


@query(
    "ag_24_modes",
    f"""select symbol, case when n >= 6 then sum(case when r <= 3 then volume end) end as recent_sum, case when n >= 6 then sum(case when r between 4 and 6 then volume end) end as prior_sum,
    case when n >= 6 then max(case when r = 1 then close end) end as recent_last, case when n >= 6 then max(case when r = 4 then close end) end as prior_last
    from (select *, row_number() over (partition by symbol order by month desc) as r, count(*) over (partition by symbol) as n from ({MONTHLY}) x
    where last_day(month) <= date '2001-08-02') y group by symbol, n""",
    "recent_sum prior_sum recent_last prior_last",
)
def ag_24_modes(t):
    full = monthly(t).filter(F.last_day("month") <= F.lit("2001-08-02").cast("date")).withColumn("r", F.row_number().over(ts.w("symbol", F.desc("month"))))
    r, enough = F.col("r"), F.count("*") >= 6
    total = lambda lo, hi: F.when(enough, F.sum(F.when(r.between(lo, hi), F.col("volume"))))
    last = lambda k: F.when(enough, F.max(F.when(r == k, F.col("close"))))
    return full.groupBy("symbol").agg(
        total(1, 3).alias("recent_sum"), total(4, 6).alias("prior_sum"), last(1).alias("recent_last"), last(4).alias("prior_last")
    )


@query(
    "ag_26_with_baseline",
    """select regime, h, count(r) as n, avg(r) as mean, quantile_cont(r, 0.75) as p75 from (select unnest([regime, 'all']) as regime, h, r from
    (select regime, unnest([5::bigint, 20]) as h, unnest([r5, r20]) as r from (select case when close > avg(close) over w then 'up' else 'down' end as regime,
    lead(close, 5) over o / close - 1 as r5, lead(close, 20) over o / close - 1 as r20 from panel
    window w as (partition by symbol order by date rows between 19 preceding and current row), o as (partition by symbol order by date)) x) y) z group by 1, 2""",
    "mean p75",
)
def ag_26_baseline(t):
    o = ts.w("symbol", "date")
    up = F.col("close") > F.avg("close").over(o.rowsBetween(-19, 0))
    p = t.panel.select(F.when(up, "up").otherwise("down").alias("regime"), *[(F.lead("close", h).over(o) / F.col("close") - 1).alias(f"r{h}") for h in (5, 20)])
    each = F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"r{h}").alias("r")) for h in (5, 20)])
    long = p.select(F.explode(F.array("regime", F.lit("all"))).alias("regime"), each.alias("x")).select("regime", F.explode("x").alias("x")).select("regime", "x.*")
    stats = long.groupBy("regime", "h").agg(F.count("r").alias("n"), F.avg("r").alias("mean"))
    q = quantiles(long, ["regime", "h"], "r", [0.75]).select("regime", "h", F.col("q0").alias("p75"))
    return stats.join(q, ["regime", "h"], "left")


@query(
    "ag_29_drawdown",
    f"""select symbol, max_drawdown, calmar, turnover, return_change from (select symbol, min(dd) as max_drawdown, avg(r) * 365 / nullif(abs(min(dd)), 0) as calmar, avg(abs(r - r0)) as return_change from (select symbol, r,
    coalesce(lag(r) over (partition by symbol order by date), 0) as r0, equity / max(equity) over (partition by symbol order by date rows unbounded preceding) - 1 as dd from
    (select symbol, date, r, exp(sum(ln(1 + r)) over (partition by symbol order by date rows unbounded preceding)) as equity from ({RET}) x where r is not null) y) z group by symbol) a
    join (select symbol, avg(dw) as turnover from ({TRADE}) t group by symbol) b using (symbol)""",
    "max_drawdown calmar turnover return_change",
)
def ag_29_drawdown(t):
    """A symbol's drawdown and Calmar ratio, its mean daily turnover in the book, and the mean change of its return from day to day."""
    o = ts.w("symbol", "date")
    e = returns(t).filter("r is not null").withColumn("equity", ts.compound("r", o))
    e = e.withColumn("dd", ts.drawdown("equity", o)).withColumn("r0", F.coalesce(F.lag("r").over(o), F.lit(0.0)))
    worst = F.min("dd")
    own = e.groupBy("symbol").agg(
        worst.alias("max_drawdown"), F.try_divide(F.avg("r") * 365, F.abs(worst)).alias("calmar"), F.avg(F.abs(F.col("r") - F.col("r0"))).alias("return_change")
    )
    traded = st.traded(weighted(t)).groupBy("symbol").agg(F.avg("dw").alias("turnover"))
    return own.join(traded, "symbol").select("symbol", "max_drawdown", "calmar", "turnover", "return_change")


@query(
    "ag_29_book",
    f"""select avg(net) / nullif(stddev_samp(net), 0) * sqrt(365) as sharpe, avg(net) / nullif(stddev_samp(case when net < 0 then net end), 0) * sqrt(365) as sortino,
    avg(case when net > 0 then 1.0 else 0.0 end) as hit, avg(turnover) as turnover from ({DAILY}) d""",
    "sharpe sortino hit turnover",
)
def ag_29_book(t):
    m = st.metrics(st.daily(weighted(t), S))
    return m.select(F.col("net_sharpe").alias("sharpe"), "sortino", "hit", "turnover")


LAGS = """select lag, corr(x, y) as c, count(*) as n from (select a.lag, a.close as x, b.close as y from (select symbol, i, close, unnest(range(-26, 27)) as lag from
    (select symbol, close, row_number() over (partition by symbol order by date) as i from panel) u where symbol = '1-URGENT') a
    join (select symbol, close, row_number() over (partition by symbol order by date) as i from panel) b on b.symbol = '2-HIGH' and b.i = a.i + a.lag) z group by lag having count(*) > 20"""


def lagged_correlation(t):
    i = t.panel.withColumn("i", F.row_number().over(ts.w("symbol", "date")))
    a = i.filter("symbol = '1-URGENT'").select("i", F.col("close").alias("x"), F.explode(F.sequence(F.lit(-26), F.lit(26))).alias("lag"))
    b = i.filter("symbol = '2-HIGH'").select(F.col("i").alias("j"), F.col("close").alias("y"))
    pairs = a.withColumn("j", F.col("i") + F.col("lag")).join(b, "j")
    return pairs.groupBy("lag").agg(F.corr("x", "y").alias("c"), F.count("*").alias("n")).filter("n > 20")


@query("ag_32_lags", LAGS, "c")
def ag_32_lags(t):
    return lagged_correlation(t)


@query("ag_32_best_lead", f"select max_by(lag, abs(c)) as lag, max(abs(c)) as c from ({LAGS}) x", "c")
def ag_32_best(t):
    return lagged_correlation(t).agg(F.max_by("lag", F.abs("c")).alias("lag"), F.max(F.abs("c")).alias("c"))


BAND = {10: "0.001", 25: "0.0025", 50: "0.005"}
BAND_SQL = ", ".join(
    f"sum(case when side = 'bid' and price >= mid * (1 - {p}) then price * qty else 0 end) as b{k}, sum(case when side = 'ask' and price <= mid * (1 + {p}) then price * qty else 0 end) as a{k}"
    for k, p in BAND.items()
)


@query(
    "ag_37_bands",
    f"""select book_id, bid, ask, mid, {", ".join(f"b{k}, a{k}, (b{k} - a{k}) / nullif(b{k} + a{k}, 0) as imbalance{k}" for k in BAND)} from (select book_id, bid, ask, mid, {BAND_SQL} from
    (select *, (bid + ask) / 2 as mid from (select *, max(case when side = 'bid' then price end) over b as bid, min(case when side = 'ask' then price end) over b as ask from levels
    window b as (partition by book_id)) x where bid is not null and ask is not null and bid < ask) y group by book_id, bid, ask, mid) z""",
    "bid ask mid " + " ".join(f"b{k} a{k} imbalance{k}" for k in BAND),
)
def ag_37_bands(t):
    best = lambda s, f: f(F.when(F.col("side") == s, F.col("price")))
    mids = t.levels.groupBy("book_id").agg(best("bid", F.max).alias("bid"), best("ask", F.min).alias("ask")).filter("bid < ask")
    mids = mids.withColumn("mid", (F.col("bid") + F.col("ask")) / 2)
    value, sums = F.col("price") * F.col("qty"), []
    for k, share in BAND.items():
        inside = {"b": F.col("price") >= F.col("mid") * (1 - float(share)), "a": F.col("price") <= F.col("mid") * (1 + float(share))}
        sums += [F.sum(F.when(F.col("side").startswith(n) & ok, value).otherwise(0.0)).alias(f"{n}{k}") for n, ok in inside.items()]
    books = t.levels.join(mids, "book_id").groupBy("book_id", "bid", "ask", "mid").agg(*sums)
    imbalance = [F.try_divide(F.col(f"b{k}") - F.col(f"a{k}"), F.col(f"b{k}") + F.col(f"a{k}")).alias(f"imbalance{k}") for k in BAND]
    return books.select("*", *imbalance)


@query(
    "ag_39_coverage",
    """select count(*) as n, count(m.mid) as books, count(b.total) as blocks, count(distinct case when m.mid is not null then d.symbol end) as symbols from dex d
    left join (select symbol, cast(ts as date) as date, avg(mid) as mid from books group by 1, 2) m on m.symbol = d.symbol and m.date = d.date
    left join (select date + 9000 as date, sum(value_eth) as total from blocks group by 1) b on b.date = d.date""",
)
def ag_39_coverage(t):
    mid = t.books.groupBy("symbol", F.col("ts").cast("date").alias("date")).agg(F.avg("mid").alias("mid"))
    total = t.blocks.groupBy(F.date_add("date", 9000).alias("date")).agg(F.sum("value_eth").alias("total"))
    mart = t.dex.join(mid, SD, "left").join(total, "date", "left")
    with_mid = F.when(F.col("mid").isNotNull(), F.col("symbol"))
    return mart.agg(F.count("*").alias("n"), F.count("mid").alias("books"), F.count("total").alias("blocks"), F.countDistinct(with_mid).alias("symbols"))


@query(
    "ag_41_cursors",
    """select chain, coalesce(bool_and(coalesce(done, false)), false) as complete, count(*) as n from (select r.chain, c.done from registry r
    left join (select chain, from_address, count(*) >= 20 as done from transfers group by 1, 2) c on c.chain = r.chain and c.from_address = r.address where active) x group by chain""",
)
def ag_41_cursors(t):
    history = t.transfers.groupBy("chain", F.col("from_address").alias("address")).agg((F.count("*") >= 20).alias("done"))
    joined = t.registry.filter("active").join(history, ["chain", "address"], "left")
    return joined.groupBy("chain").agg(F.coalesce(F.bool_and(F.coalesce("done", F.lit(False))), F.lit(False)).alias("complete"), F.count("*").alias("n"))


# ---- joins

CHAIN_OF = [("1-URGENT", "bitcoin"), ("2-HIGH", "ethereum"), ("3-MEDIUM", "solana"), ("4-NOT SPECIFIED", "ethereum")]


@query(
    "jn_03_signals_panel",
    f"""select p.symbol, p.date, p.close, oi.oi, oc.n as transfers, m.value as macro, e.events, w.net, x.likes from panel p
    left join (select symbol, cast(ts as date) as date, sum(open_interest) as oi from open_interest group by 1, 2) oi on oi.symbol = p.symbol and oi.date = p.date
    left join (select date, count(*) as n from transfers group by 1) oc on oc.date = p.date
    left join (select date, value from macro where series_id = 'M_F') m on m.date = p.date
    left join (select date - 9000 as date, count(*) as events from calendar group by 1) e on e.date = p.date
    left join (select * from (values {", ".join(str(x) for x in CHAIN_OF)}) v(symbol, chain)) c on c.symbol = p.symbol
    left join (select date, chain, sum(case when direction = 'inflow' then amount else -amount end) as net from transfers group by 1, 2) w on w.date = p.date and w.chain = c.chain
    left join (select cast(user_id % 5 + 1 as varchar) as tag, date - 9000 as date, sum(like_count)::bigint as likes from tweets group by 1, 2) x
    on x.tag = substr(p.symbol, 1, 1) and x.date = p.date
    where p.symbol in (select symbol from panel group by symbol having count(*) > 1 and symbol < '5')""",
    "close oi macro net",
)
def jn_03_signals(t):
    oi = t.open_interest.groupBy("symbol", F.col("ts").cast("date").alias("date")).agg(F.sum("open_interest").alias("oi"))
    onchain = t.transfers.groupBy("date").agg(F.count("*").alias("transfers"))
    macro = t.macro.filter("series_id = 'M_F'").select("date", F.col("value").alias("macro"))
    events = t.calendar.groupBy(F.date_sub("date", 9000).alias("date")).agg(F.count("*").alias("events"))
    chain_of = t.spark.createDataFrame(CHAIN_OF, "symbol string, chain string")  # a fixed map
    signed = F.when(F.col("direction") == "inflow", F.col("amount")).otherwise(-F.col("amount"))
    flows = t.transfers.groupBy("date", "chain").agg(F.sum(signed).alias("net"))
    tag = (F.col("user_id") % 5 + 1).cast("string").alias("tag")
    likes = t.tweets.groupBy(tag, F.date_sub("date", 9000).alias("date")).agg(F.sum("like_count").alias("likes"))
    universe = t.panel.groupBy("symbol").agg(F.count("*").alias("days")).filter("days > 1 and symbol < '5'")
    p = t.panel.select(*SD, "close").join(universe, "symbol", "left_semi").withColumn("tag", F.substring("symbol", 1, 1))
    for dim, on in ((oi, SD), (onchain, ["date"]), (macro, ["date"]), (events, ["date"]), (F.broadcast(chain_of), ["symbol"]), (flows, ["date", "chain"]), (likes, ["tag", "date"])):
        p = p.join(dim, on, "left")
    return p.select(*SD, "close", "oi", "transfers", "macro", "events", "net", "likes")


@query(
    "jn_05_by_entity_type",
    """select e.tweet_id, e.entity_value as address, e.entity_type, w.label, w.entity_type as wallet_type from mentions e left join registry w on
    (e.entity_type = 'eth_address' and lower(e.entity_value) = w.address) or (e.entity_type in ('sol_address', 'btc_address') and e.entity_value = w.address)
    where e.entity_type in ('sol_address', 'eth_address', 'btc_address')""",
)
def jn_05_types(t):
    """Addresses that posts name, with the wallet of each: only one kind of address is compared without case."""
    said = t.mentions.filter(F.col("entity_type").isin("sol_address", "eth_address", "btc_address"))
    key = F.when(F.col("entity_type") == "eth_address", F.lower("entity_value")).otherwise(F.col("entity_value"))
    wallets = t.registry.select(F.col("address").alias("_key"), "label", F.col("entity_type").alias("wallet_type"))
    return said.withColumn("_key", key).join(wallets, "_key", "left").select("tweet_id", F.col("entity_value").alias("address"), "entity_type", "label", "wallet_type")


FIVE = {
    "n_in": ("count(*)", "direction = 'inflow'"), "n_out": ("count(*)", "direction = 'outflow'"), "large": ("count(*)", "amount >= 40"),
    "usd": ("sum(amount_usd)", "amount_usd > 50000"), "senders": ("count(distinct from_address)", "asset = 'SOL'"),
}


@query(
    "jn_07_five_way",
    "select date, chain, " + ", ".join(f"coalesce({n}, 0) as {n}" for n in FIVE) + " from "
    + " full join ".join(f"(select date, chain, {agg} as {n} from transfers where {where} group by 1, 2) t_{n}" + (" using (date, chain)" if k else "") for k, (n, (agg, where)) in enumerate(FIVE.items())),
    "usd",
)
def jn_07_five(t):
    parts = [t.transfers.filter(where).groupBy("date", "chain").agg(F.expr(agg).alias(n)) for n, (agg, where) in FIVE.items()]
    return reduce(lambda a, b: a.join(b, ["date", "chain"], "full"), parts).fillna(0)


@query(
    "jn_17_event_study",
    """select title, symbol, pre, post, at_open, case when pre <> 0 and post is not null then post / pre - 1 end as change from (select title, symbol, avg(case when b.date < e.date then close end) as pre,
    avg(case when b.date > e.date then close end) as post, max(case when b.date = e.date then open end) as at_open from calendar e join bars b on b.date between e.date - 14 and e.date + 14 group by title, symbol) x""",
    "pre post at_open change",
)
def jn_17_study(t):
    near = F.sequence(F.date_sub("date", 14), F.date_add("date", 14))
    days = t.calendar.select("title", F.col("date").alias("day"), F.explode(near).alias("date"))  # an equi-join on each day near the event
    date, day = F.col("date"), F.col("day")
    x = t.bars.join(days, "date").groupBy("title", "symbol").agg(
        F.avg(F.when(date < day, F.col("close"))).alias("pre"), F.avg(F.when(date > day, F.col("close"))).alias("post"), F.max(F.when(date == day, F.col("open"))).alias("at_open")
    )
    change = F.when((F.col("pre") != 0) & F.col("post").isNotNull(), F.col("post") / F.col("pre") - 1)
    return x.withColumn("change", change)


# ---- keyed tables that are written and read again


@query(
    "snk_01_formats",
    "select 'csv' as format, count(*) as n, sum(close) as total from bars union all select 'parquet', count(*), sum(close) from bars",
    "total",
)
def snk_01_formats(t):
    folder, rows, out = stores.scratch(t.spark, "export"), t.bars.select(*SD, "close"), []
    rows.write.parquet(f"{folder}/parquet")
    rows.write.option("header", True).csv(f"{folder}/csv")
    read = {"parquet": t.spark.read.parquet(f"{folder}/parquet"), "csv": t.spark.read.option("header", True).schema(rows.schema).csv(f"{folder}/csv")}
    for name, df in read.items():
        out.append(df.agg(F.count("*").alias("n"), F.sum("close").alias("total")).select(F.lit(name).alias("format"), "n", "total"))
    return out[0].unionByName(out[1])


@query(
    "snk_06_merge_counts",
    """select (select count(*) from macro where date >= date '1999-01-01' and date < date '2000-01-01') as updated, (select count(*) from macro where date >= date '2000-01-01') as inserted,
    (select sum(case when date >= date '1999-01-01' then value * 2 else value end) from macro) as total""",
    "total",
)
def snk_06_counts(t):
    m = t.macro.select("series_id", "date", "value")
    other = m.filter("date >= date '1999-01-01'").withColumn("value", F.col("value") * 2)  # the other store's series
    store = stores.Store.create(m.filter("date < date '2000-01-01'"), stores.scratch(t.spark, "merge"), ["series_id", "date"], time="date")
    counts = store.counts(other)
    counts = t.spark.createDataFrame(counts.collect(), counts.schema)  # one row, taken before the merge
    store.upsert(other)
    store.upsert(other)  # again: nothing changes
    return counts.crossJoin(F.broadcast(store.read().agg(F.sum("value").alias("total"))))  # one row


@query(
    "snk_07_rerun",
    "select symbol, date, case when date >= date '2024-01-12' then close + 1 else close end as close from bars",
    "close",
)
def snk_07_rerun(t):
    b = t.bars.select(*SD, "close")
    store = stores.Store.create(b.filter(OLD), stores.scratch(t.spark, "incremental"), SD, time="date", period="day")
    for _ in range(2):  # the second run finds what the first has written
        store.merge_since(b.filter("date >= date '2024-01-12'").withColumn("close", F.col("close") + 1), "date", 7)
    return store.read()


@query(
    "snk_08_history",
    """select address, entity_type, valid_to is null as open from (select address, entity_type, case when c in (0, 1) then 1 end as valid_to from (select *, cast(substr(address, 2) as int) % 4 as c from registry) a where c <> 3
    union all select address, case when c = 1 then concat(entity_type, '2') else entity_type end, null from (select *, cast(substr(address, 2) as int) % 4 as c from registry) b where c in (1, 3)) x""",
)
def snk_08_history(t):
    c = F.substring("address", 2, 20).cast("int") % 4  # 0: vanishes, 1: changes, 2: stays, 3: is new
    at = lambda d: F.lit(d).cast("timestamp")
    r = t.registry.select("address", "entity_type", c.alias("c"))
    first = r.filter("c <> 3").select("address", "entity_type", at("2024-01-01").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"))
    changed = F.when(F.col("c") == 1, F.concat("entity_type", F.lit("2"))).otherwise(F.col("entity_type"))
    store = stores.Store.create(first, stores.scratch(t.spark, "history"), ["address"], buckets=4)
    for day in ("2024-02-01", "2024-02-02"):  # the same state again changes nothing
        store.snapshot(r.filter("c <> 0").select("address", changed.alias("entity_type")), ["entity_type"], at(day))
    return store.read().select("address", "entity_type", F.col("valid_to").isNull().alias("open"))


@query(
    "snk_11_promote",
    """select address, chain, case when address = 'w7' then true else active end as active, case when address = 'w7' then 1.0 else confidence end as confidence,
    (select count(*) > 0 from registry where address = 'w7') as matched from registry""",
    "confidence",
)
def snk_11_promote(t):
    r = t.registry.select("address", "chain", "active", "confidence")
    store = stores.Store.create(r, stores.scratch(t.spark, "accounts"), ["address"], buckets=4)
    promoted = r.filter("address = 'w7'").withColumn("active", F.lit(True)).withColumn("confidence", F.lit(1.0))
    matched = store.counts(promoted).select((F.col("updated") > 0).alias("matched"))
    matched = t.spark.createDataFrame(matched.collect(), matched.schema)  # one row, as it was before the update
    store.update(promoted, ["active", "confidence"])
    return store.read().crossJoin(F.broadcast(matched))  # one row


@query(
    "snk_10_json",
    f"select 'net' as name, avg(net) as value from ({DAILY}) d union all select 'nothing', null union all select 'turnover', avg(turnover) from ({DAILY}) e",
    "value",
)
def snk_10_json(t):
    d = st.daily(weighted(t), S).agg(F.avg("net").alias("net"), F.avg("turnover").alias("turnover"), F.lit(float("nan")).alias("nothing"))
    path = stores.scratch(t.spark, "report")
    stores.finite(d).write.option("ignoreNullFields", False).json(path)
    read = t.spark.read.schema("net double, turnover double, nothing double").json(path)
    return read.unpivot([], ["net", "turnover", "nothing"], "name", "value")


# ---- strategy


@query(
    "dp_01_open_interest_change",
    "select symbol, date, oi / nullif(lag(oi, 5) over (partition by symbol order by date), 0) - 1 as oi_change from (select symbol, cast(ts as date) as date, sum(open_interest) as oi from open_interest group by 1, 2) x",
    "oi_change",
)
def dp_01_oi(t):
    oi = t.open_interest.groupBy("symbol", F.col("ts").cast("date").alias("date")).agg(F.sum("open_interest").alias("oi"))
    return oi.select(*SD, ts.pct_change("oi", ts.w("symbol", "date"), 5).alias("oi_change"))


@query(
    "dp_05_benchmark_excess",
    """select a.symbol, a.date, a.fwd - b.fwd as excess from (select symbol, date, lead(close, 5) over (partition by symbol order by date) / nullif(close, 0) - 1 as fwd from panel) a
    left join (select symbol, date, lead(close, 5) over (partition by symbol order by date) / nullif(close, 0) - 1 as fwd from panel) b on b.date = a.date and b.symbol = '1-URGENT'""",
    "excess",
)
def dp_05_excess(t):
    return st.benchmark_excess(st.labels(t.panel, 5), "1-URGENT").select(*SD, F.col("fwd_vs_benchmark").alias("excess"))


LIMITED = f"select * from ({SCORE}) l where symbol in (select symbol from ({FEAT}) f group by symbol order by avg(adv) desc nulls last, symbol limit 3)"
RANKED_M = RANKED.replace(SCORE, LIMITED)
SLEEVE_M = f"select s.* exclude (sleeve), case when coalesce(m.regime_score >= -0.5, true) then sleeve else 0.0 end as sleeve, coalesce(m.regime_score >= -0.5, true) as active from ({SLEEVE.replace(RANKED, RANKED_M)}) s left join ({REGIME}) m on m.date = s.date"
TARGET_M = TARGET.replace(SLEEVE, SLEEVE_M)
WEIGHT_M = f"select * exclude (weight), case when active then weight else 0 end as weight from ({WEIGHT.replace(TARGET, TARGET_M)}) h"
DAILY_M = DAILY.replace(WEIGHT, WEIGHT_M)
MASKED = st.Strategy(min_adv=10_000.0, universe=3)


def masked(t):
    scored = st.score(st.features(t.panel.select(*SD, "close", "volume"), MASKED), MASKED)
    active = macro_regime(t).select("date", (F.col("regime_score") >= -0.5).alias("active"))
    return st.weights(scored.join(active, "date", "left"), MASKED)


@query("dp_06_masked_weights", f"select symbol, date, weight from ({WEIGHT_M}) w", "weight")
def dp_06_masked(t):
    return masked(t).select(*SD, "weight")


VOL = "median(case when sleeve <> 0 then vol end) over (partition by date)"
DIRECTIONAL = f"""select symbol, date, coalesce(last_value(case when isodow(date) = 5 then target end ignore nulls) over (partition by symbol order by date rows unbounded preceding), 0) as weight from
    (select *, sleeve * case when {VOL} > 1e-12 then greatest(0.1, least(5.0, 0.1 / sqrt(365) / {VOL})) else 1.0 end as target from
    (select f.symbol, f.date, f.vol, case when r.regime_score >= 0.3 then 1.0 when r.regime_score <= -0.3 then SHORT else 0.0 end as sleeve from ({FEAT}) f left join ({REGIME}) r on r.date = f.date) x) y"""


def directional(t, **how):
    s = st.Strategy(mode="directional", **how)
    return st.weights(st.score(st.features(t.panel, s).join(macro_regime(t), "date", "left"), s), s).select(*SD, "weight")


@query("dp_07_directional_weights", DIRECTIONAL.replace("SHORT", "-1.0"), "weight")
def dp_07_directional(t):
    return directional(t, long_z=-0.3, short_z=0.3)  # inverted bands are swapped


@query("dp_07_long_or_flat", DIRECTIONAL.replace("SHORT", "0.0"), "weight")
def dp_07_flat(t):
    return directional(t, long_z=0.3, short_z=-0.3, allow_short=False)


@query(
    "dp_09_full_sample",
    f"select -1::bigint as fold, avg(net) / nullif(stddev_samp(net), 0) * sqrt(365) as net_sharpe, count(*) as days from ({DAILY}) d",
    "net_sharpe",
)
def dp_09_full(t):
    """Where the sample is too short for a fold, the metrics of the whole of it."""
    return st.evaluate(st.daily(weighted(t), S), st.Strategy(min_adv=10_000.0, train=100_000)).select("fold", "net_sharpe", "days")


CAPACITY = "(select cap from (select cap, row_number() over (order by cap) - 1 as r, count(*) over () as n from (select coalesce(adv, 0) * 0.05 / greatest(abs(weight), 1e-12) as cap from ({}) w where weight <> 0) x where cap > 0) y where r = floor((n - 1) * 0.05 + 0.5))"


def rung(name, daily, weight):
    sharpe, ir = oos_metrics(daily)
    return f"select '{name}' as config, coalesce({sharpe} > {LEAST_SHARPE}, false) as sharpe_ok, coalesce({ir} > 0, false) as ir_ok, coalesce({CAPACITY.format(weight)} >= 20000, false) as capacity_ok"


LEAST_SHARPE = 0.5
RUNGS = "select *, sharpe_ok and ir_ok and capacity_ok as passed from ({}) r"
FIRST, SECOND = RUNGS.format(rung("base", DAILY, WEIGHT)), RUNGS.format(rung("masked", DAILY_M, WEIGHT_M))


@query("dp_10_ladder", f"{DAYS}, first_rung as ({FIRST}) select * from first_rung union all select * from ({SECOND}) s where not (select passed from first_rung)")
def dp_10_ladder(t):
    rungs = [("base", lambda: weighted(t), S), ("masked", lambda: masked(t), MASKED)]
    return st.ladder(rungs, LEAST_SHARPE, 0.0, 20_000.0)


# ---- wallets


BTC_LEGS = """select l_orderkey, l_linenumber - 1 as pos, cast(l_linenumber as bigint) as n, concat('w', cast(l_suppkey % 40 as varchar)) as address, l_quantity as value, false as coinbase, 'out' as side from lineitem where l_linestatus = 'O'
    union all select l_orderkey, l_linenumber - 1, cast(l_linenumber as bigint), concat('w', cast(l_partkey % 60 as varchar)), l_quantity, l_linenumber = 1, 'in' from lineitem where l_returnflag <> 'R'"""
BTC_SIDE = """select o.tx_hash, '{d}' as direction, o.n as leg, o.address, coalesce(f.free, case when f.head <> o.address then f.head else s.next_one end) as counterparty, o.value as amount from own o
    left join firsts f on f.tx_hash = o.tx_hash and f.side = '{other}' left join seconds s on s.tx_hash = o.tx_hash and s.side = '{other}' where o.side = '{mine}' and o.watched"""


@query(
    "dp_12_bitcoin_transfers",
    f"""with own as (select cast(l_orderkey as varchar) as tx_hash, x.*, address in (select address from registry where active) as watched from ({BTC_LEGS}) x where not coinbase),
    firsts as (select tx_hash, side, min_by(address, concat(lpad(cast(pos as varchar), 3, '0'), address)) as head, min_by(address, concat(lpad(cast(pos as varchar), 3, '0'), address)) filter (where not watched) as free from own group by 1, 2),
    seconds as (select o.tx_hash, o.side, min_by(o.address, concat(lpad(cast(o.pos as varchar), 3, '0'), o.address)) as next_one from own o join firsts f on f.tx_hash = o.tx_hash and f.side = o.side and o.address <> f.head group by 1, 2)
    {BTC_SIDE.format(d="inflow", mine="out", other="in")} union all {BTC_SIDE.format(d="outflow", mine="in", other="out")}""",
    "amount",
)
def dp_12_bitcoin(t):
    leg = lambda who: F.struct((F.col("l_linenumber") - 1).alias("at"), F.col("l_linenumber").alias("n"), F.concat(F.lit("w"), who.cast("string")).alias("address"), F.col("l_quantity").alias("value"), (F.col("l_linenumber") == 1).alias("coinbase"))
    side = lambda ok, who: F.sort_array(F.collect_list(F.when(ok, leg(who))))  # noqa: E731  a few lines an order
    tx_ = t.lineitem.groupBy(F.col("l_orderkey").cast("string").alias("tx_hash")).agg(
        F.transform(side(F.col("l_linestatus") == "O", F.col("l_suppkey") % 40), lambda x: x.withField("coinbase", F.lit(False))).alias("outputs"),
        side(F.col("l_returnflag") != "R", F.col("l_partkey") % 60).alias("inputs"),
    )
    return wallet.bitcoin_transfers(tx_, t.registry.filter("active").select("address"))


SOL = "concat('w', cast(l_suppkey as varchar))"


@query(
    "dp_13_solana_transfers",
    f"""with watched as (select address from registry where active),
    native as (select cast(l_orderkey as varchar) as tx_hash, 'SOL' as asset, {SOL} as address, l_linenumber as n, l_quantity - l_linenumber * 5 as delta from lineitem where {SOL} in (select * from watched)),
    tokens as (select cast(l_orderkey as varchar) as tx_hash, concat('m', cast(l_linenumber % 2 as varchar)) as asset, {SOL} as address, sum(cast(round(l_tax * 100) as int)) - sum(cast(round(l_discount * 100) as int)) as delta
    from lineitem where {SOL} in (select * from watched) group by 1, 2, 3),
    moved as (select tx_hash, asset, address, delta from native where delta <> 0 union all select tx_hash, asset, address, delta from tokens where delta <> 0)
    select tx_hash, asset, address, case when delta > 0 then 'inflow' else 'outflow' end as direction, abs(delta) as amount from moved
    union all select tx_hash, 'SOL', min_by(address, concat(lpad(cast(n as varchar), 3, '0'), address)), 'outflow', 0.0 from native where tx_hash not in (select tx_hash from moved) group by tx_hash""",
    "amount",
)
def dp_13_solana(t):
    who = F.concat(F.lit("w"), F.col("l_suppkey").cast("string"))
    token = lambda amount: F.collect_list(F.struct(who.alias("owner"), F.concat(F.lit("m"), (F.col("l_linenumber") % 2).cast("string")).alias("mint"), F.round(F.col(amount) * 100).alias("amount")))
    lines = F.sort_array(F.collect_list(F.struct("l_linenumber", who.alias("who"), (F.col("l_linenumber") * 5 * 1e9).alias("pre"), (F.col("l_quantity") * 1e9).alias("post"))))
    part = lambda name: F.transform(lines, lambda s: s[name]).alias({"who": "accounts"}.get(name, name))
    tx_ = t.lineitem.groupBy(F.col("l_orderkey").cast("string").alias("tx_hash")).agg(  # a few lines an order
        part("who"), part("pre"), part("post"),
        token("l_discount").alias("pre_tokens"), token("l_tax").alias("post_tokens"),
    )
    return wallet.solana_transfers(tx_, t.registry.filter("active").select("address"))


@query(
    "dp_14_evm_sides",
    """select tx_hash, 'outflow' as direction, from_address as address, to_address as counterparty, amount from transfers where from_address in (select address from registry where active) and chain = 'ethereum'
    union all select tx_hash, 'inflow', to_address, from_address, amount from transfers where to_address in (select address from registry where active) and chain = 'ethereum'""",
    "amount",
)
def dp_14_sides(t):
    raw = t.transfers.filter("chain = 'ethereum'").select("tx_hash", F.col("from_address").alias("sender"), F.col("to_address").alias("receiver"), (F.col("amount") * 1e18).alias("wei"))
    return wallet.evm_transfers(raw, t.registry.filter("active").select("address"))


# ---- posts, tiers, universe


POST = "concat('see 0x', upper(substr(h, 1, 40)), ' and BC1Q', substr(h, 1, 30), ' or 1', translate(substr(h, 1, 30), '0', '2'), ' then 9', translate(substr(h, 1, 39), '0', '3'), ' My-Name', substr(h, 1, 4), '.SOL at HTTPS://x.io/', substr(h, 1, 6), ' $ABC')"
FOUND = {
    "eth_address": "concat('0x', substr(h, 1, 40))", "bech32": "concat('bc1q', substr(h, 1, 30))", "legacy": "concat('1', translate(substr(h, 1, 30), '0', '2'))",
    "sol_address": "concat('9', translate(substr(h, 1, 39), '0', '3'))", "sol_domain": "concat('my-name', substr(h, 1, 4), '.sol')", "url": "concat('HTTPS://x.io/', substr(h, 1, 6))",
    "cashtag": "'ABC'", "symbol": "'ABC'",
}
KIND = {"bech32": "btc_address", "legacy": "btc_address"}


@query(
    "sf_02_addresses",
    " union all ".join(f"select c_custkey, '{KIND.get(k, k)}' as kind, {v} as value from (select c_custkey, sha256(c_name) as h from customer) x_{k}" for k, v in FOUND.items())
    # without a zero, a bech32 address could be a solana address too
    + " union all select c_custkey, 'sol_address', concat('BC1Q', substr(h, 1, 30)) from (select c_custkey, sha256(c_name) as h from customer) y where substr(h, 1, 30) not like '%0%'",
)
def sf_02_addresses(t):
    posts = t.customer.select("c_custkey", F.sha2("c_name", 256).alias("h")).select("c_custkey", F.expr(POST).alias("text"))
    return posts.select("c_custkey", F.explode(tx.entities(F.col("text"))).alias("e")).select("c_custkey", "e.kind", "e.value")


@query(
    "sf_12_ladders",
    """select c_custkey, case when trades < 10 then 'whale' when win >= 0.5 and hold >= 2 then 'smart_money' when win >= 0.25 then 'kol' else 'whale' end as kind,
    case when trades < 10 then 0.3 when win >= 0.5 and hold >= 2 then least(0.95, 0.5 + win * 0.5) when win >= 0.25 then 0.45 else 0.35 end as confidence,
    case when s >= 2 then 'Constructive' when s <= -2 then 'Defensive' else 'Neutral / mixed' end as stack, case when b >= 2 then 'Risk-on' when b <= -2 then 'Risk-off' else 'Mixed' end as headline
    from (select c_custkey, c_custkey % 25 as trades, (c_acctbal + 1000) / 11000 as win, c_custkey % 5 as hold, c_custkey % 3 - 1 + c_nationkey % 3 - 1 + c_custkey % 2 as s,
    case when c_acctbal / 100000 > 0.02 then 1 when c_acctbal / 100000 < -0.02 then -1 else 0 end + case when c_nationkey / 25 > 0.55 then 1 when c_nationkey / 25 < 0.45 then -1 else 0 end as b from customer) x""",
    "confidence",
)
def sf_12_ladders(t):
    c = t.customer
    kind, confidence = tx.wallet_tier((F.col("c_acctbal") + 1000) / 11000, F.col("c_custkey") % 25, F.col("c_custkey") % 5, 0.5)
    stack = tx.stack_label(F.col("c_custkey") % 3 - 1, F.col("c_nationkey") % 3 - 1, F.col("c_custkey") % 2)
    headline = tx.headline(F.col("c_acctbal") / 100000, F.col("c_nationkey") / 25)
    return c.select("c_custkey", kind.alias("kind"), confidence.alias("confidence"), stack.alias("stack"), headline.alias("headline"))


@query(
    "src_13_ranked_universe",
    """select symbol, rank, 'seen' as origin from (select symbol, rank, row_number() over (partition by symbol order by rank) as rn from (select upper(event_type) as symbol, row_number() over (order by n desc, event_type) as rank from
    (select event_type, count(*) as n from events group by 1 union all select upper(event_type), count(*) - 1 from events group by 1) x) y) z where rn = 1 union all select 'EXTRA', null, 'configured'""",
)
def src_13_ranked(t):
    n = t.events.groupBy("event_type").agg(F.count("*").alias("n"))
    listed = n.unionByName(n.select(F.upper("event_type").alias("event_type"), (F.col("n") - 1).alias("n")))
    ranked = listed.select(F.upper("event_type").alias("symbol"), F.row_number().over(Window.orderBy(F.desc("n"), "event_type")).alias("rank"))  # a row a symbol
    first = ranked.groupBy("symbol").agg(F.min("rank").alias("rank"))
    configured = t.spark.createDataFrame([("extra",), ("click",)], "symbol string").select(F.upper("symbol").alias("symbol"), F.lit(None).cast("int").alias("rank"))
    return first.withColumn("origin", F.lit("seen")).unionByName(configured.join(first, "symbol", "left_anti").withColumn("origin", F.lit("configured")))


@query(
    "dq_01_not_null",
    "select 'amount_usd' as name, count(*) filter (where amount_usd is null) as nulls, count(*) as n from transfers union all select 'tx_hash', count(*) filter (where tx_hash is null), count(*) from transfers",
)
def dq_01_not_null(t):
    one = lambda c: t.transfers.agg(F.count_if(F.col(c).isNull()).alias("nulls"), F.count("*").alias("n")).select(F.lit(c).alias("name"), "nulls", "n")
    return one("amount_usd").unionByName(one("tx_hash"))
