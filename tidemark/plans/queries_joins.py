"""Joins and keyed writes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import relational as rel
from tidemark.operators import series as ts
from tidemark.operators import stores
from tidemark.operators.clusters import others_near
from tidemark.plans.queries_basic import RET, returns
from tidemark.plans.registry import query

SD = ["symbol", "date"]


@query("jn_01_basis", "select d.symbol, d.date, d.venue, b.mid, (b.mid / nullif(d.price_usd, 0) - 1) * 10000 as basis from dex d left join (select symbol, cast(ts as date) as date, max_by(mid, event_id) as mid from books group by 1, 2) b on d.symbol = b.symbol and d.date = b.date", "mid basis")
def jn_01(t):
    mid = t.books.groupBy("symbol", F.col("ts").cast("date").alias("date")).agg(F.max_by("mid", "event_id").alias("mid"))
    return t.dex.join(mid, SD, "left").select(*SD, "venue", "mid", ((F.try_divide("mid", "price_usd") - 1) * 10000).alias("basis"))


@query("jn_02_derived_key", "select o.symbol, o.ts, o.exchange, p.close from open_interest o left join panel p on o.symbol = p.symbol and cast(o.ts as date) = p.date", "close")
def jn_02(t):
    return t.open_interest.withColumn("date", F.col("ts").cast("date")).join(t.panel.select(*SD, "close"), SD, "left").select("symbol", "ts", "exchange", "close")


@query("jn_03_wide_panel", """select b.symbol, b.date, b.close, m.v as depth, e.events, w.net, x.likes from bars b left join (select symbol, cast(ts as date) as date, avg(mid) as v from books group by 1, 2) m on m.symbol = b.symbol and m.date = b.date
    left join (select date, count(*) as events from calendar group by date) e on e.date = b.date left join (select date, sum(retweet_count)::bigint as net from tweets group by date) w on w.date = b.date
    left join (select upper(substr(split_part(text, '$', 2), 1, 4)) as tag, date, sum(like_count)::bigint as likes from tweets where text like 'Long%' group by 1, 2) x on x.tag = substr(b.symbol, 1, 4) and x.date = b.date where b.symbol in (select symbol from assets where active)""", "close depth")  # fmt: skip
def jn_03(t):
    depth = t.books.groupBy("symbol", F.col("ts").cast("date").alias("date")).agg(F.avg("mid").alias("depth"))
    events = t.calendar.groupBy("date").agg(F.count("*").alias("events"))
    net = t.tweets.groupBy("date").agg(F.sum("retweet_count").alias("net"))
    likes = t.tweets.filter(F.col("text").startswith("Long")).groupBy(F.upper(F.substring(F.split_part("text", F.lit("$"), F.lit(2)), 1, 4)).alias("tag"), "date").agg(F.sum("like_count").alias("likes"))
    base = t.bars.join(t.assets.filter("active").select("symbol"), "symbol", "left_semi").withColumn("tag", F.substring("symbol", 1, 4))
    return base.join(depth, SD, "left").join(events, "date", "left").join(net, "date", "left").join(likes, ["tag", "date"], "left").select(*SD, "close", "depth", "events", "net", "likes")


@query("jn_04_constant_symbol_price", "select f.tx_hash, f.transfer_index, f.amount * coalesce(p.close, 0) as usd from transfers f left join panel p on p.symbol = '1-URGENT' and p.date = f.date", "usd")
def jn_04(t):
    price = t.panel.filter("symbol = '1-URGENT'").select("date", "close")
    return t.transfers.join(price, "date", "left").select("tx_hash", "transfer_index", (F.col("amount") * F.coalesce("close", F.lit(0.0))).alias("usd"))


@query("jn_05_either_side", "select f.tx_hash, f.transfer_index, r.address, r.entity_type from transfers f join registry r on r.chain = f.chain and (r.address = f.from_address or r.address = f.to_address)")
def jn_05(t):
    return rel.either_side_join(t.transfers, t.registry.select("address", "chain", "entity_type"), ["from_address", "to_address"], "address", ["chain"]).select("tx_hash", "transfer_index", "address", "entity_type")


@query("jn_06_two_roles", "select f.tx_hash, f.transfer_index, coalesce(a.entity_type, b.entity_type) as entity_type from transfers f left join registry a on a.chain = f.chain and a.address = f.from_address left join registry b on b.chain = f.chain and b.address = f.to_address where a.entity_type is not null or b.entity_type is not null")
def jn_06(t):
    return rel.two_role_join(t.transfers, t.registry, "from_address", "to_address", "address", ["chain"], ["entity_type"]).select("tx_hash", "transfer_index", "entity_type")


@query("jn_07_full_outer_chain", """select coalesce(a.date, b.date) as date, coalesce(n_in, 0) as n_in, coalesce(n_out, 0) as n_out, coalesce(blocks, 0) as blocks from (select coalesce(x.date, y.date) as date, n_in, n_out from (select date, count(*) as n_in from transfers where direction = 'inflow' and chain = 'bitcoin' group by 1) x
    full join (select date, count(*) as n_out from transfers where direction = 'outflow' and chain = 'bitcoin' group by 1) y on x.date = y.date) a full join (select date, count(*) as blocks from blocks group by 1) b on a.date = b.date""")  # fmt: skip
def jn_07(t):
    btc = t.transfers.filter("chain = 'bitcoin'")
    n = lambda d, name: d.groupBy("date").agg(F.count("*").alias(name))
    return n(btc.filter("direction = 'inflow'"), "n_in").join(n(btc.filter("direction = 'outflow'"), "n_out"), "date", "full").join(n(t.blocks, "blocks"), "date", "full").fillna(0)


@query("jn_08_time_band", "select a.symbol, a.event_id, count(distinct b.user_id) as partners from ticks a join ticks b on a.symbol = b.symbol and a.user_id <> b.user_id and abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 600000000 group by 1, 2 having count(distinct b.user_id) >= 2")
def jn_08(t):
    x = t.ticks.select("symbol", "ts", "event_id", "user_id")
    return others_near(x, ["symbol"], "ts", "user_id", 600, "partners").filter("partners >= 2").select("symbol", "event_id", "partners")


@query("jn_09_anti", "select address, chain from registry r where not exists (select 1 from transfers f where f.chain = r.chain and f.from_address = r.address and f.amount >= 50 and f.chain = 'bitcoin')")
def jn_09(t):
    return t.registry.join(t.transfers.filter("amount >= 50 and chain = 'bitcoin'").select("chain", F.col("from_address").alias("address")), ["chain", "address"], "left_anti").select("address", "chain")


@query("jn_10_benchmark_return", f"select a.symbol, a.date, a.r - b.r as excess from ({RET}) a join ({RET}) b on a.date = b.date and b.symbol = '1-URGENT'", "excess")
def jn_10(t):
    r = returns(t)
    return r.join(r.filter("symbol = '1-URGENT'").select("date", F.col("r").alias("rb")), "date").select(*SD, (F.col("r") - F.col("rb")).alias("excess"))


@query("jn_11_last_vs_lagged", "select a.symbol, a.close as last, b.close as before from (select symbol, max_by(close, date) as close from panel group by 1) a join (select symbol, max_by(close, date) as close from panel where date <= date '2001-07-20' group by 1) b using (symbol)", "last before")
def jn_11(t):
    early = F.when(F.col("date") <= F.lit("2001-07-20").cast("date"), F.col("date"))
    return t.panel.groupBy("symbol").agg(F.max_by("close", "date").alias("last"), F.max_by(F.col("close"), early).alias("before"))


@query("jn_12_asof", "select p.symbol, p.date, p.close, m.value from (select * from panel where symbol = '1-URGENT') p asof left join (select date, value from macro where series_id = 'M_P') m on p.date >= m.date", "close value")
def jn_12(t):
    left = t.panel.filter("symbol = '1-URGENT'").select(*SD, "close")
    right = t.macro.filter("series_id = 'M_P'").select(F.lit("1-URGENT").alias("symbol"), "date", "value")
    return rel.asof_join(left, right, ["symbol"], "date", ["value"])


@query("jn_13_top_n_restriction", "select symbol, date, close from panel where symbol in (select symbol from panel group by symbol order by avg(close * volume) desc, symbol limit 2)", "close")
def jn_13(t):
    top = t.panel.groupBy("symbol").agg(F.avg(F.col("close") * F.col("volume")).alias("adv")).orderBy(F.desc("adv"), "symbol").limit(2)
    return t.panel.join(F.broadcast(top.select("symbol")), "symbol", "left_semi").select(*SD, "close")  # two rows


@query("jn_14_fan_out_counts", "select a.symbol, count(distinct b.date) as days, count(distinct d.venue) as venues from (select distinct symbol from assets) a left join bars b on a.symbol = b.symbol left join dex d on a.symbol = d.symbol group by a.symbol")
def jn_14(t):
    days, venues = t.bars.groupBy("symbol").agg(F.countDistinct("date").alias("days")), t.dex.groupBy("symbol").agg(F.countDistinct("venue").alias("venues"))
    return t.assets.select("symbol").distinct().join(days, "symbol", "left").join(venues, "symbol", "left").fillna(0)


@query("jn_15_date_global", "select b.symbol, b.date, b.close, d.total from panel b left join (select date, sum(value_eth) as total from blocks group by date) d on b.date = d.date", "close total")
def jn_15(t):
    return t.panel.join(t.blocks.groupBy("date").agg(F.sum("value_eth").alias("total")), "date", "left").select(*SD, "close", "total")


@query("jn_16_grid", "select n_name, g, p, n_nationkey * (1 + g) / (0.2 + p - g) as v from nation, (values (0.01), (0.02), (0.03)) a(g), (values (0.04), (0.06)) b(p)", "g p v")
def jn_16(t):
    grid = t.spark.createDataFrame([(g, p) for g in (0.01, 0.02, 0.03) for p in (0.04, 0.06)], "g double, p double")  # a fixed grid
    return t.nation.crossJoin(F.broadcast(grid)).select("n_name", "g", "p", (F.col("n_nationkey") * (1 + F.col("g")) / (0.2 + F.col("p") - F.col("g"))).alias("v"))


@query("jn_17_event_window", """select title, symbol, avg(case when b.date < e.date then close end) as pre, avg(case when b.date > e.date then close end) as post from calendar e join bars b on b.date between e.date - 5 and e.date + 5
    group by title, symbol having avg(case when b.date < e.date then close end) <> 0 and avg(case when b.date > e.date then close end) is not null""", "pre post")  # fmt: skip
def jn_17(t):
    days = t.calendar.select("title", F.col("date").alias("day"), F.explode(F.sequence(F.date_sub("date", 5), F.date_add("date", 5))).alias("date"))  # an equi-join on each day near the event
    side = lambda ok: F.avg(F.when(ok, F.col("close")))
    return t.bars.join(days, "date").groupBy("title", "symbol").agg(side(F.col("date") < F.col("day")).alias("pre"), side(F.col("date") > F.col("day")).alias("post")).filter("pre <> 0 and post is not null")


@query("jn_18_suffix_merge", "select week, a.close as a, b.close as b from (select cast(date_trunc('week', date) as date) as week, max_by(close, date) as close from panel where symbol = '1-URGENT' group by 1) a join (select cast(date_trunc('week', date) as date) as week, max_by(close, date) as close from panel where symbol = '2-HIGH' group by 1) b using (week)", "a b")
def jn_18(t):
    one = lambda s, n: ts.resample_week(t.panel.filter(F.col("symbol") == s), [], "date", ["close"]).withColumnRenamed("close", n)
    return one("1-URGENT", "a").join(one("2-HIGH", "b"), "week")


@query("jn_19_relative_return", "select date, a.close / nullif(lag(a.close, 20) over (order by date), 0) - b.close / nullif(lag(b.close, 20) over (order by date), 0) as rel from (select * from panel where symbol = '1-URGENT') a join (select * from panel where symbol = '2-HIGH') b using (date)", "rel")
def jn_19(t):
    one = lambda s, n: t.panel.filter(F.col("symbol") == s).select("date", F.col("close").alias(n))
    w = Window.orderBy("date")  # a row a day
    return one("1-URGENT", "a").join(one("2-HIGH", "b"), "date").select("date", (ts.pct_change("a", w, 20) - ts.pct_change("b", w, 20)).alias("rel"))


# ---- keyed writes, as the table that results


OLD, NEW = "date < date '2024-01-20'", "date >= date '2024-01-15'"


def halves(t):
    b = t.bars.select(*SD, "close", "volume")
    return b.filter(OLD), b.filter(NEW).withColumn("close", F.col("close") + 1)


def store(t, name, first, keys):
    return stores.Store.create(first, stores.scratch(t.spark, name), keys, time="date")


@query("snk_01_export", "select symbol, date, close from bars", "close")
def snk_01(t):
    path = stores.scratch(t.spark, "bars")
    t.bars.select(*SD, "close").write.parquet(path)
    return t.spark.read.parquet(path)


@query("snk_02_upsert", "select symbol, date, case when date >= date '2024-01-15' then close + 1 else close end as close, volume from bars", "close volume")
def snk_02(t):
    old, new = halves(t)
    s = store(t, "upsert", old, SD)
    s.upsert(new)
    return s.read()


@query("snk_03_conflict_policy", "select symbol, date, case when date >= date '2024-01-20' or date < date '2024-01-15' then close + case when date >= date '2024-01-20' then 1 else 0 end else close end as close, case when date between date '2024-01-15' and date '2024-01-19' then volume * 2 when date >= date '2024-01-20' then volume * 2 else volume end as volume from bars", "close volume")
def snk_03(t):
    old, new = halves(t)
    s = store(t, "conflict", old, SD)
    s.update(new.withColumn("volume", F.col("volume") * 2), ["volume"])
    return s.read()


@query("snk_04_insert_ignore", "select symbol, date, case when date >= date '2024-01-20' then close + 1 else close end as close, volume from bars", "close volume")
def snk_04(t):
    old, new = halves(t)
    s = store(t, "ignore", old, SD)
    s.insert_ignore(new)
    return s.read()


@query("snk_05_snapshot_replace", "select symbol, as_of_date, as_of_date = (select max(as_of_date) from assets) as active from assets")
def snk_05(t):
    last = t.assets.agg(F.max("as_of_date").alias("last"))
    today = t.assets.crossJoin(F.broadcast(last)).filter("as_of_date = last").select("symbol", "as_of_date", F.lit(True).alias("active"))  # one row
    return rel.upsert(t.assets.select("symbol", "as_of_date", F.lit(False).alias("active")), today, ["symbol", "as_of_date"])


@query("snk_06_cross_store_merge", "select series_id, date, case when date >= date '1999-01-01' then value * 2 else value end as value from macro", "value")
def snk_06(t):
    m = t.macro.select("series_id", "date", "value")
    mine = stores.Store.create(m.filter("date < date '2000-01-01'"), stores.scratch(t.spark, "mine"), ["series_id", "date"], time="date", period="year")
    other = stores.Store.create(m.filter("date >= date '1999-01-01'").withColumn("value", F.col("value") * 2), stores.scratch(t.spark, "other"), ["series_id", "date"], time="date", period="year")
    mine.upsert(stores.Store.open(t.spark, other.folder).read())
    return mine.read()


@query("snk_07_incremental", "select symbol, date, case when date >= date '2024-01-12' then close + 1 else close end as close, volume, case when date >= date '2024-01-12' then 1 end::bigint as extra from bars", "close volume")
def snk_07(t):
    b = t.bars.select(*SD, "close", "volume")
    source = b.withColumn("close", F.col("close") + 1).withColumn("extra", F.lit(1))
    target = store(t, "incremental", b.filter(OLD), SD)
    target.merge_since(source, "date", 7)
    return target.read().select(*SD, "close", "volume", "extra")


@query("snk_08_scd2", """select address, entity_type, valid_from, valid_to from (select address, entity_type, timestamp '2024-01-01' as valid_from, case when c % 4 = 0 or c % 4 = 1 then timestamp '2024-02-01' end as valid_to, c from (select *, cast(substr(address, 2) as int) as c from registry) a where c % 4 <> 3
    union all select address, case when c % 4 = 1 then concat(entity_type, '2') else entity_type end, timestamp '2024-02-01', null, c from (select *, cast(substr(address, 2) as int) as c from registry) b where c % 4 in (1, 3)) x""")  # fmt: skip
def snk_08(t):
    c = F.substring("address", 2, 20).cast("int") % 4  # 0: vanishes, 1: changes, 2: stays, 3: is new
    r = t.registry.select("address", "entity_type", c.alias("c"))
    at = lambda d: F.lit(d).cast("timestamp")
    history = r.filter("c <> 3").select("address", "entity_type", at("2024-01-01").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"))
    current = r.filter("c <> 0").select("address", F.when(F.col("c") == 1, F.concat("entity_type", F.lit("2"))).otherwise(F.col("entity_type")).alias("entity_type"))
    out = rel.scd2(history, current, "address", ["entity_type"], at("2024-02-01"))
    return out.select("address", "entity_type", F.col("valid_from").cast("timestamp_ntz").alias("valid_from"), F.col("valid_to").cast("timestamp_ntz").alias("valid_to"))


@query("snk_11_keyed_update", "select address, chain, case when address = 'w7' then true else active end as active from registry")
def snk_11(t):
    r = t.registry.select("address", "chain", "active")
    s = stores.Store.create(r, stores.scratch(t.spark, "update"), ["address"], buckets=4)
    s.update(r.filter("address = 'w7'").withColumn("active", F.lit(True)), ["active"])
    return s.read()
