"""Pipelines: compositions that are entry points of their own."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import relational as rel
from tidemark.operators import research as rs
from tidemark.operators import series as ts
from tidemark.operators import stores
from tidemark.operators import strategy as st
from tidemark.operators.clusters import others_near
from tidemark.operators.selection import quantiles
from tidemark.plans.queries_basic import RET
from tidemark.plans.queries_joins import SD
from tidemark.plans.queries_windows import FOLD  # noqa: F401
from tidemark.plans.registry import query

S = st.Strategy(min_adv=10_000.0)

FEAT = """select symbol, date, close, volume, ret, close / nullif(lag(close, 20) over o, 0) - 1 as mom_20, close / nullif(lag(close, 60) over o, 0) - 1 as mom_60, case when count(ret) over w >= 20 then stddev_samp(ret) over w end as vol,
    (volume - case when count(volume) over w >= 20 then avg(volume) over w end) / nullif(stddev_samp(volume) over w, 0) as volume_z, case when count(close) over w >= 20 then avg(close * volume) over w end as adv
    from (select *, close / nullif(lag(close) over (partition by symbol order by date), 0) - 1 as ret from panel) x window o as (partition by symbol order by date), w as (partition by symbol order by date rows between 19 preceding and current row)"""  # fmt: skip


def z(c):
    s = f"stddev_samp({c}) over (partition by date)"
    return f"case when {s} is null or {s} < 1e-12 then 0 else coalesce(({c} - avg({c}) over (partition by date)) / {s}, 0) end"


SCORE = f"select *, floor(({z('mom_20')} + {z('mom_60')} + {z('volume_z')} - {z('vol')}) * 1e9 + 0.5) / 1e9 as alpha from ({FEAT}) f"
RANKED = f"select *, isodow(date) = 5 as rebalance, (rank() over (partition by date order by alpha) + (count(*) over (partition by date, alpha) - 1) / 2.0) / count(alpha) over (partition by date) as rank from ({SCORE}) s"
SLEEVE = f"select *, case when rebalance and coalesce(adv, 0) >= 10000 and rank >= 0.8 then 1.0 when rebalance and coalesce(adv, 0) >= 10000 and rank <= 0.2 then -1.0 else 0.0 end as sleeve from ({RANKED}) r"
TARGET = f"""select s.*, case sleeve when 1 then 0.5 / n_long when -1 then -0.5 / n_short else 0 end * case when book_vol > 1e-12 then greatest(0.1, least(5.0, 0.1 / sqrt(365) / book_vol)) else 1.0 end as target from ({SLEEVE}) s
    join (select date, greatest(1, count(case when sleeve = 1 then 1 end)) as n_long, greatest(1, count(case when sleeve = -1 then 1 end)) as n_short, median(case when sleeve <> 0 then vol end) as book_vol from ({SLEEVE}) c group by date) n using (date)"""  # fmt: skip
WEIGHT = f"select *, coalesce(last_value(case when rebalance then target end ignore nulls) over (partition by symbol order by date rows unbounded preceding), 0) as weight from ({TARGET}) t"
TRADE = f"select *, abs(weight - w0) as dw, w0 * coalesce(ret, 0) as gain from (select *, coalesce(lag(weight) over (partition by symbol order by date), 0) as w0 from ({WEIGHT}) w) x"
DAILY = f"""select *, turnover * 0.001 + slippage as cost, gross - turnover * 0.001 - slippage as net from (select date, sum(gain) as gross, sum(dw) as turnover, sum(0.1 * dw * sqrt(case when adv >= 1000 then dw * 1000000 / adv else 0 end)) as slippage,
    sum(weight) as net_exposure, sum(abs(weight)) as gross_exposure, median(adv) as median_adv, max(case when adv >= 1000 then dw * 1000000 / adv else 0 end) as max_participation, avg(ret) as benchmark from ({TRADE}) t group by date) d"""  # fmt: skip


def weighted(t, s=S):
    return st.weights(st.score(st.features(t.panel.select(*SD, "close", "volume"), s), s), s)


@query("dp_01_price_features", f"select symbol, date, ret, mom_20, mom_60, vol, volume_z, adv from ({FEAT}) f", "ret mom_20 mom_60 vol volume_z adv")
def dp_01(t):
    return st.features(t.panel, S).select(*SD, "ret", "mom_20", "mom_60", "vol", "volume_z", "adv")


@query("dp_01_residual_momentum", f"select symbol, date, case when count(x) over w >= 20 then sum(x) over w end as mom from (select a.symbol, a.date, a.r - coalesce(b.r, 0) as x from ({RET}) a left join ({RET}) b on a.date = b.date and b.symbol = '1-URGENT') y window w as (partition by symbol order by date rows between 19 preceding and current row)", "mom")
def dp_01_residual(t):
    return st.residual_momentum(t.panel, "1-URGENT", 20, "mom").select(*SD, "mom")


REGIME = """select date, coalesce((g - gm) / nullif(gs, 0), 0) - coalesce((d - dm) / nullif(ds, 0), 0) as regime_score from (select date, g, d, case when count(g) over w >= 60 then avg(g) over w end as gm, case when count(g) over w >= 60 then stddev_samp(g) over w end as gs,
    case when count(d) over w >= 60 then avg(d) over w end as dm, case when count(d) over w >= 60 then stddev_samp(d) over w end as ds from (select date, a / nullif(lag(a) over (order by date), 0) - 1 as g, b - lag(b) over (order by date) as d from
    (select date, lag(max(case when series_id = 'M_F' then value end)) over (order by date) as a, lag(max(case when series_id = 'M_O' then value end)) over (order by date) as b from macro group by date) x) y window w as (order by date rows between 59 preceding and current row)) z"""  # fmt: skip


def macro_regime(t):
    """Date-level series, lagged a row, growth and change, rolling z, difference."""
    w = Window.orderBy("date")  # a row a date
    wide = t.macro.groupBy("date").pivot("series_id", ["M_F", "M_O"]).agg(F.max("value")).select("date", F.lag("M_F").over(w).alias("a"), F.lag("M_O").over(w).alias("b"))
    g = wide.select("date", ts.pct_change("a", w).alias("g"), (F.col("b") - F.lag("b").over(w)).alias("d"))
    zed = lambda c: F.coalesce(F.try_divide(F.col(c) - ts.rolling(c, w, 60), ts.rolling(c, w, 60, "stddev_samp")), F.lit(0.0))
    return g.select("date", (zed("g") - zed("d")).alias("regime_score"))


@query("dp_02_macro_regime", f"select date, regime_score, regime_score >= -0.5 as active from ({REGIME}) r", "regime_score")
def dp_02(t):
    return macro_regime(t).withColumn("active", F.col("regime_score") >= -0.5)


@query("dp_03_alpha_score", f"select symbol, date, alpha from ({SCORE}) s", "alpha")
def dp_03(t):
    return st.score(st.features(t.panel, S), S).select(*SD, "alpha")


@query("dp_04_ts_mom_score", f"select symbol, date, case when mom_20 > 0 and mom_60 > 0 then 1.0 when mom_20 < 0 and mom_60 < 0 then -1.0 else 0.0 end as alpha from ({FEAT}) f", "alpha")
def dp_04(t):
    s = st.Strategy(mode="ts_mom")
    return st.score(st.features(t.panel, s), s).select(*SD, "alpha")


@query("dp_05_labels", "select symbol, date, fwd, fwd - avg(fwd) over (partition by date) as fwd_excess from (select symbol, date, lead(close, 5) over (partition by symbol order by date) / nullif(close, 0) - 1 as fwd from panel) x", "fwd fwd_excess")
def dp_05(t):
    return st.labels(t.panel, 5).select(*SD, "fwd", "fwd_excess")


@query("dp_06_cross_section_weights", f"select symbol, date, weight from ({WEIGHT}) w", "weight")
def dp_06(t):
    return weighted(t).select(*SD, "weight")


@query("dp_07_ts_mom_weights", f"""select symbol, date, coalesce(last_value(case when isodow(date) = 5 then target end ignore nulls) over (partition by symbol order by date rows unbounded preceding), 0) as weight from (select *, alpha * case when median(case when alpha <> 0 then vol end) over (partition by date) > 1e-12 then greatest(0.1, least(5.0, 0.1 / sqrt(365) / median(case when alpha <> 0 then vol end) over (partition by date))) else 1.0 end as target
    from (select symbol, date, vol, case when mom_20 > 0 and mom_60 > 0 then 1.0 when mom_20 < 0 and mom_60 < 0 then -1.0 else 0.0 end as alpha from ({FEAT}) f) x) y""", "weight")  # fmt: skip
def dp_07(t):
    return weighted(t, st.Strategy(mode="ts_mom")).select(*SD, "weight")


@query("dp_08_costs", f"select date, turnover, slippage, cost from ({DAILY}) d", "turnover slippage cost")
def dp_08(t):
    return st.daily(weighted(t), S).select("date", "turnover", "slippage", "cost")


@query("ag_16_daily_book", f"select date, gross, net, net_exposure, gross_exposure, median_adv, max_participation from ({DAILY}) d", "gross net net_exposure gross_exposure median_adv max_participation")
def ag_16(t):
    return st.daily(weighted(t), S).select("date", "gross", "net", "net_exposure", "gross_exposure", "median_adv", "max_participation")


FOLDS = "select f::bigint as fold, (select date from days where i = 252 + 63 * f - 1) as train_end, (select date from days where i = 252 + 63 * f + 20) as test_start, (select date from days where i = 252 + 63 * f + 82) as test_end from range(0, 200) r(f) where 252 + 63 * f + 83 <= (select count(*) from days)"
DAYS = "with days as (select date, row_number() over (order by date) - 1 as i from (select distinct date from panel) x) "


@query("dp_09_folds", DAYS + FOLDS)
def dp_09(t):
    return st.folds(t.panel, S)


SHARPE = "avg({r}) / nullif(stddev_samp({r}), 0) * sqrt(365)"


def out_of_sample(daily):
    """The days of a book that lie in any fold's test window."""
    return f"select * from ({daily}) o where exists (select 1 from ({FOLDS}) f where o.date between f.test_start and f.test_end)"


def oos_metrics(daily):
    """Sharpe and information ratio (benchmark scaled to the book's deviation) out of sample."""
    both = f"select * from ({out_of_sample(daily)}) b where benchmark is not null"
    k = f"(select stddev_samp(net) / nullif(stddev_samp(benchmark), 0) from ({both}) s)"
    ir = f"(select {SHARPE.format(r='a')} from (select net - benchmark * {k} as a from ({both}) n) m)"
    return f"(select {SHARPE.format(r='net')} from ({out_of_sample(daily)}) s)", ir


WALK = f"""select fold, {SHARPE.format(r="net")} as net_sharpe, avg(net) / nullif(stddev_samp(case when net < 0 then net end), 0) * sqrt(365) as sortino, avg(case when net > 0 then 1.0 else 0.0 end) as hit, count(*) as days from"""


@query(
    "dp_09_walk_forward",
    f"""{DAYS} {WALK} (select f.fold, d.net from ({DAILY}) d join ({FOLDS}) f on d.date between f.test_start and f.test_end) x group by fold
    union all {WALK} (select -1::bigint as fold, net from ({out_of_sample(DAILY)}) d) y group by fold""",
    "net_sharpe sortino hit",
)
def dp_09_evaluate(t):
    return st.evaluate(st.daily(weighted(t), S), S).select("fold", "net_sharpe", "sortino", "hit", "days")


@query("dp_10_gates", f"{DAYS} select {oos_metrics(DAILY)[0]} > 0 as sharpe_ok, {oos_metrics(DAILY)[1]} > 0 as ir_ok")
def dp_10(t):
    m = st.evaluate(st.daily(weighted(t), S), S).filter("fold = -1")
    return m.select((F.col("net_sharpe") > 0).alias("sharpe_ok"), (F.col("ir") > 0).alias("ir_ok"))


@query("ag_17_capacity", f"select 'book' as book, cap as capacity from (select cap, row_number() over (order by cap) - 1 as r, count(*) over () as n from (select coalesce(adv, 0) * 0.05 / greatest(abs(weight), 1e-12) as cap from ({WEIGHT}) w where weight <> 0) x where cap > 0) y where r = floor((n - 1) * 0.05 + 0.5)", "capacity")
def ag_17(t):
    return st.capacity(weighted(t), 0.05)


@query("dp_11_tweet_pipeline", "select handle, count(*) as tweets, min(posted_at) as first_seen from tweets where handle not in (select concat('user', cast(c_custkey as string)) from customer where c_custkey < 20) group by handle")
def dp_11(t):
    known = t.customer.filter("c_custkey < 20").select(F.concat(F.lit("user"), F.col("c_custkey").cast("string")).alias("handle"))
    return t.tweets.join(known, "handle", "left_anti").groupBy("handle").agg(F.count("*").alias("tweets"), F.min("posted_at").alias("first_seen"))


@query("dp_12_transaction_legs", "select tx_hash, 'inflow' as direction, transfer_index as leg, to_address as address, amount from transfers where chain = 'bitcoin' and to_address in (select address from registry) union all select tx_hash, 'outflow', transfer_index, from_address, amount from transfers where chain = 'bitcoin' and from_address in (select address from registry)", "amount")
def dp_12(t):
    side = lambda direction, address: F.struct(F.lit(direction).alias("direction"), F.col(address).alias("address"))
    legs = t.transfers.filter("chain = 'bitcoin'").select("tx_hash", F.col("transfer_index").alias("leg"), "amount", F.explode(F.array(side("inflow", "to_address"), side("outflow", "from_address"))).alias("s"))
    return legs.select("tx_hash", "s.direction", "leg", "s.address", "amount").join(t.registry.select("address").distinct(), "address", "left_semi")


@query("dp_13_balance_deltas", "select address, chain, sum(d) as delta from (select to_address as address, chain, amount as d from transfers union all select from_address, chain, -amount from transfers) x where (address, chain) in (select (address, chain) from registry) group by 1, 2", "delta")
def dp_13(t):
    moves = t.transfers.select("chain", F.explode(F.array(F.struct(F.col("to_address").alias("address"), F.col("amount").alias("d")), F.struct(F.col("from_address").alias("address"), (-F.col("amount")).alias("d")))).alias("m")).select("chain", "m.*")
    return moves.join(t.registry.select("address", "chain"), ["address", "chain"], "left_semi").groupBy("address", "chain").agg(F.sum("d").alias("delta"))


@query("dp_14_evm_transfers", "select tx_hash, transfer_index, case when (l_suppkey + 0) >= 0 then 'outflow' end as direction, wei / 1e18 as eth from (select cast(l_orderkey as string) as tx_hash, cast(l_linenumber as bigint) as transfer_index, l_suppkey, l_quantity * 1e18 as wei from lineitem where l_suppkey % 3 = 1) x", "eth")
def dp_14(t):
    raw = t.transfers.filter("chain = 'ethereum'").select("tx_hash", "transfer_index", "from_address", F.format_string("%.0f", F.col("amount") * 1e18).alias("value"))
    return raw.select("tx_hash", "transfer_index", F.lit("outflow").alias("direction"), tx.wei(F.col("value"), F.lit("wei")).alias("eth"))


@query("dp_15_wallet_alerts", """select tx_hash, transfer_index, concat(entity_type, case direction when 'inflow' then '_buy_' else '_sell_' end, asset) as action, case when entity_type in ('kol', 'smart_money', 'insider') and direction = 'inflow' then 'high' when entity_type in ('deployer', 'whale') then 'medium' else 'low' end as severity
    from transfers f join registry r on r.chain = f.chain and r.address = case when direction = 'inflow' then to_address else from_address end where f.chain <> 'bitcoin' or amount >= 10 or amount_usd >= 100000""")  # fmt: skip
def dp_15(t):
    from tidemark.streaming.jobs import alerts

    return alerts(t.transfers, t.registry).select("tx_hash", "transfer_index", "action", "severity")


MOVES = """select f.date, case when direction = 'inflow' then to_address else from_address end as address, direction, tx_hash, transfer_index, coalesce(amount_usd, amount * coalesce(p.close, 0)) as usd, entity_type from transfers f
    join registry r on r.chain = f.chain and r.address = case when direction = 'inflow' then to_address else from_address end left join panel p on p.symbol = '1-URGENT' and p.date = f.date where f.chain = 'bitcoin' and (amount >= 10 or coalesce(amount_usd, amount * coalesce(p.close, 0)) >= 100000 or entity_type in ('insider', 'exchange'))"""  # fmt: skip


def moves(t):
    own = F.when(F.col("direction") == "inflow", F.col("to_address")).otherwise(F.col("from_address"))
    m = t.transfers.filter("chain = 'bitcoin'").withColumn("address", own).join(t.registry.select("address", "chain", "entity_type"), ["address", "chain"])
    m = m.join(t.panel.filter("symbol = '1-URGENT'").select("date", "close"), "date", "left").withColumn("usd", F.coalesce("amount_usd", F.col("amount") * F.coalesce("close", F.lit(0.0))))
    return m.filter("amount >= 10 or usd >= 100000 or entity_type in ('insider', 'exchange')")


@query("dp_16_insider_moves", f"select date, address, direction, tx_hash, transfer_index, usd, entity_type from ({MOVES}) m", "usd")
def dp_16(t):
    return moves(t).select("date", "address", "direction", "tx_hash", "transfer_index", "usd", "entity_type")


@query("dp_16_insider_timing", f"""select date, address, net, net7, case when net7 > 0 and coalesce(fwd, 0) > 0.05 then 1.0 when net7 > 0 and coalesce(fwd, 0) > 0.02 then 0.7 when net7 < 0 and coalesce(fwd, 0) < -0.02 then 0.6 else 0.3 end as score from (select *, sum(net) over (partition by address order by date rows between 6 preceding and current row) as net7
    from (select date, address, sum(case when direction = 'inflow' then usd else -usd end) as net from ({MOVES}) m where entity_type in ('insider', 'smart_money') group by 1, 2) a) b left join (select date, lead(close, 7) over (order by date) / nullif(close, 0) - 1 as fwd from panel where symbol = '1-URGENT') p using (date)""", "net net7 score")  # fmt: skip
def dp_16_timing(t):
    signed = F.when(F.col("direction") == "inflow", F.col("usd")).otherwise(-F.col("usd"))
    flow = moves(t).filter("entity_type in ('insider', 'smart_money')").groupBy("date", "address").agg(F.sum(signed).alias("net")).withColumn("net7", F.sum("net").over(ts.w("address", "date").rowsBetween(-6, 0)))
    price = t.panel.filter("symbol = '1-URGENT'").select("date", (F.try_divide(F.lead("close", 7).over(ts.w("symbol", "date")), "close") - 1).alias("fwd"))
    f, n = F.coalesce("fwd", F.lit(0.0)), F.col("net7")
    return flow.join(price, "date", "left").select("date", "address", "net", "net7", F.when((n > 0) & (f > 0.05), 1.0).when((n > 0) & (f > 0.02), 0.7).when((n < 0) & (f < -0.02), 0.6).otherwise(0.3).alias("score"))


@query("dp_17_insider_clusters", """select 'shared' as kind, to_address as k, count(distinct identity_id) as n from transfers f join links l on f.chain = l.chain and f.from_address = l.address group by to_address having count(distinct identity_id) >= 2
    union all select 'co_move', concat(a.symbol, ':', cast(a.event_id as varchar)), count(distinct b.user_id) from ticks a join ticks b on a.symbol = b.symbol and a.user_id <> b.user_id and abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 300000000 group by 1, 2 having count(distinct b.user_id) >= 2""")  # fmt: skip
def dp_17(t):
    shared = t.transfers.join(t.links.withColumnRenamed("address", "from_address"), ["chain", "from_address"]).groupBy(F.col("to_address").alias("k")).agg(F.countDistinct("identity_id").alias("n"))
    x = t.ticks.select("symbol", "ts", "event_id", "user_id")
    co = others_near(x, ["symbol"], "ts", "user_id", 300, "n").select(F.concat_ws(":", "symbol", "event_id").alias("k"), "n")
    return shared.select(F.lit("shared").alias("kind"), "k", "n").unionByName(co.select(F.lit("co_move").alias("kind"), "k", "n")).filter("n >= 2")


@query("dp_18_daily_mart", """select s.symbol, s.date, d.depth, x.price_usd, b.total from (select symbol, cast(ts as date) as date from books union select symbol, date from dex) s left join (select symbol, cast(ts as date) as date, avg(bid_notional_bps_25) as depth from books group by 1, 2) d on s.symbol = d.symbol and s.date = d.date
    left join (select symbol, date, price_usd from (select *, row_number() over (partition by symbol, date order by case when venue = 'defillama' then 0 else 1 end, venue) as rn from dex) v where rn = 1) x on x.symbol = s.symbol and x.date = s.date left join (select date + 9000 as date, sum(value_eth) as total from blocks group by 1) b on b.date = s.date""", "depth price_usd total")  # fmt: skip
def dp_18(t):
    depth = t.books.groupBy("symbol", F.col("ts").cast("date").alias("date")).agg(F.avg("bid_notional_bps_25").alias("depth"))
    first = F.struct(F.when(F.col("venue") == "defillama", 0).otherwise(1), "venue")
    venue = t.dex.groupBy(*SD).agg(F.min_by("price_usd", first).alias("price_usd"))
    total = t.blocks.groupBy(F.date_add("date", 9000).alias("date")).agg(F.sum("value_eth").alias("total"))
    return depth.select(*SD).union(t.dex.select(*SD)).distinct().join(depth, SD, "left").join(venue, SD, "left").join(total, "date", "left").select(*SD, "depth", "price_usd", "total")


@query("dp_19_snapshot", """select symbols, breadth, case when breadth >= 0.55 then 'risk-on' when breadth <= 0.45 then 'risk-off' else 'mixed' end as headline from (select count(*) as symbols, avg(case when close > ma then 1.0 else 0.0 end) as breadth from
    (select symbol, max_by(close, date) as close, max_by(ma, date) as ma from (select symbol, date, close, case when count(close) over w >= 50 then avg(close) over w end as ma from panel window w as (partition by symbol order by date rows between 49 preceding and current row)) x group by symbol) y where ma is not null) z""", "breadth")  # fmt: skip
def dp_19(t):
    last = t.panel.select(*SD, "close", ts.rolling("close", ts.w("symbol", "date"), 50).alias("ma")).groupBy("symbol").agg(F.max_by(F.struct("close", "ma"), "date").alias("x")).select("x.*").filter("ma is not null")
    b = F.col("breadth")
    return last.agg(F.count("*").alias("symbols"), F.avg((F.col("close") > F.col("ma")).cast("double")).alias("breadth")).withColumn("headline", F.when(b >= 0.55, "risk-on").when(b <= 0.45, "risk-off").otherwise("mixed"))


WEEKLY = "select series_id, cast(date_trunc('week', date) as date) as week, max_by(value, date) as v from macro group by 1, 2"
COMPOSITE = f"""select week, (a - avg(a) over ()) / (stddev_samp(a) over () + 1e-12) - (b - avg(b) over ()) / (stddev_samp(b) over () + 1e-12) as z from (select week, ln(a) - ln(lag(a, 52) over (order by week)) as a, ln(b) - ln(lag(b, 52) over (order by week)) as b from
    (select week, max(case when series_id = 'M_F' then v end) as a, max(case when series_id = 'M_O' then v end) as b from ({WEEKLY}) w group by week) x) y where a is not null and b is not null"""  # fmt: skip


def composite(t):
    """Weekly series, yearly log growth, difference of standardised growths."""
    weekly = ts.resample_week(t.macro.withColumnRenamed("series_id", "s"), ["s"], "date", ["value"]).groupBy("week").pivot("s", ["M_F", "M_O"]).agg(F.max("value"))
    w = Window.orderBy("week")  # a row a week
    g = weekly.select("week", *[(F.log(c) - F.lag(F.log(c), 52).over(w)).alias(c) for c in ("M_F", "M_O")]).dropna()
    stats = g.agg(*[f(c).alias(f"{n}_{c}") for c in ("M_F", "M_O") for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    zed = lambda c: (F.col(c) - F.col(f"m_{c}")) / (F.col(f"s_{c}") + 1e-12)
    return g.crossJoin(F.broadcast(stats)).select("week", (zed("M_F") - zed("M_O")).alias("z"))  # one row of statistics


@query("dp_20_liquidity_signal", f"select week, z, z - lag(z, 12) over (order by week) as momentum, sign(z - lag(z, 12) over (order by week)) as signal from ({COMPOSITE}) c", "z momentum signal")
def dp_20(t):
    momentum = F.col("z") - F.lag("z", 12).over(Window.orderBy("week"))
    return composite(t).withColumn("momentum", momentum).withColumn("signal", F.signum("momentum"))


@query("dp_21_activity_composite", f"select symbol, week, z1 + z2 as composite, case when z1 + z2 > 0.5 then 'expansion' when z1 + z2 < -0.5 then 'contraction' else 'neutral' end as regime from (select symbol, week, coalesce((a - avg(a) over w) / nullif(case when count(a) over w >= 26 then stddev_samp(a) over w end, 0), 0) as z1, coalesce((b - avg(b) over w) / nullif(case when count(b) over w >= 26 then stddev_samp(b) over w end, 0), 0) as z2 from (select symbol, week, ln(close) - ln(lag(close, 4) over o) as a, ln(volume) - ln(lag(volume, 4) over o) as b from (select symbol, cast(date_trunc('week', date) as date) as week, max_by(close, date) as close, sum(volume) as volume from panel group by 1, 2) x window o as (partition by symbol order by week)) y window w as (partition by symbol order by week rows between 25 preceding and current row)) z", "composite")
def dp_21(t):
    w = ts.w("symbol", "week")
    x = ts.resample_week(t.panel, ["symbol"], "date", ["close"], ["volume"])
    x = x.select("symbol", "week", *[(F.log(c) - F.lag(F.log(c), 4).over(w)).alias(n) for c, n in (("close", "a"), ("volume", "b"))])
    zed = lambda c: F.coalesce(F.try_divide(F.col(c) - F.avg(c).over(w.rowsBetween(-25, 0)), ts.rolling(c, w, 26, "stddev_samp")), F.lit(0.0))
    x = x.select("symbol", "week", (zed("a") + zed("b")).alias("composite"))
    return x.withColumn("regime", F.when(F.col("composite") > 0.5, "expansion").when(F.col("composite") < -0.5, "contraction").otherwise("neutral"))


@query("dp_22_cycle_features", "select symbol, week, close / nullif(case when count(close) over w >= 52 then avg(close) over w end, 0) as puell, ln(close) - ln(lag(close, 52) over (partition by symbol order by week)) as yoy from (select symbol, cast(date_trunc('week', date) as date) as week, max_by(close, date) as close from panel group by 1, 2) x window w as (partition by symbol order by week rows between 51 preceding and current row)", "puell yoy")
def dp_22(t):
    w = ts.w("symbol", "week")
    x = ts.resample_week(t.panel, ["symbol"], "date", ["close"])
    return x.select("symbol", "week", F.try_divide(F.col("close"), ts.rolling("close", w, 52)).alias("puell"), (F.log("close") - F.lag(F.log("close"), 52).over(w)).alias("yoy"))


@query("dp_23_early_warning", f"select week, (z - avg(z) over ()) / (stddev_samp(z) over () + 1e-12) as lead from ({COMPOSITE}) c", "lead")
def dp_23(t):
    c = composite(t)
    stats = c.agg(F.avg("z").alias("m"), F.stddev_samp("z").alias("s"))
    return c.crossJoin(F.broadcast(stats)).select("week", ((F.col("z") - F.col("m")) / (F.col("s") + 1e-12)).alias("lead"))  # one row


@query("dp_24_fee_dcf", "select symbol, date, least(close / nullif(volume, 0), 100000) as s2f, close - lag(close) over (partition by symbol order by date) < 0 as deflation, close * 1.03 / (0.12 - 0.03) as value from panel", "s2f value")
def dp_24(t):
    return t.panel.select(*SD, F.least(F.try_divide("close", "volume"), F.lit(100000.0)).alias("s2f"), (F.col("close") - F.lag("close").over(ts.w("symbol", "date")) < 0).alias("deflation"), (F.col("close") * 1.03 / (0.12 - 0.03)).alias("value"))


@query("dp_25_coverage_tiers", """select b.date, case when (select count(*) from macro where series_id = 'M_P') >= 0.5 * (select count(distinct date) from panel) then p.value when (select count(*) from macro where series_id = 'M_F') >= 0.5 * (select count(distinct date) from panel) then f.value end as v from (select distinct date from panel) b
    left join (select date, value from macro where series_id = 'M_P') p using (date) left join (select date, value from macro where series_id = 'M_F') f using (date)""", "v")  # fmt: skip
def dp_25(t):
    spine = t.panel.select("date").distinct()
    wide = t.macro.groupBy("date").pivot("series_id", ["M_P", "M_F"]).agg(F.max("value"))
    j = spine.join(wide, "date", "left")
    share = j.agg(*[(F.count(c) / F.count("*")).alias(f"s_{c}") for c in ("M_P", "M_F")])
    return j.crossJoin(F.broadcast(share)).select("date", F.when(F.col("s_M_P") >= 0.5, F.col("M_P")).when(F.col("s_M_F") >= 0.5, F.col("M_F")).alias("v"))  # one row


@query("dp_26_trend_regression", "select symbol, regr_slope(ln(close), i) as slope, regr_intercept(ln(close), i) as intercept, regr_r2(ln(close), i) as r2 from (select symbol, close, row_number() over (partition by symbol order by date) as i from panel) x group by symbol", "slope intercept r2")
def dp_26(t):
    return rs.trend(t.panel.withColumn("y", F.log("close")), "symbol", "date", "y", 30).select("symbol", "slope", "intercept", "r2")


NEWEY_WEST = """with x as (select symbol, ln(close) as y, row_number() over (partition by symbol order by date) as i from panel),
    fit as (select symbol, regr_slope(y, i) as slope, regr_intercept(y, i) as intercept, avg(i) as mi, regr_sxx(y, i) as sxx from x group by symbol),
    u as (select x.symbol, i, (y - intercept - slope * i) * (i - mi) as u from x join fit using (symbol)),
    s as (select a.symbol, sum(case when a.i = b.i then a.u * b.u else 2 * (1 - (a.i - b.i) / 31.0) * a.u * b.u end) as s from u a join u b on a.symbol = b.symbol and b.i between a.i - 30 and a.i group by a.symbol)
    select symbol, slope, sqrt(greatest(s, 0)) / sxx as se from fit join s using (symbol)"""


@query("dp_26_hac_errors", NEWEY_WEST, "slope se")
def dp_26_hac(t):
    return rs.trend(t.panel.withColumn("y", F.log("close")), "symbol", "date", "y", 30).select("symbol", "slope", "se")


@query("dp_27_probit")
def dp_27(t):
    w = Window.orderBy("week")  # a row a week
    x = composite(t).select("week", "z", (F.col("z") - F.lag("z", 12).over(w)).alias("momentum"))
    x = x.withColumn("ahead", (F.lead("momentum", 13).over(w) > 0).cast("double"))
    return rs.probit_walk_forward(x, "week", ["z", "momentum"], "ahead", 13)


@query("dp_28_bootstrap_fan")
def dp_28(t):
    return rs.bootstrap_fan(t.panel.withColumn("y", F.log("close")), "symbol", "date", "y", [30, 90, 365], 500)


@query("dp_29_conformal", """select symbol, quantile_cont(abs(y - m) / nullif(s, 0), 0.9) as scale, avg(case when abs(y - m) <= 1.645 * s then 1.0 else 0.0 end) as coverage from (select symbol, ln(close) as y, avg(ln(close)) over w as m, stddev_samp(ln(close)) over w as s, count(*) over w as n from panel window w as (partition by symbol order by date rows between 60 preceding and 1 preceding)) x where n = 60 and s > 0 group by symbol""", "scale coverage")
def dp_29(t):
    w = ts.w("symbol", "date").rowsBetween(-60, -1)
    y = F.log("close")
    x = t.panel.select("symbol", y.alias("y"), F.avg(y).over(w).alias("m"), F.stddev_samp(y).over(w).alias("s"), F.count("*").over(w).alias("n")).filter("n = 60 and s > 0")
    gap = F.abs(F.col("y") - F.col("m"))
    covered = x.groupBy("symbol").agg(F.avg((gap <= 1.645 * F.col("s")).cast("double")).alias("coverage"))
    scale = quantiles(x.withColumn("score", gap / F.col("s")), ["symbol"], "score", [0.9]).select("symbol", F.col("q0").alias("scale"))
    return scale.join(covered, "symbol")


F_TEST = """with wide as (select date, max(case when symbol = '1-URGENT' then close end) as x, max(case when symbol = '2-HIGH' then close end) as y from panel group by date),
    i as (select row_number() over (order by date) as i, x, y from wide where x is not null and y is not null),
    m as (select k.lag, i.y, j.y as a, j.x as b from range(1, 13) k(lag) join i on true join i j on j.i = i.i - k.lag),
    c as (select lag, count(*) as n, var_pop(y) as yy, var_pop(a) as aa, var_pop(b) as bb, covar_pop(y, a) as ya, covar_pop(y, b) as yb, covar_pop(a, b) as ab from m group by lag),
    r as (select lag, n, yy - ya * ya / aa as restricted, yy - (ya * (ya * bb - yb * ab) + yb * (yb * aa - ya * ab)) / (aa * bb - ab * ab) as full_model from c)
    select lag, (restricted - full_model) / (full_model / (n - 3)) as f, n from r"""


@query("dp_30_predictability", F_TEST, "f")
def dp_30(t):
    wide = t.panel.groupBy("date").pivot("symbol", ["1-URGENT", "2-HIGH"]).agg(F.max("close")).dropna().toDF("date", "x", "y")
    return rs.lagged_f_test(wide, "date", "y", "x", 12)


@query("snk_09_layers", "select 'panel' as model, count(*) as n from panel union all select 'monthly', count(*) from (select symbol, date_trunc('month', date) from panel group by 1, 2) x")
def snk_09(t):
    """Two layers: a panel that is written, and a monthly table made of what was written."""
    path = stores.scratch(t.spark, "panel")
    t.panel.write.parquet(path)
    panel = t.spark.read.schema(t.panel.schema).parquet(path)
    months = panel.select("symbol", F.trunc("date", "month").alias("month")).distinct()
    one = lambda df, n: df.agg(F.count("*").alias("n")).select(F.lit(n).alias("model"), "n")
    return one(panel, "panel").unionByName(one(months, "monthly"))


@query("snk_10_report", f"select 'net' as name, avg(net) as value from ({DAILY}) d union all select 'turnover', avg(turnover) from ({DAILY}) e", "value")
def snk_10(t):
    d = st.daily(weighted(t), S).agg(F.avg("net").alias("net"), F.avg("turnover").alias("turnover"))
    return d.unpivot([], ["net", "turnover"], "name", "value")
