"""Window functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import series as ts
from tidemark.operators.clusters import distinct_near
from tidemark.plans.queries_basic import RET, returns
from tidemark.plans.registry import query

SD = ("symbol", "date")


@query("wn_01_priority_dedupe", "select symbol, date, source, close from bars", "close")
def wn_01(t):
    return t.bars.select("symbol", "date", "source", "close")


@query("wn_02_preferred_venue", "select symbol, date, venue, price_usd from (select *, row_number() over (partition by symbol, date order by case when venue = 'defillama' then 0 else 1 end, venue) as rn from dex) x where rn = 1", "price_usd")
def wn_02(t):
    rn = F.row_number().over(ts.w(SD, [F.when(F.col("venue") == "defillama", 0).otherwise(1), F.col("venue")]))
    return t.dex.withColumn("rn", rn).filter("rn = 1").select("symbol", "date", "venue", "price_usd")


@query("wn_03_surrogate_id", "select row_number() over (order by date, title) as event_id, date, title from calendar")
def wn_03(t):
    return t.calendar.select(F.row_number().over(Window.orderBy("date", "title")).alias("event_id"), "date", "title")  # a row a day and kind


@query("wn_04_forward_return", "select symbol, date, lead(close, 7) over (partition by symbol order by date) / nullif(close, 0) - 1 as fwd from panel", "fwd")
def wn_04(t):
    return t.panel.select("symbol", "date", (F.try_divide(F.lead("close", 7).over(ts.w(*SD)), "close") - 1).alias("fwd"))


@query("wn_05_rolling_sum", "select symbol, date, sum(volume) over (partition by symbol order by date rows between 6 preceding and current row) as s from panel", "s")
def wn_05(t):
    return t.panel.select("symbol", "date", F.sum("volume").over(ts.w(*SD).rowsBetween(-6, 0)).alias("s"))


DELTA = "select chain, date, sum(case when direction = 'inflow' then amount else -amount end) as delta from transfers group by chain, date"


def delta(t):
    return t.transfers.groupBy("chain", "date").agg(F.sum(F.when(F.col("direction") == "inflow", F.col("amount")).otherwise(-F.col("amount"))).alias("delta"))


@query("wn_06_running_balance", f"select chain, date, sum(delta) over (partition by chain order by date rows unbounded preceding) as balance from ({DELTA}) x", "balance")
def wn_06(t):
    return delta(t).select("chain", "date", F.sum("delta").over(ts.w("chain", "date").rowsBetween(Window.unboundedPreceding, 0)).alias("balance"))


@query("wn_07_cabal", "select symbol, date_trunc('minute', ts) as minute, count(*) as n from ticks group by 1, 2 having count(*) >= 2")
def wn_07(t):
    return t.ticks.groupBy("symbol", F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("minute")).agg(F.count("*").alias("n")).filter("n >= 2")


@query("wn_08_changes", "select symbol, date, close / nullif(lag(close) over w, 0) - 1 as pct, lag(close, 3) over w as lag3, close - lag(close, 2) over w as diff2, ln(close) - lag(ln(close), 4) over w as logdiff from panel window w as (partition by symbol order by date)", "pct lag3 diff2 logdiff")
def wn_08(t):
    w = ts.w(*SD)
    return t.panel.select("symbol", "date", ts.pct_change("close", w).alias("pct"), F.lag("close", 3).over(w).alias("lag3"), (F.col("close") - F.lag("close", 2).over(w)).alias("diff2"), (F.log("close") - F.lag(F.log("close"), 4).over(w)).alias("logdiff"))


@query("wn_09_lagged_columns", "select symbol, date, lag(close) over w as close_lag1, lag(volume, 2) over w as volume_lag2 from panel window w as (partition by symbol order by date)", "close_lag1 volume_lag2")
def wn_09(t):
    lags = {"close": 1, "volume": 2, "absent": 3, "open": 0}
    out = [F.lag(c, n).over(ts.w(*SD)).alias(f"{c}_lag{n}") for c, n in lags.items() if n > 0 and c in t.panel.columns]
    return t.panel.select("symbol", "date", *out)


ROLL = "count(close) over w"


@query("wn_10_rolling", f"select symbol, date, case when {ROLL} >= 20 then avg(close) over w end as mean, case when {ROLL} >= 20 then stddev_samp(close) over w end as sd, case when {ROLL} >= 5 then sum(close) over w end as total from panel window w as (partition by symbol order by date rows between 19 preceding and current row)", "mean sd total")
def wn_10(t):
    w = ts.w(*SD)
    return t.panel.select("symbol", "date", ts.rolling("close", w, 20).alias("mean"), ts.rolling("close", w, 20, "stddev_samp").alias("sd"), ts.rolling("close", w, 20, "sum", 5).alias("total"))


GAPS = "select symbol, date, case when dayofmonth(date) % 5 = 0 then close end as x from panel"


def gaps(t):
    return t.panel.select("symbol", "date", F.when(F.dayofmonth("date") % 5 == 0, F.col("close")).alias("x"))


@query("wn_11_fill", f"select symbol, date, last_value(x ignore nulls) over (partition by symbol order by date rows unbounded preceding) as f, first_value(x ignore nulls) over (partition by symbol order by date rows between current row and unbounded following) as b from ({GAPS}) g", "f b")
def wn_11(t):
    w = ts.w(*SD)
    return gaps(t).select("symbol", "date", ts.ffill("x", w).alias("f"), ts.bfill("x", w).alias("b"))


@query("wn_12_interpolate", f"""select symbol, date, case when i0 = i1 then y0 when i0 is not null and i1 is not null then y0 + (y1 - y0) * (i - i0) / (i1 - i0) end as v from (select *, last_value(x ignore nulls) over a as y0, first_value(x ignore nulls) over z as y1,
    last_value(case when x is not null then i end ignore nulls) over a as i0, first_value(case when x is not null then i end ignore nulls) over z as i1 from (select *, row_number() over (partition by symbol order by date) as i from ({GAPS}) g) h
    window a as (partition by symbol order by date rows unbounded preceding), z as (partition by symbol order by date rows between current row and unbounded following)) k""", "v")  # fmt: skip
def wn_12(t):
    return ts.interpolate(gaps(t), ["symbol"], "date", "x", "v").select("symbol", "date", "v")


@query("wn_13_cs_zscore", "select symbol, date, case when s is null or s < 1e-12 then 0 else (close - m) / s end as z from (select *, avg(close) over (partition by date) as m, stddev_samp(close) over (partition by date) as s from panel) x", "z")
def wn_13(t):
    return t.panel.select("symbol", "date", ts.cs_zscore("close", "date").alias("z"))


@query("wn_14_avg_rank", "select symbol, date, (rank() over (partition by date order by volume) + (count(*) over (partition by date, volume) - 1) / 2.0) / count(*) over (partition by date) as r from panel", "r")
def wn_14(t):
    return ts.avg_rank(t.panel, "date", "volume", "r").select("symbol", "date", "r")


EQUITY = f"select symbol, date, exp(sum(ln(1 + r / 100)) over (partition by symbol order by date rows unbounded preceding)) as e from ({RET}) x where r is not null"


def equity(t):
    return returns(t).filter("r is not null").withColumn("small", F.col("r") / 100).withColumn("e", ts.compound("small", ts.w(*SD)))


@query("wn_15_drawdown", f"select symbol, min((e - peak) / peak) as worst from (select *, max(e) over (partition by symbol order by date rows unbounded preceding) as peak from ({EQUITY}) x) y group by symbol", "worst")
def wn_15(t):
    return equity(t).withColumn("d", ts.drawdown("e", ts.w(*SD))).groupBy("symbol").agg(F.min("d").alias("worst"))


@query("wn_16_z_composite", """select date, z, z - lag(z, 12) over (order by date) as momentum, sign(z) as regime from (select date, (a - avg(a) over ()) / (stddev_samp(a) over () + 1e-12) - (b - avg(b) over ()) / (stddev_samp(b) over () + 1e-12) as z
    from (select date, max(case when series_id = 'M_F' then value end) as a, max(case when series_id = 'M_O' then value end) as b from macro group by date) x where a is not null and b is not null) y""", "z momentum regime")  # fmt: skip
def wn_16(t):
    wide = t.macro.groupBy("date").pivot("series_id", ["M_F", "M_O"]).agg(F.max("value")).dropna()
    stats = wide.agg(*[f(c).alias(f"{n}_{c}") for c in ("M_F", "M_O") for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    z = lambda c: (F.col(c) - F.col(f"m_{c}")) / (F.col(f"s_{c}") + 1e-12)
    out = wide.crossJoin(F.broadcast(stats)).select("date", (z("M_F") - z("M_O")).alias("z"))  # one row of statistics
    return out.select("date", "z", (F.col("z") - F.lag("z", 12).over(Window.orderBy("date"))).alias("momentum"), F.signum("z").alias("regime"))  # a row a day


SIDE = "select symbol, date, case when close > avg(close) over (partition by symbol order by date rows between 19 preceding and current row) then 'bull' else 'bear' end as regime from panel"


def side(t):
    return t.panel.select("symbol", "date", F.when(F.col("close") > F.avg("close").over(ts.w(*SD).rowsBetween(-19, 0)), "bull").otherwise("bear").alias("regime"))


@query("wn_17_regime_flip", f"select symbol, date, regime from (select *, lag(regime) over (partition by symbol order by date) as before from ({SIDE}) x) y where regime = 'bull' and before = 'bear'")
def wn_17(t):
    return side(t).withColumn("before", F.lag("regime").over(ts.w(*SD))).filter("regime = 'bull' and before = 'bear'").select("symbol", "date", "regime")


@query("wn_18_regime_spans", f"""select symbol, regime, min(date) as "start", max(date) as "end", count(*) as n from (select *, sum(flip) over (partition by symbol order by date rows unbounded preceding) as run from
    (select *, case when lag(regime) over (partition by symbol order by date) = regime then 0 else 1 end as flip from ({SIDE}) x) y) z group by symbol, regime, run""")  # fmt: skip
def wn_18(t):
    return ts.spans(side(t), ["symbol"], "date", "regime")


@query("wn_19_sma", "select symbol, date, case when count(close) over w >= 50 then avg(close) over w end as sma from panel window w as (partition by symbol order by date rows between 49 preceding and current row)", "sma")
def wn_19(t):
    return t.panel.select("symbol", "date", ts.rolling("close", ts.w(*SD), 50).alias("sma"))


FOLD = """with recursive s as (select symbol, row_number() over (partition by symbol order by date) as i, date, {value} as v from {table}),
    e as (select symbol, i, date, (select avg(v) from s as f where f.symbol = s.symbol and f.i <= {size}) as x from s where i = {size}
    union all select s.symbol, s.i, s.date, e.x + {alpha} * (s.v - e.x) from e join s on s.symbol = e.symbol and s.i = e.i + 1) select s.symbol, s.date, e.x as {name} from s left join e on e.symbol = s.symbol and e.i = s.i"""  # fmt: skip


@query("wn_20_ema", FOLD.format(value="close", table="bars", size=5, alpha="(2.0 / 6)", name="ema"), "ema")
def wn_20(t):
    return ts.ema(t.bars.select("symbol", "date", "close"), "symbol", "date", "close", "ema", 5).select("symbol", "date", "ema")


TR = "(select symbol, date, greatest(high - low, coalesce(abs(high - lag(close) over (partition by symbol order by date)), 0), coalesce(abs(low - lag(close) over (partition by symbol order by date)), 0)) as tr from bars)"


@query("wn_21_atr", FOLD.format(value="tr", table=TR, size=4, alpha="0.25", name="atr"), "atr")
def wn_21(t):
    return ts.atr(t.bars.select("symbol", "date", "high", "low", "close"), "symbol", "date", "atr", 4).select("symbol", "date", "atr")


@query("wn_22_crosses", """select symbol, date, case when before <= 0 and gap > 0 then 1 else -1 end::bigint as hit from (select *, lag(gap) over (partition by symbol order by date) as before from
    (select symbol, date, avg(close) over (partition by symbol order by date rows between 9 preceding and current row) - avg(close) over (partition by symbol order by date rows between 49 preceding and current row) as gap from panel) x) y where (before <= 0 and gap > 0) or (before >= 0 and gap < 0)""")  # fmt: skip
def wn_22(t):
    w = ts.w(*SD)
    return t.panel.withColumn("fast", F.avg("close").over(w.rowsBetween(-9, 0))).withColumn("slow", F.avg("close").over(w.rowsBetween(-49, 0))).withColumn("hit", ts.crosses("fast", "slow", w)).filter("hit <> 0").select("symbol", "date", "hit")


@query("wn_23_gap_regime", """select symbol, date, case when gap > 0.3 * band then 'bull' when gap < -0.3 * band then 'bear' else 'neutral' end as regime from (select symbol, date, avg(close) over (partition by symbol order by date rows between 9 preceding and current row)
    - avg(close) over (partition by symbol order by date rows between 49 preceding and current row) as gap, avg(high - low) over (partition by symbol order by date rows between 13 preceding and current row) as band from panel) x""")  # fmt: skip
def wn_23(t):
    w = ts.w(*SD)
    gap, band = F.avg("close").over(w.rowsBetween(-9, 0)) - F.avg("close").over(w.rowsBetween(-49, 0)), F.avg(F.col("high") - F.col("low")).over(w.rowsBetween(-13, 0))
    return t.panel.select("symbol", "date", gap.alias("gap"), band.alias("band")).select("symbol", "date", F.when(F.col("gap") > 0.3 * F.col("band"), "bull").when(F.col("gap") < -0.3 * F.col("band"), "bear").otherwise("neutral").alias("regime"))


@query("wn_24_trailing_spike", """select symbol, date, (volume - m) / s as z, case when (volume - m) / s >= 3 then 'high' else 'medium' end as severity from (select symbol, date, volume, avg(volume) over w as m, stddev_pop(volume) over w as s, count(*) over w as n, row_number() over (partition by symbol order by date desc) as k from panel
    window w as (partition by symbol order by date rows between 29 preceding and 1 preceding)) x where n >= 2 and s > 0 and (volume - m) / s >= 2""", "z")  # fmt: skip
def wn_24(t):
    w = ts.w(*SD).rowsBetween(-29, -1)
    x = t.panel.select("symbol", "date", "volume", F.avg("volume").over(w).alias("m"), F.stddev_pop("volume").over(w).alias("s"), F.count("*").over(w).alias("n")).filter("n >= 2 and s > 0").withColumn("z", (F.col("volume") - F.col("m")) / F.col("s"))
    return x.filter("z >= 2").select("symbol", "date", "z", F.when(F.col("z") >= 3, "high").otherwise("medium").alias("severity"))


@query("wn_25_hour_cluster", """select symbol, min(ts) as anchor from (select a.symbol, a.ts, count(distinct b.user_id) as handles from ticks a join ticks b on a.symbol = b.symbol and b.ts >= a.ts and b.ts <= a.ts + interval 1 hour group by a.symbol, a.ts, a.event_id having count(distinct b.user_id) >= 3) x group by symbol""")
def wn_25(t):
    near = distinct_near(t.ticks.select("symbol", "ts", "user_id"), ["symbol"], "ts", "user_id", 0, 3600, "handles")
    return near.filter("handles >= 3").groupBy("symbol").agg(F.min("ts").alias("anchor"))


@query("wn_26_first_occurrence", "select symbol, min(ts) as first_ts, min_by(event_id, ts) as event_id from ticks group by symbol")
def wn_26(t):
    return t.ticks.groupBy("symbol").agg(F.min("ts").alias("first_ts"), F.min_by("event_id", "ts").alias("event_id"))


@query("wn_27_rebalance_calendar", "select distinct date from panel where isodow(date) = 5")
def wn_27(t):
    days = t.panel.select("date").distinct()
    fridays = days.filter(F.weekday("date") == 4)
    fallback = days.groupBy(F.date_trunc("week", "date")).agg(F.max("date").alias("date")).select("date")
    any_friday = fridays.agg((F.count("*") > 0).alias("any"))
    return fridays.unionByName(fallback.crossJoin(F.broadcast(any_friday)).filter("not any").select("date"))  # one row


@query("wn_28_n_row_return", "select symbol, date, close / nullif(lag(close, 20) over (partition by symbol order by date), 0) - 1 as r20, close / nullif(first_value(close) over (partition by symbol, year(date) order by date), 0) - 1 as ytd from panel", "r20 ytd")
def wn_28(t):
    year = Window.partitionBy("symbol", F.year("date")).orderBy("date")
    return t.panel.select("symbol", "date", ts.pct_change("close", ts.w(*SD), 20).alias("r20"), (F.try_divide(F.col("close"), F.first("close").over(year)) - 1).alias("ytd"))


@query("wn_29_rolling_ratio", "select symbol, date, close / nullif(case when count(close) over w >= 52 then avg(close) over w end, 0) as ratio from panel window w as (partition by symbol order by date rows between 51 preceding and current row)", "ratio")
def wn_29(t):
    return t.panel.select("symbol", "date", F.try_divide(F.col("close"), ts.rolling("close", ts.w(*SD), 52)).alias("ratio"))
