"""Research composites, snapshot, scarcity and fee value, calibrated fans over the market tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import regimes as rg
from tidemark.operators import research as rs
from tidemark.operators import series as ts
from tidemark.operators import signals as sg
from tidemark.operators import strategy as st
from tidemark.plans.queries_domain import FEAT, SD, S, z
from tidemark.plans.queries_sources import CYCLE_INDEX, LIQUIDITY, wide_macro, wide_onchain
from tidemark.plans.registry import query

#: Which column of the panel stands for which weekly series: (name, symbol, column, divisor).
SERIES = (
    ("market_cap", "1-URGENT", "close", 1), ("miner_revenue_usd", "1-URGENT", "open", 1), ("transfer_volume_usd", "1-URGENT", "high", 1), ("fees_usd", "1-URGENT", "low", 1), ("tx_count", "1-URGENT", "volume", 1),
    ("hashrate", "2-HIGH", "close", 1), ("active_addresses", "2-HIGH", "open", 1), ("exchange_balance", "2-HIGH", "high", 1),
    ("mvrv", "3-MEDIUM", "close", 1e5), ("sopr", "3-MEDIUM", "open", 1e5), ("nupl", "5-LOW", "close", 1e5), ("rhodl", "5-LOW", "open", 1e5),
)
WEEKLY = (
    "select cast(date_trunc('week', date) as date) as week, "
    + ", ".join(f"max_by({c}, date) filter (symbol = '{s}') / {by} as {n}" for n, s, c, by in SERIES)
    + " from panel group by 1"
)


def weekly(t):
    one = lambda s, c, by: F.max_by(c, F.when(F.col("symbol") == s, F.col("date"))) / by
    return t.panel.groupBy(sg.week()).agg(*[one(s, c, by).alias(n) for n, s, c, by in SERIES])


def total(*terms):
    """Sum of signed z-scores over all rows, in SQL."""
    return " ".join(f"{sign} ({c} - avg({c}) over ()) / (stddev_samp({c}) over () + 1e-12)" for sign, c in terms)


def standard(c):
    return f"({c} - avg({c}) over ()) / case when stddev_samp({c}) over () > 1e-12 then stddev_samp({c}) over () else 1 end"


# ---- alpha score with open interest

OI = "select symbol, date, oi / nullif(lag(oi, 5) over (partition by symbol order by date), 0) - 1 as oi_change from (select p.symbol, p.date, o.oi from panel p left join (select symbol, cast(ts as date) as date, sum(open_interest) as oi from open_interest group by 1, 2) o on o.symbol = p.symbol and o.date = p.date) x"


@query(
    "dp_03_with_open_interest",
    f"""select symbol, date, floor(({z("mom_20")} + {z("mom_60")} + {z("volume_z")} + {z("oi_change")} - {z("vol")}) * 1e9 + 0.5) / 1e9 as alpha from (select f.*, o.oi_change from ({FEAT}) f join ({OI}) o on o.symbol = f.symbol and o.date = f.date) g""",
    "alpha",
)
def dp_03_interest(t):
    oi = t.open_interest.groupBy("symbol", F.col("ts").cast("date").alias("date")).agg(F.sum("open_interest").alias("open_interest_usd"))
    panel = t.panel.select(*SD, "close", "volume").join(oi, SD, "left")
    return st.score(st.features(panel, S), S).select(*SD, "alpha")


# ---- snapshot


def snapshot(t):
    flows = t.transfers.groupBy("date").agg(F.sum(F.when(F.col("direction") == "inflow", F.col("amount")).otherwise(-F.col("amount"))).alias("net_flow"))
    stock = t.panel.filter("symbol = '2-HIGH'").select("date", "close")
    return rg.snapshot(t.panel.select(*SD, "close"), "1-URGENT", sg.liquidity_signal(wide_macro(t)), sg.cycle_signal(wide_onchain(t).drop("nupl")), flows, stock)


SIGN = "case when n <= {least} or m is null then 0 when m > 0 then 1 else -1 end"
LAST = "(select (select count(*) from ({series}) a) as n, (select momentum from ({series}) b order by week desc limit 1) as m)"
OWN = "select *, close / nullif(lag(close) over o, 0) - 1 as ret_1d, close / nullif(lag(close, 7) over o, 0) - 1 as ret_7d, close / nullif(lag(close, 30) over o, 0) - 1 as ret_30d, case when row_number() over y > 1 then close / first_value(close) over y - 1 end as ret_ytd from (select date, close from panel where symbol = '1-URGENT') c window o as (order by date), y as (partition by year(date) order by date)"
SNAPSHOT = f"""with own as (select * from ({OWN}) x order by date desc limit 1),
    ends as (select symbol, max_by(close, date) as latest, max_by(close, date) filter (date <= (select max(date) from panel) - 7) as earlier from panel group by symbol),
    up as (select avg(case when latest > earlier then 1.0 else 0.0 end) as pct_up_7d, count(*) as n_universe from ends where earlier > 0),
    warm as (select date, avg(case when close > ma then 1.0 else 0.0 end) as above from (select symbol, date, close, case when count(close) over w >= 50 then avg(close) over w end as ma from panel window w as (partition by symbol order by date rows between 49 preceding and current row)) x where ma is not null group by date),
    flows as (select date, sum(case when direction = 'inflow' then amount else -amount end) as f from transfers group by date order by date desc limit 7),
    rel as (select a.close / nullif(lag(a.close, 20) over o, 0) - b.close / nullif(lag(b.close, 20) over o, 0) as r from (select * from panel where symbol = '2-HIGH') a join (select * from panel where symbol = '1-URGENT') b on a.date = b.date window o as (order by a.date) order by a.date desc limit 1),
    parts as (select own.date as as_of, own.close, ret_1d, ret_7d, ret_30d, ret_ytd, pct_up_7d, n_universe, (select max_by(above, date) from warm) as pct_above_50, {SIGN.format(least=17).replace(" n ", " l.n ").replace(" m ", " l.m ")} as liq_signal, {SIGN.format(least=14).replace(" n ", " c.n ").replace(" m ", " c.m ")} as oc_signal,
    (select sum(f) from flows) as etf_7d, (select r from rel) as rel_20d from own, up, {LAST.format(series=LIQUIDITY)} l, {LAST.format(series=CYCLE_INDEX)} c),
    signed as (select *, case when coalesce(pct_above_50, pct_up_7d) > 0.55 then 1 when coalesce(pct_above_50, pct_up_7d) < 0.45 then -1 else 0 end as breadth_signal, case when etf_7d > 50 then 1 when etf_7d < -50 then -1 else 0 end + case when rel_20d > 0.02 then 1 when rel_20d < -0.02 then -1 else 0 end as wanted from parts)
    select as_of, close, ret_1d, ret_7d, ret_30d, ret_ytd, pct_up_7d, n_universe, pct_above_50, liq_signal::bigint as liq_signal, oc_signal::bigint as oc_signal, breadth_signal::bigint as breadth_signal, (liq_signal + oc_signal + breadth_signal)::bigint as stack_score, etf_7d, rel_20d,
    case when liq_signal + oc_signal + breadth_signal >= 2 then 'Constructive' when liq_signal + oc_signal + breadth_signal <= -2 then 'Defensive' else 'Neutral / mixed' end as stack_label,
    case when wanted >= 2 then 'strong demand' when wanted <= -2 then 'weak demand' when wanted > 0 then 'constructive' when wanted < 0 then 'cautious' else 'mixed' end as demand_label from signed"""


@query("dp_19_market_snapshot", SNAPSHOT, "close ret_1d ret_7d ret_30d ret_ytd pct_up_7d pct_above_50 etf_7d rel_20d")
def dp_19_market(t):
    return snapshot(t).select("as_of", "close", "ret_1d", "ret_7d", "ret_30d", "ret_ytd", "pct_up_7d", "n_universe", "pct_above_50", "liq_signal", "oc_signal", "breadth_signal", "stack_score", "etf_7d", "rel_20d", "stack_label", "demand_label")


# ---- activity

MOMS = ", ".join(f"ln({c}) - ln(lag({c}, 12) over (order by week)) as m_{c}" for c in ("market_cap", "transfer_volume_usd", "fees_usd"))
ROLL = lambda c: f"coalesce(case when count({c}) over w >= 13 then ({c} - avg({c}) over w) / nullif(stddev_samp({c}) over w, 0) end, 0)"
ACTIVITY = f"""select *, composite - lag(composite, 12) over (order by week) as activity_momentum from (select week, market_cap, transfer_volume_usd, {ROLL("m_market_cap")} + {ROLL("m_transfer_volume_usd")} + {ROLL("m_fees_usd")} as composite
    from (select *, {MOMS} from ({WEEKLY}) a) b window w as (order by week rows between 51 preceding and current row)) c"""


def active(t):
    return rg.activity(weekly(t), ["market_cap", "transfer_volume_usd", "fees_usd"])


@query("dp_21_activity", f"select week, composite, activity_momentum, case when activity_momentum is not null then (activity_momentum > 0)::bigint end as regime from ({ACTIVITY}) x", "composite activity_momentum")
def dp_21_activity(t):
    return active(t).select("week", "composite", "activity_momentum", "regime")


DIRECTION = lambda c: f"case when {c} is null then 'n/a' when {c} > 0.02 then 'up' when {c} < -0.02 then 'down' else 'flat' end"
CHANGES = ", ".join(f"{c} / nullif(lag({c}, {n}) over (order by week), 0) - 1 as {k}_{n}w" for k, c in (("size", "market_cap"), ("volume", "transfer_volume_usd")) for n in (4, 13))


@query(
    "dp_21_outlook",
    f"""select week, size_13w, volume_13w, {DIRECTION("size_13w")} as size_direction, case when coalesce(r, 0) = 1 and {DIRECTION("size_13w")} = 'up' and {DIRECTION("volume_13w")} in ('up', 'flat') then 'constructive'
    when coalesce(r, 0) = 0 and {DIRECTION("size_13w")} = 'down' then 'defensive' else 'mixed' end as outlook from (select week, (activity_momentum > 0)::int as r, {CHANGES} from ({ACTIVITY}) x) y order by week desc limit 1""",
    "size_13w volume_13w",
)
def dp_21_outlook(t):
    return rg.activity_outlook(active(t), "market_cap", "transfer_volume_usd").select("week", "size_13w", "volume_13w", F.col("size_13w_direction").alias("size_direction"), "outlook")


# ---- on-chain cycle

YOY = lambda n, c: f"ln({c}) - ln(lag({c}, 52) over o) as {n}_yoy"
FEATURES = f"""select *, puell_multiple - lag(puell_multiple, 12) over (order by week) as puell_mom, mvrv - lag(mvrv, 12) over (order by week) as mvrv_mom, sopr - lag(sopr, 12) over (order by week) as sopr_mom, nupl - lag(nupl, 12) over (order by week) as nupl_mom from
    (select *, miner_revenue_usd / (hashrate + 1e-9) as hashprice, fees_usd / (miner_revenue_usd + 1e-9) as fee_rev_share, transfer_volume_usd / (market_cap + 1e-9) as transfer_velocity,
    miner_revenue_usd / nullif(case when count(miner_revenue_usd) over w >= 52 then avg(miner_revenue_usd) over w end, 0) as puell_multiple, {YOY("active_addr", "active_addresses")}, {YOY("tx_count", "(tx_count + 1.0)")}, {YOY("hashrate", "hashrate")}, {YOY("exchange_balance", "exchange_balance")}
    from ({WEEKLY}) a window o as (order by week), w as (order by week rows between 51 preceding and current row)) b"""
DERIVED = ("hashprice", "fee_rev_share", "transfer_velocity", "puell_multiple", "active_addr_yoy", "tx_count_yoy", "hashrate_yoy", "exchange_balance_yoy", "puell_mom", "mvrv_mom", "sopr_mom", "nupl_mom")


@query("dp_22_onchain_features", f"select week, {', '.join(DERIVED)} from ({FEATURES}) f", " ".join(DERIVED))
def dp_22_features(t):
    return rg.cycle_features(weekly(t)).select("week", *DERIVED)


KNOWN = f"select * from ({FEATURES}) f where hashprice is not null and puell_multiple is not null and mvrv is not null"
CYCLE = f"""select week, cycle_index, cycle_index - lag(cycle_index, 12) over (order by week) as cycle_mom, early_warn from (select week, {standard("c")} as cycle_index, {standard("e")} as early_warn from
    (select week, {total(("", "mvrv"), ("+", "sopr"), ("+", "nupl"), ("+", "rhodl"), ("-", "puell_multiple"))} as c, {total(("-", "puell_mom"), ("+", "mvrv_mom"), ("+", "active_addr_yoy"), ("+", "sopr_mom"))} as e from ({KNOWN}) k) r) s"""


@query("dp_22_cycle_composite", CYCLE, "cycle_index cycle_mom early_warn")
def dp_22_composite(t):
    return rg.cycle_composite(rg.cycle_features(weekly(t))).select("week", "cycle_index", "cycle_mom", "early_warn")


# ---- early warning

WARN_BASE = "select week, mvrv - nupl as real_10y, sopr - rhodl as curve, ln(market_cap) - ln(lag(market_cap, 52) over (order by week)) as money, hashrate as dollar from ({}) w".format(WEEKLY)
WARN = f"""select week, money, {standard("e")} as early_warn from (select week, money, {total(("-", "real_m"), ("+", "curve_m"), ("+", "money_m"), ("-", "dollar_m"))} as e from (select week, money, {", ".join(f"{c} - lag({c}, 12) over (order by week) as {n}_m" for n, c in (("real", "real_10y"), ("curve", "curve"), ("money", "money"), ("dollar", "dollar")))}
    from ({WARN_BASE}) a) b) c"""


def warned(t):
    w = weekly(t).select("week", (F.col("mvrv") - F.col("nupl")).alias("real_10y"), (F.col("sopr") - F.col("rhodl")).alias("curve"), rg.log_change(F.col("market_cap"), 52).alias("money"), F.col("hashrate").alias("dollar"))
    return rg.early_warning(w, "real_10y", "curve", "money", "dollar")


@query("dp_23_four_series", f"select week, early_warn from ({WARN}) x", "early_warn")
def dp_23_series(t):
    return warned(t).select("week", "early_warn")


@query(
    "dp_23_lead",
    f"""with i as (select row_number() over (order by week) as i, early_warn as x, money as y from ({WARN}) w where early_warn is not null and money is not null),
    c as (select lag, corr(a.x, b.y) as corr from (select *, unnest(range(-26, 27)) as lag from i) a join i b on b.i = a.i + a.lag group by lag having count(*) > 20)
    select (select lag from c order by abs(corr) desc, lag limit 1) as lag, (select corr from c order by abs(corr) desc, lag limit 1) as corr""",
    "corr",
)
def dp_23_lead(t):
    """How many weeks the early warning goes ahead of money growth."""
    return rg.best_lead(warned(t), "week", "early_warn", "money")


# ---- scarcity and fee value

ETH = "select week, market_cap as close, hashrate * 100 as supply, case when mvrv > 1.5 then -1.0 else 1.0 end * nupl * 40 as net_issuance, fees_usd as fee_revenue, mvrv as dgs10 from ({}) w where market_cap is not null".format(WEEKLY)


def eth(t):
    net = F.when(F.col("mvrv") > 1.5, -1.0).otherwise(1.0) * F.col("nupl") * 40
    w = weekly(t).filter("market_cap is not null")
    return w.select("week", F.col("market_cap").alias("close"), (F.col("hashrate") * 100).alias("supply"), net.alias("net_issuance"), F.col("fees_usd").alias("fee_revenue"), F.col("mvrv").alias("dgs10"))


@query(
    "dp_24_scarcity",
    f"select week, net_issuance * 52 as net_issuance_ann, (net_issuance * 52 <= 0)::bigint as is_deflationary, case when net_issuance * 52 > 1000 then supply / (net_issuance * 52) else 500.0 end as s2f, ln(greatest(case when net_issuance * 52 > 1000 then supply / (net_issuance * 52) else 500.0 end, 1e-6)) as log_s2f from ({ETH}) e",
    "net_issuance_ann s2f log_s2f",
)
def dp_24_scarcity(t):
    return rg.scarcity(eth(t)).select("week", "net_issuance_ann", "is_deflationary", "s2f", "log_s2f")


GORDON = lambda cash, rate, g, supply: f"case when {rate} > {g} + 1e-4 then {cash} * (1 + {g}) / ({rate} - {g}) / {supply} end"


@query(
    "dp_24_fee_scenarios",
    f"select *, close / nullif(dcf_base, 0) - 1 as dcf_gap from (select week, close, {', '.join(f'{GORDON("(fee_revenue * 52)", "(dgs10 / 100 + 0.08)", f"({g})", "supply")} as dcf_{n}' for n, g in rg.SCENARIOS.items())} from ({ETH}) e) x",
    "close dcf_bear dcf_base dcf_bull dcf_gap",
)
def dp_24_scenarios(t):
    return rg.fee_value(eth(t)).select("week", "close", "dcf_bear", "dcf_base", "dcf_bull", "dcf_gap")


@query(
    "dp_24_fee_grid",
    f"""select growth, premium, {GORDON("(fee_revenue * 52)", "(dgs10 / 100 + premium)", "growth", "supply")} as value from (select * from ({ETH}) e where fee_revenue is not null and dgs10 is not null and supply is not null order by week desc limit 1) x,
    (select unnest({list(rg.GROWTHS)}::double[]) as growth) g, (select unnest({list(rg.PREMIUMS)}::double[]) as premium) p""",
    "growth premium value",
)
def dp_24_grid(t):
    return rg.fee_grid(eth(t))


# ---- calibrated fans


@query("dp_29_calibrated_fan")
def dp_29_fan(t):
    """Intervals of each symbol's trend, rescaled by earlier origins; draws come from hashes, which SQL cannot repeat."""
    return rs.calibrated_fan(t.panel.withColumn("y", F.log("close")), "symbol", "date", "y", [30, 90], 200, 30, 200, 900)


@query(
    "dp_26_prefix_trends",
    """select symbol, i as origin, slope, intercept from (select symbol, i, regr_slope(y, i) over w as slope, regr_intercept(y, i) over w as intercept from (select symbol, date, ln(close) as y, row_number() over (partition by symbol order by date) as i from panel) x
    window w as (partition by symbol order by i rows unbounded preceding)) z where i > 2 and i % 50 = 0""",
    "slope intercept",
)
def dp_26_prefix(t):
    x = t.panel.select("symbol", F.log("close").alias("y"), F.row_number().over(ts.w("symbol", "date")).cast("double").alias("i"))
    return rs.prefix_fits(x, "symbol").filter("origin % 50 = 0").select("symbol", "origin", "slope", "intercept")
