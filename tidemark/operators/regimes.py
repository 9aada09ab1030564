"""Research composites on weekly series: activity, cycle valuation, early warning, scarcity and fee value, market snapshot."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import series as ts
from tidemark.operators import signals as sg
from tidemark.operators.stores import written


def _along(order: str = "week"):
    return Window.orderBy(order)  # a row a week or a day


def log_change(c: Column, n: int, window=None) -> Column:
    w = _along() if window is None else window
    return F.log(c) - F.lag(F.log(c), n).over(w)


def change(c: str | Column, n: int, window=None) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c - F.lag(c, n).over(_along() if window is None else window)


# ---- activity

#: Weeks of momentum, window and least weeks of its z-score; bounds of a direction.
ACTIVITY_MOMENTUM, ACTIVITY_WINDOW, ACTIVITY_LEAST, FLAT = 12, 52, 13, 0.02


def activity(weekly: DataFrame, columns: Sequence[str], window: int = ACTIVITY_WINDOW, least: int = ACTIVITY_LEAST, momentum: int = ACTIVITY_MOMENTUM) -> DataFrame:
    """Adds composite (sum of rolling z-scores of log momenta, unknown ones 0), activity_momentum and regime (1: it rises)."""
    w = _along()
    x = weekly.withColumns({f"_m_{c}": log_change(F.col(c), momentum) for c in columns})
    zed = lambda c: F.coalesce(F.try_divide(F.col(c) - ts.rolling(c, w, window, least=least), ts.rolling(c, w, window, "stddev_samp", least)), F.lit(0.0))
    x = x.withColumn("composite", sum((zed(f"_m_{c}") for c in columns), F.lit(0.0))).drop(*[f"_m_{c}" for c in columns])
    x = x.withColumn("activity_momentum", change("composite", momentum))
    return x.withColumn("regime", (F.col("activity_momentum") > 0).cast("int"))


def direction(c: Column) -> Column:
    return F.when(c.isNull() | F.isnan(c), "n/a").when(c > FLAT, "up").when(c < -FLAT, "down").otherwise("flat")


def activity_outlook(active: DataFrame, size: str, volume: str) -> DataFrame:
    """The last week with its 4- and 13-week changes of size and volume, their directions and the outlook."""
    w = _along()
    x = active.select("week", "composite", "regime", *[ts.pct_change(c, w, n).alias(f"{k}_{n}w") for k, c in (("size", size), ("volume", volume)) for n in (4, 13)])
    x = x.filter("composite is not null").orderBy(F.desc("week")).limit(1)
    up = direction(F.col("size_13w"))
    bull = (F.coalesce("regime", F.lit(0)) == 1) & (up == "up") & direction(F.col("volume_13w")).isin("up", "flat")
    bear = (F.coalesce("regime", F.lit(0)) == 0) & (up == "down")
    return x.withColumns({f"{k}_direction": direction(F.col(k)) for k in ("size_4w", "size_13w", "volume_4w", "volume_13w")}).withColumn("outlook", F.when(bull, "constructive").when(bear, "defensive").otherwise("mixed"))


# ---- on-chain cycle

YEAR, MOMENTUM = 52, 12


def cycle_features(weekly: DataFrame) -> DataFrame:
    """Adds hash price, fee share, velocity, Puell multiple, yearly log growths and 12-week momenta to a wide weekly table."""
    c, tiny = F.col, 1e-9
    x = weekly.withColumns(
        {
            "hashprice": c("miner_revenue_usd") / (c("hashrate") + tiny), "fee_rev_share": c("fees_usd") / (c("miner_revenue_usd") + tiny), "transfer_velocity": c("transfer_volume_usd") / (c("market_cap") + tiny),
            "puell_multiple": F.try_divide(c("miner_revenue_usd"), ts.rolling("miner_revenue_usd", _along(), YEAR)),
        }
        | {f"{n}_yoy": log_change(v, YEAR) for n, v in (("active_addr", c("active_addresses")), ("tx_count", c("tx_count") + 1.0), ("hashrate", c("hashrate")), ("exchange_balance", c("exchange_balance")))}
    )
    return x.withColumns({f"{n}_mom": change(v, MOMENTUM) for n, v in (("puell", "puell_multiple"), ("mvrv", "mvrv"), ("sopr", "sopr"), ("nupl", "nupl"))})


def composite(df: DataFrame, signs: Mapping[str, int], out: str) -> DataFrame:
    """Adds the standardised sum of signed z-scores over all rows."""
    x = written(sg.zscores(df, signs, "_raw"), "composite")
    stats = x.agg(F.avg("_raw").alias("_mean"), F.stddev_samp("_raw").alias("_sd"))
    sd = F.when(F.col("_sd") > 1e-12, F.col("_sd")).otherwise(1.0)
    return x.crossJoin(F.broadcast(stats)).withColumn(out, (F.col("_raw") - F.col("_mean")) / sd).drop("_raw", "_mean", "_sd")  # one row


def cycle_composite(features: DataFrame) -> DataFrame:
    """Adds cycle_index, cycle_mom, regime and early_warn to the weeks on which price, hash price, Puell multiple and MVRV are known."""
    x = features.dropna(subset=["hashprice", "puell_multiple", "mvrv"])
    x = composite(x, {"mvrv": 1, "sopr": 1, "nupl": 1, "rhodl": 1, "puell_multiple": -1}, "cycle_index")
    x = x.withColumn("cycle_mom", change("cycle_index", MOMENTUM)).withColumn("regime", (F.col("cycle_mom") > 0).cast("int"))
    return composite(x, {"puell_mom": -1, "mvrv_mom": 1, "active_addr_yoy": 1, "sopr_mom": 1}, "early_warn")


# ---- early warning


def early_warning(weekly: DataFrame, real: str, curve: str, money: str, dollar: str, out: str = "early_warn") -> DataFrame:
    """Adds the standardised -z(real rate) + z(curve) + z(money growth) - z(dollar), each of its 12-week change."""
    x = weekly.withColumns({f"_{k}": change(c, MOMENTUM) for k, c in (("real", real), ("curve", curve), ("money", money), ("dollar", dollar))})
    return composite(x, {"_real": -1, "_curve": 1, "_money": 1, "_dollar": -1}, out).drop("_real", "_curve", "_money", "_dollar")


def best_lead(df: DataFrame, order: str, x: str, y: str, most: int = 26, least: int = 20) -> DataFrame:
    """(lag, corr): how many rows x goes ahead of y where their correlation is largest in size; pairs of more than ``least`` rows."""
    i = written(df.dropna(subset=[x, y]).select(F.row_number().over(Window.orderBy(order)).alias("i"), F.col(x).alias("x"), F.col(y).alias("y")), "leads")  # a row a week
    ahead = i.select("x", F.explode(F.sequence(F.lit(-most), F.lit(most))).alias("lag"), "i").select("x", "lag", (F.col("i") + F.col("lag")).alias("i"))
    each = ahead.join(i.select("i", "y"), "i").groupBy("lag").agg(F.corr("x", "y").alias("corr"), F.count("*").alias("n")).filter(F.col("n") > least)
    return each.agg(F.max_by("lag", F.struct(F.abs("corr"), -F.col("lag"))).alias("lag"), F.max_by("corr", F.struct(F.abs("corr"), -F.col("lag"))).alias("corr"))


# ---- scarcity and fee value

#: Floor of a year's issuance, the ratio beyond it, growth by scenario, grids, premium.
S2F_FLOOR, S2F_CAP = 1e3, 500.0
SCENARIOS = {"bear": -0.02, "base": 0.03, "bull": 0.08}
PREMIUMS, GROWTHS, PREMIUM, MARGIN = (0.04, 0.06, 0.08, 0.10, 0.12), (-0.02, 0.00, 0.03, 0.05, 0.08), 0.08, 1e-4


def scarcity(weekly: DataFrame, net: str = "net_issuance", supply: str = "supply") -> DataFrame:
    """Adds net_issuance_ann, is_deflationary, s2f (capped where next to nothing is issued) and log_s2f."""
    year = F.col(net) * 52.0
    s2f = F.when(year > S2F_FLOOR, F.col(supply) / year).otherwise(S2F_CAP)
    return weekly.withColumns({"net_issuance_ann": year, "is_deflationary": (year <= 0).cast("int"), "s2f": s2f, "log_s2f": F.log(F.greatest(s2f, F.lit(1e-6)))})


def gordon(cash: Column, rate: Column, growth: Column, supply: Column) -> Column:
    """Value a unit of a cash flow that grows for ever; null where growth comes up to the rate."""
    return F.when(rate > growth + MARGIN, cash * (1 + growth) / (rate - growth) / supply)


def fee_value(weekly: DataFrame, fees: str = "fee_revenue", yield_: str = "dgs10", supply: str = "supply", premium: float = PREMIUM) -> DataFrame:
    """Adds the fee value by scenario and the market's gap to the middle one."""
    cash, rate = F.col(fees) * 52.0, F.col(yield_) / 100.0 + premium
    x = weekly.withColumns({f"dcf_{name}": gordon(cash, rate, F.lit(g), F.col(supply)) for name, g in SCENARIOS.items()})
    return x.withColumn("dcf_gap", F.try_divide(F.col("close"), F.col("dcf_base")) - 1)


def fee_grid(weekly: DataFrame, fees: str = "fee_revenue", yield_: str = "dgs10", supply: str = "supply") -> DataFrame:
    """(growth, premium, value) of the last known week over both grids."""
    last = weekly.dropna(subset=[fees, yield_, supply]).orderBy(F.desc("week")).limit(1).select((F.col(fees) * 52.0).alias("cash"), (F.col(yield_) / 100).alias("y"), F.col(supply).alias("s"))
    grid = last.withColumn("growth", F.explode(F.array(*map(F.lit, GROWTHS)))).withColumn("premium", F.explode(F.array(*map(F.lit, PREMIUMS))))
    return grid.select("growth", "premium", gordon(F.col("cash"), F.col("y") + F.col("premium"), F.col("growth"), F.col("s")).alias("value"))


# ---- market snapshot


def breadth(daily: DataFrame) -> DataFrame:
    """One row: share of symbols up over 7 days, of symbols above their 50-row mean on the last day that has one, how many, signal."""
    latest = daily.agg((F.max("date") - F.expr("interval 7 days")).cast("date").alias("_week_ago"))
    x = daily.crossJoin(F.broadcast(latest))  # one row
    ends = x.groupBy("symbol").agg(F.max_by("close", "date").alias("last"), F.max_by("close", F.when(F.col("date") <= F.col("_week_ago"), F.col("date"))).alias("lag")).filter("lag > 0")
    up = ends.agg(F.avg((F.col("last") > F.col("lag")).cast("double")).alias("pct_up_7d"), F.count("*").alias("n_universe"))
    warm = daily.withColumn("ma50", ts.rolling("close", ts.w("symbol", "date"), 50)).filter("ma50 is not null")
    day = warm.groupBy("date").agg(F.avg((F.col("close") > F.col("ma50")).cast("double")).alias("above"))
    above = day.agg(F.max_by("above", "date").alias("pct_above_50"))
    both = up.crossJoin(F.broadcast(above))  # one row each
    share = F.coalesce("pct_above_50", "pct_up_7d")
    return both.withColumn("breadth_signal", F.when(share > 0.55, 1).when(share < 0.45, -1).otherwise(0))


def demand(flows: DataFrame, stock: DataFrame, coin: DataFrame) -> DataFrame:
    """One row (demand_signal, etf_7d, rel_20d) of (date, net_flow) and two series of (date, close). Fixed values."""
    last = flows.orderBy(F.desc("date")).limit(7).agg(F.sum("net_flow").alias("etf_7d"))
    j = stock.select("date", F.col("close").alias("a")).join(coin.select("date", F.col("close").alias("b")), "date")
    w = _along("date")
    j = j.select("date", (ts.pct_change("a", w, 20) - ts.pct_change("b", w, 20)).alias("rel"))
    rel = j.agg(F.max_by("rel", "date").alias("rel_20d"))
    sign = lambda c, by: F.when(F.col(c) > by, 1).when(F.col(c) < -by, -1).otherwise(0)
    score = sign("etf_7d", 50.0) + sign("rel_20d", 0.02)
    out = last.crossJoin(F.broadcast(rel)).withColumn("demand_signal", F.when(score > 0, 1).when(score < 0, -1).otherwise(0))  # one row each
    label = F.when(score >= 2, "strong demand").when(score <= -2, "weak demand").when(score > 0, "constructive").when(score < 0, "cautious").otherwise("mixed")
    return out.withColumn("demand_label", F.when(F.col("etf_7d").isNull() & F.col("rel_20d").isNull(), "MISSING").otherwise(label))


def snapshot(daily: DataFrame, coin: str, liquidity: DataFrame, cycle: DataFrame, flows: DataFrame, stock: DataFrame) -> DataFrame:
    """One row: the coin's returns, breadth, signals, labels and the text that names what drives them.

    ``daily``: (symbol, date, close); ``liquidity`` and ``cycle``: (signal, label); ``flows``: (date, net_flow); ``stock``: (date, close).
    """
    own = daily.filter(F.col("symbol") == coin).select("date", "close")
    w = _along("date")
    returns = {f"ret_{n}d": ts.pct_change("close", w, n) for n in (1, 7, 30)}
    x = own.withColumns(returns).withColumn("_year", F.year("date")).withColumn("_open", F.first("close").over(Window.partitionBy("_year").orderBy("date")))
    x = x.withColumn("ret_ytd", F.when(F.row_number().over(Window.partitionBy("_year").orderBy("date")) > 1, F.col("close") / F.col("_open") - 1))
    last = x.agg(F.max_by(F.struct("date", "close", *returns, "ret_ytd"), "date").alias("l")).select("l.*").withColumnRenamed("date", "as_of")
    one = last
    for more in (breadth(daily), liquidity.select(F.col("signal").alias("liq_signal"), F.col("label").alias("liq_label")), cycle.select(F.col("signal").alias("oc_signal"), F.col("label").alias("oc_label")), demand(flows, stock, own)):
        one = one.crossJoin(F.broadcast(more))  # one row each
    s = F.col("breadth_signal")
    one = one.withColumn("breadth_label", F.when(s == 1, "broad").when(s == -1, "narrow").otherwise("balanced"))
    one = one.withColumn("stack_score", F.col("liq_signal") + F.col("oc_signal") + s).withColumn("stack_label", tx.stack_label(F.col("liq_signal"), F.col("oc_signal"), s))
    one = one.withColumn("headline", tx.headline(F.col("ret_7d"), F.col("pct_up_7d")))
    drivers = F.concat_ws(
        "; ",
        F.when(F.col("liq_signal") != 0, F.concat("liq_label", F.lit(" liquidity"))), F.when(F.col("oc_signal") != 0, F.concat(F.lit("on-chain "), "oc_label")), F.concat("breadth_label", F.lit(" breadth")),
        F.when((F.col("demand_signal") != 0) | F.col("etf_7d").isNotNull(), F.concat(F.lit("demand "), "demand_label")),
        F.when(F.col("ret_7d").isNotNull(), F.format_string("7d %+.1f%%", F.col("ret_7d") * 100)),
    )
    return one.withColumn("drivers", drivers)
