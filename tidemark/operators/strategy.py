"""A rule-based strategy on a (symbol, date) panel: features, score, weights, costs, walk-forward evaluation.

Everything is grouped so that the plan shuffles by symbol, then by date.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import series as ts
from tidemark.operators.selection import quantiles
from tidemark.operators.stores import written


#: The defaults.
@dataclass(frozen=True)
class Strategy:
    momentum: tuple[int, ...] = (20, 60)
    vol_window: int = 20
    volume_window: int = 20
    oi_window: int = 5
    quantiles: int = 5
    vol_target: float = 0.10
    min_adv: float = 1_000_000.0
    mode: str = "cross_section"  # or long_only, directional, ts_mom
    allow_short: bool = True
    long_z: float = 0.5
    short_z: float = -0.5
    fee_bps: float = 10.0
    slippage: float = 0.10
    notional: float = 1_000_000.0
    min_adv_for_slippage: float = 1_000.0
    train: int = 252
    test: int = 63
    step: int = 63
    embargo: int = 20
    universe: int = 0  # so many symbols by mean ADV take part; 0: all


def _by_symbol():
    return ts.w("symbol", "date")


def features(panel: DataFrame, s: Strategy) -> DataFrame:
    out = panel.withColumn("ret", ts.pct_change("close", _by_symbol()))
    volume = {"mean": ts.rolling("volume", _by_symbol(), s.volume_window), "sd": ts.rolling("volume", _by_symbol(), s.volume_window, "stddev_samp")}
    if "open_interest_usd" in panel.columns:
        out = out.withColumn("oi_change", ts.pct_change("open_interest_usd", _by_symbol(), s.oi_window))
    return out.withColumns(
        {f"mom_{n}": ts.pct_change("close", _by_symbol(), n) for n in s.momentum}
        | {
            "vol": ts.rolling("ret", _by_symbol(), s.vol_window, "stddev_samp"),
            "volume_z": F.try_divide(F.col("volume") - volume["mean"], volume["sd"]),
            "adv": ts.rolling(F.col("close") * F.col("volume"), _by_symbol(), s.vol_window),
        }
    )


def residual_momentum(panel: DataFrame, benchmark: str, n: int, out: str) -> DataFrame:
    """Rolling sum of the return less the benchmark's: one window over the date, one over the symbol."""
    r = panel.withColumn("ret", ts.pct_change("close", _by_symbol()))
    bench = F.max(F.when(F.col("symbol") == benchmark, F.col("ret"))).over(Window.partitionBy("date"))
    return r.withColumn("_x", F.col("ret") - F.coalesce(bench, F.lit(0.0))).withColumn(out, ts.rolling("_x", _by_symbol(), n, "sum")).drop("_x")


def score(df: DataFrame, s: Strategy) -> DataFrame:
    if s.mode == "directional":  # the date's macro regime, for every symbol
        return df.withColumn("alpha", F.col("regime_score"))
    if s.mode == "ts_mom":
        a, b = (F.col(f"mom_{n}") for n in s.momentum[:2])
        return df.withColumn("alpha", F.when((a > 0) & (b > 0), 1.0).when((a < 0) & (b < 0), -1.0).otherwise(0.0))
    out = F.lit(0.0)
    for c in [*[f"mom_{n}" for n in s.momentum], "volume_z", *(["oi_change"] if "oi_change" in df.columns else [])]:
        out = out + ts.cs_zscore(c, "date")
    out = out - ts.cs_zscore("vol", "date")
    return df.withColumn("alpha", F.floor(out * 1e9 + 0.5) / 1e9)  # to nine places, so that ties do not hang on the order of sums


def labels(df: DataFrame, horizon: int) -> DataFrame:
    fwd = F.try_divide(F.lead("close", horizon).over(_by_symbol()), "close") - 1
    return df.withColumn("fwd", fwd).withColumn("fwd_excess", F.col("fwd") - F.avg("fwd").over(Window.partitionBy("date")))


def benchmark_excess(labelled: DataFrame, benchmark: str) -> DataFrame:
    """Adds fwd_vs_benchmark: the forward return less that of the benchmark's symbol over the same days."""
    bench = F.max(F.when(F.col("symbol") == benchmark, F.col("fwd"))).over(Window.partitionBy("date"))
    return labelled.withColumn("fwd_vs_benchmark", F.col("fwd") - bench)


def _with_rebalance(df: DataFrame) -> DataFrame:
    """Fridays; where the data have none, the last date of each week."""
    friday = F.weekday("date") == 4
    some = df.agg(F.coalesce(F.max(friday), F.lit(False)).alias("_fridays"))  # one row
    last = F.col("date") == F.max("date").over(Window.partitionBy("symbol", F.date_trunc("week", "date")))
    return df.crossJoin(F.broadcast(some)).withColumn("rebalance", F.when(F.col("_fridays"), friday).otherwise(last)).drop("_fridays")


def _scaled(df: DataFrame, s: Strategy) -> DataFrame:
    """Adds target: the raw weight times the volatility target over the median volatility of the date's book."""
    own = F.median(F.when(F.col("sleeve") != 0, F.col("vol"))).over(Window.partitionBy("date"))  # the dates' rows are together already
    scale = F.when(F.col("book_vol") > 1e-12, F.greatest(F.lit(0.1), F.least(F.lit(5.0), s.vol_target / 365**0.5 / F.col("book_vol")))).otherwise(1.0)
    return df.withColumn("book_vol", own).withColumn("target", F.col("raw") * scale)


def weights(df: DataFrame, s: Strategy) -> DataFrame:
    """Targets on rebalance days, carried until the next.

    With ``universe``, only so many symbols take part, those of the greatest mean ADV over the whole sample. With a
    column ``active`` (a cross-section's regime), nothing is bought or held on any day on which it is false.
    """
    cross_section = s.mode not in ("directional", "ts_mom")
    if s.universe and cross_section:
        df = written(df, "scored")  # read for the ranking and again
        mean = df.groupBy("symbol").agg(F.avg("adv").alias("_adv"))
        top = mean.orderBy(F.desc_nulls_last("_adv"), "symbol").limit(s.universe).select("symbol")
        df = df.join(F.broadcast(top), "symbol", "left_semi")  # ``universe`` rows
    df = _with_rebalance(df)
    active = F.coalesce("active", F.lit(True)) if cross_section and "active" in df.columns else F.lit(True)
    if not cross_section:
        lo, hi = sorted((s.short_z, s.long_z))
        df = df.withColumn("sleeve", F.when(F.col("alpha") >= hi, 1.0).when(F.col("alpha") <= lo, -1.0 if s.allow_short else 0.0).otherwise(0.0)).withColumn("raw", F.col("sleeve"))
    else:
        q = max(s.quantiles, 2)
        ranked = ts.avg_rank(df, "date", "alpha", "rank")  # among all symbols of the date, eligible or not
        eligible = F.coalesce("adv", F.lit(0.0)) >= s.min_adv
        rank = F.when(eligible & F.col("rebalance"), F.col("rank"))
        sleeve = F.when(~active, 0.0).when(rank >= 1 - 1 / q, 1.0)
        sleeve = sleeve.otherwise(0.0) if s.mode == "long_only" else sleeve.when(rank <= 1 / q, -1.0).otherwise(0.0)
        df = ranked.withColumn("sleeve", sleeve)
        side = lambda v: F.greatest(F.lit(1), F.count_if(F.col("sleeve") == v).over(Window.partitionBy("date")))
        full = 1.0 if s.mode == "long_only" else 0.5
        df = df.withColumn("raw", F.when(F.col("sleeve") == 1, full / side(1)).when(F.col("sleeve") == -1, -full / side(-1)).otherwise(0.0))
    carried = F.last(F.when(F.col("rebalance"), F.col("target")), ignorenulls=True).over(_by_symbol().rowsBetween(Window.unboundedPreceding, 0))
    return _scaled(df, s).withColumn("weight", F.when(active, F.coalesce(carried, F.lit(0.0))).otherwise(0.0))


def traded(df: DataFrame) -> DataFrame:
    """Adds dw, the change of a symbol's weight from the day before, and gain, yesterday's weight on today's return."""
    before = F.coalesce(F.lag("weight").over(_by_symbol()), F.lit(0.0))
    return df.withColumn("dw", F.abs(F.col("weight") - before)).withColumn("gain", before * F.coalesce("ret", F.lit(0.0)))


def daily(df: DataFrame, s: Strategy) -> DataFrame:
    """Gross and net return of the book by day: yesterday's weights on today's returns, less fees and slippage."""
    x = traded(df)
    part = F.when(F.col("adv") >= s.min_adv_for_slippage, F.col("dw") * s.notional / F.col("adv")).otherwise(0.0)
    x = x.withColumn("part", part).withColumn("slip", s.slippage * F.col("dw") * F.sqrt("part"))
    d = x.groupBy("date").agg(
        F.sum("gain").alias("gross"), F.sum("dw").alias("turnover"), F.sum("slip").alias("slippage"), F.sum("weight").alias("net_exposure"),
        F.sum(F.abs("weight")).alias("gross_exposure"), F.median("adv").alias("median_adv"), F.max("part").alias("max_participation"), F.avg("ret").alias("benchmark"),
    )
    cost = F.col("turnover") * s.fee_bps / 10_000 + F.col("slippage")
    return d.withColumn("cost", cost).withColumn("net", F.col("gross") - F.col("cost"))


#: Deviations under it are none.
STILL = 1e-15


def sharpe(r: Column | str) -> Column:
    """Mean over sample deviation, a year of 365 days; null where there is no deviation."""
    sd = F.stddev_samp(r)
    return F.when(sd >= STILL, F.avg(r) / sd) * 365**0.5


def sortino(r: Column) -> Column:
    """Mean over the sample deviation of the negative returns alone."""
    sd = F.stddev_samp(F.when(r < 0, r))
    return F.when(sd >= STILL, F.avg(r) / sd) * 365**0.5


def information_ratio(r: str, benchmark: str) -> Column:
    """Sharpe ratio of the return less the benchmark's, the latter scaled to the same deviation.

    The deviation of r - k b with k = sd(r) / sd(b) follows from both deviations and the covariance, so one pass is enough.
    """
    both = F.col(r).isNotNull() & F.col(benchmark).isNotNull()
    x, b = F.when(both, F.col(r)), F.when(both, F.col(benchmark))
    sx, sb = F.stddev_samp(x), F.stddev_samp(b)
    k = F.when(sb >= STILL, sx / sb)
    sd = F.sqrt(F.greatest(2 * sx * sx - 2 * k * F.covar_samp(x, b), F.lit(0.0)))
    return F.when(sd >= STILL, (F.avg(x) - k * F.avg(b)) / sd) * 365**0.5


def metrics(d: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    net = F.col("net")
    return d.groupBy(*by).agg(
        sharpe("net").alias("net_sharpe"), sharpe("gross").alias("gross_sharpe"), sortino(net).alias("sortino"), information_ratio("net", "benchmark").alias("ir"),
        F.avg((net > 0).cast("double")).alias("hit"), F.avg("turnover").alias("turnover"), F.count("*").alias("days"),
    )


def folds(d: DataFrame, s: Strategy) -> DataFrame:
    """(fold, train_end, test_start, test_end): expanding windows over the dates, an embargo between."""
    dates = d.select("date").distinct().agg(F.sort_array(F.collect_list("date")).alias("dates"))  # one row, a date a day
    last = F.size("dates") - s.embargo - s.test
    starts = dates.filter(last >= s.train).select("dates", F.posexplode(F.sequence(F.lit(s.train), last, F.lit(max(s.step, 1)))).alias("fold", "at"))
    place = lambda offset: F.element_at("dates", (F.col("at") + offset + 1).cast("int"))
    return starts.select("fold", place(-1).alias("train_end"), place(s.embargo).alias("test_start"), place(s.embargo + s.test - 1).alias("test_end"))


def evaluate(d: DataFrame, s: Strategy) -> DataFrame:
    """Metrics of each fold's test window, and as fold -1 of all days in any of them: the out-of-sample result.

    Where the dates are too few for a fold, fold -1 is the whole sample. The book is computed once.
    """
    d = written(d, "daily")
    if d.count() < s.train + s.embargo + s.test:
        return metrics(d.withColumn("fold", F.lit(-1)), ("fold",))
    f = folds(d, s)
    inside = d.join(F.broadcast(f), (F.col("date") >= F.col("test_start")) & (F.col("date") <= F.col("test_end")))  # a row a quarter
    each = metrics(inside, ("fold",))
    return each.unionByName(metrics(inside.dropDuplicates(["date"]).withColumn("fold", F.lit(-1)), ("fold",)))


def gates(weighted: DataFrame, s: Strategy, config: str, least_sharpe: float, least_ir: float, target: float, most: float = 0.05) -> DataFrame:
    """One row: whether the out-of-sample Sharpe and information ratios and the capacity are enough; what is not known is not."""
    w = written(weighted.select("symbol", "date", "ret", "adv", "weight"), "weights")
    m = evaluate(daily(w, s), s).filter("fold = -1")
    m = m.crossJoin(F.broadcast(capacity(w, most).agg(F.max("capacity").alias("capacity"))))  # one row each
    ok = lambda c: F.coalesce(c, F.lit(False))
    m = m.select(
        F.lit(config).alias("config"), ok(F.col("net_sharpe") > least_sharpe).alias("sharpe_ok"), ok(F.col("ir") > least_ir).alias("ir_ok"),
        (F.coalesce("capacity", F.lit(0.0)) >= target).alias("capacity_ok"),
    )
    return m.withColumn("passed", F.col("sharpe_ok") & F.col("ir_ok") & F.col("capacity_ok"))


def ladder(rungs: Iterable[tuple[str, Callable[[], DataFrame], Strategy]], least_sharpe: float, least_ir: float, target: float) -> DataFrame:
    """The gates of (name, weights, strategy) in turn, up to the first that passes; later ones are not computed."""
    out = None
    for name, weighted, s in rungs:
        one = written(gates(weighted(), s, name, least_sharpe, least_ir, target), "rung")
        out = one if out is None else out.unionByName(one)
        if one.first()["passed"]:
            break
    return out


def capacity(df: DataFrame, most: float) -> DataFrame:
    """Fifth percentile (nearest) of the notional at which a position takes ``most`` of the ADV."""
    cap = F.coalesce("adv", F.lit(0.0)) * most / F.greatest(F.abs("weight"), F.lit(1e-12))
    held = df.filter("weight <> 0").select(cap.alias("cap")).filter("cap > 0")
    return quantiles(held, [], "cap", [0.05], "nearest").select(F.lit("book").alias("book"), F.col("q0").alias("capacity"))
