"""Hand-worked cases of the strategy, wallet and monthly rules."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import strategy as st
from tidemark.operators import wallet


def rows(df):
    return sorted(tuple(r) for r in df.collect())


FRIDAY = dt.date(2024, 1, 5)


def scored(spark, days, alphas, active=None, adv=None):
    """A panel of symbols with given scores on each of some days from a Friday on."""
    data = [
        (s, FRIDAY + dt.timedelta(days=d), 100.0, 0.01, alphas[s], float((adv or {}).get(s, 1e9)), 0.02, None if active is None else active[d])
        for s in alphas for d in range(days)
    ]
    df = spark.createDataFrame(data, "symbol string, date date, close double, ret double, alpha double, adv double, vol double, active boolean")
    return df.drop("active") if active is None else df


def held(w):
    return {(r.symbol, (r.date - FRIDAY).days): r.weight for r in w.select("symbol", "date", "weight").collect()}


def test_nothing_is_held_on_inactive_days_and_carried_ones_return(spark):
    s = st.Strategy(quantiles=4, vol_target=0.02 * math.sqrt(365))  # scale 1
    active = [True, True, False, True, True, True, True, False, True]  # day 0 and 7 are Fridays
    w = held(st.weights(scored(spark, 9, {"A": 4.0, "B": 3.0, "C": 2.0, "D": 1.0}, active), s))
    assert [round(w["A", d], 9) for d in range(9)] == [0.25, 0.25, 0, 0.25, 0.25, 0.25, 0.25, 0, 0]
    assert [round(w["D", d], 9) for d in range(9)] == [-0.5, -0.5, 0, -0.5, -0.5, -0.5, -0.5, 0, 0]


def test_universe_is_taken_once_and_before_ranks(spark):
    s = st.Strategy(quantiles=2, universe=2, vol_target=0.02 * math.sqrt(365))
    out = st.weights(scored(spark, 2, {"A": 9.0, "B": 1.0, "C": 5.0}, adv={"A": 1e6, "B": 1e8, "C": 1e9}), s)
    w = held(out)
    assert {k[0] for k in w} == {"B", "C"} and round(w["C", 0], 9) == round(w["B", 0], 9) == 0.25  # among two, both are in the upper half


def book(spark, net, benchmark):
    data = [(FRIDAY + dt.timedelta(days=k), float(n), float(n) + 0.001, 0.1, None if b is None else float(b)) for k, (n, b) in enumerate(zip(net, benchmark, strict=True))]
    return spark.createDataFrame(data, "date date, net double, gross double, turnover double, benchmark double")


def test_metrics_equal_their_definitions(spark):
    rng = np.random.default_rng(1)
    net, bench = rng.normal(0.001, 0.01, 200), rng.normal(0.002, 0.05, 200)
    m = st.metrics(book(spark, net, [None, *bench[1:]])).first()
    year = math.sqrt(365)
    assert m.net_sharpe == pytest.approx(net.mean() / net.std(ddof=1) * year)
    assert m.sortino == pytest.approx(net.mean() / net[net < 0].std(ddof=1) * year)
    x, b = net[1:], bench[1:]
    active = x - b * x.std(ddof=1) / b.std(ddof=1)
    assert m.ir == pytest.approx(active.mean() / active.std(ddof=1) * year)
    flat = st.metrics(book(spark, [0.01] * 5, [0.0] * 5)).first()
    assert (flat.net_sharpe, flat.sortino, flat.ir) == (None, None, None)


def test_gates_look_at_the_folds_only(spark):
    s = st.Strategy(train=4, test=3, step=3, embargo=1)
    net = [1.0] * 5 + [-0.01, -0.03, -0.02, 0.01, -0.04, -0.02] + [2.0] * 2  # gains only where no fold tests
    d = book(spark, net, np.linspace(0, 0.1, len(net)))
    got = {r.fold: r for r in st.evaluate(d, s).collect()}
    assert sorted(got) == [-1, 0, 1] and got[-1].days == 6 and got[-1].net_sharpe < 0
    short = {r.fold: r for r in st.evaluate(d, st.Strategy(train=100)).collect()}
    assert sorted(short) == [-1] and short[-1].days == 13 and short[-1].net_sharpe > 0


def test_ladder_stops_at_the_first_that_passes(spark):
    w = scored(spark, 40, {"A": 1.0}).withColumn("weight", F.lit(0.5)).withColumn("ret", F.when(F.dayofmonth("date") % 3 == 0, 0.004).otherwise(0.01))
    s = st.Strategy(train=1000)
    made = []

    def rung(name, weight):
        return name, lambda: made.append(name) or w.withColumn("weight", F.lit(weight) * F.when(F.dayofmonth("date") > 20, 0.9).otherwise(1.0)), s

    out = st.ladder([rung("losing", -0.5), rung("winning", 0.5), rung("later", 0.5)], 0.0, -1e9, 1.0)
    assert made == ["losing", "winning"] and [(r.config, r.passed) for r in out.orderBy("config").collect()] == [("losing", False), ("winning", True)]


def test_solana_fallback_is_one_outflow_of_the_first_account(spark):
    tx = spark.createDataFrame(
        [
            ("idle", ["x", "b", "a"], [5.0, 7.0, 9.0], [4.0, 7.0, 9.0], [], []),
            ("moved", ["a", "b"], [1e9, 3.0], [1e9 + 1, 3.0], [], [("b", "m", 2.0)]),
            ("short", ["a", "b"], [1e9], [], [("b", "m", 2.0)], [("b", "m", 2.0)]),
            ("other", ["x"], [1.0], [2.0], [], []),
        ],
        "tx_hash string, accounts array<string>, pre array<double>, post array<double>, pre_tokens array<struct<owner:string,mint:string,amount:double>>, post_tokens array<struct<owner:string,mint:string,amount:double>>",
    )
    got = rows(wallet.solana_transfers(tx, spark.createDataFrame([("a",), ("b",)], "address string")))
    assert got == [("idle", "SOL", "b", "outflow", 0.0), ("moved", "SOL", "a", "inflow", 1e-9), ("moved", "m", "b", "inflow", 2.0), ("short", "SOL", "a", "outflow", 1.0)]


def test_drawdown_of_a_symbol_comes_with_its_turnover(spark, monkeypatch):
    """AG-29 whole: drawdown, Calmar ratio, turnover of the symbol's weights and mean change of its return, by hand."""
    from types import SimpleNamespace

    from tidemark.plans import queries_whole as q

    day = lambda k: dt.date(2001, 1, 1) + dt.timedelta(days=k)
    panel = spark.createDataFrame([("a", day(k), c) for k, c in enumerate([100.0, 110.0, 99.0, 99.0])] + [("b", day(0), 5.0), ("b", day(1), 10.0)], "symbol string, date date, close double")
    monkeypatch.setattr(q, "weighted", lambda t: t.panel.join(spark.createDataFrame([("a", day(1), 0.5), ("a", day(2), -0.25), ("a", day(3), -0.25)], "symbol string, date date, w double"), ["symbol", "date"], "left").selectExpr("symbol", "date", "0D as ret", "coalesce(w, 0D) as weight"))
    got = {r["symbol"]: r for r in q.ag_29_drawdown(SimpleNamespace(panel=panel)).collect()}
    a, b = got["a"], got["b"]
    assert a["max_drawdown"] == pytest.approx(-0.1) and a["calmar"] == pytest.approx(0.0, abs=1e-9)
    assert a["turnover"] == pytest.approx((0.5 + 0.75) / 4)  # 0, 0.5, -0.25, -0.25: nothing is traded on the first and the last day
    assert a["return_change"] == pytest.approx((0.1 + 0.2 + 0.1) / 3)  # returns 0.1, -0.1, 0
    assert b["turnover"] == 0 and b["calmar"] is None and b["return_change"] == pytest.approx(1.0)
