"""Quantiles by selection, recurrences by blocks and clusters in time against plain Python."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import clusters
from tidemark.operators import selection as sel
from tidemark.operators import series as ts


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("few", [1, 50, 100_000])
def test_quantiles_equal_numpy(spark, few):
    rng = np.random.default_rng(1)
    groups = {
        "even": rng.uniform(-5, 5, 700), "tied": np.repeat([1.0, 2.0, 2.0, 7.0], 90), "one": np.array([3.5]), "wide": np.r_[rng.standard_normal(300), 1e300, -1e300, 5e-324, 0.0, 1e-300],
        "geometric": 4096.0 ** -np.arange(60), "near": 1.0 + np.arange(300) * 2.0**-52, "infinite": np.r_[np.arange(40.0), np.inf, -np.inf, np.inf],
    }
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("even", None), ("even", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "h string, v double").repartition(5)
    shares = [0.0, 0.05, 0.5, 0.9, 1.0]
    got = {r["h"]: r for r in sel.quantiles(df, ["h"], "v", shares, few=few).collect()}
    near = {r["h"]: r for r in sel.quantiles(df, ["h"], "v", shares, "nearest", few).collect()}
    assert set(got) == set(near) == set(groups)
    for g, values in groups.items():
        ordered = np.sort(values)
        assert got[g]["n"] == len(values)
        for k, share in enumerate(shares):
            assert near[g][f"q{k}"] == ordered[int((len(values) - 1) * share + 0.5)]
            if g != "infinite":
                assert got[g][f"q{k}"] == pytest.approx(np.quantile(values, share), rel=1e-12)
    whole = sel.quantiles(df, [], "v", [0.5], "nearest", few).collect()
    every = np.sort(np.concatenate(list(groups.values())))
    assert [(r["n"], r["q0"]) for r in whole] == [(len(every), every[int((len(every) - 1) * 0.5 + 0.5)])]
    assert sel.quantiles(df.limit(0), [], "v", [0.5]).count() == 0 == sel.quantiles(df.limit(0), ["h"], "v", [0.5]).count()


def fold(values, size, alpha):
    out, x, known = [], None, []
    for v in values:
        if v is None:
            out.append(None)
            continue
        known.append(v)
        if len(known) == size:
            x = sum(known) / size
        elif len(known) > size:
            x += alpha * (v - x)
        out.append(x)
    return out


@pytest.mark.parametrize("size", [1, 2, 5, 40])
def test_ema_equals_the_fold(spark, size):
    rng = np.random.default_rng(size)
    series = {s: [None if rng.random() < 0.03 and s != "a" else float(v) for v in rng.lognormal(0, 3, n)] for s, n in (("a", 1500), ("b", 300), ("c", size), ("d", size - 1))}
    rows = [(s, dt.date(2019, 1, 1) + dt.timedelta(days=i), v) for s, values in series.items() for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "s string, date date, v double").repartition(6)
    out = ts.ema(df, "s", "date", "v", "e", size)
    assert not any(x in plan(out) for x in ("Python", "Pandas", "Arrow"))
    got = {(r.s, r.date): r.e for r in out.collect()}
    assert len(got) == len(rows)
    for s, values in series.items():
        want = fold(values, size, 2 / (size + 1))
        for i, x in enumerate(want):
            have = got[s, dt.date(2019, 1, 1) + dt.timedelta(days=i)]
            assert (have is None) == (x is None) and (x is None or abs(have - x) <= 1e-9 * max(1, abs(x)))


def test_atr_looks_over_the_ends_of_blocks(spark):
    rng = np.random.default_rng(0)
    close = 100 + np.cumsum(rng.standard_normal(200))
    high, low = close + rng.random(200), close - rng.random(200)
    day = lambda i: dt.date(2024, 1, 1) + dt.timedelta(days=i)
    df = spark.createDataFrame([("a", day(i), float(high[i]), float(low[i]), float(close[i])) for i in range(200)], "s string, date date, high double, low double, close double")
    ranges = [high[0] - low[0]] + [max(high[i] - low[i], abs(high[i] - close[i - 1]), abs(low[i] - close[i - 1])) for i in range(1, 200)]
    want = fold([float(x) for x in ranges], 14, 1 / 14)
    got = [r.x for r in ts.atr(df, "s", "date", "x", 14).orderBy("date").collect()]
    assert got[:13] == [None] * 13 and np.allclose(got[13:], want[13:], rtol=1e-9)


def test_distinct_near_equals_all_pairs(spark):
    rng = np.random.default_rng(3)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(k, "ab"[int(rng.integers(2))], t0 + dt.timedelta(seconds=int(rng.integers(6000))), int(rng.integers(12))) for k in range(400)]
    rows += [(1000 + k, "a", t0 + dt.timedelta(seconds=300), 3) for k in range(50)] + [(2000, "a", None, 1), (2001, "b", t0, None), (2002, None, t0, 1)]
    df = spark.createDataFrame(rows, "id long, s string, ts timestamp, who long").repartition(3)
    for before, after in ((0, 600), (300, 300), (0, 0)):
        got = {r["id"]: r["n"] for r in clusters.distinct_near(df, ["s"], "ts", "who", before, after, "n").collect()}
        others = {r["id"]: r["n"] for r in clusters.others_near(df, ["s"], "ts", "who", before, "n").collect()} if before == after else None
        assert len(got) == len(rows)
        for i, k, at, who in rows:
            if k is None:
                continue
            near = {w for _, k2, at2, w in rows if k2 == k and at is not None and at2 is not None and w is not None and -before <= (at2 - at).total_seconds() <= after}
            assert got[i] == len(near)
            assert others is None or others[i] == len(near - {who})
    out = clusters.others_near(df, ["s"], "ts", "who", 300, "n")
    assert "Join" not in plan(out) and "collect_set" not in plan(out)
    assert out.filter(F.col("n") > 11).isEmpty()
