"""Streams against their batch forms, written tables, and regressions against numpy."""

import datetime as dt
import math

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import research as rs
from tidemark.operators import stores, wallet
from tidemark.streaming import jobs


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def streamed(spark, df, parts, tmp_path, job, name):
    """What a job gives on the table's files one after the other."""
    for k in range(parts):
        df.filter(F.col("event_id") % parts == k).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    stream = jobs.file_stream(spark, str(tmp_path / name), df.schema, maxFilesPerTrigger=1)
    result = job(stream)
    mode = "complete" if "Aggregate" in result._jdf.queryExecution().logical().toString() else "append"
    q = result.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def ticks(spark):
    at = lambda i: dt.datetime(2024, 1, 1, 0, 0) + dt.timedelta(minutes=i * 7 % 90)
    data = [(i, "AB"[i % 2], at(i), i % 5, "inflow" if i % 3 else "outflow", f"w{i % 4}", f"w{i % 6}", "SOL", 1.0 + i, "solana", None) for i in range(60)]
    return spark.createDataFrame(data, "event_id long, symbol string, ts timestamp, user_id long, direction string, from_address string, to_address string, asset string, amount double, chain string, amount_usd double")


def test_clusters_stream(spark, tmp_path):
    job = lambda d: jobs.clusters(d).select("symbol", "window.start", "users")
    assert rows(streamed(spark, ticks(spark), 3, tmp_path, job, "clusters_out")) == rows(job(ticks(spark))) != []


def test_co_buying_and_cursor_streams(spark, tmp_path):
    t = ticks(spark).withColumn("block_time", F.col("ts"))
    job = lambda d: jobs.co_buying(d, "10 minutes").select("asset", "window.start", "buyers")
    assert rows(streamed(spark, t, 3, tmp_path, job, "co_buying_out")) == rows(job(t)) != []
    read = lambda d: jobs.cursors(d, "user_id")
    assert rows(streamed(spark, t, 3, tmp_path, read, "cursors_out")) == rows(read(t)) != []
    both = jobs.merged_cursors(read(t.filter("event_id < 20")), read(t.filter("event_id >= 20")), "user_id")
    assert rows(both) == rows(read(t))


def test_alerts_stream_joins_the_registry(spark, tmp_path):
    registry = spark.createDataFrame([("w1", "solana", "kol", "a"), ("w2", "solana", "whale", "b")], "address string, chain string, entity_type string, label string")
    job = lambda d: jobs.alerts(d, registry).select("event_id", "action", "severity")
    assert rows(streamed(spark, ticks(spark), 3, tmp_path, job, "alerts_out")) == rows(job(ticks(spark))) != []


def test_repeats_are_dropped_across_batches(spark, tmp_path):
    job = lambda d: jobs.deduplicated(d, ["symbol", "user_id"]).select("symbol", "user_id")
    assert rows(streamed(spark, ticks(spark), 3, tmp_path, job, "dedup_out")) == rows(ticks(spark).select("symbol", "user_id").distinct())


def test_read_files_are_archived(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(k,)], "k int").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = jobs.file_stream(spark, str(tmp_path / "in"), "k int", "json", archive=str(tmp_path / "done"), maxFilesPerTrigger=1)
    seen = []
    jobs.merge_stream(stream, lambda df, _: seen.extend(rows(df)), str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(seen) == [(0,), (1,), (2,)] and len(list((tmp_path / "done").rglob("*.json"))) >= 1


def test_store_reruns_change_nothing(spark):
    old, new = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, at int, v string"), spark.createDataFrame([(2, 2, "x"), (2, 3, "c"), (3, 1, "d")], "k int, at int, v string")
    store = stores.Store.create(old, stores.scratch(spark, "test"), ["k"], ["at"], buckets=3)
    assert store.counts(new).first() == (1, 1)
    for _ in range(2):
        store.upsert(new)
        assert rows(store.read()) == [(1, 1, "a"), (2, 3, "c"), (3, 1, "d")]
    store.insert_ignore(new.withColumn("k", F.col("k") + 1))
    assert rows(store.read().select("k")) == [(1,), (2,), (3,), (4,)]
    assert rows(stores.finite(spark.createDataFrame([(float("nan"), float("inf"), 1.5)], "a double, b double, c double"))) == [(None, None, 1.5)]


def files(store):
    return {f for f in store.read().inputFiles()}


def test_upsert_rewrites_only_touched_parts_and_opens_again(spark):
    day = lambda m, d: dt.date(2024, m, d)
    first = spark.createDataFrame([("a", day(m, d), float(m)) for m in (1, 2, 3) for d in (1, 2)], "s string, date date, v double")
    store = stores.Store.create(first, stores.scratch(spark, "parts"), ["s", "date"], time="date")
    before = files(store)
    assert store.parts() == ["2024-01", "2024-02", "2024-03"]
    new = spark.createDataFrame([("a", day(2, 2), 9.0), ("b", day(2, 3), 8.0)], "s string, date date, v double")
    plan = store.touched(new)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [_part" in plan.replace("isnotnull(", "") or "PartitionFilters: [" in plan and "2024-02" in plan
    store.upsert(new)
    kept = before & files(store)
    assert {f for f in before if "2024-02" not in f} == kept
    other = stores.Store.open(spark.newSession(), store.folder)  # another session goes on with it
    other.upsert(spark.createDataFrame([("c", day(4, 1), 1.0, "x")], "s string, date date, v double, extra string"))
    again = stores.Store.open(spark, store.folder)
    assert again.read().columns == ["s", "date", "v", "extra"]
    assert rows(again.read().filter("extra is not null")) == [("c", day(4, 1), 1.0, "x")]
    assert rows(again.read().filter("v >= 8").select("s", "date", "v")) == [("a", day(2, 2), 9.0), ("b", day(2, 3), 8.0)]
    assert again.read().count() == 8 and kept <= files(again)


def test_lookback_leaves_older_parts_alone(spark):
    day = lambda d: dt.date(2024, 1, 1) + dt.timedelta(days=d)
    rows_ = lambda span, v: spark.createDataFrame([("a", day(d), v) for d in span], "s string, date date, v double")
    store = stores.Store.create(rows_(range(30), 1.0), stores.scratch(spark, "lookback"), ["s", "date"], time="date", period="day")
    before = files(store)
    for _ in range(2):
        store.merge_since(rows_(range(40), 2.0), "date", 7)
        assert {r.v: r.n for r in store.read().groupBy("v").agg(F.count("*").alias("n")).collect()} == {1.0: 22, 2.0: 18}
        before &= files(store)
        assert len(before) == 22
    nothing = stores.Store.create(rows_(range(0), 1.0), stores.scratch(spark, "empty"), ["s", "date"], time="date")
    nothing.merge_since(rows_(range(3), 2.0), "date")
    assert nothing.read().count() == 3
    try:
        stores.Store.create(rows_(range(1), 1.0), stores.scratch(spark, "bad"), ["s"], time="date")
        raise AssertionError
    except ValueError:
        pass


def test_stream_killed_after_its_merge_counts_nothing_twice(spark, tmp_path):
    t = ticks(spark)
    for k in range(3):
        t.filter(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    empty = jobs.cursors(t.limit(0), "user_id")
    store = stores.Store.create(empty, stores.scratch(spark, "cursors"), ["user_id"], buckets=2)
    add = {"earliest": F.least, "latest": F.greatest, "n": lambda old, new: old + new}
    died = []

    def run(fail_at):
        def each(batch, number):
            stores.Store.open(batch.sparkSession, store.folder).merge_batch(jobs.cursors(batch, "user_id"), "cursors", number, add)
            if number == fail_at:
                died.append(number)
                raise RuntimeError("killed between merge and checkpoint")

        stream = jobs.file_stream(spark, str(tmp_path / "in"), t.schema, maxFilesPerTrigger=1)
        return jobs.merge_stream(stream, each, str(tmp_path / "cp"))

    for fail_at in (0, 1):
        try:
            run(fail_at).awaitTermination(120)
        except Exception as e:  # noqa: BLE001
            assert "killed" in str(e)
    stream = jobs.file_stream(spark, str(tmp_path / "in"), t.schema, maxFilesPerTrigger=1)
    jobs.poll_cursors(stream, store, "user_id", str(tmp_path / "cp")).awaitTermination(120)
    assert died == [0, 1]
    got = stores.Store.open(spark, store.folder).read()
    assert rows(got.select("user_id", "earliest", "latest", "n")) == rows(jobs.cursors(t, "user_id"))
    # a part of a batch that was merged before the failure: the other keys still take it in
    partly = stores.Store.create(empty, stores.scratch(spark, "partly"), ["user_id"], buckets=2)
    batch = jobs.cursors(t, "user_id")
    partly.merge_batch(batch.filter("user_id < 2"), "cursors", 5, add)
    for _ in range(2):
        partly.merge_batch(batch, "cursors", 5, add)
    assert rows(partly.read().select("user_id", "earliest", "latest", "n")) == rows(batch)


def test_bitcoin_counterparties(spark):
    schema = "tx_hash string, inputs array<struct<at:int,n:long,address:string,value:double,coinbase:boolean>>, outputs array<struct<at:int,n:long,address:string,value:double,coinbase:boolean>>"
    leg = lambda at, who, v, base=False: (at, at, who, v, base)
    tx = spark.createDataFrame([
        ("a", [leg(0, "own", 5.0), leg(1, "p", 1.0)], [leg(0, "own", 2.0), leg(1, "shop", 4.0)]),
        ("b", [leg(0, None, 0.0, True)], [leg(0, "own", 50.0)]),
        ("c", [leg(0, "own", 1.0), leg(1, "other", 2.0)], [leg(0, "own", 3.0)]),
    ], schema)
    got = wallet.bitcoin_transfers(tx, spark.createDataFrame([("own",), ("other",)], "address string"))
    assert rows(got.select("tx_hash", "direction", "address", "counterparty", "amount").fillna("-")) == [
        ("a", "inflow", "own", "p", 2.0), ("a", "outflow", "own", "shop", 5.0), ("b", "inflow", "own", "-", 50.0),
        ("c", "inflow", "own", "other", 3.0), ("c", "outflow", "other", "own", 2.0), ("c", "outflow", "own", "-", 1.0),
    ]


def series(n=300, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal(n)
    y = np.zeros(n)
    for i in range(1, n):
        y[i] = 0.3 * y[i - 1] + 0.5 * x[i - 1] + rng.standard_normal()
    return x, y


def test_newey_west_errors(spark):
    _, y = series()
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(y)], "s string, t int, y double")
    got = rs.trend(df, "s", "t", "y", 5).first()
    i = np.arange(1, len(y) + 1.0)
    slope, intercept = np.polyfit(i, y, 1)
    u = (y - intercept - slope * i) * (i - i.mean())
    s = (u * u).sum() + 2 * sum((1 - k / 6) * (u[k:] * u[:-k]).sum() for k in range(1, 6))
    assert abs(got.slope - slope) < 1e-9 and abs(got.se - np.sqrt(s) / ((i - i.mean()) ** 2).sum()) < 1e-9


def test_lagged_f(spark):
    x, y = series()
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "t int, x double, y double")
    got = {r.lag: r.f for r in rs.lagged_f_test(df, "t", "y", "x", 3).collect()}
    for k in (1, 2, 3):
        target, own, other = y[k:], y[:-k], x[:-k]
        rss = lambda cols: np.linalg.lstsq(np.column_stack([np.ones(len(target)), *cols]), target, rcond=None)[1][0]  # noqa: B023, E731
        a, b = rss([own]), rss([own, other])
        assert abs(got[k] - (a - b) / (b / (len(target) - 3))) < 1e-6 * max(1, got[k])
    assert got[1] > 20 > got[3]


def test_bootstrap_fan_draws_coefficients_and_residuals(spark):
    rng = np.random.default_rng(8)
    n, horizons, draws = 60, [5, 200], 4000
    i = np.arange(1, n + 1.0)
    y = 1 + 0.02 * i + rng.standard_normal(n) * 0.3
    df = spark.createDataFrame([("s", int(k), float(v)) for k, v in enumerate(y)], "s string, t int, y double")
    fan = rs.bootstrap_fan(df, "s", "t", "y", horizons, draws)
    x = np.column_stack([np.ones(n), i])
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    e = y - x @ beta
    cov = e @ e / (n - 2) * np.linalg.inv(x.T @ x)
    for r in fan.collect():
        paths = rng.multivariate_normal(beta, cov, 200_000) @ np.array([1, n + r.horizon]) + rng.choice(e, 200_000)
        width = np.quantile(paths, 0.95) - np.quantile(paths, 0.05)
        assert all(abs(p - np.quantile(paths, q)) < 0.06 * width for p, q in ((r.p05, 0.05), (r.p50, 0.5), (r.p95, 0.95)))
        residuals_alone = np.quantile(e, 0.95) - np.quantile(e, 0.05)
        assert r.horizon < 100 or r.p95 - r.p05 > 1.3 * residuals_alone
    assert rows(fan) == rows(rs.bootstrap_fan(df.repartition(5), "s", "t", "y", horizons, draws))


def test_normal_cdf_is_exact(spark):
    x = np.r_[np.linspace(-37, 9, 400), 0.0, 7.08, -7.08, -1e6, 1e6]
    got = [r.p for r in spark.createDataFrame([(float(v),) for v in x], "x double").select(rs.normal_cdf(F.col("x")).alias("p")).collect()]
    want = [0.5 * math.erfc(-v / math.sqrt(2)) for v in x]
    assert np.allclose(got, want, rtol=2e-11, atol=0) or max(abs(a - b) / max(b, 1e-290) for a, b in zip(got, want, strict=True)) < 1e-6
    assert max(abs(a - b) for a, b in zip(got, want, strict=True)) < 1e-14


def one_fit(x, y, ridge):
    x, b = np.column_stack([np.ones(len(x)), x]), np.zeros(x.shape[1] + 1)
    for _ in range(100):
        eta = x @ b
        p, d = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in eta]), np.exp(-eta * eta / 2) / math.sqrt(2 * math.pi)
        w = d * d / (p * (1 - p))
        penalty = np.diag([0.0] + [ridge * len(x)] * (x.shape[1] - 1))
        b = np.linalg.solve(x.T * w @ x + penalty, x.T @ (w * eta + d * (y - p) / (p * (1 - p))))
    return b


def test_probit_of_all_origins_equals_single_fits(spark):
    rng = np.random.default_rng(2)
    n = 150
    x = rng.standard_normal((n, 2)) * [3, 0.1] + [10, 0]
    y = (x[:, 0] - 10 + 10 * x[:, 1] + 2 * rng.standard_normal(n) > 0).astype(float)
    df = spark.createDataFrame([(k, float(a), float(b), float(c)) for k, ((a, b), c) in enumerate(zip(x, y, strict=True))], "t int, a double, b double, y double")
    got = {r.origin: r for r in rs.probit_walk_forward(df, "t", ["a", "b"], "y", 13, least=80, step=13).collect()}
    z = (x - x.mean(0)) / x.std(0)
    assert sorted(got) == list(range(80, n - 13, 13))
    for o, r in got.items():
        b = one_fit(z[:o], y[:o], 1e-6)
        p = 0.5 * math.erfc(-(b[0] + z[o] @ b[1:]) / math.sqrt(2))
        assert abs(r.p - p) < 1e-6 and r.y == y[o] and abs(r.brier - (p - y[o]) ** 2) < 1e-6
    same = rs.probit_walk_forward(df.withColumn("y", F.lit(1.0)), "t", ["a", "b"], "y", 13)
    assert same.count() == 0 == rs.probit_walk_forward(df.limit(20), "t", ["a"], "y", 13).count()


def test_prefix_fits_equal_single_fits(spark):
    rng = np.random.default_rng(6)
    y = 11 + 0.01 * np.arange(80) + rng.standard_normal(80)
    df = spark.createDataFrame([("s", i + 1.0, float(v)) for i, v in enumerate(y)], "s string, i double, y double")
    got = {r.origin: r for r in rs.prefix_fits(df, "s").collect()}
    assert sorted(got) == list(range(3, 81))
    for o in (3, 40, 80):
        x = np.column_stack([np.ones(o), np.arange(1, o + 1.0)])
        beta = np.linalg.lstsq(x, y[:o], rcond=None)[0]
        e = y[:o] - x @ beta
        factor = np.linalg.cholesky(e @ e / (o - 2) * np.linalg.inv(x.T @ x))
        assert np.allclose([got[o].intercept, got[o].slope, got[o].l11, got[o].l21, got[o].l22], [*beta, factor[0, 0], factor[1, 0], factor[1, 1]], atol=1e-7)


def test_calibration_widens_what_was_too_narrow(spark):
    rng = np.random.default_rng(9)
    n = 700
    walk = np.cumsum(rng.standard_normal(n) * 0.05)  # a trend's intervals are far too narrow for a random walk
    noise = 0.001 * np.arange(n) + rng.standard_normal(n) * 0.05
    df = spark.createDataFrame([(s, i, float(v)) for s, values in (("walk", walk), ("noise", noise)) for i, v in enumerate(values)], "s string, t int, y double")
    got = {r.s: r for r in rs.calibrated_fan(df, "s", "t", "y", [30], 300, 10, 200, 450).collect()}
    assert got["noise"].origins == got["walk"].origins == len([o for o in range(250, n - 30, 10)])
    assert got["noise"].emp_95 > 0.85 and 0.7 < got["noise"].scale_95 < 1.5
    assert got["walk"].emp_95 < got["noise"].emp_95 and got["walk"].scale_50 > 1.2
    for r in got.values():
        assert r.lo95 < r.lo50 < r.median < r.hi50 < r.hi95
    short = rs.calibrated_fan(df.filter("t < 100"), "s", "t", "y", [30], 50, 10, 200, 450).collect()
    assert {(r.origins, r.scale_50, r.scale_95) for r in short} == {(0, 1.0, 1.0)}


def test_snapshot_says_what_drives_it(spark):
    from tidemark.operators import regimes as rg

    day = lambda i: dt.date(2024, 1, 1) + dt.timedelta(days=i)
    daily = spark.createDataFrame([(s, day(i), 100.0 * g**i) for s, g in (("BTC", 1.01), ("A", 1.02), ("B", 0.99)) for i in range(60)], "symbol string, date date, close double")
    one = lambda v, label: spark.createDataFrame([(v, label)], "signal long, label string")
    flows = spark.createDataFrame([(day(i), 20.0) for i in range(60)], "date date, net_flow double")
    stock = daily.filter("symbol = 'A'").select("date", "close")
    r = rg.snapshot(daily, "BTC", one(1, "expanding"), one(0, "MISSING"), flows, stock).first()
    assert (r.as_of, r.n_universe, r.breadth_signal, r.stack_score, r.stack_label, r.headline) == (day(59), 3, 1, 2, "Constructive", "Risk-on")
    assert abs(r.ret_7d - (1.01**7 - 1)) < 1e-9 and abs(r.ret_ytd - (1.01**59 - 1)) < 1e-9 and r.etf_7d == 140.0
    assert r.drivers == "expanding liquidity; broad breadth; demand strong demand; 7d +7.2%"
