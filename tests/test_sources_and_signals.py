"""Landed answers, raw tables, panels, regime signals and the post pipeline on small files and hand-worked rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import signals as sg
from tidemark.operators import social
from tidemark.sources import landed, panels, tables


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def landed_file(spark, tmp_path, name, lines):
    (tmp_path / name).write_text("\n".join(lines) + "\n")
    return spark.read.text(str(tmp_path / name)).withColumns({c: F.lit("btc") for c in ("symbol", "series_id", "metric")})


def test_landed_answers_from_files(spark, tmp_path):
    bars = landed_file(spark, tmp_path, "klines.json", ['[[1704067200000,"1","2","0.5","1.5","10",1704153599999],[1704153600000,"x","2","1","1","1"],[1]]', "", "not json", "[]"])
    assert rows(landed.klines(bars)) == [("BTC", dt.date(2024, 1, 1), 1.0, 2.0, 0.5, 1.5, 10.0, "binance")]
    oi = landed_file(spark, tmp_path, "oi.json", ['[{"timestamp":1704070799999,"sumOpenInterestValue":"5.5","more":1},{"timestamp":null,"sumOpenInterestValue":"1"},{"timestamp":1704070800000,"sumOpenInterestValue":"NaN"}]'])
    assert rows(landed.open_interest(oi)) == [("BTC", dt.datetime(2024, 1, 1, 0), 5.5, "binance", "usd_notional", "1h")]
    fred = landed_file(spark, tmp_path, "fred.json", ['{"observations":[{"date":"2024-01-01","value":"."},{"date":"2024-01-02","value":""},{"date":"2024-01-03","value":"4.1"},{"date":"bad","value":"1"},{"date":"2024-01-04"}]}', '{"error":1}'])
    assert rows(landed.observations(fred)) == [("btc", dt.date(2024, 1, 3), 4.1, "fred")]
    chart = landed_file(spark, tmp_path, "chart.json", ['{"values":[{"x":1704067200,"y":7.5},{"x":1704153600,"y":null},{"y":3},{"x":"later","y":1}]}', '{"values":null}'])
    assert rows(landed.chart(chart)) == [("btc", dt.date(2024, 1, 1), 7.5, "blockchain.info")]
    wide = landed_file(spark, tmp_path, "wide.json", ['[{"date":"2024-01-01T00:00","total_mvrv":1.0},{"date":"2024-01-01T00:00","total_mvrv":2.0,"total_nupl":"NaN"},{"date":"2024-01-02","total_nupl":0.5},{"total_mvrv":9}]'])
    assert rows(landed.valuation(wide)) == [("mvrv", dt.date(2024, 1, 1), 2.0, "bitcoinisdata"), ("nupl", dt.date(2024, 1, 2), 0.5, "bitcoinisdata")]


@pytest.mark.parametrize("name", sorted(tables.RAW))
def test_raw_schemas_and_staging(spark, name):
    row = spark.createDataFrame([(None,)], "x string").select(*[F.lit("AbC" if tables.kind(name, c) == "string" else "2024-01-01" if tables.kind(name, c) in ("date", "timestamp_ntz") else "1").cast(tables.kind(name, c)).alias(c) for c in tables.RAW[name].split()])
    if name in tables.NOT_STAGED:
        with pytest.raises(ValueError):
            tables.staging(name, row)
        return
    for chain, address in (("ethereum", "abc"), ("solana", "AbC")):
        got = tables.staging(name, row.withColumn("chain", F.lit(chain)) if "chain" in row.columns else row).first().asDict()
        assert got.get("symbol", "ABC") == "ABC" and got.get("address", address) == address
        assert got.get("handle", "abc") == ("AbC" if name == "twitter_accounts" else "abc") and "raw_json" not in got
    if name in tables.ACTIVE_ONLY:
        assert tables.staging(name, row.withColumn("active", F.lit(False))).count() == 0


def test_scan_reads_its_columns_only(spark, tmp_path):
    spark.createDataFrame([("a", dt.date(2024, 1, 1), 1.0, "other")], "symbol string, date date, close double, extra string").write.parquet(str(tmp_path / "t"))
    df = tables.scan(spark, "ohlcv_daily", str(tmp_path / "t"))
    assert df.columns == tables.RAW["ohlcv_daily"].split() and df.first()["close"] == 1.0 and df.first()["open"] is None
    assert len(tables.RAW) == 29 and len(tables.VIEWS) == 25


def test_panels_fall_back(spark):
    spark.sql("create database if not exists main_marts")
    day = spark.createDataFrame([("BTC", dt.date(2024, 1, 1)), ("ETH", dt.date(2024, 1, 1))], "symbol string, date date")
    bars = day.selectExpr("*", "1d as open", "1d as high", "1d as low", "1d as close", "1d as volume", "'raw' as source", "5 as more")
    names = ("main_marts.fct_ohlcv_daily", "ohlcv_daily", "main_marts.mart_signals_daily")
    try:
        assert panels.load(spark, "daily").count() == 0 and panels.load(spark, "mev").columns[:2] == ["symbol", "date"]
        bars.write.saveAsTable(names[1])
        assert {r.source for r in panels.load(spark, "daily").collect()} == {"raw"} and "more" not in panels.load(spark, "daily").columns
        bars.withColumn("source", F.lit("mart")).write.saveAsTable(names[0])
        assert {r.source for r in panels.load(spark, "daily").collect()} == {"mart"}
        with pytest.raises(LookupError):
            panels.load(spark, "signals")
        bars.write.saveAsTable(names[2])
        assert panels.strategy_panel(spark, "anything").columns == bars.columns
        assert rows(panels.strategy_panel(spark, "daily", ["eth"]).select("symbol")) == [("ETH",)]
        assert rows(panels.strategy_panel(spark, "btc_macro").select("symbol")) == [("BTC",)]
    finally:
        for n in names:
            spark.sql(f"drop table if exists {n}")
    macro = spark.createDataFrame([(dt.date(2024, 1, 1), 5.0)], "date date, m2sl double")
    more = day.unionByName(spark.createDataFrame([("BTC", dt.date(2024, 1, 2))], "symbol string, date date")).selectExpr("*", "1d as open", "1d as high", "1d as low", "1d as close", "1d as volume", "'raw' as source")
    find = {"ohlcv_daily": more, "main_signals.fct_macro_series": macro}.get
    assert rows(panels.btc_macro(spark, find).select("date", "m2sl")) == [(dt.date(2024, 1, 1), 5.0), (dt.date(2024, 1, 2), 5.0)]


def onchain(spark, **columns):
    days = len(next(iter(columns.values())))
    data = [(dt.date(2022, 1, 3) + dt.timedelta(days=i), *[None if v[i] is None else float(v[i]) for v in columns.values()]) for i in range(days)]
    return spark.createDataFrame(data, "date date, " + ", ".join(f"{c} double" for c in columns))


def test_cycle_signal_takes_covered_and_varying_columns(spark):
    n = 200
    rising, sparse = [1.0 + i * i for i in range(n)], [float(i) if i % 20 == 0 else None for i in range(n)]
    late = [float(i % 7) if i >= 140 else None for i in range(n)]
    got = sg.cycle_signal(onchain(spark, hashrate=rising, active_addresses=[3.0] * n, fees_usd=sparse, mvrv=late)).first()
    assert sg.usable(onchain(spark, hashrate=rising, active_addresses=[3.0] * n, fees_usd=sparse, mvrv=late))[1] == ["hashrate"]  # mvrv leaves 60 days
    assert (got.signal, got.label) == (0, "MISSING")  # too few weeks are left
    got = sg.cycle_signal(onchain(spark, hashrate=rising, active_addresses=[3.0] * n, fees_usd=sparse)).first()
    assert (got.signal, got.label) == (1, "bullish mom (hashrate)")
    assert sg.cycle_signal(onchain(spark, other=rising)).first().label == "MISSING"
    assert sg.cycle_signal(onchain(spark, hashrate=rising[:10])).first().label == "MISSING"
    assert sg.cycle_signal(onchain(spark, hashrate=rising[::-1], fees_usd=rising)).first().label.endswith("(hashrate+fees_usd)")


def test_liquidity_signal_needs_all_series(spark):
    n = 7 * 90
    up = {c: [100 * 1.001 ** (i * i / n) for i in range(n)] for c in ("m2sl", "walcl")}
    wide = onchain(spark, **up, dgs10=[5 - i / n for i in range(n)], t10yie=[2.0] * n)
    assert sg.liquidity_signal(wide).first().asDict() == {"signal": 1, "label": "expanding"}
    assert sg.liquidity_signal(wide.drop("walcl")).first().label == "MISSING" == sg.liquidity_signal(wide.limit(60)).first().label


NOW = dt.datetime(2025, 6, 10)


def post(k, who, at, text):
    return (str(k), who, NOW - dt.timedelta(days=at[0], minutes=at[1]), text)


def test_post_pipeline_end_to_end(spark):
    posts = spark.createDataFrame(
        [
            post(1, "kol1", (3, 90), "$SOL long, to the moon"), post(2, "bob", (3, 60), "sell $SOL $ETH"), post(3, "amy", (3, 40), "$SOL $SOL"), post(4, "amy", (1, 0), "gm"),
            post(5, "bob", (20, 0), "old $ABC"), post(6, "bob", (1, 0), "again $ABC"), post(7, "zed", (0, 5), "$NEW at 0x" + "AB" * 20),
        ],
        "tweet_id string, handle string, posted_at timestamp_ntz, text string",
    )
    accounts = spark.createDataFrame([("kol1", "kol"), ("bob", "trader")], "handle string, entity_type string")
    universe = spark.createDataFrame([("sol",), ("ABC",)], "symbol string")
    known = spark.createDataFrame([("1", "symbol", "SOL"), ("1", "cashtag", "SOL")], "tweet_id string, entity_type string, entity_value string")
    out = social.run(posts, accounts, universe, known, F.lit(NOW).cast("timestamp_ntz"))
    assert rows(out.accounts.select("handle", "active")) == [("amy", False), ("zed", False)]
    assert {r.tweet_id for r in out.entities.collect()} == {"2", "3", "5", "6", "7"} and ("7", "eth_address", "0x" + "ab" * 20) in rows(out.entities)
    got = {(r.date.day, r.symbol): (r.mention_count, r.kol_mention_count, r.bullish_keyword_count, r.bearish_keyword_count, r.unique_accounts) for r in out.signals.collect()}
    assert got == {(6, "SOL"): (3, 1, 2, 1, 3), (9, "_all"): (1, 0, 0, 0, 1), (21, "ABC"): (1, 0, 0, 0, 1), (9, "ABC"): (1, 0, 0, 0, 1)} | {(9, "_all"): (2, 0, 0, 0, 2)}
    assert rows(out.alerts.select("alert_type", "symbol", "tweet_id")) == [("kol_cluster_mention", "SOL", "1"), ("new_token_call", "ETH", "2"), ("new_token_call", "NEW", "7"), ("new_token_call", "SOL", "1")]


def test_spikes(spark):
    signals = spark.createDataFrame([(dt.date(2025, 6, k), "SOL", n) for k, n in ((1, 2), (2, 1), (3, 3), (4, 20))] + [(dt.date(2025, 6, k), "FLAT", 2) for k in range(1, 5)] + [(dt.date(2025, 6, 1), "NEW", 9)], "date date, symbol string, mention_count long")
    assert rows(social.spikes(signals).select("symbol", "severity", "tweet_id")) == [("SOL", "high", "spike-SOL-2025-06-04")]
