import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import relational as rel
from tidemark.operators import series as ts
from tidemark.operators import strategy as st
from tidemark.sources import posts
from tidemark.streaming import jobs


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_upsert_is_idempotent(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    once = rel.upsert(old, new, ["k"])
    assert rows(once) == rows(rel.upsert(once, new, ["k"])) == [(1, "a"), (2, "c"), (3, "d")]


def test_scd2_keeps_one_open_row(spark):
    at = lambda d: F.lit(d).cast("timestamp")
    empty = spark.createDataFrame([], "k int, v string, valid_from timestamp, valid_to timestamp")
    one = rel.scd2(empty, spark.createDataFrame([(1, "a"), (2, None)], "k int, v string"), "k", ["v"], at("2024-01-01")).drop("scd_id")
    two = rel.scd2(one, spark.createDataFrame([(1, "b"), (2, None)], "k int, v string"), "k", ["v"], at("2024-01-02"))
    assert two.filter("valid_to is null").groupBy("k").count().filter("count <> 1").isEmpty()
    assert two.count() == 3


def test_asof_never_looks_ahead(spark):
    left = spark.createDataFrame([("a", 1), ("a", 3), ("a", 5), ("b", 3)], "s string, t int")
    right = spark.createDataFrame([("a", 2, 20), ("a", 3, 30), ("b", 9, 90)], "s string, t int, v int")
    assert {(r.s, r.t): r.v for r in rel.asof_join(left, right, ["s"], "t", ["v"]).collect()} == {("a", 1): None, ("a", 3): 30, ("a", 5): 30, ("b", 3): None}


def test_asof_by_blocks_equals_asof(spark):
    import random

    rng = random.Random(4)
    left = spark.createDataFrame([(rng.choice("ab"), rng.randint(0, 400), k) for k in range(300)], "s string, t int, id int")
    right = spark.createDataFrame([(s, t, None if rng.random() < 0.3 else float(t), t % 7) for s in "ab" for t in rng.sample(range(400), 12)], "s string, t int, v double, u int")
    block = F.floor(F.col("t") / 50)
    for on in (["s"], []):
        r = right if on else right.filter("s = 'a'")
        want = rel.asof_join(left, r, on, "t", ["v", "u"])
        assert rows(rel.asof_join(left, r, on, "t", ["v", "u"], block).fillna(-1)) == rows(want.fillna(-1))


def test_band_join_is_exact(spark):
    t = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    x = spark.createDataFrame([("a", t(s), s) for s in (0, 59, 60, 61, 3600)], "k string, ts timestamp, id int")
    got = {(r.id, r.id_r) for r in rel.band_join(x, x, ["k"], "ts", 60).filter("id < id_r").collect()}
    assert got == {(a, b) for a in (0, 59, 60, 61, 3600) for b in (0, 59, 60, 61, 3600) if a < b and b - a <= 60}


def test_ema_is_seeded_by_the_mean(spark):
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate((2, 4, 6, 8))], "s string, i int, v double")
    assert [r.e for r in ts.ema(df, "s", "i", "v", "e", 3).orderBy("i").collect()] == [None, None, 4.0, 6.0]


def test_interpolation_and_fill(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate((None, 1.0, None, 3.0, None))], "s string, i int, v double")
    assert [r.x for r in ts.interpolate(df, ["s"], "i", "v", "x").orderBy("i").collect()] == [None, 1.0, 2.0, 3.0, None]


def test_entities_and_numbers(spark):
    df = spark.createDataFrame([("buy $BTC $BTC at foo.sol 0x" + "ab" * 20,)], "t string")
    found = {(e.kind, e.value) for e in df.select(tx.entities(F.col("t")).alias("e")).first().e}
    assert found == {("cashtag", "BTC"), ("symbol", "BTC"), ("sol_domain", "foo.sol"), ("eth_address", "0x" + "ab" * 20)}
    n = spark.createDataFrame([("(1,234.5)",), ("-",), (" 7 ",), ("x",)], "t string").select(tx.parse_number(F.col("t")).alias("n"))
    assert [r.n for r in n.collect()] == [-1234.5, None, 7.0, None]


def test_post_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,username,created_at,full_text,favorite_count\n1,@Bob,2024-01-01T00:00:00Z,"hi, ""you""",3\n2,amy,,x,1\n')
    (tmp_path / "b.jsonl").write_text('{"id":"5","created_at":"2024-01-02T00:00:00Z","text":"t","author":{"username":"Cat"},"public_metrics":{"like_count":9}}\n\nnot json\n')
    a = posts.posts_csv(spark, str(tmp_path / "a.csv")).collect()
    assert [(r.tweet_id, r.handle, r.text, r.like_count) for r in a] == [("1", "bob", 'hi, "you"', 3)]
    b = posts.posts_jsonl(spark, str(tmp_path / "b.jsonl")).collect()
    assert [(r.tweet_id, r.handle, r.like_count) for r in b] == [("5", "cat", 9)]


def test_block_payload_units(spark, tmp_path):
    spark.createDataFrame([(0, "2000000000000000000")], "slot long, value_wei string").write.parquet(str(tmp_path / "p/x"))
    spark.createDataFrame([(1, 2e9)], "slot long, value_gwei double").write.parquet(str(tmp_path / "p/y"))
    got = posts.block_payloads(spark, str(tmp_path / "p/*")).collect()
    assert [r.value_eth for r in got] == [2.0, 2.0] and str(got[0].date) == "2020-12-01"


def test_flow_tables(spark):
    html = "<table><tr><th>Date</th><th>AAA</th><th>Total</th></tr><tr><td>01 Jan 2024</td><td>(10.0)</td><td>1,234.5</td></tr><tr><td>Total</td><td>1</td><td>2</td></tr></table>"
    got = posts.flow_tables(spark.createDataFrame([(html,)], "html string"))
    assert rows(got.select("ticker", "flow")) == [("AAA", -10.0), ("TOTAL", 1234.5)]


def test_seed_defaults_and_errors(spark, tmp_path):
    (tmp_path / "s.csv").write_text("address,active,linked_at\n a ,FALSE,\nb,,bad\n")
    df = posts.seed_csv(spark, str(tmp_path / "s.csv"), ["address"], {"confidence": 0.5})
    assert rows(df.select("address", "active", "confidence")) == [("a", False, 0.5), ("b", True, 0.5)]
    with pytest.raises(Exception, match="bad linked_at"):
        df.collect()


def panel(spark, days=130):
    data = [(s, dt.date(2024, 1, 1) + dt.timedelta(days=d), 100.0 * (1 + 0.1 * i) * (1.001 + 0.0005 * i) ** d * (1 + 0.01 * ((d * 7 + i * 3) % 5)), 1e5 + 1e3 * ((d + i) % 7)) for i, s in enumerate("ABCDE") for d in range(days)]
    return spark.createDataFrame(data, "symbol string, date date, close double, volume double")


def test_weights_are_neutral_and_costs_positive(spark):
    s = st.Strategy(momentum=(5, 10), vol_window=5, volume_window=5, train=40, test=20, step=20, embargo=5)
    w = st.weights(st.score(st.features(panel(spark), s), s), s).cache()
    sums = [r.x for r in w.groupBy("date").agg(F.sum("weight").alias("x")).collect()]
    assert max(map(abs, sums)) < 1e-9 and not w.filter("weight <> 0").isEmpty()
    d = st.daily(w, s)
    assert d.filter("cost < 0 or net > gross + 1e-12").isEmpty()
    for r in st.folds(d, s).collect():
        assert (r.test_start - r.train_end).days > s.embargo
    shuffled = st.daily(st.weights(st.score(st.features(panel(spark).repartition(7, "close"), s), s), s), s)
    assert abs(d.agg(F.sum("net")).first()[0] - shuffled.agg(F.sum("net")).first()[0]) < 1e-9


def test_stream_equals_batch(spark, tmp_path):
    ticks = spark.createDataFrame([(i, "AB"[i % 2], dt.datetime(2024, 1, 1 + i // 4, i % 24), float(i)) for i in range(12)], "event_id long, symbol string, ts timestamp, price double")
    for k in range(3):
        ticks.filter(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = jobs.file_stream(spark, str(tmp_path / "in"), ticks.schema, maxFilesPerTrigger=1)
    q = jobs.bars(stream).writeStream.outputMode("complete").format("memory").queryName("bars_out").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.table("bars_out").select("symbol", "open", "close", "n")) == rows(jobs.bars(ticks).select("symbol", "open", "close", "n"))


def test_stream_merges_by_key(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = jobs.file_stream(spark, str(tmp_path / "in"), "k int, v string")
    jobs.merge_stream(stream, lambda df, _: seen.extend(rows(df)), str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(seen) == [(1, "a"), (2, "b")]
