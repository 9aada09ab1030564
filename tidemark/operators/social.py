"""The post pipeline: entities, new accounts, daily signals and alerts of one import, each made once and reused."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators.clusters import distinct_near
from tidemark.operators.stores import written

#: Confidence of an account that an import brought.
DISCOVERED = 0.3
#: Days of an alert's reach, least accounts of a cluster and its seconds.
RECENT_DAYS, CLUSTER, HOUR = 7, 3, 3600


@dataclass(frozen=True)
class Pipeline:
    """What one run gives, as written tables."""

    entities: DataFrame
    accounts: DataFrame
    signals: DataFrame
    alerts: DataFrame


def new_entities(posts: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(tweet_id, entity_type, entity_value) of the posts that have none yet."""
    fresh = posts if known is None else posts.join(known.select("tweet_id").distinct(), "tweet_id", "left_anti")
    found = fresh.select("tweet_id", F.explode(tx.entities(F.col("text"))).alias("e"))
    return found.select("tweet_id", F.col("e.kind").alias("entity_type"), F.col("e.value").alias("entity_value"))


def new_accounts(posts: DataFrame, accounts: DataFrame) -> DataFrame:
    """(handle, entity_type, confidence, source, active) of authors that are no accounts yet; they wait for review."""
    unknown = posts.select("handle").distinct().join(accounts, "handle", "left_anti")
    return unknown.select("handle", F.lit("trader").alias("entity_type"), F.lit(DISCOVERED).alias("confidence"), F.lit("import_discovered").alias("source"), F.lit(False).alias("active"))


def daily_signals(posts: DataFrame, entities: DataFrame, accounts: DataFrame, universe: DataFrame) -> DataFrame:
    """(date, symbol, mention_count, kol_mention_count, bullish_keyword_count, bearish_keyword_count, unique_accounts).

    A post counts for each symbol of the universe that it names, and for ``_all`` where it names none.
    """
    named = entities.filter("entity_type = 'symbol'").select("tweet_id", F.upper("entity_value").alias("symbol")).join(universe.select(F.upper("symbol").alias("symbol")).distinct(), "symbol", "left_semi").distinct()
    kol = accounts.filter("entity_type = 'kol'").select("handle", F.lit(True).alias("kol")).distinct()
    x = posts.select("tweet_id", "handle", F.col("posted_at").cast("date").alias("date"), tx.keyword_hits(F.col("text"), tx.BULLISH).alias("bull"), tx.keyword_hits(F.col("text"), tx.BEARISH).alias("bear"))
    x = x.join(named, "tweet_id", "left").join(kol, "handle", "left").withColumn("symbol", F.coalesce("symbol", F.lit("_all")))
    return x.groupBy("date", "symbol").agg(
        F.count("*").alias("mention_count"), F.count("kol").alias("kol_mention_count"), F.sum("bull").cast("long").alias("bullish_keyword_count"), F.sum("bear").cast("long").alias("bearish_keyword_count"),
        F.countDistinct("handle").alias("unique_accounts"),
    )


def spikes(signals: DataFrame, window: int = 30, least: float = 2.0) -> DataFrame:
    """Symbols whose last day has ``least`` deviations more mentions than the up to ``window - 1`` days before it."""
    back = Window.partitionBy("symbol").orderBy(F.desc("date"))
    x = signals.filter("symbol <> '_all'").withColumn("r", F.row_number().over(back)).filter(F.col("r") <= window)
    before = F.when(F.col("r") > 1, F.col("mention_count"))
    x = x.groupBy("symbol").agg(F.count("*").alias("n"), F.avg(before).alias("m"), F.stddev_pop(before).alias("s"), F.max_by("mention_count", "date").alias("last"), F.max("date").alias("date"))
    z = (F.col("last") - F.col("m")) / F.col("s")
    x = x.filter("n >= 3 and s > 0").filter(z >= least)
    return x.select(
        F.concat_ws("-", F.lit("spike"), "symbol", F.col("date").cast("string")).alias("tweet_id"), F.lit("_system").alias("handle"), F.lit("symbol_spike").alias("alert_type"),
        F.when(z >= least + 1, "high").otherwise("medium").alias("severity"), "symbol", F.col("date").cast("timestamp_ntz").alias("posted_at"),
    )


def _mentions(posts: DataFrame) -> DataFrame:
    tags = F.array_distinct(F.regexp_extract_all("text", F.lit(tx.CASHTAG), F.lit(1)))
    return posts.select("tweet_id", "handle", "posted_at", F.explode(tags).alias("symbol"))


def _first(rows: DataFrame, kind: str, severity: str) -> DataFrame:
    """The first row of each symbol, as an alert; ties to the least id."""
    first = rows.groupBy("symbol").agg(F.min_by(F.struct("tweet_id", "handle", "posted_at"), F.struct("posted_at", "tweet_id")).alias("f"))
    return first.select("f.tweet_id", "f.handle", F.lit(kind).alias("alert_type"), F.lit(severity).alias("severity"), "symbol", "f.posted_at")


def clusters(posts: DataFrame, now: Column) -> DataFrame:
    """Each symbol's first post of the last days after which, within an hour, several accounts name it."""
    recent = _mentions(posts.filter(F.col("posted_at") >= now - F.expr(f"interval {RECENT_DAYS} days")))
    near = distinct_near(recent, ["symbol"], "posted_at", "handle", 0, HOUR, "n")
    return _first(near.filter(F.col("n") >= CLUSTER), "kol_cluster_mention", "medium")


def new_tokens(posts: DataFrame, now: Column) -> DataFrame:
    """Symbols that were named for the first time in the last days."""
    return _first(_mentions(posts), "new_token_call", "low").filter(F.col("posted_at") >= now - F.expr(f"interval {RECENT_DAYS} days"))


def run(posts: DataFrame, accounts: DataFrame, universe: DataFrame, known: DataFrame | None = None, now: Column | None = None) -> Pipeline:
    """All stages of an import of (tweet_id, handle, posted_at, text): posts are read once, and each stage's result is written once."""
    now = F.current_timestamp().cast("timestamp_ntz") if now is None else now
    posts = written(posts.select("tweet_id", "handle", "posted_at", "text"), "posts")
    entities = written(new_entities(posts, known), "entities")
    everything = entities if known is None else entities.unionByName(known.select(*entities.columns))
    discovered = written(new_accounts(posts, accounts), "accounts")
    signals = written(daily_signals(posts, everything, accounts, universe), "signals")
    alerts = spikes(signals).unionByName(clusters(posts, now)).unionByName(new_tokens(posts, now))
    return Pipeline(entities, discovered, signals, written(alerts, "alerts"))
