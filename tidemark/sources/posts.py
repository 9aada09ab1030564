"""Posts, seeds and archives from files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as tx

#: Names that the same field goes by.
ALIASES = {
    "tweet_id": ("tweet_id", "id"), "handle": ("handle", "username"), "text": ("text", "full_text"), "posted_at": ("posted_at", "created_at"),
    "like_count": ("like_count", "favorite_count"), "retweet_count": ("retweet_count",), "reply_count": ("reply_count",), "is_retweet": ("is_retweet",), "is_reply": ("is_reply",),
}
JSON_POST = """tweet_id string, id string, handle string, username string, text string, full_text string, posted_at string, created_at string, like_count long, favorite_count long, retweet_count long, reply_count long,
    is_retweet boolean, is_reply boolean, author struct<username: string>, user struct<screen_name: string>, public_metrics struct<like_count: long, retweet_count: long, reply_count: long>"""  # fmt: skip


def _typed(df: DataFrame, raw: str) -> DataFrame:
    """Posts with a handle and a date; times in UTC."""
    flag = lambda c: F.lower(F.trim(F.col(c).cast("string"))).isin("true", "1", "yes")
    count = lambda c: F.coalesce(F.col(c).cast("string").try_cast("long"), F.lit(0).cast("long"))
    out = df.select(
        F.col("tweet_id").cast("string").alias("tweet_id"), tx.handle(F.col("handle")).alias("handle"), F.try_to_timestamp(F.regexp_replace("posted_at", "Z$", "+00:00")).cast("timestamp_ntz").alias("posted_at"), F.col("text"),
        *[count(c).alias(c) for c in ("like_count", "retweet_count", "reply_count")], *[F.coalesce(flag(c), F.lit(False)).alias(c) for c in ("is_retweet", "is_reply")], F.col(raw).alias("raw_json"),
    )
    return out.filter("posted_at is not null and tweet_id is not null")


def posts_csv(spark: SparkSession, path: str) -> DataFrame:
    """Posts of a CSV file with any of the known header names; the whole row is kept as JSON."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    present = lambda names: [F.col(n) for n in names if n in df.columns] or [F.lit(None).cast("string")]
    named = df.select(*[F.coalesce(*present(names)).alias(k) for k, names in ALIASES.items()], F.to_json(F.struct(*df.columns)).alias("_raw"))
    return _typed(named, "_raw")


def posts_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Posts of JSON lines, flat or nested; lines that are blank or no object go."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    j = lines.select("value", F.from_json("value", JSON_POST).alias("j")).filter(F.trim("value").startswith("{")).select("value", "j.*")
    c = F.coalesce
    flat = j.select(
        c("tweet_id", "id").alias("tweet_id"), c("handle", "username", "author.username", "user.screen_name").alias("handle"), c("text", "full_text").alias("text"), c("posted_at", "created_at").alias("posted_at"),
        c("like_count", "favorite_count", "public_metrics.like_count").alias("like_count"), c("retweet_count", "public_metrics.retweet_count").alias("retweet_count"),
        c("reply_count", "public_metrics.reply_count").alias("reply_count"), "is_retweet", "is_reply", F.col("value").alias("_raw"),
    )
    return _typed(flat, "_raw")


def block_payloads(spark: SparkSession, path: str, relay: str = "unknown") -> DataFrame:
    """(slot, block_number, builder_pubkey, relay, date, value_eth): files of differing columns, values in any unit, dates from slots."""
    df = spark.read.option("mergeSchema", True).parquet(path)
    units = {"value_wei": "wei", "value_gwei": "gwei", "bid_value": None, "value": None}
    values = [tx.wei(F.col(c).cast("string"), F.lit(u) if u else None) for c, u in units.items() if c in df.columns]
    if not values:
        raise ValueError(f"none of {', '.join(units)} in {path}")
    maybe = lambda c, kind: F.col(c).cast(kind) if c in df.columns else F.lit(None).cast(kind)
    slot_date = F.timestamp_seconds(F.lit(1606824023) + F.col("slot") * 12).cast("date")  # fixed values: the chain's first slot, and seconds a slot
    return df.select(F.col("slot").cast("long").alias("slot"), maybe("block_number", "long").alias("block_number"), maybe("builder_pubkey", "string").alias("builder_pubkey"), F.coalesce(maybe("relay", "string"), F.lit(relay)).alias("relay"), F.coalesce(maybe("date", "date"), slot_date).alias("date"), F.coalesce(*values).alias("value_eth"))


def watched_archive(df: DataFrame, watched: DataFrame) -> DataFrame:
    """(signature, block_time, address, amount): a row for each transaction that has a watched account, by the first such, with its fee."""
    keys = F.transform("accounts", lambda a: a["pubkey"]) if "accounts" in df.columns else F.col("account_keys")
    each = df.select("signature", "block_time", "fee", F.posexplode(keys).alias("at", "address"))
    hit = each.join(watched.select("address").distinct(), "address", "left_semi")
    return hit.groupBy("signature", "block_time", "fee").agg(F.min_by("address", "at").alias("address")).select("signature", "block_time", "address", (F.col("fee") / 1e9).alias("amount"))


def seed_csv(spark: SparkSession, path: str, required: Sequence[str], defaults: dict[str, str | float]) -> DataFrame:
    """A seed file: trimmed values, defaults for blanks, ``active`` unless it says false, an error for a bad ``linked_at``."""
    df = spark.read.csv(path, header=True)
    df = df.select(*[F.nullif(F.trim(c), F.lit("")).alias(c) for c in df.columns])
    for c, v in defaults.items():
        old = F.col(c) if c in df.columns else F.lit(None).cast("string")
        df = df.withColumn(c, F.coalesce(old.try_cast("double") if isinstance(v, float) else old, F.lit(v)))
    if "active" in df.columns:
        df = df.withColumn("active", F.lower(F.coalesce("active", F.lit("true"))) != "false")
    if "linked_at" in df.columns:
        at = F.try_to_timestamp("linked_at")
        df = df.withColumn("linked_at", F.when(F.col("linked_at").isNotNull() & at.isNull(), F.raise_error(F.concat(F.lit("bad linked_at: "), "linked_at"))).otherwise(at))
    return df.dropna(subset=list(required))


def flow_tables(pages: DataFrame, html: str = "html") -> DataFrame:
    """(date, ticker, flow): dated rows of HTML tables, the first row naming the columns; other rows go."""
    table = F.xxhash64(html).alias("p")  # pages that are alike give the same rows
    rows = pages.dropDuplicates([html]).select(table, F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("r", "row"))
    cells = rows.select("p", "r", F.transform(F.regexp_extract_all("row", F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda c: F.trim(F.regexp_replace(c, "<[^>]+>", ""))).alias("cells"))
    head = cells.filter("r = 0").select("p", F.col("cells").alias("names"))
    dated = cells.filter("r > 0").withColumn("date", F.coalesce(F.to_date(F.try_to_timestamp(F.element_at("cells", 1), F.lit("d MMM yyyy"))), F.to_date(F.try_to_timestamp(F.element_at("cells", 1), F.lit("yyyy-MM-dd"))))).filter("date is not null")
    pairs = dated.join(head, "p").select("date", F.explode(F.arrays_zip(F.slice("names", 2, 200).alias("name"), F.slice("cells", 2, 200).alias("cell"))).alias("x"))
    return pairs.select("date", F.upper("x.name").alias("ticker"), tx.parse_number(F.col("x.cell")).alias("flow")).filter("flow is not null")


def klines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Bars of landed arrays [open time in ms, open, high, low, close, volume, ...]."""
    a = F.from_json(value, "array<string>")
    num = lambda k: F.element_at("a", k).try_cast("double")
    out = lines.select(a.alias("a")).filter(F.size("a") >= 6)
    return out.select(F.timestamp_millis(F.element_at("a", 1).try_cast("long")).cast("date").alias("date"), *[num(k).alias(n) for k, n in enumerate(("open", "high", "low", "close", "volume"), 2)])
