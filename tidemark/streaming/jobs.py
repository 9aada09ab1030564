"""Detection and merge jobs that run alike on a batch and on a stream."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.stores import Store

#: Entity types by how much an alert on them matters.
HIGH, MEDIUM = ("kol", "smart_money", "insider_cluster", "insider"), ("deployer", "whale")


def alerts(transfers: DataFrame, registry: DataFrame, least: float = 10.0, least_usd: float = 100_000.0) -> DataFrame:
    """Material transfers of registered wallets, with action and severity: a stream may be joined to the static registry."""
    into = F.col("direction") == "inflow"
    own = F.when(into, F.col("to_address")).otherwise(F.col("from_address"))
    material = (F.col("chain") != "bitcoin") | (F.col("amount") >= least) | F.coalesce(F.col("amount_usd") >= least_usd, F.lit(False))
    kind = F.col("entity_type")
    j = transfers.filter(material).withColumn("address", own).join(registry.select("address", "chain", "entity_type", "label"), ["address", "chain"])
    return j.withColumn("action", F.concat(kind, F.when(into, "_buy_").otherwise("_sell_"), F.col("asset"))).withColumn("severity", F.when(kind.isin(*HIGH) & into, "high").when(kind.isin(*MEDIUM), "medium").otherwise("low"))


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", archive: str | None = None, **options) -> DataFrame:
    """Files as they arrive; with ``archive``, they are moved there once read."""
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.load(path)


def bars(ticks: DataFrame, width: str = "1 day", late: str = "7 days") -> DataFrame:
    """(symbol, window, open, high, low, close, n) of (symbol, ts, price, event_id)."""
    x = ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return x.groupBy("symbol", F.window("ts", width)).agg(F.min_by("price", "event_id").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "event_id").alias("close"), F.count("*").alias("n"))


def deduplicated(rows: DataFrame, keys: Sequence[str], late: str = "7 days") -> DataFrame:
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))


def clusters(ticks: DataFrame, width: str = "1 hour", slide: str = "5 minutes", least: int = 3, late: str = "1 hour") -> DataFrame:
    """Windows in which many distinct users are active."""
    x = ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return x.groupBy("symbol", F.window("ts", width, slide)).agg(F.size(F.collect_set("user_id")).alias("users")).filter(F.col("users") >= least)


def co_buying(transfers: DataFrame, width: str = "1 minute", least: int = 2, late: str = "1 hour") -> DataFrame:
    """(asset, window, buyers): minutes in which several wallets took in the same asset."""
    x = transfers.filter("direction = 'inflow'").withColumn("ts", F.col("block_time").cast("timestamp")).withWatermark("ts", late)
    buyers = F.size(F.collect_set("to_address")).alias("buyers")
    return x.groupBy("asset", F.window("ts", width)).agg(buyers).filter(F.col("buyers") >= least)


def cursors(rows: DataFrame, key: str) -> DataFrame:
    """(key, earliest, latest, n): how far each key has been read."""
    return rows.groupBy(key).agg(F.min("ts").alias("earliest"), F.max("ts").alias("latest"), F.count("*").alias("n"))


def merged_cursors(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Cursors widened by those of a batch."""
    a, b = (d.select(key, *[F.col(c).alias(f"{c}{s}") for c in ("earliest", "latest", "n")]) for d, s in ((old, 1), (new, 2)))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return a.join(b, key, "full").select(
        key, F.least("earliest1", "earliest2").alias("earliest"), F.greatest("latest1", "latest2").alias("latest"), (zero("n1") + zero("n2")).alias("n")
    )


def merge_stream(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Each micro-batch goes to ``merge``; the checkpoint is the cursor."""
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_into(
    stream: DataFrame, store: Store, name: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] | None = None, combine: Mapping[str, Callable[[Column, Column], Column]] | None = None
) -> StreamingQuery:
    """Micro-batches merged into a keyed table; a batch that is run again after a failure changes nothing.

    ``prepare`` makes of a batch the rows to merge (a row a key, where ``combine`` adds to old values). The batch's
    number is written with the rows, so it does not matter whether the stream broke off before, in or after the merge.
    """

    def each(batch: DataFrame, number: int) -> None:
        Store.open(batch.sparkSession, store.folder).merge_batch(prepare(batch) if prepare else batch, name, number, combine)

    return merge_stream(stream, each, checkpoint)


def poll_cursors(stream: DataFrame, store: Store, key: str, checkpoint: str) -> StreamingQuery:
    """How far each key has been read, kept in a keyed table from batch to batch."""
    add = {"earliest": F.least, "latest": F.greatest, "n": lambda old, new: old + new}
    return merge_into(stream, store, "cursors", checkpoint, lambda batch: cursors(batch, key), add)
