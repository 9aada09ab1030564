"""Chain transactions to transfers of watched addresses.

Transactions have arrays of legs; these are exploded, and membership of the watched addresses is a join, so
neither the number of addresses nor that of legs has a bound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.stores import written


def bitcoin_transfers(transactions: DataFrame, watched: DataFrame) -> DataFrame:
    """(tx_hash, direction, leg, address, counterparty, amount) of (tx_hash, inputs, outputs) and (address).

    Outputs to a watched address are inflows, inputs from one outflows; coinbase inputs are skipped. The
    counterparty is the first address of the other side that is not watched, else the first that is another.
    """
    own = watched.select("address").distinct().withColumn("watched", F.lit(True))

    def side(name: str) -> DataFrame:
        each = transactions.select("tx_hash", F.posexplode(name).alias("_at", "x")).select("tx_hash", "_at", "x.address", "x.n", "x.value", *(["x.coinbase"] if has_coinbase else []))
        return (each.filter(~F.coalesce("coinbase", F.lit(False))).drop("coinbase") if has_coinbase else each).withColumn("side", F.lit(name))

    has_coinbase = "coinbase" in transactions.select(F.explode("inputs").alias("x")).select("x.*").columns
    legs = written(side("outputs").unionByName(side("inputs")).join(own, "address", "left"), "legs")  # read several times
    known = legs.filter("address is not null")
    free = F.min_by("address", F.when(F.col("watched").isNull(), F.col("_at")))
    first = known.groupBy("tx_hash", "side").agg(F.min_by("address", "_at").alias("first"), free.alias("free"))
    # of the addresses that are not the first, the first: for legs whose own address is the first
    second = known.join(first.select("tx_hash", "side", "first"), ["tx_hash", "side"]).filter("address <> first").groupBy("tx_hash", "side").agg(F.min_by("address", "_at").alias("second"))
    mine = legs.filter("watched").withColumn("direction", F.when(F.col("side") == "outputs", "inflow").otherwise("outflow"))
    mine = mine.withColumn("side", F.when(F.col("side") == "outputs", "inputs").otherwise("outputs"))  # the other side's addresses are its counterparties
    joined = mine.join(first, ["tx_hash", "side"], "left").join(second, ["tx_hash", "side"], "left")
    other = F.coalesce("free", F.when(F.col("first") != F.col("address"), F.col("first")).otherwise(F.col("second")))
    return joined.select("tx_hash", "direction", F.col("n").alias("leg"), "address", other.alias("counterparty"), F.col("value").alias("amount"))


def solana_transfers(transactions: DataFrame, watched: DataFrame) -> DataFrame:
    """(tx_hash, asset, address, direction, amount) of (tx_hash, accounts, pre, post, pre_tokens, post_tokens).

    A row for each watched account whose lamports change, and for each change of a watched owner's balance of a token;
    balances that are missing are 0. A transaction that gives no such row gives one with amount 0 as the outflow of its
    first watched account, if it has one.
    """
    own = watched.select("address").distinct()
    zipped = transactions.select("tx_hash", F.posexplode(F.arrays_zip("accounts", "pre", "post")).alias("at", "x"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    native = zipped.select("tx_hash", "at", F.col("x.accounts").alias("address"), (zero(F.col("x.post")) - zero(F.col("x.pre"))).alias("lamports")).join(own, "address", "left_semi")

    def balances(column: str, sign: int) -> DataFrame:
        x = transactions.select("tx_hash", F.explode(column).alias("x"))
        return x.select("tx_hash", F.col("x.mint").alias("asset"), F.col("x.owner").alias("address"), (F.col("x.amount") * sign).alias("delta"))

    tokens = balances("post_tokens", 1).unionByName(balances("pre_tokens", -1)).join(own, "address", "left_semi")
    tokens = tokens.groupBy("tx_hash", "asset", "address").agg(F.sum("delta").alias("delta"))
    moved = native.select("tx_hash", F.lit("SOL").alias("asset"), "address", (F.col("lamports") / 1e9).alias("delta")).unionByName(tokens).filter("delta <> 0")
    direction = F.when(F.col("delta") > 0, "inflow").otherwise("outflow")
    rows = moved.select("tx_hash", "asset", "address", direction.alias("direction"), F.abs("delta").alias("amount"))
    idle = native.groupBy("tx_hash").agg(F.min_by("address", "at").alias("address")).join(moved.select("tx_hash"), "tx_hash", "left_anti")
    return rows.unionByName(idle.select("tx_hash", F.lit("SOL").alias("asset"), "address", F.lit("outflow").alias("direction"), F.lit(0.0).alias("amount")))


def evm_transfers(transactions: DataFrame, watched: DataFrame) -> DataFrame:
    """(tx_hash, direction, address, counterparty, amount) of (tx_hash, sender, receiver, wei): a row for each watched side."""
    own = watched.select("address").distinct()
    amount = (F.col("wei") / 1e18).alias("amount")

    def side(direction: str, mine: str, other: str) -> DataFrame:
        x = transactions.join(own.withColumnRenamed("address", mine), mine, "left_semi")
        return x.select("tx_hash", F.lit(direction).alias("direction"), F.col(mine).alias("address"), F.col(other).alias("counterparty"), amount)

    return side("outflow", "sender", "receiver").unionByName(side("inflow", "receiver", "sender"))
