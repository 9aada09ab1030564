"""Joins, deduplication, pivots and keyed writes that Spark has no single operator for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Venues in order of preference.
SOURCE_PRIORITY = {"binance": 1, "coinbase": 2, "coingecko": 3}
OTHER_PRIORITY = 4


def source_rank(source: Column) -> Column:
    out = F.lit(None)
    for name, rank in SOURCE_PRIORITY.items():
        out = F.when(source == name, rank) if name == "binance" else out.when(source == name, rank)
    return out.otherwise(OTHER_PRIORITY)


def dedupe_by_priority(df: DataFrame, keys: Sequence[str], source: str) -> DataFrame:
    """The row of the preferred source for each key; ties by the source's name."""
    w = Window.partitionBy(*keys).orderBy(source_rank(F.col(source)), source)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the greatest ``order`` for each key, by partial aggregation."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def pivot_metrics(df: DataFrame, by: str, name: str, value: str, names: Sequence[str]) -> DataFrame:
    return df.groupBy(by).pivot(name, list(names)).agg(F.max(value))


def asof_join(left: DataFrame, right: DataFrame, on: Sequence[str], time: str, values: Sequence[str], block: Column | None = None) -> DataFrame:
    """Each left row with the latest right values at or before its time: one shuffle, no range join.

    With ``block``, a column that grows with the time, windows run within a key's blocks, and each block starts from the
    last values of those before it: so keys of any size, or none at all, are dealt over as many tasks as there are blocks.
    """
    lc = left.columns
    tagged = left.select(*lc, *[F.lit(None).cast(right.schema[v].dataType).alias(f"_{v}") for v in values], F.lit(1).alias("_side"))
    other = right.select(*[F.col(c) if c in (*on, time) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in lc], *[F.col(v).alias(f"_{v}") for v in values], F.lit(0).alias("_side"))
    both = tagged.unionByName(other).withColumn("_block", F.lit(0) if block is None else block)
    w = Window.partitionBy(*on, "_block").orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    carried = both.select(*lc, "_side", "_block", *[F.last(f"_{v}", ignorenulls=True).over(w).alias(v) for v in values]).filter("_side = 1")
    if block is None:
        return carried.drop("_side", "_block")
    known = other.withColumn("_block", block)
    ends = known.groupBy(*on, "_block").agg(*[F.max_by(f"_{v}", F.when(F.col(f"_{v}").isNotNull(), F.col(time))).alias(f"_{v}") for v in values])  # a row a block
    blocks = both.select(*on, "_block").distinct().join(ends, [*on, "_block"], "left")
    earlier = Window.partitionBy(*on).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select(*on, "_block", *[F.last(f"_{v}", ignorenulls=True).over(earlier).alias(f"_{v}") for v in values])
    return carried.join(starts, [*on, "_block"], "left").select(*lc, *[F.coalesce(v, f"_{v}").alias(v) for v in values])


def band_join(left: DataFrame, right: DataFrame, on: Sequence[str], time: str, seconds: int, suffix: str = "_r") -> DataFrame:
    """Pairs of rows of the same key whose times differ by at most ``seconds``: equi-join on time buckets, then exact."""
    width = seconds * 1_000_000
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    l = left.withColumn("_t", micros(time)).withColumn("_b", F.explode(F.array(*[F.floor(F.col("_t") / width) + k for k in (-1, 0, 1)])))
    r = right.select(*[F.col(c) if c in on else F.col(c).alias(c + suffix) for c in right.columns], micros(time).alias("_t2")).withColumn("_b", F.floor(F.col("_t2") / width))
    return l.join(r, [*on, "_b"]).filter(F.abs(F.col("_t") - F.col("_t2")) <= width).drop("_b", "_t", "_t2")


def either_side_join(df: DataFrame, dim: DataFrame, sides: Sequence[str], key: str, on: Sequence[str] = ()) -> DataFrame:
    """Inner join where any of the sides matches: an equi-join in place of OR; a row with equal sides matches once."""
    return df.withColumn(key, F.explode(F.array_distinct(F.array(*sides)))).join(dim, [key, *on])


def two_role_join(df: DataFrame, dim: DataFrame, first: str, second: str, key: str, on: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Left joins of a dimension in two roles; rows with neither go; values of the first role come first."""
    a = dim.select(*on, F.col(key).alias(first), *[F.col(v).alias(f"_a_{v}") for v in values])
    b = dim.select(*on, F.col(key).alias(second), *[F.col(v).alias(f"_b_{v}") for v in values])
    joined = df.join(a, [*on, first], "left").join(b, [*on, second], "left").filter(F.col(f"_a_{values[0]}").isNotNull() | F.col(f"_b_{values[0]}").isNotNull())
    return joined.select(*df.columns, *[F.coalesce(f"_a_{v}", f"_b_{v}").alias(v) for v in values])


def one_each(new: DataFrame, keys: Sequence[str], order: Sequence[str] | None = None) -> DataFrame:
    """One row a key: the last by ``order``, then (or without it) by the other columns from left to right."""
    rest = [c for c in new.columns if c not in keys]
    return keep_last(new, keys, [*(order or ()), *rest]) if rest else new.distinct()


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str] | None = None) -> DataFrame:
    """Last write wins: the new rows (``one_each``), and the old ones of other keys."""
    fresh = one_each(new, keys, order)
    return fresh.unionByName(old.join(fresh.select(*keys), list(keys), "left_anti"), allowMissingColumns=True)


def insert_ignore(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    return old.unionByName(one_each(new, keys).join(old.select(*keys), list(keys), "left_anti"))


def update_columns(old: DataFrame, new: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Existing keys take the new values of some columns; new keys are added."""
    n = one_each(new, keys)
    hit = n.select(*keys, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_n_{c}") for c in columns])
    kept = old.join(hit, list(keys), "left").select(*[F.when(F.col("_hit"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in old.columns])
    return kept.unionByName(n.join(old.select(*keys), list(keys), "left_anti"), allowMissingColumns=True)


def incremental_merge(target: DataFrame, source: DataFrame, keys: Sequence[str], time: str, lookback_days: int = 7) -> DataFrame:
    """Upsert of the source's rows since the target's latest time less the lookback; new columns are appended."""
    since = target.agg((F.coalesce(F.max(time).cast("timestamp"), F.lit("1970-01-01").cast("timestamp")) - F.expr(f"interval {lookback_days} days")).alias("_since"))
    recent = source.crossJoin(F.broadcast(since)).filter(F.col(time).cast("timestamp") >= F.col("_since")).drop("_since")  # one row
    return upsert(target, recent, keys)


def scd2(history: DataFrame, current: DataFrame, key: str, checks: Sequence[str], now: Column) -> DataFrame:
    """Changed or vanished keys are closed at ``now``; changed and new ones are opened."""
    open_rows = history.filter("valid_to is null")
    cur = current.select(key, *checks)
    same = F.lit(True)
    for c in checks:
        same = same & F.col(f"h.{c}").eqNullSafe(F.col(f"c.{c}"))
    in_h, in_c = F.col("h.valid_from").isNotNull(), F.coalesce(F.col("c._here"), F.lit(False))
    both = open_rows.alias("h").join(cur.withColumn("_here", F.lit(True)).alias("c"), key, "full")
    closed = both.filter(in_h).select(key, *[F.col(f"h.{c}").alias(c) for c in checks], F.col("h.valid_from").alias("valid_from"), F.when(in_c & same, F.lit(None)).otherwise(now).cast("timestamp").alias("valid_to"))
    opened = both.filter(in_c & ~(in_h & same)).select(key, *[F.col(f"c.{c}").alias(c) for c in checks], now.cast("timestamp").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"))
    rows = closed.unionByName(opened).unionByName(history.filter("valid_to is not null").select(key, *checks, "valid_from", "valid_to"))
    return rows.withColumn("scd_id", F.sha2(F.concat_ws("|", F.col(key).cast("string"), F.col("valid_from").cast("string")), 256))
