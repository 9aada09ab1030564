"""Who else is active around each row, in time linear in the rows: no pairs and no sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def distinct_near(df: DataFrame, by: Sequence[str], time: str, who: str, before: int, after: int, out: str) -> DataFrame:
    """All rows with ``out``: how many distinct ``who`` have a row of the same ``by`` from ``before`` seconds earlier to
    ``after`` seconds later, both ends included, the row's own among them.

    A row of someone counts for the times from its own less ``after`` to its own plus ``before``. Time is cut into
    buckets as wide as that; in each, the stretches of one person are joined to disjoint ones, and a running sum of
    their begins and ends is the number of persons at every time. Rows come out as they go in (twice as many in
    between), and a key's rows are split by time. Rows without a time count nobody; without a person they are nobody.
    """
    by, width = list(by), (before + after + 1) * 1_000_000
    at = df.select(*by, F.unix_micros(F.col(time).cast("timestamp")).alias("_t"), F.col(who).alias("_w"), F.struct(*df.columns).alias("_row"))
    reach = at.filter("_t is not null and _w is not null").select(*by, "_w", (F.col("_t") - after * 1_000_000).alias("_s"), (F.col("_t") + before * 1_000_000).alias("_e")).distinct()
    bucket = lambda c: F.floor(F.col(c) / width)
    cut = reach.select(*by, "_w", "_s", "_e", F.explode(F.sequence(bucket("_s"), bucket("_e"))).alias("_b"))
    cut = cut.select(*by, "_b", "_w", F.greatest("_s", F.col("_b") * width).alias("_s"), F.least("_e", (F.col("_b") + 1) * width - 1).alias("_e"))
    w = Window.partitionBy(*by, "_b", "_w").orderBy("_s", "_e")
    new = F.when(F.col("_s") > F.max("_e").over(w.rowsBetween(Window.unboundedPreceding, -1)), 1).otherwise(0)
    runs = cut.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy(*by, "_b", "_w", "_run").agg(F.min("_s").alias("_s"), F.max("_e").alias("_e"))
    ends = F.explode(F.array(F.struct(F.col("_s").alias("_t"), F.lit(0).alias("_k"), F.lit(1).alias("_d")), F.struct(F.col("_e").alias("_t"), F.lit(2).alias("_k"), F.lit(-1).alias("_d"))))
    steps = runs.select(*by, "_b", ends.alias("x")).select(*by, "_b", "x.*", F.lit(None).cast(at.schema["_row"].dataType).alias("_row"))
    rows = at.select(*by, bucket("_t").alias("_b"), "_t", F.lit(1).alias("_k"), F.lit(0).alias("_d"), "_row")
    running = F.sum("_d").over(Window.partitionBy(*by, "_b").orderBy("_t", "_k").rowsBetween(Window.unboundedPreceding, 0))
    return steps.unionByName(rows).withColumn(out, running).filter("_k = 1").select("_row.*", F.coalesce(out, F.lit(0)).cast("long").alias(out))


def others_near(df: DataFrame, by: Sequence[str], time: str, who: str, seconds: int, out: str) -> DataFrame:
    """All rows with ``out``: how many distinct others are active within ``seconds`` on either side."""
    near = distinct_near(df, by, time, who, seconds, seconds, out)
    own = F.when(F.col(time).isNotNull() & F.col(who).isNotNull(), 1).otherwise(0)
    return near.withColumn(out, F.col(out) - own)
