"""Keyed tables that are written, part by part, and read again by any session."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Callable, Mapping, Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import relational as rel


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, in ``spark.checkpoint.dir``."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return f"{shared}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The table written once and read from there, so that later uses do not run its plan again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Store:
    """One keyed table under ``folder``: Parquet partitioned by ``_part``, which follows from the key.

    With ``time`` (one of the keys), a part is a day, month or year of it; without, one of ``buckets`` hash buckets of
    the key. A write reads and overwrites only the parts that its rows touch (Spark's dynamic partition overwrite), so
    files of other parts stay as they are. Writing the same rows again gives the same table. There is one writer at
    a time; a write that dies while Spark moves finished parts into place must be run again, which completes it.

    Columns may be added by later writes; ``spec`` next to the data has the keys and every schema so far, so another
    session can open the table.
    """

    FORMATS = {"day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}

    def __init__(self, spark: SparkSession, folder: str, spec: dict):
        self.spark, self.folder, self.spec = spark, folder, spec
        self.keys, self.order, self.schema = spec["keys"], spec["order"], T.StructType.fromJson(spec["schema"])

    @classmethod
    def create(cls, first: DataFrame, folder: str, keys: Sequence[str], order: Sequence[str] | None = None, time: str | None = None, period: str = "month", buckets: int = 16) -> Store:
        if time is not None and time not in keys:
            raise ValueError("the time that decides over a row's part must be one of the keys")
        spec = {"keys": list(keys), "order": list(order or ()), "time": time, "period": period, "buckets": buckets, "schema": json.loads(first.schema.json())}
        store = cls(first.sparkSession, folder, spec)
        store._note()
        store._overwrite(first)
        return store

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> Store:
        specs = [json.loads(r[0]) for r in spark.read.text(f"{folder}/spec").collect()]  # a row a change of schema
        return cls(spark, folder, max(specs, key=lambda s: len(s["schema"]["fields"])))

    def on(self, spark: SparkSession) -> Store:
        """The same table for another session."""
        return Store(spark, self.folder, self.spec)

    def _note(self) -> None:
        self.spark.createDataFrame([(json.dumps(self.spec),)], "spec string").coalesce(1).write.mode("append").text(f"{self.folder}/spec")

    def part(self, time: Column | None = None) -> Column:
        if self.spec["time"] is None:
            return F.format_string("%05d", F.pmod(F.xxhash64(*self.keys), F.lit(self.spec["buckets"])))
        time = F.col(self.spec["time"]) if time is None else time
        return F.coalesce(F.date_format(time.cast("timestamp"), self.FORMATS[self.spec["period"]]), F.lit("none"))

    def _all(self) -> DataFrame:
        """The table with ``_part``, by which a filter leaves out whole folders."""
        return self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("_part", T.StringType())])).parquet(f"{self.folder}/data")

    def read(self) -> DataFrame:
        return self._all().drop("_part")

    def parts(self) -> list[str]:
        """Names of the parts, from the list of files that Spark has anyway."""
        return sorted({unquote(m[1]) for m in (re.search(r"/_part=([^/]*)/", f) for f in self._all().inputFiles()) if m})

    def touched(self, new: DataFrame) -> DataFrame:
        """The rows of all parts that ``new`` has a key in."""
        parts = [r[0] for r in new.select(self.part().alias("p")).distinct().collect()]  # a row a part
        return self._all().filter(F.col("_part").isin(parts)).drop("_part")

    def _overwrite(self, rows: DataFrame) -> None:
        added = [f for f in rows.schema.fields if f.name not in self.schema.names]
        if added:
            self.schema = T.StructType([*self.schema.fields, *added])
            self.spec = self.spec | {"schema": json.loads(self.schema.json())}
            self._note()
        placed = rows.select(*[F.col(f"`{f.name}`").cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields], self.part().alias("_part"))
        spread = placed.hint("rebalance", "_part")  # few files a part, large parts over several tasks
        spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_part").parquet(f"{self.folder}/data")

    def counts(self, new: DataFrame) -> DataFrame:
        """(updated, inserted): how many keys of ``new`` are there already, and how many are not."""
        fresh = new.select(*self.keys).distinct()
        known = self.touched(fresh).select(*self.keys).distinct().withColumn("_known", F.lit(True))
        joined = fresh.join(known, self.keys, "left")
        return joined.agg(F.count("_known").alias("updated"), F.count_if(F.col("_known").isNull()).alias("inserted"))

    def upsert(self, new: DataFrame) -> None:
        self._overwrite(rel.upsert(self.touched(new), new, self.keys, self.order))

    def insert_ignore(self, new: DataFrame) -> None:
        self._overwrite(rel.insert_ignore(self.touched(new), new, self.keys))

    def update(self, new: DataFrame, columns: Sequence[str]) -> None:
        self._overwrite(rel.update_columns(self.touched(new), new, self.keys, columns))

    def since(self, time: str, lookback_days: int):
        """The latest time of the table less the lookback, None where it is empty; reads the last part only."""
        last = [p for p in self.parts() if p != "none"][-1:] if self.spec["time"] == time else None
        rows = self._all() if last is None else self._all().filter(F.col("_part").isin(last))
        return rows.agg((F.max(time).cast("timestamp") - F.expr(f"interval {lookback_days} days")).alias("since")).first()["since"]

    def merge_since(self, source: DataFrame, time: str, lookback_days: int = 7) -> None:
        """Upsert of the source's rows from the latest time less the lookback on; parts before that are not read."""
        since = self.since(time, lookback_days)
        if since is None:
            return self.upsert(source)
        start = F.lit(since).cast("timestamp")
        new = source.filter(F.col(time).cast("timestamp") >= start)
        if self.spec["time"] != time:
            return self.upsert(new)
        old = self._all().filter((F.col("_part") >= self.part(start)) & (F.col("_part") != "none")).drop("_part")
        self._overwrite(rel.upsert(old, new, self.keys, self.order))

    def merge_batch(self, new: DataFrame, stream: str, batch: int, combine: Mapping[str, Callable[[Column, Column], Column]] | None = None) -> None:
        """Merges a micro-batch, and does nothing for keys that have it already.

        Each row keeps the stream and the number of the last batch that it took in, written with the data itself, so
        a batch that is run again after a failure adds nothing twice, wherever it broke off. ``combine`` says for a
        column how the old and the new value make one; others take the new value.
        """
        combine, own = combine or {}, [c for c in new.columns if c not in self.keys]
        fresh = rel.one_each(new, self.keys, self.order).select(*self.keys, *[F.col(c).alias(f"_n_{c}") for c in own], F.lit(True).alias("_new"))
        old = self.touched(new)
        for name, kind in (("_stream", "string"), ("_batch", "long")):
            old = old if name in old.columns else old.withColumn(name, F.lit(None).cast(kind))
        old = old.withColumn("_old", F.lit(True))
        done = F.coalesce((F.col("_stream") == stream) & (F.col("_batch") >= batch), F.lit(False))
        keep = F.col("_new").isNull() | done
        value = lambda c: combine[c](F.col(c), F.col(f"_n_{c}")) if c in combine else F.col(f"_n_{c}")
        joined = old.join(fresh, self.keys, "full")
        columns = [c for c in old.columns if c not in (*self.keys, "_old", "_stream", "_batch")]
        out = [F.when(keep, F.col(c)).when(F.col("_old").isNull(), F.col(f"_n_{c}")).otherwise(value(c)).alias(c) if c in own else F.col(c) for c in columns]
        out += [F.col(f"_n_{c}").alias(c) for c in own if c not in columns]
        marks = [F.when(keep, F.col(c)).otherwise(F.lit(v)).alias(c) for c, v in (("_stream", stream), ("_batch", batch))]
        self._overwrite(joined.select(*self.keys, *out, *marks))

    def snapshot(self, current: DataFrame, checks: Sequence[str], now: Column) -> None:
        """A slowly changing history, of one key column; every open row is compared."""
        self._overwrite(rel.scd2(self.read(), current, self.keys[0], checks, now))


def finite(df: DataFrame) -> DataFrame:
    """NaN and infinite doubles become null, as JSON has neither."""
    bad = lambda c: F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    return df.select(*[F.when(~bad(c), F.col(c)).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes])
