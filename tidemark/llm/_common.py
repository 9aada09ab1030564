"""Helpers shared by the text operators.

Text is handled in Arrow batches. Each batch is cut into slices of a few MB so that a task's
memory does not depend on how Spark sized the batch.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import time
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that driver and executors share (``spark.checkpoint.dir``).

    Only where the session sets none and all runs on this machine (tests, a laptop) is a temporary folder chosen.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if configured is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        configured = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(configured)
    return configured


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within it, every action's shuffle files are removed when it ends, and not when the driver's JVM next collects garbage.

    For actions that write all they make; an executor lost meanwhile is made up for as ever.
    """
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, which survives lost executors."""
    shared_dir(df.sparkSession)
    with shuffles_removed(df.sparkSession):
        return df.select("*").checkpoint()  # planned anew, as the setting is read when a plan is made


class Steps:
    """Tables that one run writes and reads again, in a folder of its own under the shared one.

    A table that is read back brings nothing of the plan that made it: plans of a loop stay small. (What
    checkpoint() returns keeps the constraints of its plan, which grow from round to round.)
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def drop(self, *names: str) -> None:
        """Removes tables that nothing reads any more, where Arrow can reach the store."""
        for name in names:
            with contextlib.suppress(OSError, NotImplementedError, pa.ArrowInvalid):
                fs, path = pyarrow.fs.FileSystem.from_uri(f"{self.folder}/{name}")
                fs.delete_dir(path)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of what is checkpointed by now.

    It does so for what the driver's garbage collector finds unused, which in a driver with little to
    do may be never, while the files take up the executors' disks.
    """
    for _ in range(2):  # what Python lets go of in the first turn the JVM can find in the second
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)
    pa.default_memory_pool().release_unused()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: The cached functions whose values this worker keeps from task to task.
_kept: set[Callable] = set()


def _give_back() -> None:
    """What neither Arrow's pool nor the C library's heap uses any more goes back, where the latter can do so."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError, TypeError):
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, budget: int = SLICE_BYTES, keeps: tuple[Callable, ...] = ()) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of the batches with at most ``budget`` bytes of ``column`` each, or one row.

    A worker lives on after its task, and others' tasks come to it. So what is no longer used goes back before and after,
    and of what cached functions hold only the values of ``keeps`` stay.
    """
    for other in _kept.difference(keeps):
        other.cache_clear()
    _kept.clear()
    _kept.update(keeps)
    _give_back()
    try:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(sizes)
            at = 0
            while at < batch.num_rows:
                before = ends[at - 1] if at else 0
                upto = max(at + 1, int(np.searchsorted(ends, before + budget, side="right")))
                yield batch.slice(at, upto - at)
                at = upto
    finally:
        _give_back()


def row_slices(batches: Iterator[pa.RecordBatch], field: str) -> Iterator[pa.RecordBatch]:
    """The same by the bytes of a field of the struct ``_row``."""
    for batch in batches:
        own = pa.RecordBatch.from_arrays([*batch.columns, pc.struct_field(batch.column("_row"), field)], [*batch.schema.names, "_bytes_of"])
        for part in slices(iter([own]), "_bytes_of"):
            yield part.drop_columns(["_bytes_of"])


def words(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words (runs of anything but space and \\x09-\\x0D) of each text, with A-Z in lower case if asked for.

    Returns the distinct words, each word's index among them, and the texts' offsets into those
    indices. A null text has no words.
    """
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    coded = lists.flatten().dictionary_encode()
    index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    distinct = coded.dictionary
    empty = pc.index(distinct, pa.scalar("", distinct.type)).as_py()
    if empty >= 0:
        real = index != empty
        offsets = np.concatenate([[0], np.cumsum(real)])[offsets]
        index = index[real]
    return distinct, index, offsets


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def chain(hashes: list[np.ndarray], seed: int = 0) -> np.ndarray:
    """Order-dependent hash of parallel columns of hashes."""
    out = np.full(len(hashes[0]), (0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    for h in hashes:
        out = mix(out * np.uint64(0xBF58476D1CE4E5B9) + h)
    return out


def word_hashes(distinct: pa.Array, seed: int = 0) -> np.ndarray:
    """64-bit hash of each string's bytes, eight at a time over all strings that are long enough."""
    offsets = np.frombuffer(distinct.buffers()[1], np.int32)[distinct.offset : distinct.offset + len(distinct) + 1].astype(np.int64)
    data = np.concatenate([np.frombuffer(distinct.buffers()[2] or b"", np.uint8)[: offsets[-1]], np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) - 7, np.dtype("<u8"), data, strides=(1,))
    left = np.diff(offsets)
    out, at, live = mix(left.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (2 * seed + 1)) & 0xFFFFFFFFFFFFFFFF)), offsets[:-1].copy(), np.flatnonzero(left > 0)
    while len(live):
        rest = left[live]
        keep = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(8) * (np.uint64(8) - np.minimum(rest, 8).astype(np.uint64)))
        out[live] = mix(mix(out[live] ^ (eight[at[live]] & keep)) + np.uint64(0xC2B2AE3D27D4EB4F))
        left[live] -= 8
        at[live] += 8
        live = live[left[live] > 0]
    return out


def owners(offsets: np.ndarray) -> np.ndarray:
    """For each element of a ragged array, the number of its row."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def fold_of(ids: np.ndarray, modulus: int) -> np.ndarray:
    """crc32 of the decimal text of each id, modulo ``modulus``."""
    return np.array([zlib.crc32(str(i).encode()) % modulus for i in ids.tolist()], dtype=np.int64)


def fold_column(id_column: str, modulus: int):
    """The same as a column."""
    return F.pmod(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(modulus))
