"""Operator 7. Line deduplication by content-defined chunks.

A document's lines are hashed, and a rolling hash over ``ROLLING`` line hashes ends a chunk where it
falls into one of every ``MEAN_LINES`` values, so the same passage is cut alike wherever it stands. Runs of
equal lines, whose rolling hash does not change, may have no such place; they are cut every ``MAX_LINES`` lines.
Chunks of several lines that occur more than once anywhere are compared byte for byte, by grouping
on the bytes themselves; all but the first (least doc_id, then place) are removed. Single lines and
chunks of white space stay; only a lone last line goes where it and the chunk before it occurred together.

Null text stays null. Empty texts stay. Rows equal in doc_id and text count as one document, and
each of them gets its result; rows with a null doc_id come before all others. Other columns are
kept as they are, but for those named in ``ADDED``. An empty table gives no rows. No line or text is too long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._common import checkpointed, documents, mix, row_slices, slices

ROLLING = 2
MEAN_LINES = 3
MAX_LINES = 64
KEY = "_rid long, _th long"
#: Columns that the operator adds; an input's own of the same name give way to them.
ADDED = ("_clean", "_lines", "_removed")


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A key for every row: the doc_id, and where it is null a negative number below all others, from the text's hash."""
    return F.coalesce(F.col(doc_id).cast("long"), F.shiftright(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), 2) - F.lit(3 << 61))


def keyed(df: DataFrame, doc_id: str = "doc_id", text: str = "text", added: tuple[str, ...] = ADDED) -> DataFrame:
    """(_rid, _th, _row): the first two stand for a document, _row has the row's own columns."""
    own = F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in added]).alias("_row")
    return df.select(row_key(doc_id, text).alias("_rid"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_th"), own)


def chunks(text: str) -> list[tuple[int, int]]:
    """(first line, line after the last) of each chunk."""
    lines = text.split("\n")
    h = np.array([xxhash.xxh3_64_intdigest(x) for x in lines], np.uint64)
    rolling = mix(h)
    for k in range(1, ROLLING):
        rolling[k:] = mix(rolling[k:] + h[:-k] * np.uint64(2 * k + 1))
    cut = (np.flatnonzero(rolling % np.uint64(MEAN_LINES) == 0) + 1).tolist()
    out, at = [], 0
    for end in [*cut, len(lines)]:
        if end - at < 2 and end < len(lines):
            continue  # a chunk has several lines
        while end - at > MAX_LINES:
            out.append((at, at + MAX_LINES))
            at += MAX_LINES
        if end > at:
            out.append((at, end))
        at = end
    return out


def compared(cut: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(chunk, first line, line after the last) of what decides over each chunk: its own lines, for a lone
    last line those with the chunk before it."""
    own = [(k, a, b) for k, (a, b) in enumerate(cut) if b - a > 1]
    return own + [(len(cut) - 1, cut[-2][0], cut[-1][1])] if len(cut) > 1 and cut[-1][1] - cut[-1][0] == 1 else own


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "_t"):
        rid, th, k, h = [], [], [], []
        for r, t, text in zip(part.column("_rid").to_pylist(), part.column("_th").to_pylist(), part.column("_t").to_pylist(), strict=True):
            if not text or "\n" not in text:
                continue
            lines = text.split("\n")
            for i, a, b in compared(chunks(text)):
                if (body := "\n".join(lines[a:b])).strip():
                    rid.append(r), th.append(t), k.append(i), h.append(xxhash.xxh3_64_intdigest(body) - (1 << 63))
        yield pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(th, pa.int64()), pa.array(k, pa.int32()), pa.array(h, pa.int64())], ["_rid", "_th", "k", "h"])


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "_t"):
        out = []
        for r, t, text, want in zip(*(part.column(c).to_pylist() for c in ("_rid", "_th", "_t", "ks")), strict=True):
            lines, want = text.split("\n"), set(want)
            out += [(r, t, k, "\n".join(lines[a:b])) for k, a, b in compared(chunks(text)) if k in want]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.string()), strict=True)], ["_rid", "_th", "k", "body"])


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """(_rid, _th, ks): the chunks to remove from each document, of (_rid, _th, _t)."""
    occurrences = checkpointed(docs.mapInArrow(_occurrences, KEY + ", k int, h long"))  # small: 28 bytes a chunk
    repeated = checkpointed(occurrences.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"))
    wanted = occurrences.join(repeated, "h").groupBy("_rid", "_th").agg(F.collect_set("k").alias("ks"))
    bodies = docs.join(wanted, ["_rid", "_th"]).mapInArrow(_bodies, KEY + ", k int, body string")
    bodies = checkpointed(bodies.withColumn("sha", F.unhex(F.sha2("body", 256))))
    # grouping by the bytes compares them; should two kinds of bytes share a digest, neither is touched
    kinds = bodies.groupBy("body").agg(F.min(F.struct("_rid", "_th", "k")).alias("first"), F.first("sha").alias("sha"), F.count("*").alias("n"))
    first = checkpointed(kinds.groupBy("sha").agg(F.first("first").alias("first"), F.count("*").alias("kinds"), F.max("n").alias("n")).filter("kinds = 1 and n > 1").select("sha", "first"))
    later = bodies.select("_rid", "_th", "k", "sha").join(first, "sha").filter(F.struct("_rid", "_th", "k") != F.col("first"))
    return later.groupBy("_rid", "_th").agg(F.collect_set("k").alias("ks"))


def remove_repeated_chunks(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``df``, and _clean (the text without repeated chunks), _lines, _removed (numbers of lines)."""

    def without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in row_slices(batches, text):
            texts, n, gone = [], [], []
            for whole, drop in zip(pc.struct_field(part.column("_row"), text).to_pylist(), part.column("ks").to_pylist(), strict=True):
                n.append(whole.count("\n") + 1 if whole is not None else 0)
                if drop:
                    all_lines, cut, drop = whole.split("\n"), chunks(whole), set(drop)
                    left = [x for k, (a, b) in enumerate(cut) if k not in drop for x in all_lines[a:b]]
                    gone.append(n[-1] - len(left))
                    whole = "\n".join(left)
                else:
                    gone.append(0)
                texts.append(whole)
            yield pa.RecordBatch.from_arrays([part.column("_row"), pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64())], ["_row", *ADDED])

    docs = keyed(df, doc_id, text)
    drop = repeated_chunks(docs.select("_rid", "_th", F.col("_row").getField(text).alias("_t")))
    joined = docs.join(drop, ["_rid", "_th"], "left").select("_row", "ks")
    return joined.mapInArrow(without, f"_row {docs.schema['_row'].dataType.simpleString()}, _clean string, _lines long, _removed long").select("_row.*", *ADDED)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = documents(spark, sf_dir).select("doc_id", "text")
    return remove_repeated_chunks(df).select("doc_id", F.col("_lines").alias("n_lines"), F.col("_removed").alias("n_removed"), F.col("_clean").alias("text"))
