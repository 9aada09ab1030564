"""Operator 12. Spelling variants by Bloom-guided neighbourhoods.

Words that differ by one inserted, deleted or replaced code point are near. Each word's edits are generated, as
hashes only, and looked up in blocked Bloom filters of the vocabulary, one for each length; the few edits that a
filter may hold are spelt out and joined with the vocabulary itself, which removes the false positives. Of two near
words one generates the other: the longer one by a deletion, the one with the smaller code point by a replacement.

The filters are broadcast, so their size is bounded (``PASS_BYTES``): lengths are dealt out over as many passes as
that takes, and a length too large for one is split by the words' hashes. In each pass only words take part that have
an edit of one of its lengths. A filter's errors cost time and never change the result.

A word's form is its near word of largest count, where that is at least ``RATIO`` times its own count; ties go to the
smallest in code-point order. Counts rise tenfold along a chain of forms, so there are at most 18 steps to its root,
and jumping from form to form's form takes five joins at most.

Null and empty texts have no words. A null doc_id counts as an empty text. Repeated rows count as often as they
stand. An empty table gives no rows. Columns besides doc_id and text are not read. Texts and words may be of any
length: texts are read whole, match by match, and edits of long words are generated in slices.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import _bloom
from tidemark.llm._common import Steps, checkpointed, documents, mix, slices

#: Least code points of a word and least occurrences of one, and how many times a form outnumbers its variant.
LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
#: Most bytes of filters that are broadcast at once.
PASS_BYTES = 64 << 20
#: Lengths up to it have a filter each, longer ones one for each power of two.
EXACT_LENGTHS = 64
#: Distinct words that a task adds up before it hands them on, and edits that it tries at once.
HELD_WORDS, HELD_EDITS = 200_000, 1 << 20

RUN = re.compile(f"[a-zÀ-ÿ]{{{LEAST_LENGTH},}}")
STEP = np.uint64(0x9E3779B97F4A7C15)
STEP_BACK = np.uint64(pow(int(STEP), -1, 1 << 64))


def word_counts(df: DataFrame, doc_id: str = "doc_id", text: str = "text", drop_one_in: int | None = None) -> DataFrame:
    """(word, n): words of at least ``LEAST_LENGTH`` code points and ``LEAST_COUNT`` occurrences.

    With ``drop_one_in``, the occurrences of a run in a document lose one code point where that number divides
    the crc32 of ``<doc_id>:<run>``, the one at that crc32 modulo the run's length.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def handed_on() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            return out

        seen: Counter[str] = Counter()
        for part in slices(batches, "t"):
            for doc, whole in zip(part.column("d").to_pylist(), part.column("t").to_pylist(), strict=True):
                if not whole:
                    continue
                started = zlib.crc32(f"{doc}:".encode())
                for run, n in Counter(m[0] for m in RUN.finditer(whole.encode().lower().decode())).items():
                    if drop_one_in and (h := zlib.crc32(run.encode(), started)) % drop_one_in == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                    if len(run) >= LEAST_LENGTH:
                        seen[run] += n
                if len(seen) >= HELD_WORDS:
                    yield handed_on()
        yield handed_on()

    rows = df.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("d"), F.col(text).alias("t"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def shard(length: int) -> int:
    return length if length <= EXACT_LENGTHS else EXACT_LENGTHS + length.bit_length() - EXACT_LENGTHS.bit_length() + 1


def shard_column(length):
    """The same as a column."""
    return F.when(length <= EXACT_LENGTHS, length).otherwise(F.length(F.bin(length)) + F.lit(EXACT_LENGTHS - EXACT_LENGTHS.bit_length() + 1)).cast("int")


#: Shards of all lengths that an array can have.
SHARDS = shard((1 << 31) - 1) + 1


def code_points(words: list[str]) -> np.ndarray:
    """A row of code points for each of some words of equal length."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1).astype(np.uint64)


def powers(length: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(length, STEP)], dtype=np.uint64)


def key_of(sums: np.ndarray, length: int) -> np.ndarray:
    """The hash of words of one length from the sums of code point times power of its place."""
    return mix(mix(sums) + np.uint64(length))


def _by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places among the words, code points) in parts of bounded size."""
    places: dict[int, list[int]] = {}
    for k, word in enumerate(words):
        places.setdefault(len(word), []).append(k)
    for length, own in places.items():
        rows = max(1, HELD_EDITS // (length * 96))
        for at in range(0, len(own), rows):
            yield length, np.array(own[at : at + rows]), code_points([words[k] for k in own[at : at + rows]])


class Units:
    """How shards are split so that each unit's filter is at most ``most_blocks``, and which pass has which unit."""

    def __init__(self, sizes: dict[int, int], most_blocks: int):
        self.split = np.ones(SHARDS, np.int64)
        for s, n in sizes.items():
            self.split[s] = -(-_bloom.blocks_for(n) // most_blocks)
        self.base = np.r_[0, np.cumsum(self.split)]
        blocks = np.zeros(self.base[-1], np.int64)
        for s, n in sizes.items():
            blocks[self.base[s] : self.base[s + 1]] = min(most_blocks, _bloom.blocks_for(-(-n // self.split[s])))
        self.passes: list[np.ndarray] = []
        room = 0
        for unit in np.flatnonzero(blocks):
            if not self.passes or blocks[unit] > room:
                self.passes.append(np.zeros_like(blocks))
                room = most_blocks
            self.passes[-1][unit] = blocks[unit]
            room -= blocks[unit]

    def of(self, keys: np.ndarray, length: int) -> np.ndarray | np.int64:
        """The unit of each hash of words of one length, one number where all have the same."""
        s = shard(length)
        return self.base[s] if self.split[s] == 1 else self.base[s] + ((keys >> np.uint64(7)) % np.uint64(self.split[s])).astype(np.int64)

    def shards(self, blocks: np.ndarray) -> list[int]:
        """Shards that have a unit in a pass."""
        return sorted(set((np.searchsorted(self.base, np.flatnonzero(blocks), side="right") - 1).tolist()))


def vocabulary_keys(words: DataFrame, units: Units) -> DataFrame:
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "word", 1 << 20):
            for length, _, cps in _by_length(part.column("word").to_pylist()):
                own = key_of((cps * powers(length)[:length]).sum(1, dtype=np.uint64), length)
                yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(units.of(own, length), len(own)), pa.int32()), pa.array(own.view(np.int64))], ["unit", "key"])

    return words.select("word").mapInArrow(keys, "unit int, key long")


def _edits(cps: np.ndarray, letters: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(length of the edits, hashes, row, place, new code point or 0 for none) of words of one length."""
    length = cps.shape[1]
    power = powers(length)
    terms = cps * power[:length]
    sums = terms.sum(1, dtype=np.uint64)
    if length > LEAST_LENGTH:
        upto = np.cumsum(terms, axis=1, dtype=np.uint64)
        without = (upto - terms) + (sums[:, None] - upto) * STEP_BACK
        row, place = np.nonzero(np.c_[np.ones(len(cps), bool), cps[:, 1:] != cps[:, :-1]])  # equal neighbours give one word
        yield length - 1, key_of(without[row, place], length - 1), row, place, np.zeros(len(row), np.uint64)
    wide = max(1, HELD_EDITS // (len(cps) * len(letters)))
    for at in range(0, length, wide):
        part = cps[:, at : at + wide]
        row, place, letter = np.nonzero(letters > part[:, :, None])
        new, own = letters[letter], part[row, place]
        place = place + at
        yield length, key_of(sums[row] + (new - own) * power[place], length), row, place, new


def _spelt(cps: np.ndarray, row: np.ndarray, place: np.ndarray, new: np.ndarray) -> list[str]:
    """Words with one code point replaced, or removed where the new one is 0."""
    if not len(row):
        return []
    out, length = cps[row].astype(np.uint32), cps.shape[1]
    if new[0]:
        out[np.arange(len(row)), place] = new
    else:
        out = out[np.arange(length) != place[:, None]].reshape(len(row), length - 1)
        length -= 1
    whole = out.tobytes().decode("utf-32-le")
    return [whole[k : k + length] for k in range(0, len(whole), length)]


def _probe(units: Units, letters: np.ndarray, filter_):
    """Edits of words that the broadcast filter may hold, spelt out."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = filter_.value
        for part in slices(batches, "word", 1 << 20):
            own, n = part.column("word").to_pylist(), part.column("n").to_numpy()
            for _, places, cps in _by_length(own):
                for length, hashes, row, place, new in _edits(cps, letters):
                    unit = units.of(hashes, length)
                    if np.ndim(unit):
                        here = np.flatnonzero(held.blocks[unit])
                        hit = here[held.places(hashes[here], unit[here])]
                    else:
                        hit = held.places(hashes, unit) if held.blocks[unit] else np.zeros(0, np.int64)
                    if len(hit):
                        source = places[row[hit]]
                        near = _spelt(cps, row[hit], place[hit], new[hit])
                        yield pa.RecordBatch.from_arrays([pa.array([own[k] for k in source], pa.string()), pa.array(n[source], pa.int64()), pa.array(near, pa.string())], ["word", "n", "near"])

    return probe


def near_words(words: DataFrame, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(word, n, near, near_n) of (word, n): every pair of near words, once. ``words`` is read several times."""
    spark = words.sparkSession
    length = F.length("word")
    sizes = {r["s"]: r["n"] for r in words.groupBy(shard_column(length).alias("s")).agg(F.count("*").alias("n")).collect()}  # a row a shard
    letters = np.array(sorted(ord(r[0]) for r in words.select(F.explode(F.array_distinct(F.split("word", "")))).distinct().collect() if r[0]), np.uint64)
    units = Units(sizes, max(1, pass_bytes * 8 // _bloom.BLOCK_BITS))
    keys = vocabulary_keys(words, units)
    found = None
    for blocks in units.passes:
        first = np.cumsum(blocks) - blocks
        filter_ = spark.sparkContext.broadcast(_bloom.build(keys, first, blocks))  # at most pass_bytes
        own = units.shards(blocks)
        part = words.filter(shard_column(length).isin(own) | shard_column(length - 1).isin(own)).select("word", "n").mapInArrow(_probe(units, letters, filter_), "word string, n long, near string")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return words.select("word", "n", F.col("word").alias("near"), F.col("n").alias("near_n")).limit(0)
    return found.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "n", "near", "near_n")


def variants(words: DataFrame, ratio: int = RATIO, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(word, n, form, root, n_near, form_n) of (word, n), which is read several times."""
    steps = Steps(words.sparkSession, "spelling")
    sides = F.explode(F.array(F.struct("word", "n", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))))
    pairs = near_words(words, pass_bytes).select(sides.alias("p")).select("p.*")
    best = F.min(F.when(F.expr(f"near_n div {ratio}") >= F.col("n"), F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))))
    near = pairs.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("b"))
    found = steps.write(
        words.join(near, "word", "left").select("word", "n", F.col("b.word").alias("form"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), (-F.col("b.n")).alias("form_n")), "found"
    )
    chain = steps.write(found.filter("form is not null").select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots-0")
    made = 0
    while not chain.filter("moved").isEmpty():
        made += 1
        ahead = chain.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        jumped = chain.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved"))
        chain = steps.write(jumped, f"roots-{made}")
    return found.join(chain.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = checkpointed(word_counts(documents(spark, sf_dir), drop_one_in=31))
    return variants(words)
