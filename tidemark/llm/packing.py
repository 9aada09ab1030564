"""Operator 3. Best-fit packing after a Martello-Toth dominance reduction.

How documents are dealt to sequences depends on piece lengths alone, and there are at most
``capacity`` of them, so the whole packing is decided on a histogram of lengths (bounded by
``capacity`` rows) and only then written out to the pieces: pieces of one length are
interchangeable, the k-th of them takes the k-th slot that the plan has for that length. A step of the
plan uses up a length or a kind of sequence and makes two new kinds at most, so the plan has a few kinds a
length, however many pieces there are, and fewer than 64 lengths a kind (their sum is ``capacity``
at most): that bounds what is broadcast.

Reduction (Martello and Toth): a set of pieces that dominates every other set which could hold its
largest piece is fixed for good. Fixed are a full piece alone, a piece that nothing fits beside, two
pieces that fill a sequence exactly, a piece with the largest that fits where no two more fit, and
the same where three more do not fit and no pair beats the single piece. What is left is packed
best-fit, longest first, whole multiplicities at a time.

Null text counts as empty and becomes one piece of one token (the separator). Equal rows are packed
one by one. Longer documents are cut into pieces of ``capacity``; only the last may be shorter. An
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm._common import checkpointed, documents, slices, words

CAPACITY = 2048
#: Words a worker remembers with their ids; when more, it starts anew.
REMEMBERED = 600_000
#: Rows of one length are numbered within groups of about so many.
GROUP_ROWS = 200_000


@cache
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


class _WordIds:
    """Ids of words, remembered.

    The tokenizer drops white space before it splits and merges nothing across it, so the ids of a
    text are those of its words in turn. A plain word (Latin letters, then perhaps some marks) is
    split as the tokenizer does, and many bare words are encoded as one text, in which every word
    ends with a token that says so. Other words are encoded one by one.
    """

    _PLAIN = r"^(?P<a>[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]+)(?P<b>[.,;:!?*$%&#|()]*)$"

    def __init__(self, path: str):
        self.path = path
        vocabulary = _tokenizer(path).get_vocab()
        self.ending = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ending[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._clear()

    def _clear(self):
        self.place: dict[str, int] = {"": 0}
        self.starts, self.known = np.zeros(1 << 16, np.int64), 1
        self.ids, self.used = np.zeros(1 << 20, np.uint32), 0

    def _keep(self, names: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.known + len(names) >= len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts[self.known + 1 : self.known + 1 + len(names)] = self.used + np.cumsum(lengths)
        self.place.update(zip(names, range(self.known, self.known + len(names)), strict=True))
        self.used, self.known = self.used + len(ids), self.known + len(names)

    def _one_by_one(self, names: list[str]) -> None:
        for at in range(0, len(names), 4096):
            each = [e.ids for e in _tokenizer(self.path).encode_batch_fast(names[at : at + 4096], add_special_tokens=False)]
            self._keep(names[at : at + 4096], np.array([i for ids in each for i in ids], np.uint32), np.array([len(ids) for ids in each]))

    def _bare(self, names: list[str]) -> None:
        for at in range(0, len(names), 4096):
            some = names[at : at + 4096]
            ids = np.array(_tokenizer(self.path).encode(" ".join(some), add_special_tokens=False).ids, np.uint32)
            ends = np.flatnonzero(self.ending[ids]) + 1
            if len(ends) == len(some):
                self._keep(some, ids, np.diff(ends, prepend=0))
            else:
                self._one_by_one(some)

    def encode(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For each word two parts: their first positions in ``ids`` and numbers of ids."""
        if self.known + 2 * len(distinct) > REMEMBERED:
            self._clear()
        parts = pc.extract_regex(distinct, self._PLAIN)
        plain = pc.is_valid(parts)
        out = np.zeros((2, len(distinct)), np.int64)
        for row, names, add in ((0, pc.if_else(plain, pc.utf8_lower(pc.struct_field(parts, "a")), ""), self._bare), (0, pc.if_else(plain, "", distinct), self._one_by_one), (1, pc.if_else(plain, pc.struct_field(parts, "b"), ""), self._one_by_one)):
            coded = names.dictionary_encode()
            kinds = coded.dictionary.to_pylist()
            if new := [w for w in kinds if w not in self.place]:
                add(new)
            out[row] += np.fromiter(map(self.place.__getitem__, kinds), np.int64, len(kinds))[coded.indices.to_numpy()]
        return self.starts[out], self.starts[out + 1] - self.starts[out]


@cache
def _word_ids(path: str) -> _WordIds:
    return _WordIds(path)


def pieces(df: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer_path: str | None = None, separator: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the token pieces of each document, whole texts encoded."""
    path = tokenizer_path or public_tokenizers.path("word_bpe_49k.json")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t", 2 << 20, (_word_ids, _tokenizer)):
            distinct, index, offsets = words(part.column("t"), lower=False)
            memory = _word_ids(path)
            first, count = (x[:, index].T.ravel() for x in memory.encode(distinct))
            ends = np.concatenate([[0], np.cumsum(count)])
            flat = memory.ids[np.repeat(first - ends[:-1], count) + np.arange(ends[-1])]
            docs = part.column("d").to_pylist()
            out: list[tuple] = []
            for row, (a, b) in enumerate(zip(ends[2 * offsets[:-1]], ends[2 * offsets[1:]], strict=True)):
                ids = np.append(flat[a:b], np.uint32(separator)).astype("<u4")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    some = ids[at : at + capacity]
                    out.append((docs[row], k, at, len(some), zlib.crc32(some.tobytes())))
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return df.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t")).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _best_pair(order: list[int], left: Counter, room: int) -> int:
    """The largest sum of two of the lengths in ``order`` that fits."""
    best = 0
    for a in order:
        if 2 * a > room:
            break
        other = order[bisect.bisect_right(order, room - a) - 1]
        if other != a or left[a] > 1:
            best = max(best, a + other)
    return best


def _reduce(left: Counter, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Takes dominating sets out of ``left`` (length: how many); returns them as (lengths, how often)."""
    fixed: list[tuple[tuple[int, ...], int]] = []

    def take(lengths: tuple[int, ...], times: int) -> None:
        fixed.append((lengths, times))
        for length, k in Counter(lengths).items():
            left[length] -= k * times
            if not left[length]:
                del left[length]

    for length in sorted(left, reverse=True):  # exact pairs dominate whatever else either could be with
        other = capacity - length
        if length == capacity:
            take((length,), left[length])
        elif other < length and left[length] and left[other]:
            take((length, other), min(left[length], left[other]))
        elif other == length and left[length] > 1:
            take((length, length), left[length] // 2)
    for length in sorted(left, reverse=True):
        while left[length]:
            left[length] -= 1  # the piece itself; what can go with it?
            order = sorted(k for k in left if left[k])
            least = [k for k in order for _ in range(min(3, left[k]))][:3]
            left[length] += 1
            room = capacity - length
            if not least or least[0] > room:
                take((length,), left[length])
                continue
            if len(least) > 2 and sum(least) <= room:
                return fixed  # three more would fit, and beside all shorter ones too
            single = order[bisect.bisect_right(order, room) - 1]
            if len(least) > 1 and least[0] + least[1] <= room and single < _best_pair(order, left, room):
                break  # not decided for this length; a shorter one may be
            take((length, single), max(1, min(left[length], left[single]) if single != length else left[length] // 2))
    return fixed


def _best_fit(left: Counter, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over multiplicities. Bins with the same contents are kept as one."""
    bins: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)  # free room: contents: how many
    rooms: list[int] = []

    def put(contents: tuple[int, ...], times: int) -> None:
        room = capacity - sum(contents)
        if not bins[room]:
            bisect.insort(rooms, room)
        bins[room][contents] = bins[room].get(contents, 0) + times

    for length in sorted(left, reverse=True):
        count = left[length]
        while count:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                each = max(1, capacity // length)  # open new ones, filled with this length
                if count >= each:
                    put((length,) * each, count // each)
                    count %= each
                else:
                    put((length,) * count, 1)
                    count = 0
                continue
            room = rooms[at]
            contents, have = next(iter(bins[room].items()))
            each = min(room // length, count)
            times = max(1, min(have, count // each))
            if have == times:
                del bins[room][contents]
                if not bins[room]:
                    del rooms[at]
            else:
                bins[room][contents] = have - times
            put(contents + (length,) * each, times)
            count -= each * times
    return [x for by in bins.values() for x in by.items()]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Sequences as (piece lengths, how many such sequences), for so many pieces of each length."""
    left = Counter({k: v for k, v in histogram.items() if v})
    return _reduce(left, capacity) + _best_fit(left, capacity)


def pack(piece_table: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to (doc_id, piece, ..., length)."""
    spark = piece_table.sparkSession
    salts = 1 + piece_table.count() // GROUP_ROWS
    salted = piece_table.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    slots, sequence, taken = defaultdict(list), 0, Counter()
    for lengths, times in plan(histogram, capacity):
        offset = 0
        for length, k in sorted(Counter(lengths).items(), reverse=True):
            # k slots for this length in each of the sequences sequence .. sequence + times - 1
            slots[length].append((taken[length], k, sequence, offset))
            taken[length] += k * times
            offset += k * length
        sequence += times
    slots = spark.sparkContext.broadcast({length: np.array(x, np.int64) for length, x in slots.items()})
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).select("length", "salt", "base")
    numbered = salted.withColumn("rn", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1)
    ranked = numbered.join(base, ["length", "salt"]).withColumn("rank", (F.col("rn") + F.col("base")).cast("long"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence_id, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for size in np.unique(length):  # slots of a length are contiguous ranges of ranks
                own = np.flatnonzero(length == size)
                first, k, sequence, at = slots.value[size][np.searchsorted(slots.value[size][:, 0], rank[own], side="right") - 1].T
                within = rank[own] - first
                sequence_id[own], offset[own] = sequence + within // k, at + size * (within % k)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence_id), pa.array(offset)], [*names, "sequence_id", "offset"])

    names = piece_table.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in piece_table.schema.fields)
    return ranked.select(*names, "rank").mapInArrow(place, f"{fields}, sequence_id long, offset long")


def best_fit_packing(df: DataFrame, capacity: int = CAPACITY, **how) -> DataFrame:
    return pack(checkpointed(pieces(df, capacity=capacity, **how)), capacity)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(documents(spark, sf_dir))
