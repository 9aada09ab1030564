"""Operator 10. Language-model scoring by deleted interpolation.

P(v | u) = w(b) c(u v) / c(u) + (1 - w(b)) (c(v) + 1) / (N + V + 1), where b is the bucket (by powers
of two) of how often the context u was seen. The weights w are learned by expectation-maximisation
on deleted counts: every training token is predicted from the counts without itself. What EM needs
of a token is its bucket and the ratio of the two estimates, so a histogram of the two, of a fixed
number of cells, is gathered from the whole corpus and iterated on.

Documents are tokenised once, into chunks stored as a bucketed table. A chunk sends each of its distinct
words, and later bigrams, once, as packed arrays by hash; parts add up the counts and send them
back in the order received. The returns are joined to the chunks by id, without moving those again.
What a part gathers is bounded by the number of parts, which follows the input; a frequent word is
one entry a chunk.

Text null or empty: the end token alone, after the start. Rows with a null doc_id are scored, not
learned from, and have a null held_out. Repeated rows are learned from and scored each. With nothing
to learn from, every token has probability 1 in V + 1 = 1. An empty table gives no rows. Other columns are
ignored. Texts are used whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._common import Steps, chain, checkpointed, documents, fold_of, mix, shuffle_partitions, slices, word_hashes, words

CHUNK_BYTES = 12 << 20
#: Entries for each part.
PART_ENTRIES = 2_000_000
END, START = np.uint64(0x8BADF00D5EEDC0DE), np.uint64(0x0DDBA11CAFEB0BA1)
#: Histogram: context buckets, and quarter-octaves of the ratio of the estimates (the first cell: ratio 0).
BUCKETS, CELLS = 64, 512
ROUNDS = 60
DOCS = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def pack(counts: np.ndarray) -> bytes:
    """Counts, one byte each where they are below 255."""
    small = np.minimum(counts, 255).astype(np.uint8)
    return small.tobytes() + counts[small == 255].astype("<u8").tobytes()


def unpack(data: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(data, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(data, "<u8", offset=n).astype(np.int64)
    return out


def _chunks(batches: Iterator[pa.RecordBatch], modulus: int, held: int) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "t", CHUNK_BYTES):
        distinct, index, offsets = words(part.column("t"))
        ids = part.column("d")
        fold = fold_of(ids, modulus)
        fold[ids.is_null().to_numpy(zero_copy_only=False)] = -1
        row = (uuid.uuid4().int >> 65, ids.to_pylist(), np.where(fold < 0, 2, fold == held).astype(np.uint8).tobytes(), np.diff(offsets).astype(np.int32).tobytes(), word_hashes(distinct).tobytes(), index.astype(np.int32).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, (pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 4), strict=True)], ["chunk", "ids", "held", "lengths", "hashes", "tokens"])


class _Chunk:
    """A chunk's token pairs: u before v, with the local numbers len(hashes) for the end and one more for the start."""

    def __init__(self, row: dict):
        self.id, self.ids = row["chunk"], row["ids"]
        self.held = np.frombuffer(row["held"], np.uint8)
        lengths = np.frombuffer(row["lengths"], np.int32).astype(np.int64)
        self.hashes = np.concatenate([np.frombuffer(row["hashes"], np.uint64), [END, START]]).astype(np.uint64)
        tokens = np.frombuffer(row["tokens"], np.int32)
        self.n = lengths + 1
        last = np.cumsum(self.n) - 1
        self.v = np.full(len(tokens) + len(lengths), len(self.hashes) - 2, np.int64)
        word = np.ones(len(self.v), bool)
        word[last] = False
        self.v[word] = tokens
        self.u = np.empty_like(self.v)
        self.u[1:] = self.v[:-1]
        self.u[last - self.n + 1] = len(self.hashes) - 1
        self.doc = np.repeat(np.arange(len(lengths)), self.n)
        self.learned = self.held[self.doc] == 0

    def word_entries(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys and training counts of the words and the end token."""
        return self.hashes[:-1], np.bincount(self.v[self.learned], minlength=len(self.hashes) - 1)

    def bigrams(self) -> None:
        pair = self.u * len(self.hashes) + self.v
        types, self.type = np.unique(pair, return_inverse=True)
        self.tu, self.tv = types // len(self.hashes), types % len(self.hashes)
        self.count = np.bincount(self.type[self.learned], minlength=len(types))

    def bigram_entries(self) -> tuple[np.ndarray, np.ndarray]:
        self.bigrams()
        return chain([self.hashes[self.tu], self.hashes[self.tv]], seed=2), self.count


def _order(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    part = (mix(keys ^ np.uint64(0xA5A5A5A5)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def _send(chunk: int, keys: np.ndarray, counts: np.ndarray, parts: int) -> pa.RecordBatch:
    order, cuts = _order(keys, parts)
    keys, counts = keys[order], counts[order]
    rows = [(p, chunk, keys[a:b].tobytes(), pack(counts[a:b])) for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["part", "chunk", "keys", "counts"])


def _received(returned: list[dict], keys: np.ndarray, parts: int) -> np.ndarray:
    """The totals that came back, in the order of ``keys``."""
    order, cuts = _order(keys, parts)
    out = np.zeros(len(keys), np.int64)
    for r in returned:
        a, b = cuts[r["part"]], cuts[r["part"] + 1]
        out[order[a:b]] = unpack(r["totals"], b - a)
    return out


def _totals(table: pa.Table) -> pa.Table:
    """Adds up counts by key and gives each sender the totals of its keys; in a row of its own how many keys, and their sum."""
    keys = [np.frombuffer(k, np.uint64) for k in table["keys"].to_pylist()]
    counts = np.concatenate([unpack(c, len(k)) for c, k in zip(table["counts"].to_pylist(), keys, strict=True)])
    sizes = [len(k) for k in keys]
    _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(inverse, weights=counts).astype(np.int64)
    each = np.split(total[inverse], np.cumsum(sizes)[:-1])
    n, part = len(sizes), table["part"][0].as_py()
    return pa.table({
        "chunk": pa.array([*table["chunk"].to_pylist(), None], pa.int64()), "part": pa.array([part] * (n + 1), pa.int32()),
        "totals": pa.array([*map(pack, each), None], pa.binary()),
        "kinds": pa.array([None] * n + [int((total > 0).sum())], pa.int64()), "sum": pa.array([None] * n + [int(total.sum())], pa.int64()),
    })


RETURN = "chunk long, part int, totals binary, kinds long, sum long"


def _by_chunk(returned: DataFrame, name: str) -> DataFrame:
    return returned.filter("chunk is not null").groupBy("chunk").agg(F.collect_list(F.struct("part", "totals")).alias(name))


def bucket(context: np.ndarray) -> np.ndarray:
    """Bucket of a context's count: 0 for none, then one for each power of two."""
    return np.frexp(context.astype(np.float64))[1]


def learn_weights(histogram: np.ndarray) -> np.ndarray:
    """Weights by EM; histogram[b, cell]: deleted training tokens."""
    ratio = np.concatenate([[0.0], np.exp2((np.arange(1, CELLS) - 1 - CELLS // 4) / 4)])
    n = histogram.sum(1)
    w = np.where(n > 0, 0.5, 0.0)
    for _ in range(ROUNDS):
        share = w[:, None] * ratio / np.maximum(w[:, None] * ratio + 1 - w[:, None], 1e-300)
        w = (histogram * share).sum(1) / np.maximum(n, 1)
    w = np.minimum(w, 0.999)
    w[0] = 0
    return w


def _cells(c: _Chunk, word: np.ndarray, both: np.ndarray, n: int, v: int) -> np.ndarray:
    """The chunk's share of the histogram."""
    use = c.count > 0
    cu, cv, cuv, times = (word[c.tu] - 1)[use], (word[c.tv] - 1)[use], (both - 1)[use], c.count[use]
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = (cuv / cu) * ((n + v) / (cv + 1))
        cell = np.clip(np.floor(np.log2(ratio) * 4 + 0.5) + 1 + CELLS // 4, 1, CELLS - 1)
    cell = np.where((cuv > 0) & (cu > 0), cell, 0).astype(np.int64)
    return np.bincount(bucket(cu) * CELLS + cell, weights=times, minlength=BUCKETS * CELLS)


def lm_scores(df: DataFrame, doc_id: str = "doc_id", text: str = "text", modulus: int = 7, held: int = 2) -> DataFrame:
    """DOCS and train_tokens for every row; rows whose crc32(doc_id) mod ``modulus`` is ``held`` are not learned from."""
    spark = df.sparkSession
    name = f"lm_chunks_{uuid.uuid4().hex}"
    rows = df.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t")).mapInArrow(lambda b: _chunks(b, modulus, held), "chunk long, ids array<long>, held binary, lengths binary, hashes binary, tokens binary")
    buckets = max(shuffle_partitions(spark), 1)
    rows.write.option("compression", "zstd").bucketBy(buckets, "chunk").saveAsTable(name)
    table = spark.table(name)
    size = table.agg(F.sum(F.octet_length("hashes") / 8 + F.size("ids")).alias("words"), F.sum(F.octet_length("tokens") / 4 + F.size("ids")).alias("tokens")).first()
    parts = [int(max(64, (size[k] or 0) // PART_ENTRIES)) for k in ("words", "tokens")]

    def send_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield _send(row["chunk"], *_Chunk(row).word_entries(), parts[0])

    sent = "part int, chunk long, keys binary, counts binary"
    word_totals = checkpointed(table.mapInArrow(send_words, sent).groupBy("part").applyInArrow(_totals, RETURN))
    known = word_totals.filter("chunk is null").agg(F.sum("kinds").alias("v"), F.sum("sum").alias("n")).first()
    v, n = int(known["v"] or 0), int(known["n"] or 0)
    with_words = table.join(_by_chunk(word_totals, "w"), "chunk")

    def opened(row: dict) -> tuple[_Chunk, np.ndarray]:
        c = _Chunk(row)
        word = _received(row["w"], c.hashes[:-1], parts[0])
        return c, np.append(word, word[-1])  # a start for every end

    def send_bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield _send(row["chunk"], *_Chunk(row).bigram_entries(), parts[1])

    bigram_totals = checkpointed(table.mapInArrow(send_bigrams, sent).groupBy("part").applyInArrow(_totals, RETURN))
    complete = with_words.join(_by_chunk(bigram_totals, "b"), "chunk")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS * CELLS)
        for batch in batches:
            for row in batch.to_pylist():
                c, word = opened(row)
                keys, _ = c.bigram_entries()
                total += _cells(c, word, _received(row["b"], keys, parts[1]), n, v)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(at, pa.int32()), "n": pa.array(total[at])})

    histogram = np.zeros(BUCKETS * CELLS)
    for r in complete.mapInArrow(tally, "cell int, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # a fixed number of cells
        histogram[r["cell"]] = r["n"]
    weights = learn_weights(histogram.reshape(BUCKETS, CELLS))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                c, word = opened(row)
                keys, _ = c.bigram_entries()
                both = _received(row["b"], keys, parts[1])
                base = (word[c.tv] + 1) / (n + v + 1)
                w = weights[bucket(word[c.tu])]
                p = w * both / np.maximum(word[c.tu], 1) + (1 - w) * base
                size = len(c.ids)
                add = lambda x: np.bincount(c.doc, weights=x[c.type], minlength=size)  # noqa: B023, E731
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(c.ids, pa.int64()), "held_out": pa.array(c.held == 1, mask=c.held == 2), "n_tokens": pa.array(c.n),
                    "n_known": pa.array(add(word[c.tv] > 0).astype(np.int64)), "base_score": pa.array(add(np.log10(base))), "score": pa.array(add(np.log10(p))),
                })

    scores = complete.mapInArrow(score, DOCS).withColumn("train_tokens", F.lit(n).cast("long"))
    scores = Steps(spark, "lm-scores").write(scores, "scores")
    spark.sql(f"drop table {name}")
    return scores


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(documents(spark, sf_dir))
