"""Operator 9. Benchmark decontamination by latent semantic retrieval.

Inverse document frequencies are counted over every passage of every document, by hash of the word.
A randomised SVD is taken of the TF-IDF passages over the benchmark's vocabulary: the benchmark's own, and
those of all documents. The range of A' (rows of A are unit passages) is found by power iteration from a random start, Q; B = A Q has
a row a passage, so it is decomposed through B'B = Q'(A'A)Q, a small matrix whose products Spark sums over all passages (word by word,
or, for a vocabulary of more than ``GRAM`` words, as distributed products A'(A x)). Its eigenvectors turn Q into the right singular vectors,
of which the first max(``LEAST_RANK``, items / ``PER_RANK``) are kept: words that go together in the corpus share directions.
The space has the benchmark's words alone, so a synonym brings a paraphrase nearer only where some item of the block has it.
A document's words are read in overlapping windows ``STEP`` words apart (half as far where an item is shorter than
``SHORT``); their lengths double, and an item is sought in those of about its own length. Windows and items are both laid into the
space and normalised there. Pairs with a cosine of ``COSINE`` or more are candidates, but for windows that have less than ``INSIDE``
of the item's own part of their length in the space: those hold next to nothing of the benchmark's words. Each candidate is then checked on
the words around the window: the longest common subsequence must cover ``EXACT`` of the
item, or ``LOOSE`` of it where the item's answer is found too, which is what remains of a
paraphrase. The answer is a column of the benchmark, or else its last sentence.

A block of the benchmark is broadcast, its size so bounded; there is a pass for each block.

Null or empty texts and items match nothing, nor do items without letters or digits. Rows with a null
doc_id are given with a null doc_id. Repeated rows and repeated items give their pairs once each.
Of several windows of a document that hold an item, the largest figures are given. A vocabulary without words, or without any weight,
spans no space and nothing is found. Empty tables give no rows. Other columns are ignored. Texts are searched whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._common import documents, slices, word_hashes, words

#: Document frequencies are counted for so many hash values of words.
COUNT_BITS = 18
ITEM_BLOCK = 512
#: Directions kept: one for so many items, but so many at least; directions sought beyond those; rounds of power iteration.
PER_RANK, LEAST_RANK, SPARE, POWER = 4, 16, 16, 2
STEP, SHORT = 8, 14
PASSAGE = 32
COSINE, INSIDE = 0.5, 0.2
#: Products of passages are summed word by word up to so many words of the vocabulary.
GRAM = 4096
EXACT, LOOSE = 0.6, 0.45


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts' words without marks around them: distinct hashes, indices into them, the texts' offsets."""
    distinct, index, offsets = words(texts)
    bare = pc.replace_substring_regex(distinct, r"^[^\pL\pN]+|[^\pL\pN]+$", "")
    real = pc.not_equal(bare, "").to_numpy(zero_copy_only=False).astype(bool)
    keep = real[index]
    return word_hashes(bare), index[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


def _cell(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - COUNT_BITS)).astype(np.int64)


def _passages(offsets: np.ndarray, size: int) -> np.ndarray:
    """Starts of consecutive passages of ``size`` words, none across texts."""
    n = np.diff(offsets)
    count = -(-n // size)
    first = np.repeat(offsets[:-1], count)
    return first + size * (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))


def _blocks(values: np.ndarray) -> pa.RecordBatch:
    parts = np.array_split(values.ravel(), 64)
    return pa.RecordBatch.from_pydict({"b": pa.array(range(64), pa.int32()), "z": pa.array([x.tobytes() for x in parts], pa.binary())})


def _sum_blocks(partial: DataFrame, kind: type) -> np.ndarray:
    """The sum of the arrays that tasks gave as _blocks."""

    def add(table: pa.Table) -> pa.Table:
        arrays = table["z"].to_pylist()
        wide = np.float64 if "g" not in table.schema.names else kind
        total = np.sum([np.frombuffer(z, wide) for z in arrays], axis=0, dtype=np.float64)
        return pa.table({"b": table["b"].slice(0, 1), "z": pa.array([total.tobytes()], pa.binary())})

    some = partial.withColumn("g", F.spark_partition_id() % F.lit(math.isqrt(partial.rdd.getNumPartitions()) + 1))
    some = some.groupBy("b", "g").applyInArrow(add, "b int, z binary")  # in two steps: few arrays meet in a task at either
    rows = some.groupBy("b").applyInArrow(add, "b int, z binary").collect()  # 65 rows, of an array of fixed size
    return np.concatenate([np.frombuffer(r["z"], np.float64) for r in sorted(rows, key=lambda r: r["b"])]) if rows else np.zeros(0)


def _weights(docs: DataFrame) -> np.ndarray:
    """Inverse document frequency of each hash value, over all passages."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(1 << COUNT_BITS, np.int64), 0
        for part in slices(batches, "t"):
            h, index, offsets = _words(part.column("t"))
            starts = _passages(offsets, PASSAGE)
            passage = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(index))))
            pair = passage * len(h) + index
            pair.sort()
            new = np.flatnonzero(np.diff(pair, prepend=-1))
            df += np.bincount(_cell(h)[pair[new] % max(1, len(h))], minlength=len(df))
            n += len(starts)
        yield _blocks(df.astype(np.float32))
        yield pa.RecordBatch.from_pydict({"b": pa.array([64], pa.int32()), "z": pa.array([np.float32(n).tobytes()], pa.binary())})

    df = _sum_blocks(docs.select("t").mapInArrow(count, "b int, z binary"), np.float32)
    return np.log((df[-1] + 1) / (df[:-1] + 1)).astype(np.float32) if len(df) else np.zeros(1 << COUNT_BITS, np.float32)


def _gather(h: np.ndarray, index: np.ndarray, vocabulary: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word: its weight, and its place in the vocabulary or -1."""
    at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
    return idf[_cell(h)][index], np.where(vocabulary[at] == h, at, -1)[index]


def _gram(docs: DataFrame, vocabulary: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, float]:
    """Sum of the products of words over the unit passages of all documents, and the number of passages."""
    m = len(vocabulary)

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, count = np.zeros(m * (m + 1) // 2, np.float32), 0  # a triangle
        for part in slices(batches, "t", 1 << 20):
            h, index, offsets = _words(part.column("t"))
            starts = _passages(offsets, PASSAGE)
            if not len(starts):
                continue
            weight, at = _gather(h, index, vocabulary, idf)
            passage = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(index))))
            size = np.sqrt(np.maximum(np.add.reduceat(weight**2, starts), 1e-9))
            inside = np.flatnonzero(at >= 0)
            at, passage = at[inside], passage[inside]
            weight = weight[inside] / size[passage]
            for lag in range(PASSAGE):
                one = np.flatnonzero(passage[: len(at) - lag] == passage[lag:]) if lag < len(at) else ()
                if not len(one):
                    break
                a, b = np.minimum(at[one], at[one + lag]), np.maximum(at[one], at[one + lag])
                w = weight[one] * weight[one + lag]
                np.add.at(z, a * (2 * m - a - 1) // 2 + b, np.where(a == b, w * np.float32(2), w) if lag else w)
            count += len(starts)
        yield _blocks(z)
        yield pa.RecordBatch.from_pydict({"b": pa.array([64], pa.int32()), "z": pa.array([np.float32(count).tobytes()], pa.binary())})

    sums = _sum_blocks(docs.select("t").mapInArrow(product, "b int, z binary"), np.float32)
    out = np.zeros((m, m), np.float32)
    for a in range(m if len(sums) else 0):
        out[a, a:] = sums[a * (2 * m - a + 1) // 2 : a * (2 * m - a + 1) // 2 + m - a]
        out[a:, a] = out[a, a:]
    return out, max(sums[-1], 1) if len(sums) else 1


def rank_for(items: int, vocabulary: int) -> int:
    return min(vocabulary, max(LEAST_RANK, items // PER_RANK))


def latent_space(docs: DataFrame, items: list[np.ndarray], vocabulary: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors (word of the vocabulary, direction) and singular values of the unit TF-IDF passages.

    The documents' passages together weigh as much as the items.
    """
    own = idf[_cell(vocabulary)].astype(np.float64)
    place = [np.searchsorted(vocabulary, w) for w in items]
    rank = rank_for(len(items), len(vocabulary))

    def of_items(x: np.ndarray) -> np.ndarray:
        z = np.zeros_like(x)
        for p in place:
            np.add.at(z, p, own[p][:, None] * ((own[p] @ x[p]) / max((own[p] ** 2).sum(), 1e-9)))
        return z

    if len(vocabulary) <= GRAM:
        gram, count = _gram(docs, vocabulary, idf)
        gram *= len(items) / count

    def of_passages(x: np.ndarray) -> np.ndarray:
        if len(vocabulary) <= GRAM:
            return gram @ x.astype(np.float32)
        shared = docs.sparkSession.sparkContext.broadcast(x.astype(np.float32))

        def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x, count = shared.value, 0
            z = np.zeros(x.shape, np.float32)
            for part in slices(batches, "t", 1 << 20):
                h, index, offsets = _words(part.column("t"))
                starts = _passages(offsets, PASSAGE)
                if not len(starts):
                    continue
                weight, at = _gather(h, index, vocabulary, idf)
                passage = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(index))))
                square = np.maximum(np.add.reduceat(weight**2, starts), 1e-9)
                inside = np.flatnonzero(at >= 0)
                weight, at, passage = weight[inside], at[inside], passage[inside]
                for a in range(0, len(at), 1 << 14):
                    w, k, p = weight[a : a + (1 << 14)], at[a : a + (1 << 14)], passage[a : a + (1 << 14)]
                    first = np.flatnonzero(np.diff(p, prepend=-1))
                    y = np.add.reduceat(x[k] * w[:, None], first, axis=0) / square[p[first]][:, None]
                    row = np.repeat(y, np.diff(np.append(first, len(p))), axis=0) * w[:, None]
                    order = np.argsort(k, kind="stable")
                    cut = np.flatnonzero(np.diff(k[order], prepend=-1))
                    z[k[order][cut]] += np.add.reduceat(row[order], cut, axis=0)
                count += len(starts)
            yield _blocks(z)
            yield pa.RecordBatch.from_pydict({"b": pa.array([64], pa.int32()), "z": pa.array([np.float32(count).tobytes()], pa.binary())})

        z = _sum_blocks(docs.mapInArrow(product, "b int, z binary"), np.float32)
        if not len(z):
            return np.zeros_like(x)
        return z[:-1].reshape(x.shape) * (len(items) / max(z[-1], 1))

    def normal(x: np.ndarray) -> np.ndarray:
        return of_items(x) + of_passages(x)

    q, _ = np.linalg.qr(np.random.default_rng(11).standard_normal((len(vocabulary), min(len(vocabulary), rank + SPARE))))
    for _ in range(POWER):
        q, _ = np.linalg.qr(normal(q))
    small = q.T @ normal(q)
    squares, turn = np.linalg.eigh((small + small.T) / 2)
    best = np.argsort(-squares, kind="stable")[:rank]
    return q @ turn[:, best], np.sqrt(np.maximum(squares[best], 0))


def common_subsequence(item: np.ndarray, text: np.ndarray) -> int:
    """Length of the longest common subsequence, one bit for each word of the item."""
    places: dict[int, int] = {}
    for k, w in enumerate(item.tolist()):
        places[w] = places.get(w, 0) | 1 << k
    full = (1 << len(item)) - 1
    row = full
    for w in text.tolist():
        if m := places.get(w):
            hit = row & m
            row = (row + hit | row - hit) & full
    return len(item) - row.bit_count()


def _last_sentence(text: str) -> str:
    parts = [p for p in text.replace("\n", " ").replace("! ", ". ").replace("? ", ". ").split(". ") if p.strip()]
    return parts[-1] if parts else ""


class _Items:
    """One block of the benchmark as words; later in latent space."""

    def __init__(self, rows: list[tuple[int, str, str | None]]):
        texts = [t or "" for _, t, _ in rows]
        answers = [_last_sentence(t) if a is None else a for t, (_, _, a) in zip(texts, rows, strict=True)]
        h, index, offsets = _words(pa.array(texts, pa.string()))
        ah, aindex, aoffsets = _words(pa.array(answers, pa.string()))
        real = np.flatnonzero(np.diff(offsets))
        self.ids = [rows[i][0] for i in real]
        self.words = [h[index[offsets[i] : offsets[i + 1]]] for i in real]
        self.answers = [ah[aindex[aoffsets[i] : aoffsets[i + 1]]] for i in real]
        n = np.diff(offsets)[real]
        #: Windows have STEP << kind words, which suits items of 7/8 to 7/4 of that.
        self.kind = np.maximum(np.log2(np.maximum(n, 1) / (SHORT / 2)).astype(np.int64), 0)
        self.step = STEP // 2 if (self.kind == 0).any() else STEP
        self.vocabulary = np.unique(np.concatenate(self.words)) if self.words else np.zeros(0, np.uint64)

        self.counts = np.zeros((len(real), len(self.vocabulary)), np.int32)
        for k, own in enumerate(self.words):
            np.add.at(self.counts[k], np.searchsorted(self.vocabulary, own), 1)

    def project(self, vectors: np.ndarray, idf: np.ndarray) -> None:
        """Words in latent space, and for each kind its items: their numbers, directions, and the part of their length that is in the space."""
        weight = idf[_cell(self.vocabulary)]
        self.space = (vectors * weight[:, None]).astype(np.float32)
        x = self.counts.astype(np.float32) @ self.space
        inside = np.linalg.norm(x, axis=1)
        size = np.sqrt((self.counts * weight.astype(np.float64) ** 2).sum(1))
        there = inside > 1e-6 * np.maximum(size, 1e-9)
        self.groups = []
        for kind in np.unique(self.kind[there]).tolist():
            own = np.flatnonzero(there & (self.kind == kind))
            self.groups.append((kind, own, x[own] / inside[own, None], inside[own] / size[own]))

    def check(self, item: int, text: np.ndarray) -> tuple[float, bool]:
        """Share of the item in the text, and whether its answer is there."""
        own, answer = self.words[item], self.answers[item]
        return common_subsequence(own, text) / len(own), bool(len(answer)) and common_subsequence(answer, text) == len(answer)


def _runs(first: np.ndarray, n: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Some runs first : first + n at a time, none of them empty: which, their elements, and where each starts among these."""
    for a in range(0, len(n), 4096):
        r = slice(a, a + 4096)
        ends = np.cumsum(n[r])
        yield r, np.repeat(first[r] - (ends - n[r]), n[r]) + np.arange(ends[-1]), ends - n[r]


def common_words(at: np.ndarray, lo: np.ndarray, hi: np.ndarray, item: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How many words the stretches lo : hi of a text have in common with their items, each as often as the item has it at most.

    at: the text's words in the vocabulary, or -1; counts[item, word].
    """
    out = np.zeros(len(lo), np.int64)
    before = np.concatenate([[0], np.cumsum(at >= 0)])
    place, lo, hi = at[at >= 0], before[lo], before[hi]
    has, size = counts > 0, counts.shape[1]
    some = np.flatnonzero(hi > lo)
    for r, k, start in _runs(lo[some], (hi - lo)[some]):
        own, word = item[some[r]], place[k]
        n = np.diff(np.append(start, len(k)))
        hit = np.flatnonzero(has.ravel()[np.repeat(own * size, n) + word])
        key = np.repeat(np.arange(len(n)) * size, n)[hit] + word[hit]
        key, times = np.unique(key.astype(np.int32) if len(n) * size < 1 << 31 else key, return_counts=True)
        pair, word = np.divmod(key.astype(np.int64), size)
        out[some[r]] = np.bincount(pair, weights=np.minimum(times, counts[own[pair], word]), minlength=len(n))
    return out


def window_sums(x: np.ndarray, text: np.ndarray, width: int) -> np.ndarray:
    """Sums of x over windows of ``width`` steps (a power of two) from every step on, which end with their text."""
    return widen(x, text, 1, width)


def widen(x: np.ndarray, text: np.ndarray, have: int, width: int) -> np.ndarray:
    """The same from the sums over windows of ``have`` steps."""
    while have < width:
        longer = x.copy()
        same = np.flatnonzero(text[have:] == text[:-have])
        longer[same] += x[same + have]
        x, have = longer, 2 * have
    return x


def candidates(inside: np.ndarray, square: np.ndarray, items: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, ...]:
    """(window, item, cosine) of all pairs with a cosine of COSINE or more, where the window is as far within the space as asked.

    inside: the windows in latent space; square: their squared norms outside it; part: the part of each item that is inside.
    """
    length = np.sqrt(np.einsum("ij,ij->i", inside, inside))
    share = length / np.sqrt(np.maximum(square, 1e-9))
    live = np.flatnonzero((share >= INSIDE * part.min(initial=1)) & (length > 0))
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
    for a in range(0, len(live), 4096):
        own = live[a : a + 4096]
        cosine = ((inside[own] / length[own, None]) @ items.T).ravel()
        near = np.flatnonzero(cosine >= COSINE)
        w, i = np.divmod(near, len(items))
        far = share[own[w]] >= INSIDE * part[i]
        out.append((own[w[far]], i[far], cosine[near[far]]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _find(docs: DataFrame, items: _Items, idf: np.ndarray) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((items, idf))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, idf = shared.value
        lengths = np.array([len(x) for x in items.words])
        for part in slices(batches, "t", 2 << 20):
            h, index, offsets = _words(part.column("t"))
            starts = _passages(offsets, items.step)
            if not len(starts):
                continue
            weight, at = _gather(h, index, items.vocabulary, idf)
            text = np.searchsorted(offsets, starts, side="right") - 1
            ends = np.append(starts, len(index))
            inside = np.flatnonzero(at >= 0)
            place = at[inside]
            cuts = np.searchsorted(inside, ends)
            square = np.add.reduceat(weight**2, starts)
            steps = np.zeros((len(starts), items.space.shape[1]), np.float32)
            some = np.flatnonzero(np.diff(cuts))
            for r, k, start in _runs(cuts[some], np.diff(cuts)[some]):
                steps[some[r]] = np.add.reduceat(items.space[place[k]], start, axis=0)
            found: dict[tuple[int, int], tuple] = {}
            square, have = square.astype(np.float64), 1
            for kind, numbers, directions, inner in items.groups:  # by growing length
                width = (STEP << kind) // items.step
                steps, square, have = widen(steps, text, have, width), widen(square, text, have, width), width
                w, i, cosine = candidates(steps, square, directions, inner)
                own = numbers[i]
                last = np.minimum(w + width, np.searchsorted(text, text[w], side="right"))
                lo, hi = np.maximum(offsets[text[w]], starts[w] - lengths[own]), np.minimum(offsets[text[w] + 1], ends[last] + lengths[own])
                common = common_words(at, lo, hi, own, items.counts)
                for p in np.flatnonzero(common >= LOOSE * lengths[own]):
                    t, item = int(text[w[p]]), int(own[p])
                    if (before := found.get((t, item))) and before[1] >= EXACT:
                        continue
                    share, answer = items.check(item, h[index[lo[p] : hi[p]]])
                    if (share >= EXACT or share >= LOOSE and answer) and (not before or share > before[1]):
                        found[t, item] = (float(cosine[p]), share, answer)
            if found:
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("d").take(pa.array([t for t, _ in found])), "item_id": pa.array([items.ids[i] for _, i in found], pa.int64()),
                    "cosine": pa.array([x[0] for x in found.values()]), "shared": pa.array([x[1] for x in found.values()]), "answer": pa.array([x[2] for x in found.values()]),
                })

    return docs.select("d", "t").mapInArrow(find, FOUND)


FOUND = "doc_id long, item_id long, cosine double, shared double, answer boolean"


def contaminated(df: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item: str = "text", answer: str | None = None) -> DataFrame:
    """(doc_id, item_id, cosine, shared, answer) for each document that holds a benchmark item."""
    docs = df.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t")).filter("t is not null and t <> ''")
    given = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item).alias("x"), (F.col(answer) if answer else F.lit(None)).cast("string").alias("a")).filter("i is not null and x is not null").distinct()
    blocks = -(-given.count() // ITEM_BLOCK)
    out = docs.sparkSession.createDataFrame([], FOUND)
    if not blocks:
        return out
    idf = _weights(docs)
    fit = docs.coalesce(max(12, docs.rdd.getNumPartitions() // 8))  # each task gives sums of a fixed size; the scan's parts go by bytes
    for b in range(blocks):
        rows = given.filter(F.pmod(F.xxhash64("i", "x"), F.lit(blocks)) == b).orderBy("i", "x").collect()  # about ITEM_BLOCK rows
        items = _Items([tuple(r) for r in rows])
        if items.words:
            items.project(latent_space(fit, items.words, items.vocabulary, idf)[0], idf)
            out = out.unionByName(_find(docs, items, idf))
    return out.groupBy("doc_id", "item_id").agg(F.max("cosine").alias("cosine"), F.max("shared").alias("shared"), F.max("answer").alias("answer"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
