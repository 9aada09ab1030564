"""Operator 4. Language ID by interpolated Kneser-Ney character models.

One model a language, over the letters of white-space-delimited words in lower case, each word with
its boundaries; n-grams do not reach across words. A model is a sorted array of n-gram hashes with
the discounted probabilities, and one of context hashes with the back-off weights. A text gets the
language whose model needs the fewest bits per character. Since a word's bits depend on the word
alone, a worker scores each distinct word once and remembers it.

Training counts come from about ``SAMPLE_DOCS`` labelled documents a language, chosen by a hash of
id and text (a documented bound; with more than ``SAMPLE_ALL / SAMPLE_DOCS`` languages each has its share of
``SAMPLE_ALL``, but ``LEAST_DOCS`` at least). Every language that has a label is learned; prediction covers all whole
texts. Rejection is calibrated on labelled documents that training left out: a text is rejected
where its bits per character, against what is usual for its language and length, exceed
``SLACK`` times the ``QUANTILE`` of those documents, and ``LEAST_EXCESS`` bits (at ``STEADY`` characters)
in any case, so that a few short or odd calibration texts can't make clean documents go.

A text that is null, empty or without letters gets ``und``, score 0, and is rejected. Ties between
languages go to the first in alphabetical order. Repeated rows are judged one by one. Rows with a null doc_id are
predicted, not learned from, and op4's held_out is null for them. Rows with a
null language are predicted but not learned from. An empty table gives no rows; with nothing to
learn from, all is ``und``. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._common import chain, documents, fold_column, slices, words

ORDER = 4
SAMPLE_DOCS, SAMPLE_ALL, LEAST_DOCS = 500, 200_000, 20
QUANTILE, SLACK = 0.999, 1.5
LEAST_EXCESS = 2.0
#: Beyond so many characters a longer text is not held to a narrower band.
STEADY = 400
REMEMBERED = 400_000
#: New words are scored so many at a time, and texts judged so many bytes at a time: a worker's memory follows these.
SCORED, JUDGED = 16_384, 2 << 20
UNSEEN = 1 / 5000  # the uniform share of a character that no text had


def letters_only(distinct: pa.Array) -> pa.Array:
    """Letters and marks of each word in lower case, nothing where there is no letter."""
    return pc.replace_substring_regex(pc.replace_substring_regex(pc.utf8_lower(distinct), r"[^\pL\pM]+", ""), r"^\pM+$", "")


def _positions(spelled: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all words, each after ORDER - 1 zeros and before a 1; the positions to predict; their words."""
    text = "".join("\0" * (ORDER - 1) + w + "\1" for w in spelled.to_pylist())
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    at = np.flatnonzero(points)
    ends = points[at] == 1
    word = np.cumsum(ends) - ends
    return points, at, word


def _grams(points: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    if not n:
        return np.zeros(len(at), np.uint64)
    return chain([points[at - k] for k in range(n - 1, -1, -1)], seed=n)


class KneserNey:
    """Character model of one language from (word, count)."""

    def __init__(self, spelled: pa.Array, counts: np.ndarray):
        points, at, word = _positions(spelled)
        weight = counts.astype(np.float64)[word]
        self.orders = []
        longer, first = None, None
        for n in range(ORDER, 0, -1):
            where = at if first is None else first
            gram = _grams(points, where, n)
            gram, first_of, inverse = np.unique(gram, return_index=True, return_inverse=True)
            count = np.bincount(inverse, weights=weight if longer is None else None)  # raw, below: distinct left extensions
            first, longer = where[first_of], gram
            context, of = np.unique(_grams(points, first - 1, n - 1), return_inverse=True)
            once, twice = (count == 1).sum(), (count == 2).sum()
            discount = min(0.95, max(0.1, once / (once + 2 * twice) if once + twice else 0.5))
            total, kinds = np.bincount(of, weights=count), np.bincount(of)
            self.orders.insert(0, (gram, (np.maximum(count - discount, 0) / total[of]).astype(np.float32), context, (discount * kinds / total).astype(np.float32)))

    def probability(self, points: np.ndarray, at: np.ndarray) -> np.ndarray:
        p = np.full(len(at), UNSEEN)
        for n, (gram, alpha, context, gamma) in enumerate(self.orders, 1):
            for keys, values, missing, sought in ((context, gamma, 1.0, _grams(points, at - 1, n - 1)), (gram, alpha, 0.0, _grams(points, at, n))):
                i = np.minimum(np.searchsorted(keys, sought), len(keys) - 1)
                found = np.where(keys[i] == sought, values[i], missing)
                p = p * found if missing else p + found
        return p


class Identifier:
    """The models of all languages, and the usual bits per character with the calibrated excess."""

    def __init__(self, models: dict[str, KneserNey]):
        self.languages = sorted(models)
        self.models = [models[k] for k in self.languages]
        self.usual = np.zeros(len(models))
        self.excess = np.full(len(models), np.inf)
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = {}
        self.bits = np.zeros((1 << 16, len(self.models) + 1), np.float32)  # in the last column: characters

    def __getstate__(self):
        return {k: v for k, v in vars(self).items() if k not in ("place", "bits")}

    def __setstate__(self, state):
        vars(self).update(state)
        self._clear()

    def _score(self, spelled: pa.Array) -> np.ndarray:
        points, at, word = _positions(spelled)
        _, first, inverse = np.unique(_grams(points, at, ORDER), return_index=True, return_inverse=True)
        out = np.zeros((len(spelled), len(self.models) + 1), np.float32)
        for k, model in enumerate(self.models):
            bits = -np.log2(model.probability(points, at[first]))
            out[:, k] = np.bincount(word, weights=bits[inverse], minlength=len(spelled))
        out[:, -1] = np.bincount(word, minlength=len(spelled))
        out[pc.equal(spelled, "").to_numpy(zero_copy_only=False)] = 0
        return out

    def bits_of(self, distinct: list[str]) -> np.ndarray:
        if len(self.place) + len(distinct) > REMEMBERED:
            self._clear()
        new = [w for w in distinct if w not in self.place]
        if new:
            used = len(self.place)
            while used + len(new) > len(self.bits):
                self.bits = np.concatenate([self.bits, np.zeros_like(self.bits)])
            for at in range(0, len(new), SCORED):
                some = new[at : at + SCORED]
                self.bits[used + at : used + at + len(some)] = self._score(letters_only(pa.array(some, pa.string())))
            self.place.update(zip(new, range(used, used + len(new)), strict=True))
        return self.bits[np.fromiter((self.place[w] for w in distinct), np.int64, len(distinct))]

    def judge(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Bits per character for each text and language, and the number of characters (0: no letters)."""
        distinct, index, offsets = words(texts, lower=False)
        each = self.bits_of(distinct.to_pylist()).astype(np.float64)
        text = np.repeat(np.arange(len(texts)), np.diff(offsets))
        sums = np.stack([np.bincount(text, weights=each[index, k], minlength=len(texts)) for k in range(each.shape[1])], axis=1)
        n = sums[:, -1]
        return sums[:, :-1] / np.maximum(n, 1)[:, None], n

    def z(self, best: np.ndarray, bits: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (bits - self.usual[best]) * np.sqrt(np.minimum(n, STEADY))


def _sample(df: DataFrame, counts: dict[str, int]) -> DataFrame:
    """Some rows (d, t, l, ...) of each language, by a hash of id and text."""
    size = min(SAMPLE_DOCS, max(LEAST_DOCS, SAMPLE_ALL // len(counts)))
    shares = df.sparkSession.createDataFrame([(k, min(1.0, size / n)) for k, n in counts.items()], "l string, share double")  # a row a language, as there are models
    hashed = F.pmod(F.xxhash64("d", "t", F.lit("fit")), F.lit(1 << 30))
    return df.join(F.broadcast(shares), "l").filter(hashed < F.col("share") * (1 << 30)).drop("share")


def fit(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", learn: Column | None = None, calibrate: Column | None = None) -> Identifier:
    """Models from the rows where ``learn`` holds, rejection from those where ``calibrate`` holds (else: every fourth learned row, kept out)."""
    known = df.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    held = calibrate if calibrate is not None else F.pmod(F.xxhash64(F.col(doc_id), F.lit("held")), F.lit(4)) == 0
    known = known.filter(learn if learn is not None else F.lit(True)).select(F.col(doc_id).alias("d"), F.col(text).alias("t"), F.col(lang).cast("string").alias("l"), held.alias("held"))
    counts = {r["l"]: r["n"] for r in known.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Identifier({})
    sample = _sample(known, counts)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t"):
            table = pa.Table.from_batches([part])
            for name in pc.unique(part.column("l")).to_pylist():
                own = table.filter(pc.equal(table["l"], name))
                distinct, index, _ = words(own["t"].combine_chunks(), lower=False)
                n = np.bincount(index, minlength=len(distinct))
                yield pa.RecordBatch.from_pydict({"l": pa.array([name] * len(n), pa.string()), "w": letters_only(distinct).cast(pa.string()), "n": pa.array(n, pa.int64())})

    rows = sample.filter(~F.col("held")).select("t", "l").mapInArrow(count, "l string, w string, n long").filter("w != ''").groupBy("l", "w").agg(F.sum("n").alias("n")).toArrow()  # bounded by the sample
    models = {}
    for name in pc.unique(rows["l"]).to_pylist():
        own = rows.filter(pc.equal(rows["l"], name)).combine_chunks()
        models[name] = KneserNey(own["w"].chunk(0), own["n"].to_numpy())
    identifier = Identifier(models)
    del rows

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t", JUDGED):
            h, n = identifier.judge(part.column("t"))
            own = np.array([identifier.languages.index(x) if x in identifier.languages else -1 for x in part.column("l").to_pylist()])
            use = (n > 0) & (own >= 0)
            yield pa.RecordBatch.from_pydict({"l": pa.array(own[use], pa.int32()), "h": pa.array(h[use, own[use]]), "n": pa.array(n[use])})

    if identifier.languages:
        seen = sample.filter("held").select("t", "l").mapInArrow(bits, "l int, h double, n double").toArrow()  # bounded by the sample
        for k in range(len(identifier.languages)):
            own = seen.filter(pc.equal(seen["l"], k))
            if len(own):
                identifier.usual[k] = np.median(own["h"].to_numpy())
                calibrated = SLACK * np.quantile(identifier.z(np.full(len(own), k), own["h"].to_numpy(), own["n"].to_numpy()), QUANTILE)
                identifier.excess[k] = max(LEAST_EXCESS * STEADY**0.5, calibrated)
    return identifier


def predict(df: DataFrame, identifier: Identifier, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, bits_per_char, rejected) for every row. score: the best language's share at 20 characters."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t", JUDGED):
            size = part.num_rows
            if identifier.languages:
                h, n = identifier.judge(part.column("t"))
                best = h.argmin(axis=1)
                low = h[np.arange(size), best]
                score = 1 / np.exp2(-20 * (h - low[:, None])).sum(axis=1)
                ok = n > 0
                rejected = ~ok | (identifier.z(best, low, n) > identifier.excess[best])
                name = np.where(ok, np.array(identifier.languages, object)[best], "und")
            else:
                ok, low, score, rejected, name = np.zeros(size, bool), np.zeros(size), np.zeros(size), np.ones(size, bool), np.full(size, "und", object)
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.column("d"), "lang_pred": pa.array(name, pa.string()), "score": pa.array(np.where(ok, score, 0.0)),
                "bits_per_char": pa.array(low, mask=~ok), "rejected": pa.array(rejected),
            })

    return df.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t")).mapInArrow(each, "doc_id long, lang_pred string, score double, bits_per_char double, rejected boolean")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    fold = fold_column("doc_id", 4)
    identifier = fit(docs, learn=fold != 2, calibrate=fold == 1)
    return predict(docs, identifier).withColumn("held_out", fold == 2)


def keep_identified(df: DataFrame) -> DataFrame:
    """The documents whose language is recognised; rejected ones go. With no labelled row to learn from, all stay."""
    identifier = fit(df)
    if not identifier.languages:
        return df

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", JUDGED):
            h, n = identifier.judge(part.column("text"))
            best = h.argmin(axis=1)
            keep = (n > 0) & ~(identifier.z(best, h[np.arange(len(n)), best], n) > identifier.excess[best])
            yield part.filter(pa.array(keep))

    return df.mapInArrow(each, df.schema)
