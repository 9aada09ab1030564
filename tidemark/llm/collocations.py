"""Operator 13. Phrase collocations mined with stripes: for each prefix, an associative counter of next words.

A text is cut into pieces at punctuation and line ends, and pieces into words. A stripe belongs to a language and a
prefix of up to three words; it counts which words follow, and under null all other occurrences of the prefix (at a
piece's end, or before a word too rare to matter). Tasks send stripes, many together, to the bucket of their prefix, where they are added up
element by element. One structure has it all: entries are extensions of the prefix by a word, a stripe's sum is the
prefix's own count, and its largest entry the most that one longer phrase takes of it.

Stripes grow by one word a level. A phrase occurs no more often than any part of it, so a level looks only at places
where both shorter parts were frequent; tasks know them from a blocked Bloom filter of bounded size, whose errors only
let rare phrases through to be counted and left out. The stripe of the empty prefix (all words of a language) and those
of very frequent prefixes are dealt over several keys by the next word's hash, so no stripe goes to one task.

A null language is ``und``. Null and empty texts have no words. Repeated rows count as often as they stand. Ties are
broken by the phrase in byte order. An empty table gives no rows. Columns besides text and lang are not read. Texts
and words may be of any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import _bloom
from tidemark.llm._common import checkpointed, documents, mix, slices, word_hashes

#: Longest phrase, least occurrences of one, and how many phrases of a language are reported.
LONGEST, LEAST, TOP = 4, 30, 2000
#: Of a phrase's occurrences, the percentage within one longer phrase from which it goes.
SUBSUMED = 80
#: Most bytes of a broadcast filter, and most prefixes that are told to tasks as very frequent.
FILTER_BYTES, MOST_FREQUENT = 64 << 20, 20_000
#: Occurrences of a prefix that go to one key at least.
KEY_OCCURRENCES = 1 << 14
#: Buckets of a language: at least so many, and one for so many documents or words.
LEAST_BUCKETS, BUCKET_DOCS, BUCKET_WORDS = 64, 4096, 500_000
SLICE = 8 << 20

#: Kinds of bytes. Pieces end at 2, words at 1 and 2.
KINDS = np.zeros(256, np.uint8)
KINDS[[0x20, 0x09]] = 1
KINDS[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2


def pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words (A-Z in lower case); each occurrence's word, piece and text, in order."""
    texts = pc.ascii_lower(pc.fill_null(texts, "")).cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    kind = KINDS[data]
    inside = kind == 0
    cut = np.zeros(len(data) + 1, bool)  # a text begins
    cut[offsets] = True
    before, after = cut[:-1].copy(), cut[1:].copy()  # a word begins or ends here, if it stands here
    before[1:] |= ~inside[:-1]
    after[:-1] |= ~inside[1:]
    starts = np.flatnonzero(inside & before)
    lengths = np.flatnonzero(inside & after) + 1 - starts
    piece = np.searchsorted(np.flatnonzero((kind == 2) | cut[:-1]), starts, side="right").astype(np.int32)
    text = np.searchsorted(offsets, starts, side="right") - 1
    strings = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.r_[0, np.cumsum(lengths)].astype(np.int64)), pa.py_buffer(data[inside]))
    coded = strings.dictionary_encode()
    return coded.dictionary.cast(pa.string()), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), piece, text


def extended(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase with one more word, from the phrase's and the word's."""
    return mix(h * np.uint64(0xBF58476D1CE4E5B9) + word)


def hash_of(langs: pa.Array, phrases: pa.Array) -> np.ndarray:
    """The same hash, of whole phrases."""
    split = pc.split_pattern(phrases, " ")
    words = split.flatten().dictionary_encode()
    own = word_hashes(words.dictionary)[words.indices.to_numpy(zero_copy_only=False)]
    ends = split.offsets.to_numpy().astype(np.int64)
    at, h = ends[:-1] - ends[0], word_hashes(langs)
    for _ in range(int(np.diff(ends).max(initial=0))):
        on = at < ends[1:] - ends[0]
        h[on] = extended(h[on], own[at[on]])
        at = at + 1
    return h


def _prefix_strings(words: pa.Array, columns: list[np.ndarray]) -> pa.Array:
    if not columns:
        return pa.array([], pa.string())
    taken = [words.take(pa.array(c)) for c in columns]
    return taken[0] if len(taken) == 1 else pc.binary_join_element_wise(*taken, " ")


def _counted(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of some integer columns from -1 on, in order, and how often each occurs."""
    if not len(columns[0]):
        return columns, np.zeros(0, np.int64)
    packed, width = [], 1 << 62
    for c in columns:  # as many columns as fit into one of 62 bits
        values = int(c.max()) + 2
        if width * values >= 1 << 62:
            packed.append(c + 1)
            width = values
        else:
            packed[-1] = packed[-1] * values + (c + 1)
            width *= values
    order = np.lexsort(packed[::-1]) if len(packed) > 1 else np.argsort(packed[0])
    packed = [p[order] for p in packed]
    starts = np.flatnonzero(np.r_[True, np.logical_or.reduce([p[1:] != p[:-1] for p in packed])])
    return [c[order[starts]] for c in columns], np.diff(np.r_[starts, len(order)])


def stripes(docs: DataFrame, levels: range, frequent=None, shares=None, buckets: int = 0) -> DataFrame:
    """(lang, prefix, size, bucket, next, n) of (lang, text), one row for each element of a stripe, summed up.

    ``levels``: sizes of prefixes. ``frequent``: broadcast filter of frequent phrases one word longer than the
    parts (None: every place counts). ``shares``: broadcast (hashes in order, keys, size) of the very frequent prefixes.
    Tasks send the stripes of a language and bucket together, a line each: the prefix, its next words, their counts.
    """
    buckets = max(buckets, LEAST_BUCKETS)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slice_ in slices(batches, "text", SLICE):
            words, word, piece, text = pieces(slice_.column("text"))
            langs = slice_.column("lang").dictionary_encode()
            lang = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[text] if len(text) else text
            hashes, lang_hashes = word_hashes(words), word_hashes(langs.dictionary)
            known = None if frequent is None else _frequent_at(frequent.value, word, piece, lang, hashes, lang_hashes)
            for size in levels:
                yield from _of_level(size, known, words, word, piece, lang, langs.dictionary, hashes, lang_hashes)

    def _of_level(size, known, words, word, piece, lang, lang_names, hashes, lang_hashes) -> Iterator[pa.RecordBatch]:
        # places where the prefix stands, and where its parts of the level below are frequent
        n = len(word) - max(size - 1, 0)
        if n <= 0:
            return
        at = np.arange(n)
        if size > 1:
            at = at[piece[at] == piece[at + size - 1]]
        if known is not None:
            for k in range(size - frequent.value.size + 1):
                at = at[known[at + k]]
        # the next word, or none: the piece ends or the last part is rare
        if size:
            nxt = np.full(len(at), -1, np.int64)
            has = at + size < len(word)
            has[has] = piece[at[has] + size] == piece[at[has]]
            if known is not None:
                last = at + size - (frequent.value.size - 1)
                has[has] = known[last[has]]
            nxt[has] = word[at[has] + size]
        else:
            nxt = word[at]
        prefix = [word[at + k] for k in range(size)]
        columns, count = _counted([lang[at], *prefix, nxt])
        if not len(count):
            return
        lang_, prefix, nxt = columns[0], columns[1:-1], columns[-1]
        # a stripe goes to one bucket, but for those of very frequent prefixes, which next words' hashes deal out
        h = lang_hashes[lang_]
        keys = np.uint64(buckets if not size else 1)
        for k, p in enumerate(prefix):
            h = extended(h, hashes[p])
            if shares is not None and k + 1 == shares.value[2] and len(shares.value[0]):
                place = np.minimum(np.searchsorted(shares.value[0], h), len(shares.value[0]) - 1)
                keys = np.where(shares.value[0][place] == h, shares.value[1][place], 1).astype(np.uint64)
        next_hash = np.where(nxt >= 0, hashes[np.maximum(nxt, 0)], 0).astype(np.uint64)
        bucket = (mix(h + mix(next_hash ^ np.uint64(5)) % keys) % np.uint64(buckets)).astype(np.int32)
        order = np.lexsort([nxt, *prefix[::-1], bucket, lang_])
        lang_, bucket, prefix, nxt, count = lang_[order], bucket[order], [p[order] for p in prefix], nxt[order], count[order]
        sends = np.r_[True, (lang_[1:] != lang_[:-1]) | (bucket[1:] != bucket[:-1])]
        starts = np.flatnonzero(np.logical_or.reduce([sends, *[np.r_[True, p[1:] != p[:-1]] for p in prefix]]))
        joined = lambda ends, column, by: pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), column), by)
        ends = np.r_[starts, len(nxt)]
        nexts = joined(ends, pc.fill_null(words.take(pa.array(nxt, mask=nxt < 0)), ""), " ")
        counts = joined(ends, pa.array(count, pa.int64()).cast(pa.string()), " ")
        prefixes = _prefix_strings(words, [p[starts] for p in prefix]) if size else pa.array([""] * len(starts), pa.string())
        lines = pc.binary_join_element_wise(prefixes, nexts, counts, "\t")
        first = np.flatnonzero(sends[starts])
        lang_, bucket = lang_[starts[first]], bucket[starts[first]]
        yield pa.RecordBatch.from_arrays(
            [lang_names.take(pa.array(lang_)), pa.array(bucket, pa.int32()), pa.array(np.full(len(first), size), pa.int32()), joined(np.r_[first, len(starts)], lines, "\n")],
            ["lang", "bucket", "size", "lines"],
        )

    sent = docs.mapInArrow(send, "lang string, bucket int, size int, lines string")
    met = sent.repartition("lang", "bucket")  # stripes travel whole and are opened where they are added up
    lines = met.select("lang", "bucket", "size", F.explode(F.split("lines", "\n")).alias("line")).select("lang", "bucket", "size", F.split("line", "\t").alias("s"))
    elements = F.arrays_zip(F.split(F.col("s")[1], " ").alias("next"), F.split(F.col("s")[2], " ").alias("n"))
    opened = lines.select("lang", "bucket", "size", F.col("s")[0].alias("prefix"), F.explode(elements).alias("e"))
    opened = opened.select("lang", "bucket", "size", "prefix", F.nullif("e.next", F.lit("")).alias("next"), F.col("e.n").cast("long").alias("n"))
    return opened.groupBy("lang", "bucket", "size", "prefix", "next").agg(F.sum("n").alias("n"))


def _frequent_at(known: KnownPhrases, word, piece, lang, hashes, lang_hashes) -> np.ndarray:
    """For every place, whether a frequent phrase of the filter's size may begin there."""
    out = np.zeros(len(word) + 1, bool)
    n = len(word) - known.size + 1
    if n <= 0:
        return out
    at = np.arange(n)
    at = at[piece[at] == piece[at + known.size - 1]]
    h = lang_hashes[lang[at]]
    for k in range(known.size):
        h = extended(h, hashes[word[at + k]])
    out[at[known.filter.places(h, np.zeros(len(at), np.int64))]] = True
    return out


class KnownPhrases:
    """A filter of phrases of one size."""

    def __init__(self, filter_: _bloom.Filter, size: int):
        self.filter, self.size = filter_, size


def phrase():
    return F.when(F.col("prefix") == "", F.col("next")).otherwise(F.concat_ws(" ", "prefix", "next"))


def _keys(phrases: DataFrame) -> DataFrame:
    """(unit, key, n) of (lang, phrase, f)."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "phrase"):
            h = hash_of(part.column("lang"), part.column("phrase")).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(h), np.int32)), pa.array(h), part.column("f")], ["unit", "key", "f"])

    return phrases.select("lang", "phrase", "f").mapInArrow(keys, "unit int, key long, f long")


def _told(phrases: DataFrame, size: int, total: int, filter_bytes: int):
    """What tasks are told of the frequent phrases (lang, phrase, f) of one size: a filter, and how many keys the most frequent take."""
    sc = phrases.sparkSession.sparkContext
    keys = checkpointed(_keys(phrases))
    blocks = np.array([min(max(1, filter_bytes * 8 // _bloom.BLOCK_BITS), _bloom.blocks_for(keys.count()))])
    known = KnownPhrases(_bloom.build(keys.select("unit", "key"), np.zeros(1, np.int64), blocks), size)
    share = max(KEY_OCCURRENCES, total // MOST_FREQUENT)
    most = keys.filter(F.col("f") > share).groupBy("key").agg(F.max("f").alias("f")).toArrow()  # MOST_FREQUENT rows at most: their counts add up to the total
    h, n = most.column("key").to_numpy().view(np.uint64), most.column("f").to_numpy()
    order = np.argsort(h)
    return sc.broadcast(known), sc.broadcast((h[order], -(-n[order] // share), size))


def frequent_phrases(df: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, filter_bytes: int = FILTER_BYTES) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, size, f) of all phrases of up to ``LONGEST`` words that occur ``least`` times or more in a language, (lang, n): its words)."""
    docs = df.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    words = checkpointed(stripes(docs, range(1), buckets=docs.count() // BUCKET_DOCS))
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    n = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def kept(s: DataFrame) -> DataFrame:
        return s.filter(F.col("next").isNotNull() & (F.col("n") >= least)).select("lang", phrase().alias("phrase"), (F.col("size") + 1).alias("size"), F.col("n").alias("f"))

    levels = [kept(words)]
    for size in range(1, LONGEST):
        known, shares = _told(levels[-1], size, n, filter_bytes)
        levels.append(checkpointed(kept(stripes(docs, range(size, size + 1), known, shares, n // BUCKET_WORDS))))
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out, totals


def collocations(phrases: DataFrame, totals: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) from what ``frequent_phrases`` returns."""
    words = F.split("phrase", " ")
    some = phrases.filter("size > 1")
    # the most that one longer phrase takes: largest entry of the phrase's own stripe, or of one that it ends
    longer = phrases.filter("size > 2").select(
        "lang", "f", F.explode(F.array(F.concat_ws(" ", F.slice(words, F.lit(1), F.col("size") - 1)), F.concat_ws(" ", F.slice(words, F.lit(2), F.col("size") - 1)))).alias("phrase")
    )
    taken = longer.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    left = some.join(taken, ["lang", "phrase"], "left")
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    left = left.filter(F.col("longer").isNull() | (wide("longer") * 100 < wide("f") * SUBSUMED)).select("lang", "phrase", "size", F.col("f").alias("a"))
    part = lambda begin, n: F.concat_ws(" ", F.slice(words, begin, n))
    cuts = left.select("lang", "phrase", "size", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumns({"first": part(F.lit(1), F.col("k")), "rest": part(F.col("k") + 1, F.col("size") - F.col("k"))})
    f = lambda name, count: phrases.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    cuts = cuts.join(f("first", "l"), ["lang", "first"]).join(f("rest", "r"), ["lang", "rest"])
    score = F.expr("(cast(2000000 as decimal(8,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    lowest = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some_best = lowest.withColumn("_s", F.pmod(F.xxhash64("phrase"), F.lit(64)))  # so that few rows a language are left for its one rank
    some_best = some_best.withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_s").orderBy(*order))).filter(F.col("_r") <= top)
    ranked = some_best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(*frequent_phrases(documents(spark, sf_dir)))
