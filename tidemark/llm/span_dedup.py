"""Operator 8. Substring deduplication by sliding sentence spans.

A text is read as sentences (they end at . ! ? before white space, and at line ends); a sentence of
more than ``MAX_WORDS`` words counts as several, cut where a hash of two words is the least among those up to ``NEAR``
words away, so that copies are cut alike a few words into a passage, and after ``MAX_WORDS`` words at the latest. From every sentence a span runs
on until it has ``LEAST_SENTENCES`` sentences and ``LEAST_WORDS`` words, so that a passage gives the
same spans wherever it stands. Spans are hashed (128 bits, from two hashes of every word) and joined over all documents; sentences
covered by a repeated span that is not the first (least doc_id, then place) are removed.

A passage repeated for some 50 words or more is so found, wherever in a sentence it starts, but for few. White space
between words does not count. Null text stays null; empty texts and such with fewer words stay.
Rows equal in doc_id and text count as one document and each gets its result; rows with a null
doc_id come before all others. Other columns are kept, but for those named in ``ADDED``. An empty table gives no
rows. Texts may be of any length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._common import chain, checkpointed, documents, mix, owners, row_slices, slices, word_hashes, words
from tidemark.llm.line_dedup import keyed

LEAST_SENTENCES = 3
LEAST_WORDS = 20
MAX_WORDS = 10
NEAR = 4
#: Stands for a line end among the words; where a text has it as a word of its own, it ends a sentence too.
LINE_END = "\x1e"
_END = r"[.!?][\"')\]]*$"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def pieces(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """Of each word (line ends are none): two hashes, its text, and whether a sentence or a piece of one starts with it."""
    distinct, index, offsets = words(pc.replace_substring(pc.fill_null(texts, ""), "\n", f" {LINE_END} "), lower=False)
    text = owners(offsets)
    line = np.zeros(len(distinct), bool)
    if (at := pc.index(distinct, pa.scalar(LINE_END, distinct.type)).as_py()) >= 0:
        line[at] = True
    ends = pc.match_substring_regex(distinct, _END).to_numpy(zero_copy_only=False).astype(bool)
    is_line = line[index]
    ending = ends[index]
    ending[:-1] |= is_line[1:]
    real = np.flatnonzero(~is_line)
    h, other = word_hashes(distinct)[index[real]], word_hashes(distinct, 1)[index[real]]
    text, ending = text[real], ending[real]
    starts = np.ones(len(real), bool)
    starts[1:] = ending[:-1] | (text[1:] != text[:-1])
    sentence = np.cumsum(starts)
    rolling = mix(h * np.uint64(0xBF58476D1CE4E5B9) + np.roll(h, 1))
    rolling[starts] = np.uint64(0xFFFFFFFFFFFFFFFF)
    least = ~starts & (np.bincount(sentence, minlength=1)[sentence] > MAX_WORDS)
    for d in range(1, NEAR + 1):
        same = sentence[d:] == sentence[:-d]
        least[:-d] &= ~same | (rolling[:-d] < rolling[d:])
        least[d:] &= ~same | (rolling[d:] <= rolling[:-d])
    starts |= least
    place = np.arange(len(real))
    return h, other, text, (place - np.maximum.accumulate(np.where(starts, place, 0))) % MAX_WORDS == 0


def _split(text: str, starts: np.ndarray) -> list[str]:
    at = [m.start() for m in _WORD.finditer(text) if m[0] != LINE_END]
    cuts = [at[k] for k in np.flatnonzero(starts)]
    return [text[a:b] for a, b in zip([0, *cuts[1:]], [*cuts[1:], len(text)], strict=True)] if cuts else []


def sentences(text: str) -> list[str]:
    """The sentences of one text, each with the white space after it."""
    return _split(text, pieces(pa.array([text]))[3])


def _runs(h: np.ndarray, first: np.ndarray, size: np.ndarray, seed: int = 0) -> np.ndarray:
    """Order-dependent hash of each run h[first : first + size]."""
    acc = size.astype(np.uint64) + np.uint64(seed << 32)
    live = np.arange(len(first))
    for k in range(int(size.max()) if len(size) else 0):
        live = live[size[live] > k]
        acc[live] = chain([acc[live], h[first[live] + k]], seed)
    return acc


def _extents(text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """First words, sizes and texts of the sentences; first sentence and number of sentences of each span."""
    first_word = np.flatnonzero(starts)
    n = np.diff(np.append(first_word, len(text)))
    of, m = text[first_word], len(n)
    before = np.concatenate([[0], np.cumsum(n)])
    last = np.maximum(np.searchsorted(before, before[:-1] + LEAST_WORDS) - 1, np.arange(m) + LEAST_SENTENCES - 1)
    first = np.flatnonzero(last < m)
    first = first[of[last[first]] == of[first]]
    return first_word, n, of, first, last[first] - first + 1


def spans(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """Text, first sentence, number of sentences, and two hashes of each span."""
    h, other, text, starts = pieces(texts)
    first_word, n, of, first, size = _extents(text, starts)
    a, b = (_runs(_runs(x, first_word, n, seed), first, size, seed) for seed, x in ((1, h), (2, other)))
    start = np.searchsorted(of, np.arange(len(texts)))  # the first sentence of each text
    return of[first], first - start[of[first]], size, a, b


#: Columns that the operator adds; an input's own of the same name give way to them.
ADDED = ("_clean", "_removed")
#: A span's place: so many bits of the text's hash, which tell texts of one doc_id apart, then its first
#: sentence (a string of Spark's holds no more than that counts).
FIRST_BITS = 31


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "_t"):
        text, first, _, a, b = spans(part.column("_t"))
        rid, th = (part.column(c).to_numpy(zero_copy_only=False)[text] for c in ("_rid", "_th"))
        place = pa.array(th << FIRST_BITS | first)
        yield pa.RecordBatch.from_arrays([pa.array(rid), place, pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["_rid", "place", "h1", "h2"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(_rid, _th, firsts): first sentences of the spans that occurred before, of (_rid, _th, _t)."""
    occurrences = docs.mapInArrow(_occurrences, "_rid long, place long, h1 long, h2 long")
    first = occurrences.groupBy("h1", "h2").agg(F.min(F.struct("_rid", "place")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    first = checkpointed(first.select("h1", "h2", "first"))
    later = occurrences.join(first, ["h1", "h2"]).filter(F.struct("_rid", "place") != F.col("first"))
    place = F.col("place").bitwiseAND((1 << FIRST_BITS) - 1)
    return later.groupBy("_rid", F.shiftright("place", FIRST_BITS).alias("_th")).agg(F.collect_set(place).alias("firsts"))


def remove_repeated_spans(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``df``, and _clean (the text without repeated spans), _removed (sentences)."""

    def without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in row_slices(batches, text):
            whole, firsts = pc.struct_field(part.column("_row"), text), part.column("firsts").to_pylist()
            cut = [x for x, f in enumerate(firsts) if f]
            *_, owner, starts = pieces(whole.take(pa.array(cut, pa.int64())))
            _, n, of, first, size = _extents(owner, starts)
            begin = np.searchsorted(of, np.arange(len(cut) + 1))  # each text's first sentence
            length = np.zeros(len(n), np.int64)
            length[first] = size
            bounds = np.split(starts, np.searchsorted(owner, np.arange(1, len(cut)))) if cut else []
            texts, gone = whole.to_pylist(), [0] * part.num_rows
            for k, x in enumerate(cut):
                own = length[begin[k] : begin[k + 1]]
                out = {s for f in firsts[x] for s in range(f, f + int(own[f]))}
                texts[x] = "".join(s for i, s in enumerate(_split(texts[x], bounds[k])) if i not in out)
                gone[x] = len(out)
            yield pa.RecordBatch.from_arrays([part.column("_row"), pa.array(texts, pa.string()), pa.array(gone, pa.int64())], ["_row", *ADDED])

    # the hash's upper bits: as many as a place has room for
    docs = keyed(df, doc_id, text, ADDED).withColumn("_th", F.shiftright("_th", FIRST_BITS))
    found = repeated_spans(docs.select("_rid", "_th", F.col("_row").getField(text).alias("_t")))
    joined = docs.join(found, ["_rid", "_th"], "left").select("_row", "firsts")
    return joined.mapInArrow(without, f"_row {docs.schema['_row'].dataType.simpleString()}, _clean string, _removed long").select("_row.*", *ADDED)


def op8_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = documents(spark, sf_dir).select("doc_id", "text")
    return remove_repeated_spans(df).select("doc_id", F.col("_removed").alias("n_removed"), F.col("_clean").alias("text"))
