"""Operator 6. Exact n-gram Jaccard self-join by rare-first prefix filtering.

A text's set holds its distinct five-word shingles as 64-bit hashes. Texts with equal sets (by a
128-bit signature) form one class, which takes part once. Shingles are ordered rarest first, by a
fixed-size tally of all of them over hash buckets (ties by hash); any total order gives the same
links, a good one fewer candidates. Two sets similar enough share a shingle within their prefixes.

1. One pass tallies the shingles and describes each set (size, signature, sizes by range of hashes).
2. One pass sends each text's prefix, packed by slice, to the part that its shingles' hashes belong to,
   where shingles that only one class has are dropped. Shingles in very full buckets skip this and
   are settled later, so no part gathers an unbounded list.
3. Rounds of leaders: classes of a shingle that are not in its largest component (at first each class
   is one) pair with one leader from there, so a round has no more pairs than entries. Length and
   positional filters thin them, then the suffix filter: each side's sizes by range of hashes bound
   the overlap before any set is fetched. Each pair is verified once. Components follow, shingles
   whose classes are one component by now drop out, and the next round takes other leaders.
4. When leaders meet few more, classes outside a shingle's largest component are verified against all
   others of like size there. A pair within a component needs no check.

Ids: rows with the same doc_id are one document, linked if any of its texts are; rows with a null
doc_id get their set size and a null component. Null, empty or wordless texts have empty sets and
link with nothing; a text of fewer than five words has its whole sequence as one shingle. An empty
table gives no rows. Other columns are ignored. Texts are used whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._common import Steps, chain, documents, mix, owners, release, slices, word_hashes, words
from tidemark.llm._components import components

SHINGLE = 5
SIMILARITY = Fraction(3, 4)
#: Buckets of the tally; 8 MB on the driver, whatever the input.
TALLY_BITS = 20
BLOCKS = 64
#: Shingles in a bucket so many times fuller than the mean don't go through a part.
FULL = 64
#: Ranges of hashes in which the sizes of a set are counted, and the most that a range can say.
RANGES, MOST_IN_RANGE = 64, 255
#: Leaders are chosen anew until a round has fewer pairs than this share of the entries, or so often.
FEW, MOST_ROUNDS = 0.01, 4
#: Leaders of a shingle in a round; one in the first, whose links settle most.
LEADERS = 4
#: Prefix entries for each part.
PART_ENTRIES = 1_500_000
MOST_PARTS = 100_000


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values: each text's distinct shingles in ascending order of hash."""
    distinct, index, offsets = words(texts)
    h = word_hashes(distinct)[index]
    n = np.diff(offsets)
    text = owners(offsets)
    full = offsets[1:][text] - np.arange(len(h)) >= size
    at = np.flatnonzero(full)
    out = [chain([h[at + k] for k in range(size)], seed=size)]
    row = [text[at]]
    for k in range(1, size):  # whole short sequences
        short = np.flatnonzero(n == k)
        if len(short):
            out.append(chain([h[offsets[short] + i] for i in range(k)], seed=k))
            row.append(short)
    out, row = np.concatenate(out), np.concatenate(row)
    order = np.lexsort((out, row))
    out, row = out[order], row[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (row[1:] != row[:-1])
    out, row = out[new], row[new]
    return np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(texts)))]), out


def signatures(offsets: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that stand for each set."""
    sums = []
    for seed in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values * np.uint64(seed)))])
        sums.append(mix(total[offsets[1:]] - total[offsets[:-1]] + np.diff(offsets).astype(np.uint64)))
    return sums[0], sums[1]


def _needed(n, m=None):
    """Least overlap of similar sets of n and m shingles: of n and its smallest likely partner without m."""
    p, q = SIMILARITY.numerator, SIMILARITY.denominator
    return -(-p * n // q) if m is None else -(-p * (n + m) // (p + q))


def ranges(offsets: np.ndarray, values: np.ndarray) -> list[bytes | None]:
    """How many shingles of each set are in each range of hashes; None where that may not fit a byte."""
    n = np.diff(offsets)
    cell = owners(offsets) * RANGES + (values >> np.uint64(58)).astype(np.int64)
    counts = np.bincount(cell, minlength=len(n) * RANGES).reshape(len(n), RANGES)
    fits = counts.max(axis=1, initial=0) <= MOST_IN_RANGE
    return [row.tobytes() if ok else None for row, ok in zip(counts.astype(np.uint8), fits, strict=True)]


DESCRIBED = "doc_id long, n long, s1 long, s2 long, ranges binary, block int, tally binary"


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text; at the end of the task its tally, in blocks."""
    tally = np.zeros(1 << TALLY_BITS, np.int64)
    names = ["doc_id", "n", "s1", "s2", "ranges", "block", "tally"]
    for part in slices(batches, "t"):
        offsets, values = shingle_sets(part.column("t"))
        tally += np.bincount(values >> np.uint64(64 - TALLY_BITS), minlength=len(tally))
        s1, s2 = signatures(offsets, values)
        size = part.num_rows
        yield pa.RecordBatch.from_arrays(
            [part.column("d"), pa.array(np.diff(offsets)), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)),
             pa.array(ranges(offsets, values), pa.binary()), pa.nulls(size, pa.int32()), pa.nulls(size, pa.binary())],
            names,
        )
    if tally.any():
        blocks = np.split(np.minimum(tally, (1 << 32) - 1).astype(np.uint32), BLOCKS)
        none = pa.nulls(BLOCKS, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [none, none, none, none, pa.nulls(BLOCKS, pa.binary()), pa.array(range(BLOCKS), pa.int32()),
             pa.array([b.tobytes() for b in blocks], pa.binary())],
            names,
        )


def _sum_blocks(table: pa.Table) -> pa.Table:
    total = np.zeros((1 << TALLY_BITS) // BLOCKS, np.int64)
    for b in table["tally"].to_pylist():
        total += np.frombuffer(b, np.uint32)
    return pa.table({"block": pa.array([table["block"][0].as_py()], pa.int32()), "tally": pa.array([total.tobytes()], pa.binary())})


def _prefixes(docs: DataFrame, tally, parts: int) -> DataFrame:
    """(key, s1, s2, pos) of prefix shingles that several sets may share."""
    heavy = max(1000, FULL * int(tally.value.mean()))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = tally.value
        for part in slices(batches, "t"):
            offsets, values = shingle_sets(part.column("t"))
            sign = np.stack(signatures(offsets, values), axis=1)
            row, n = owners(offsets), np.diff(offsets)
            first = np.zeros(len(n), bool)
            first[np.unique(sign, axis=0, return_index=True)[1]] = True
            keep = first[row]  # equal sets of one slice send once
            row, values = row[keep], values[keep]
            common = counts[(values >> np.uint64(64 - TALLY_BITS)).astype(np.int64)]
            order = np.lexsort((values, common, row))
            row, values, common = row[order], values[order], common[order]
            n = np.where(first, n, 0)
            pos = np.arange(len(row)) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
            inside = pos < (n - _needed(n) + 1)[row]
            row, values, common, pos = row[inside], values[inside], common[inside], pos[inside]
            to = (mix(values) % np.uint64(parts)).astype(np.int64)
            own = parts + int(mix(sign[:1, 0])[0] % np.uint64(1 << 30)) if len(sign) else parts
            to[common > heavy] = own
            order = np.argsort(to, kind="stable")
            row, values, pos, to = row[order], values[order], pos[order], to[order]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(to)) + 1, [len(to)]]) if len(to) else np.zeros(1, np.int64)
            out = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                who, index = np.unique(row[a:b], return_inverse=True)
                narrow = lambda x: x.astype(np.uint32 if x.max() > 65535 else np.uint16).tobytes()
                out.append((int(to[a]), values[a:b].tobytes(), narrow(index), narrow(pos[a:b]), sign[who].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), *[pa.binary()] * 4), strict=True)], ["part", "keys", "who", "pos", "sets"])

    def shared(table: pa.Table) -> pa.Table:
        key, sign, pos = [], [], []
        wide = lambda x, n: np.frombuffer(x, np.uint16 if len(x) == 2 * n else np.uint32)
        for k, w, p, s in zip(*(table[c].to_pylist() for c in ("keys", "who", "pos", "sets")), strict=True):
            key.append(np.frombuffer(k, np.uint64))
            sign.append(np.frombuffer(s, np.uint64).reshape(-1, 2)[wide(w, len(key[-1]))])
            pos.append(wide(p, len(key[-1])).astype(np.int32))
        key, sign, pos = np.concatenate(key), np.concatenate(sign), np.concatenate(pos)
        order = np.lexsort((sign[:, 1], sign[:, 0], key))
        key, sign, pos = key[order], sign[order], pos[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (sign[1:] != sign[:-1]).any(axis=1)
        key, sign, pos = key[new], sign[new], pos[new]
        if table["part"][0].as_py() < parts:
            same = key[1:] == key[:-1]
            several = np.zeros(len(key), bool)
            several[1:] |= same
            several[:-1] |= same
            key, sign, pos = key[several], sign[several], pos[several]
        sign = sign.view(np.int64)
        return pa.table({"key": key.view(np.int64), "s1": sign[:, 0], "s2": sign[:, 1], "pos": pos})

    packed = docs.mapInArrow(send, "part long, keys binary, who binary, pos binary, sets binary")
    return packed.groupBy("part").applyInArrow(shared, "key long, s1 long, s2 long, pos int")


def _could_match(a: str, b: str):
    """Length and positional filters on (n, pos) of two entries of one shingle."""
    p, q = SIMILARITY.numerator, SIMILARITY.denominator
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    left = F.least(na - F.col(f"{a}.pos"), nb - F.col(f"{b}.pos"))
    return (F.least(na, nb) * q >= F.greatest(na, nb) * p) & (left * (p + q) >= (na + nb) * p)


def _ordered(a: str, b: str):
    """The pair with the lesser class first."""
    one, two = F.col(f"{a}.c"), F.col(f"{b}.c")
    return F.least(one, two).alias("a"), F.greatest(one, two).alias("b")


def _possible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Of (a, b), those whose sets' sizes by range of hashes let them overlap enough."""

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("na", "nb"))
            known = pc.and_(batch.column("ra").is_valid(), batch.column("rb").is_valid())
            at = np.flatnonzero(known.to_numpy(zero_copy_only=False))
            x, y = (np.frombuffer(b"".join(batch.column(c).take(pa.array(at)).to_pylist()), np.uint8).reshape(-1, RANGES) for c in ("ra", "rb"))
            keep = np.ones(batch.num_rows, bool)
            keep[at] = np.minimum(x, y).sum(axis=1, dtype=np.int64) >= _needed(n[at], m[at])
            keep = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    for side in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("c").alias(side), F.col("n").alias(f"n{side}"), F.col("ranges").alias(f"r{side}")), side)
    return pairs.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(bound, "a long, b long")


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of (a, b), those whose sets (c, shingles) are similar."""
    p, q = SIMILARITY.numerator, SIMILARITY.denominator

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "x", 16 << 20):
            ok = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)):
                both = np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
                both.sort(kind="stable")
                overlap = int((both[1:] == both[:-1]).sum())
                ok[i] = overlap * q >= (len(both) - overlap) * p
            ok = pa.array(ok)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok)], ["a", "b"])

    with_b = pairs.join(sets.select(F.col("c").alias("b"), F.col("shingles").alias("y")), "b")
    both = with_b.join(sets.select(F.col("c").alias("a"), F.col("shingles").alias("x")), "a")
    return both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def _sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(c, shingles) for (c, rep, s1, s2): one row for each row of ``docs`` with that text and id."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t"):
            offsets, values = shingle_sets(part.column("t"))
            s1, s2 = (s.view(np.int64) for s in signatures(offsets, values))
            rows = np.flatnonzero((s1 == part.column("s1").to_numpy()) & (s2 == part.column("s2").to_numpy()))
            sets = pa.array([values[offsets[r] : offsets[r + 1]].tobytes() for r in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("c").take(pa.array(rows)), sets], ["c", "shingles"])

    # a merge join at every size: nothing tells how many are wanted
    found = docs.join(wanted.hint("merge"), docs.d == wanted.rep).select("c", "s1", "s2", "t")
    return found.mapInArrow(each, "c long, shingles binary")


def _open(steps: Steps, entries: DataFrame, classes: DataFrame, labels: DataFrame | None, round_: int) -> DataFrame:
    """Entries of shingles that several components share, each with the largest of these there and that
    one's leaders of the round. In round 0, when little is linked, any class may lead.

    A leader has the shingle early in its prefix, where the positional filter lets most pairs pass; a
    hash deals the component's classes anew each round, so that others lead.
    """
    of = classes.select("c", F.col("c").alias("comp"))
    if labels is not None:
        of = classes.select("c").join(labels, F.col("c") == F.col("id"), "left").select("c", F.coalesce("component", "c").alias("comp"))
    labelled = entries.join(of, "c").select("key", "comp", "c", "n", "pos")
    hash_, leaders = F.xxhash64("key", "c", F.lit(round_)), LEADERS if round_ else 1
    one = F.struct(F.greatest(F.col("pos"), F.lit(round_)).alias("early"), hash_.alias("h"), "c", "n", "pos")
    leads = F.array(*[F.min(F.when(F.pmod(hash_, F.lit(leaders)) == k, one)) for k in range(leaders)])
    side = F.col("comp") if round_ else F.lit(-1).cast("long")
    several = F.min("comp") < F.max("comp")
    parts = labelled.groupBy("key", side.alias("side")).agg(F.count("*").alias("m"), several.alias("several"), leads.alias("leads"))
    keys = parts.groupBy("key").agg(
        F.max(F.struct("m", F.xxhash64("key", "side").alias("h"), "side", "leads")).alias("top"),
        F.max("several").alias("several"), F.count("*").alias("sides"),
    )
    # written before it is joined: with exchanges of Spark's own on both sides it can split a hot shingle
    keys = keys.filter("several or sides > 1").select("key", F.col("top.side").alias("top"), F.filter("top.leads", lambda x: x.isNotNull()).alias("leads"))
    return steps.write(labelled.join(steps.write(keys, f"keys-{round_}"), "key"), f"open-{round_}")


def ngram_join(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row."""
    spark = df.sparkSession
    steps = Steps(spark, "ngram-join")
    docs = df.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t"))
    described = steps.write(docs.mapInArrow(_describe, DESCRIBED), "described")
    rows = described.filter("block is null").select("doc_id", "n", "s1", "s2", "ranges")
    tally = np.zeros((BLOCKS, (1 << TALLY_BITS) // BLOCKS), np.int64)
    blocks = described.filter("block is not null").select("block", "tally").groupBy("block").applyInArrow(_sum_blocks, "block int, tally binary")
    for r in blocks.collect():  # BLOCKS rows
        tally[r["block"]] = np.frombuffer(r["tally"], np.int64)
    shared_tally = spark.sparkContext.broadcast(tally.ravel())
    parts = int(min(MOST_PARTS, max(64, tally.sum() // 4 // PART_ENTRIES)))

    taking = rows.filter("n > 0 and doc_id is not null")
    classes = taking.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("ranges").alias("ranges"))
    classes = steps.write(classes.withColumn("c", F.monotonically_increasing_id()), "classes")  # numbered once: read back from here on
    entries = _prefixes(docs.filter("d is not null"), shared_tally, parts).join(classes, ["s1", "s2"])
    entries = steps.write(entries.select("key", "c", "n", "pos").dropDuplicates(["key", "c"]), "entries")
    release(spark)

    member = taking.join(classes.select("s1", "s2", "c"), ["s1", "s2"]).select("doc_id", "c")
    several = member.groupBy("doc_id").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi")
    texts_of_one = member.join(several, "doc_id").filter("c <> lo").select(F.col("lo").alias("a"), F.col("c").alias("b"))
    links = [steps.write(texts_of_one.distinct(), "links-0")]
    labels = None if links[0].isEmpty() else components(links[0])
    checked: list[DataFrame] = []  # at most MOST_ROUNDS
    sets: list[DataFrame] = []
    n_pairs, repeats = 0, not taking.groupBy("doc_id").count().filter("count > 1").isEmpty()
    for round_ in range(MOST_ROUNDS):
        open_ = _open(steps, entries, classes, labels, round_)
        steps.drop(f"open-{round_ - 1}" if round_ else "entries", f"keys-{round_ - 1}")
        entries = open_.select("key", "c", "n", "pos")
        outside = F.col("comp") != F.col("top")
        n_entries = open_.count()
        last = round_ > 0 and (n_pairs <= FEW * n_entries or round_ == MOST_ROUNDS - 1)
        mine = F.struct("c", "n", "pos", "comp")
        if last:  # all that is left; similar sets are in the same or the next band of sizes
            band = F.floor(F.log("n") / math.log(1 / SIMILARITY))
            others = open_.filter(outside).select("key", mine.alias("y"), F.explode(F.array(band - 1, band, band + 1)).alias("band"))
            pairs = open_.select("key", band.alias("band"), mine.alias("x"), (~outside).alias("inside")).join(steps.write(others, "others"), ["key", "band"])
            once = F.col("inside") | (F.col("x.c") < F.col("y.c"))
            pairs = pairs.filter((F.col("x.comp") != F.col("y.comp")) & once & _could_match("x", "y")).select(*_ordered("x", "y"))
        else:
            met = open_.filter(outside).select(mine.alias("x"), F.explode(F.filter("leads", lambda lead: lead["c"] != F.col("c"))).alias("lead"))
            pairs = met.filter(_could_match("x", "lead")).select(*_ordered("x", "lead"))
        pairs = pairs.distinct()
        for before in checked:
            pairs = pairs.join(before, ["a", "b"], "left_anti")
        pairs = steps.write(pairs, f"pairs-{round_}")
        n_pairs = pairs.count()
        if n_pairs:
            checked.append(pairs)
            possible = steps.write(_possible(pairs, classes), f"possible-{round_}")
            ends = possible.select(F.col("a").alias("c")).union(possible.select("b")).distinct()
            for known in sets:
                ends = ends.join(known, "c", "left_anti")
            wanted = steps.write(classes.join(ends, "c").select("c", "rep", "s1", "s2"), f"wanted-{round_}")
            if not wanted.isEmpty():
                found = _sets_of(docs, wanted)
                sets.append(steps.write(found.dropDuplicates(["c"]) if repeats else found, f"sets-{round_}"))
                release(spark)
            new = None
            if sets:  # else no pair is possible
                new = steps.write(_similar(possible, reduce(DataFrame.unionByName, sets)), f"links-{round_ + 1}")
            if new is not None and not new.isEmpty():
                links.append(new)
                labels = components(reduce(DataFrame.unionByName, links))
        release(spark)
        if last:
            break
    steps.drop(*(f"sets-{k}" for k in range(len(sets))), "others")

    of = classes.select("s1", "s2", "rep", F.col("c").alias("comp"))
    if labels is not None:
        of = classes.join(labels, F.col("c") == F.col("id"), "left").select("s1", "s2", "rep", F.coalesce("component", "c").alias("comp"))
    of = steps.write(of, "components")
    least = of.groupBy("comp").agg(F.min("rep").alias("component_id"))
    named = steps.write(of.join(least, "comp").select("s1", "s2", "component_id"), "named")
    found = rows.filter("n > 0").join(named, ["s1", "s2"], "left")
    found = found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
    empty = rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"))
    # an empty text beside another of the same document
    beside = found.join(empty.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    empty = empty.join(beside, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return found.unionByName(empty)


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(documents(spark, sf_dir))
