"""Operators against brute force, and at the edges: nulls, empty and long texts, repeated rows, clashing columns, empty tables."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import decontamination, language_id, line_dedup, lm_scoring, ngram_join, packing, span_dedup, token_counts, vector_search, warc
from tidemark.llm._components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TR = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def corpus(n=120, seed=3):
    rng = random.Random(seed)
    vocabulary = {"en": ["the", "of", "and"] + ["".join(rng.choices("aeiounsthr", k=rng.randint(3, 8))) for _ in range(300)], "xx": ["zu", "kö"] + ["".join(rng.choices("zkwxyöüäqj", k=rng.randint(3, 8))) for _ in range(300)]}
    boiler = "This Line repeats everywhere in the corpus.\nAnd so does this second line of it, word for word, again and again."
    rows = []
    for i in range(n):
        lang = "en" if i % 3 else "xx"
        lines = [" ".join(rng.choices(vocabulary[lang], k=rng.randint(4, 14))).capitalize() + "." for _ in range(rng.randint(1, 12))]
        if i % 5 == 0:
            lines[1:1] = boiler.split("\n")
        rows.append((i, "\n".join(lines), lang if i % 11 else None, "s", 1))
    for i in range(0, 30, 3):  # exact and near copies
        rows.append((n + i, rows[i][1], "en", "s", 1))
        words = rows[i][1].split(" ")
        words[len(words) // 2] = "changed"
        rows.append((n + i + 1, " ".join(words), "en", "s", 1))
    return rows + [(500, None, "en", "s", 0), (501, "", None, "s", 0), (502, " \n\t ", "en", None, 3), (503, "x" * 50_000, None, "s", 1), (504, "Two words", "en", "s", 9), (505, "two Words", "en", "s", 9), (None, "a row without id here now", "en", "s", 3), (7, rows[7][1], "en", "s", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_token_counts(docs, empty):
    import tiktoken

    encoder = token_counts._encoder(token_counts.public_tokenizers.path("byte_bpe_50k.tiktoken"))
    assert isinstance(encoder, tiktoken.Encoding)
    lengths = sorted(len(encoder.encode_ordinary(r[1] or "")) for r in corpus())
    sums = token_counts.suffix_sums(token_counts.length_histogram(docs)).cache()
    got = {r.length: r for r in sums.collect()}
    assert {k: r.n_docs for k, r in got.items()} == Counter(lengths)
    for k, r in got.items():
        assert r.docs_ge == sum(x >= k for x in lengths) and r.tokens_ge == sum(x for x in lengths if x >= k) and r.truncated_tokens == sum(min(x, k) for x in lengths)
    for limit in (0, 7, 50, 10**6):
        assert token_counts.truncated_total(sums, limit).first().tokens == sum(min(x, limit) for x in lengths)
    assert [r.length for r in token_counts.quantiles(sums, [0.5, 1.0]).collect()] == [lengths[math.ceil(len(lengths) * 0.5) - 1], lengths[-1]]
    assert token_counts.length_histogram(empty).isEmpty()


def test_vector_search(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((700, 16))
    x[300:340] = x[300]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [None] * 16), (1004, [1.0]), (None, [1.0] * 16), (1005, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).repartition(3)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    hits = total = 0
    got = {}
    for r in vector_search.search(df, F.col("id") % 50 == 0).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert sorted(got) == list(range(0, 700, 50))
    for q, found in got.items():
        cos = unit @ unit[q]
        cos[q] = -2
        best = np.lexsort((np.arange(700), -np.round(cos, 12)))[:5]
        assert sorted(found) == [1, 2, 3, 4, 5] and all(abs(cos[v] - s) < 1e-12 for v, s in found.values())
        hits, total = hits + len(set(best) & {v for v, _ in found.values()}), total + 5
    assert hits / total >= 0.9
    assert [v for v, _ in (got[300][k] for k in range(1, 6))] == [301, 302, 303, 304, 305]  # ties to the smaller id
    assert vector_search.search(df.limit(0), F.col("id") % 50 == 0).isEmpty()


def test_vector_search_among_near_copies(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((6000, 16))
    x[:2000] = x[0] + rng.standard_normal((2000, 16)) * 1e-3
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    hits = total = 0
    for r in vector_search.search(df, F.col("id") % 50 == 0).groupBy("query_id").agg(F.collect_list("vec_id").alias("v")).collect():
        cos = unit @ unit[r.query_id]
        cos[r.query_id] = -2
        hits, total = hits + len(set(np.argsort(-cos)[:5].tolist()) & set(r.v)), total + 5
    assert total == 600 and hits == total, hits / total


def test_packing(docs, empty):
    tokenizer = packing._tokenizer(packing.public_tokenizers.path("word_bpe_49k.json"))
    got = packing.best_fit_packing(docs, capacity=256).toPandas()
    want = []
    for i, t, *_ in corpus():
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        want += [(-1 if i is None else i, k, at, len(ids[at : at + 256]), zlib.crc32(ids[at : at + 256].tobytes())) for k, at in enumerate(range(0, len(ids), 256))]
    assert sorted(got.fillna({"doc_id": -1})[["doc_id", "piece", "start", "length", "ids_crc32"]].astype(int).itertuples(index=False, name=None)) == sorted(want)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s["offset"].tolist() == [0, *s["length"].cumsum().tolist()[:-1]] and s["length"].sum() <= 256
    assert packing.best_fit_packing(empty).isEmpty()


def test_packing_plan_is_near_the_bound():
    rng = random.Random(2)
    for n in (3, 50, 3000):
        h = Counter(min(2048, max(1, int(rng.lognormvariate(6, 1)))) for _ in range(n))
        plan = packing.plan(h)
        used = Counter()
        for lengths, times in plan:
            assert sum(lengths) <= 2048
            for k in lengths:
                used[k] += times
        assert used == h and sum(t for _, t in plan) <= -(-sum(k * v for k, v in h.items()) // 2048) * 1.1 + 1
    assert sorted(packing.plan(Counter([1000, 1048, 2048, 2000, 48]))) == [((1048, 1000), 1), ((2000, 48), 1), ((2048,), 1)]


def test_word_ids_equal_whole_texts():
    path = packing.public_tokenizers.path("word_bpe_49k.json")
    tokenizer, memory = packing._tokenizer(path), packing._WordIds(path)
    for text in ("It's THE end, of. café CAFÉ ΣΑΣ naïve 12ab3 l'été !!! a.b <|endoftext|> x y 日本語 (foo)", "ÀÉ öß? ñ;", "don't I'll we'd"):
        words = text.split(" ")
        starts, n = memory.encode(pa.array(words))
        ids = [i for k in range(len(words)) for row in (0, 1) for i in memory.ids[starts[row, k] : starts[row, k] + n[row, k]].tolist()]
        assert ids == tokenizer.encode(text, add_special_tokens=False).ids


def test_language_id(docs, empty):
    identifier = language_id.fit(docs)
    got = {r.doc_id: r for r in language_id.predict(docs, identifier).collect()}
    assert len(language_id.predict(docs, identifier).collect()) == len(corpus())
    truth = {i: lang for i, t, lang, *_ in corpus() if i is not None and i < 120 and lang}
    assert sum(got[i].lang_pred == lang for i, lang in truth.items()) / len(truth) > 0.97
    assert not any(got[i].rejected for i in truth)
    for i in (500, 501, 502):
        assert got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language_id.predict(empty, language_id.fit(empty)).isEmpty()
    assert {r.lang_pred for r in language_id.predict(docs, language_id.fit(empty)).collect()} == {"und"}


def test_probabilities_sum_to_one():
    model = language_id.KneserNey(pa.array(["abc", "abd", "bca"]), np.array([5, 2, 1]))
    ends = [c for c in "abcd"] + [""]
    total = 0.0
    for c in ends:
        points, at, _ = language_id._positions(pa.array(["ab" + c]))
        total += model.probability(points, at)[2]
    assert 0.97 < total <= 1.001  # the rest is for characters that no text had


def test_warc(spark, tmp_path):
    rows = [(1, "http://a", "<p>x</p>"), (2, "http://b\nc", "<p>x</p>"), (3, None, None), (4, "u", ""), (5, "u", "é" * 300_000), (6, "u", "y"), (6, "u", "y"), (None, "u", "<p>x</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha", F.lit(1)).repartition(3)
    files = warc.write(warc.mark(pages), f"file://{tmp_path}/w")
    got = {(r.page_id, r.record_type): r for r in warc.read(files, with_payload=True).collect()}
    assert {k: r.refers_to for k, r in got.items()} == {(1, "revisit"): 2, (2, "response"): None, (3, "revisit"): 4, (4, "response"): None, (5, "response"): None, (6, "response"): None, (None, "revisit"): 2}
    assert warc.read(files).count() == len(rows)
    for i, _, html in rows:
        payload = (html or "").encode()
        r = next(r for (k, _), r in got.items() if k == i)
        assert r.payload_bytes == len(payload) and r.payload_digest == warc.digest(payload) and (r.record_type == "revisit" or bytes(r.payload) == payload)
    assert warc.read(warc.write(warc.mark(pages.limit(0)), f"file://{tmp_path}/e")).isEmpty()
    assert warc.mark(pages, least_bytes=5).filter("revisit and page_id = 3").isEmpty()


def test_warc_reader_rejects_damage():
    data = warc.record(1, "u", b"hello") + warc.record(2, "u", b"world")
    assert [warc.parse(m)[1] for m in warc.members([data[:10], data[10:60], data[60:]])] == [b"hello", b"world"]
    with pytest.raises(ValueError):
        list(warc.members([data[:-5]]))
    foreign = b"WARC/1.0\r\nwarc-type: response\r\nCONTENT-LENGTH: 25\r\nContent-Type: application/http; msgtype=response\r\n\r\nHTTP/1.1 200 OK\r\n\r\npage!!\r\n\r\n"
    fields, block = warc.parse(foreign)
    assert warc._payload(fields, block) == b"page!!" and "warc-payload-digest" not in fields
    one = warc.parse(next(warc.members([warc.record(3, "u", b"z" * (9 << 20))])))  # inflated in steps
    assert len(one[1]) == 9 << 20 and one[0]["warc-date"].endswith("Z") and one[0]["warc-record-id"].startswith("<urn:uuid:")
    assert warc.parse(next(warc.members([warc.info("a")])))[0]["warc-type"] == "warcinfo"
    good = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Payload-Digest: sha1:X\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    for bad in (good, good.replace(b": 2", b": 3"), b"x" + good):
        with pytest.raises(ValueError):
            warc.parse(bad)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(TR))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t, *_ in rows if i is not None]
    label = {i: i for i, _ in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, u in sets[:a]:
            if s and u and 100 * len(s & u) >= 75 * len(s | u):
                x, y = find(i), find(j)
                label[max(x, y)] = min(x, y)
    return {i: find(i) for i in label}


def test_ngram_join(docs, empty, spark):
    rng = random.Random(5)
    base = [f"w{k}" for k in range(60)]
    near = [(1000 + k, " ".join(f"v{rng.randint(0, 9)}" if rng.random() < 0.02 * (k % 4) else w for w in base), "en", "s", 1) for k in range(60)]
    rows = corpus() + near
    got = ngram_join.ngram_join(docs.unionByName(spark.createDataFrame(near, SCHEMA)).withColumn("s1", F.lit(1))).collect()
    assert len(got) == len(rows)
    want = brute_components(rows)
    sizes = {i: {len(shingles(t)) for j, t, *_ in rows if j == i} for i in want}
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.n_shingles == 2
        else:
            assert r.component_id == want[r.doc_id] and r.n_shingles in sizes[r.doc_id]
    assert ngram_join.ngram_join(empty).isEmpty()


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 102), (7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).isEmpty()


def by_id(rows):
    return sorted({(-(1 << 62) if i is None else i, t or "") for i, t, *_ in rows})


def test_line_dedup(docs, empty):
    seen, want = set(), {}
    order = sorted(by_id(corpus()))
    for i, t in order:
        lines, out = t.split("\n"), []
        cut = line_dedup.chunks(t) if "\n" in t else [(0, len(lines))]
        for k, (a, b) in enumerate(cut):
            lone = k == len(cut) - 1 > 0 and b - a == 1  # a last line goes with the chunk before it or not at all
            body = "\n".join(lines[cut[k - 1][0] if lone else a : b])
            if (b - a > 1 or lone) and body.strip():
                if body in seen:
                    continue
                seen.add(body)
            out += lines[a:b]
        want[i, t] = "\n".join(out)
    got = line_dedup.remove_repeated_chunks(docs.withColumn("_removed", F.lit("x")).withColumn("k", F.lit(1))).collect()
    assert len(got) == len(corpus()) and any(r._removed for r in got)
    for r in got:
        assert (r._clean or "") == want[-(1 << 62) if r.doc_id is None else r.doc_id, r.text or ""] and (r._clean is None) == (r.text is None) and r.k == 1
    assert line_dedup.remove_repeated_chunks(empty).isEmpty()


def test_chunks_resist_shifts():
    rng = random.Random(1)
    lines = ["".join(rng.choices("abcdef ", k=20)) for _ in range(200)]
    body = lambda text: {"\n".join(text.split("\n")[a:b]) for a, b in line_dedup.chunks(text)}
    a, b = body("\n".join(lines)), body("\n".join(["new", *lines]))
    assert len(a & b) > 0.9 * len(a) and line_dedup.chunks("one") == [(0, 1)]


def test_chunks_keep_a_lone_last_line_apart(spark):
    rng = random.Random(6)
    line = lambda: "".join(rng.choices("abcdefgh ", k=30))
    rows = []
    for k in range(40):  # a block, cut before its end where the hash says so, and a last line of its own
        block = [line() for _ in range(6)]
        cut = line_dedup.chunks("\n".join(block + [line(), line(), line()]))
        whole = [b for _, b in cut if b <= 6]
        if whole:
            rows += [(2 * k + j, "\n".join([*block[: whole[-1]], line()]), whole[-1]) for j in (0, 1)]
    assert len(rows) > 40
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    removed = {r.doc_id: r._removed for r in line_dedup.remove_repeated_chunks(df).collect()}
    assert removed == {i: n if i % 2 else 0 for i, _, n in rows}


def test_span_dedup(docs, empty, spark):
    passage = "Here begins a passage of many words that stands in two of them. It goes on for a second sentence of some length here. And then a third one ends it after quite some more words than that, so there. Last."
    more = [(900, "Something first. " + passage + " After.", "en", "s", 1), (901, "Else\n" + passage.replace(" ", "  "), "en", "s", 1), (902, "Nothing of the kind.", "en", "s", 1)]
    got = span_dedup.remove_repeated_spans(docs.unionByName(spark.createDataFrame(more, SCHEMA)).withColumn("drop", F.lit(1))).collect()
    clean = {r.doc_id: r._clean for r in got}
    assert len(got) == len(corpus()) + 3 and clean[900] == more[0][1] and clean[902] == more[2][1] and "passage" not in clean[901] and clean[901].startswith("Else")
    seen = set()
    want = {}
    for i, t in sorted(by_id(corpus() + more), key=lambda x: x[0]):
        parts = span_dedup.sentences(t)
        words, drop = [p.split() for p in parts], set()
        for k in range(len(parts)):
            n = 0
            for j in range(k, len(parts)):
                n += len(words[j])
                if j - k >= 2 and n >= 20:
                    key = tuple(map(tuple, words[k : j + 1]))
                    drop |= set(range(k, j + 1)) if key in seen else set()
                    seen.add(key)
                    break
        want[i] = "".join(p for k, p in enumerate(parts) if k not in drop) if drop else t
    for r in got:
        if r.doc_id is not None:
            assert (r._clean or "") == want[r.doc_id]
    assert span_dedup.remove_repeated_spans(empty).isEmpty()


def test_span_dedup_inside_long_sentences(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("bcdfgaeiou", k=6))
    rows = []
    for k in range(60):  # a passage of one sentence, with other words before and after it in that sentence
        passage = [word() for _ in range(60)]
        rows += [(2 * k + j, " ".join([word() for _ in range(3 + k % 7 + 4 * j)] + passage + [word() for _ in range(5)]) + ".", "en", "s", 1) for j in (0, 1)]
    assert all("".join(span_dedup.sentences(r[1])) == r[1] for r in rows)
    got = {r.doc_id: r for r in span_dedup.remove_repeated_spans(spark.createDataFrame(rows, SCHEMA)).collect()}
    left = [len(got[2 * k + 1]._clean.split()) - 5 - (3 + k % 7 + 4) for k in range(60)]
    assert all(got[2 * k]._removed == 0 for k in range(60)) and max(left) <= 35 and sum(left) / 60 < 20


def test_decontamination(docs, empty, spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("bcdfgaeiou", k=7))
    items = [(k, " ".join(word() for _ in range(rng.randint(15, 50))) + ". The answer is " + word() + ".") for k in range(12)] + [(90, None), (91, "..."), (92, "")]
    leaks = [(2000 + k, "Some text before it. " * 3 + t.upper() + " and some after.", "en", "s", 1) for k, t in items[:12]]
    changed = items[0][1].split(" ")
    changed[4], changed[9] = "other", "words"
    leaks.append((3000, " ".join(changed), "en", "s", 1))
    bench = spark.createDataFrame(items + items[:2], "item_id long, text string")
    got = decontamination.contaminated(docs.unionByName(spark.createDataFrame(leaks, SCHEMA)), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(2000 + k, k) for k in range(12)} | {(3000, 0)}
    assert decontamination.contaminated(empty, bench).isEmpty() and decontamination.contaminated(docs, bench.limit(0)).isEmpty()


def test_decontamination_finds_short_and_long_items(spark):
    rng = random.Random(21)
    word = lambda n=7: "".join(rng.choices("bcdfgaeiou", k=n))
    items = [(k, [word() for _ in range(n)]) for k, n in enumerate([15, 16, 18, 20] * 10 + [150, 400])]
    rows, want = [], set()
    for k, own in items:
        for at in range(0, 16, 3):
            kept = own
            if len(own) <= 20:  # a paraphrase: fewer than 60 % of the words, spread, and the answer
                keep = set(rng.sample(range(len(own) - 1), math.ceil(0.5 * len(own)) - 1)) | {len(own) - 1}
                kept = [w if i in keep else word() for i, w in enumerate(own)]
            rows.append((len(rows), " ".join([word(9) for _ in range(40 + at)] + kept + [word(9) for _ in range(40)]), "en", "s", 1))
            want.add((rows[-1][0], k))
    bench = spark.createDataFrame([(k, " ".join(own), own[-1]) for k, own in items], "item_id long, text string, a string")
    got = decontamination.contaminated(spark.createDataFrame(rows, SCHEMA).repartition(3), bench, answer="a").collect()
    assert {(r.doc_id, r.item_id) for r in got} == want


def test_candidates_are_all_pairs():
    rng = np.random.default_rng(3)
    items = rng.standard_normal((7, 5)).astype(np.float32)
    items /= np.linalg.norm(items, axis=1, keepdims=True)
    part = rng.uniform(0.2, 0.9, 7)
    text = np.sort(rng.integers(0, 9, 200))
    steps = rng.standard_normal((200, 5)).astype(np.float32)
    steps[rng.random(200) < 0.3] = 0  # steps without a word of the vocabulary
    square = (steps.astype(np.float64) ** 2).sum(1) * rng.uniform(1, 40, 200) + 0.1
    for width in (1, 2, 4):
        want = {}
        for w in range(200):
            own = [k for k in range(w, min(w + width, 200)) if text[k] == text[w]]
            x, size = steps[own].sum(0, dtype=np.float64), np.sqrt(square[own].sum())
            length = np.linalg.norm(x)
            for i in range(7):
                if length > 0 and length / size >= decontamination.INSIDE * part[i] and (c := x @ items[i] / length) >= decontamination.COSINE:
                    want[w, i] = c
        *pairs, cosine = decontamination.candidates(decontamination.window_sums(steps, text, width), decontamination.window_sums(square, text, width), items, part)
        got = dict(zip(zip(*(p.tolist() for p in pairs), strict=True), cosine.tolist(), strict=True))
        assert {k for k, c in want.items() if c > decontamination.COSINE + 1e-4} <= set(got) and len(got) == len(cosine)
        assert all(abs(want.get(k, decontamination.COSINE) - c) < 1e-4 for k, c in got.items())


def test_common_words_equal_counters():
    rng = random.Random(4)
    at = np.array([rng.randint(-1, 9) for _ in range(400)])
    counts = np.array([[rng.choice([0, 0, 1, 3]) for _ in range(10)] for _ in range(5)])
    lo = np.array([rng.randint(0, 380) for _ in range(5000)])
    hi, item = lo + np.array([rng.randint(1, 20) for _ in lo]), np.array([rng.randint(0, 4) for _ in lo])
    want = [sum(min(n, counts[i, w]) for w, n in Counter(at[a:b].tolist()).items() if w >= 0) for a, b, i in zip(lo, hi, item, strict=True)]
    assert decontamination.common_words(at, lo, hi, item, counts).tolist() == want


def _related(seed: int):
    """Passages of six topics; a topic's words come in pairs of synonyms, of which a passage has one each."""
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choices("bcdfgaeiou", k=n))
    common = [word(3) for _ in range(40)]
    topics = [[(word(8), word(8)) for _ in range(14)] for _ in range(40)]
    passage = lambda t: " ".join(rng.choice(p) for p in rng.sample(t, 14)) + " " + " ".join(rng.choices(common, k=18))
    return rng, common, topics, [passage(t) for t in topics for _ in range(40)]


def _matrix(texts, vocabulary, idf):
    """Unit TF-IDF passages over the vocabulary, the words outside it in the norm alone."""
    h, index, offsets = decontamination._words(pa.array(texts))
    rows = []
    for a in range(len(texts)):
        for b in range(offsets[a], offsets[a + 1], decontamination.PASSAGE):
            own = h[index[b : min(b + decontamination.PASSAGE, offsets[a + 1])]]
            weight, at = decontamination._gather(own, np.arange(len(own)), vocabulary, idf)
            row = np.zeros(len(vocabulary))
            np.add.at(row, at[at >= 0], weight[at >= 0])
            rows.append(row / np.sqrt((weight.astype(float) ** 2).sum()))
    return np.array(rows)


def test_decontamination_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "ITEM_BLOCK", 5)
    rng = random.Random(31)
    word = lambda: "".join(rng.choices("bcdfgaeiou", k=6))
    items = [(k, " ".join(word() for _ in range(rng.randint(12, 60)))) for k in range(23)] + [(50, None), (51, " ")]
    rows = [(k, f"{' '.join(word() for _ in range(k % 9))} {t} {word()}", "en", "s", 1) for k, t in items[:23]] + [(100 + k, " ".join(word() for _ in range(60)), "en", "s", 1) for k in range(30)]
    rows += [(None, items[0][1], "en", "s", 1), rows[3], (200, None, "en", "s", 1), (201, "", "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("lang", "cosine").withColumn("d", F.lit(1)).repartition(4)
    got = decontamination.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(((-1 if r.doc_id is None else r.doc_id), r.item_id) for r in got) == sorted([(k, k) for k in range(23)] + [(-1, 0)])


@pytest.mark.parametrize("gram", [4096, 0])
def test_latent_space_is_the_svd(spark, monkeypatch, gram):
    monkeypatch.setattr(decontamination, "GRAM", gram)
    _, _, topics, texts = _related(5)
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "d long, t string").repartition(3)
    idf = decontamination._weights(df)
    items = decontamination._Items([(k, " ".join(p[0] for p in t), None) for k, t in enumerate(topics)])
    vectors, values = decontamination.latent_space(df, items.words, items.vocabulary, idf)
    own = [np.bincount(np.searchsorted(items.vocabulary, w), minlength=len(items.vocabulary)) * idf[decontamination._cell(items.vocabulary)] for w in items.words]
    passages = _matrix(texts, items.vocabulary, idf)
    whole = np.concatenate([np.array([x / np.linalg.norm(x) for x in own]), passages * np.sqrt(len(own) / len(passages))])
    _, exact, right = np.linalg.svd(whole, full_matrices=False)
    rank = decontamination.rank_for(len(own), len(items.vocabulary))
    assert vectors.shape == (len(items.vocabulary), rank) and rank < len(own) / 2
    assert np.allclose(vectors.T @ vectors, np.eye(rank), atol=1e-6)
    assert np.allclose(values, exact[:rank], rtol=0.03)
    assert ((whole @ vectors) ** 2).sum() > 0.97 * (exact[:rank] ** 2).sum()  # as much as the best space of this rank, nearly


def test_paraphrases_that_share_few_rare_words(spark):
    """An item's rare words are all replaced by synonyms, which other items have and which stand with its topic's words elsewhere; what is shared is common words."""
    rng, common, topics, texts = _related(6)
    topics, texts = topics[:20], texts[: 20 * 40]
    items, leaks, plain = [], [], []
    for k, t in enumerate(topics):
        filler = rng.sample(common, 14)
        say = lambda side, filler: " ".join(x for p, c in zip(t, filler, strict=True) for x in (p[side], c))  # noqa: B023, E731
        items.append((k, say(0, filler), " ".join(filler[-3:])))
        leaks.append((5000 + k, say(1, filler)))
    for k, t in enumerate(topics * 3):
        filler = rng.sample(common, 14)
        items.append((100 + k, " ".join(x for p, c in zip(t, filler, strict=True) for x in (p[k // 20 % 2], c)), "no such words"))
    docs = spark.createDataFrame([*enumerate(texts), *leaks], "doc_id long, text string").repartition(3)
    got = decontamination.contaminated(docs, spark.createDataFrame(items, "item_id long, text string, a string"), answer="a").collect()
    found = {(r.doc_id, r.item_id) for r in got}
    assert sum((5000 + k, k) in found for k in range(len(topics))) >= 0.9 * len(topics)
    idf = decontamination._weights(docs.select(F.col("text").alias("t")))
    for (_, item, _), (_, leak) in zip(items[: len(leaks)], leaks, strict=True):
        vocabulary = np.unique(np.concatenate([decontamination._words(pa.array([x]))[0] for x in (item, leak)]))
        a, b = _matrix([item, leak], vocabulary, idf)
        plain.append(a @ b)
    assert max(plain) < 0.22  # cosines of TF-IDF


def test_common_subsequence():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = rng.integers(0, 6, 12), rng.integers(0, 6, 20)
        t = np.zeros((13, 21), int)
        for i in range(12):
            for j in range(20):
                t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
        assert decontamination.common_subsequence(a, b) == t[-1, -1]


def test_lm_scoring(docs, empty):
    rows = corpus()
    tokens = [(i, [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(TR)), None]) for i, t, *_ in rows]
    learned = [w for i, w in tokens if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    count = Counter(x for w in learned for x in w)
    n, v = sum(count.values()), len(count)
    got = lm_scoring.lm_scores(docs).collect()
    assert len(got) == len(rows)
    want = Counter()
    for i, w in tokens:
        want[i, None if i is None else zlib.crc32(str(i).encode()) % 7 == 2, len(w), sum(count[x] > 0 for x in w), round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), 6)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) and {r.train_tokens for r in got} == {n}
    assert lm_scoring.lm_scores(empty).isEmpty()


def test_pipeline(docs, spark, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, corpus()[4][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, str(tmp_path)).checkpoint()
        assert kept.columns == docs.columns, name
        assert kept.count() <= before.count()
    ids = {r.doc_id for r in kept.collect()}
    assert 4 not in ids and not ids & {500, 501, 502} and {1, 2, 7} <= ids and not any(120 <= (i or 0) < 150 and (i - 120) % 3 == 0 for i in ids)
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == ids
