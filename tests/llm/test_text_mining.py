"""License scans, spelling variants and collocations against brute force."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import _bloom, collocations, license_scan, spelling

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string"


def docs(spark, texts, langs=None):
    return spark.createDataFrame([(k, t, (langs or {}).get(k, "en"), "s") for k, t in enumerate(texts)], DOCS)


# ---- licenses


def plain_scan(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    found = [(k, label) for phrase, label in license_scan.NAMES.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    starts = [k for k, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


TEXTS = [
    None, "", " \t\n", "MIT License", "mit-license MIT\nLICENSE mit license", "Licensed under the Apache License, Version 2.0.", "mit licenses, summit license",
    "GNU General Public License, version 3", "général public license; GENERAL PUBLIC LICENSE", "ÀMIT license mit license", "// SPDX-License-Identifier: MIT OR (Apache-2.0 AND GPL-2.0-only WITH Classpath-exception-2.0)\ncode",
    "SPDX-License-Identifier: ((MIT", "mit license " * 300_000, "x" * 3_000_000 + " apache license", "SPDX-License-Identifier:", "a\x00mit\x01license\x7fb",
]


def test_licenses_equal_brute_force(spark):
    df = docs(spark, TEXTS + ["mit license"] * 2).withColumn("_labels", F.lit("own"))
    rows = license_scan.scan_licenses(df).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        assert (r["_words"], r["_places"], r["_first"], r["_last"], ",".join(r["_base"])) == plain_scan(r["text"])
        assert set(r["_base"]) <= set(r["_labels"]) and 0 <= r["_score"] <= 1 and (r["_score"] > 0) == bool(r["_labels"])
    assert license_scan.scan_licenses(df.limit(0)).count() == 0


def test_license_query_over_the_given_documents(spark):
    from tidemark.llm._common import documents

    got = {r["doc_id"]: r for r in license_scan.op11_license_scan(spark, SF).collect()}
    for r in documents(spark, SF).collect():
        g = got[r["doc_id"]]
        assert (g["n_words"], g["n_base"], g["first_word"], g["last_word"], g["base_labels"]) == plain_scan(r["text"])


def test_expressions():
    def of(text):
        postfix, end = license_scan.parse(text)
        return (license_scan.TERMS[license_scan.evaluate(postfix)[0]], license_scan.evaluate(postfix)[1], text[:end]) if postfix else None

    assert of("MIT") == ("permissive", ["mit"], "MIT")
    assert of("GPL-2.0 OR MIT")[0] == "permissive" and of("GPL-2.0 AND MIT")[0] == "strong-copyleft"
    assert of("MIT OR GPL-2.0 AND CC-BY-NC-4.0")[0] == "permissive"  # and binds closer
    assert of("(MIT OR GPL-2.0) AND CC-BY-NC-4.0")[0] == "non-commercial"
    assert of("GPL-2.0-only WITH Classpath-exception-2.0") == ("weak-copyleft", ["gpl-2.0-only with classpath-exception-2.0"], "GPL-2.0-only WITH Classpath-exception-2.0")
    assert of("MIT AND") == ("permissive", ["mit"], "MIT") and of("MIT */ code")[2] == "MIT" and of("MIT) OR X")[2] == "MIT"
    assert of("Apache-2.0. Then MIT")[1] == ["apache-2.0"] and of("((MIT") is None and of("") is None and of("and MIT") is None
    assert of("((MIT) OR (ISC))")[1] == ["mit", "isc"] and of("Foo-1.0")[0] == "unknown" and of("LGPL-2.1+")[0] == "weak-copyleft"


# ---- spelling variants


def plain_words(rows, drop=None):
    seen = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if drop and h % drop == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 7 and n >= 2}


def plain_variants(words):
    near = defaultdict(set)
    masks = defaultdict(list)
    for w in words:
        for k in range(len(w)):
            masks[w[:k], w[k + 1 :]].append(w)
            if (v := w[:k] + w[k + 1 :]) in words:
                near[w].add(v), near[v].add(w)
    for own in masks.values():
        for w in own:
            near[w].update(v for v in own if v != w)
    form = {}
    for w, n in words.items():
        best = min(((-words[v], v) for v in near[w]), default=None)
        form[w] = best[1] if best and -best[0] >= 10 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, n, form[w], root, len(near[w]), words[form[w]] if form[w] else None))
    return out


def as_set(df):
    rows = [(r["word"], r["n"], r["form"], r["root"], r["n_near"], r["form_n"]) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("pass_bytes", [spelling.PASS_BYTES, 192])
def test_variants_equal_brute_force(spark, pass_bytes):
    rng = np.random.default_rng(5)
    words = {}
    for _ in range(150):
        word = "".join(rng.choice(list("abcàÀ"), rng.integers(6, 11)))
        n = int(10 ** rng.uniform(3, 6))
        for _ in range(25):
            words.setdefault(word, n)
            kind, k, c = rng.integers(3) if len(word) > 6 else 1, rng.integers(len(word)), rng.choice(list("abcàÀ"))
            word = word[:k] + (c if kind else "") + word[k + (kind != 1) :]
            n = max(2, int(n / 10 ** rng.uniform(0, 2)))
    words = {w: n for w, n in words.items() if len(w) >= 7}
    long = "a" * 5000
    words |= {long: 30, long + "b": 3, long[:-1] + "c": 2, "zzzzzzz": 2}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got, want = as_set(spelling.variants(df, pass_bytes=pass_bytes)), plain_variants(words)
    assert got == want
    assert any(r[3] not in (r[0], r[2]) for r in want)  # chains of several steps


def test_filters_of_many_passes_hold_every_word(spark):
    units = spelling.Units({7: 1000, 8: 10, 64: 3, 70: 5000}, 16)
    assert len(units.passes) > 5 and all(p.sum() <= 16 for p in units.passes)
    assert (sum(p > 0 for p in units.passes) <= 1).all()
    keys = np.random.default_rng(0).integers(0, 1 << 64, 3000, dtype=np.uint64)
    df = spark.createDataFrame([(0, int(k)) for k in keys.view(np.int64)], "unit int, key long")
    held = _bloom.build(df, np.zeros(1, np.int64), np.array([_bloom.blocks_for(3000)]))
    assert len(held.places(keys)) == 3000
    others = np.random.default_rng(1).integers(0, 1 << 64, 100_000, dtype=np.uint64)
    assert len(held.places(others)) < 1500


def test_word_counts_with_edge_cases(spark):
    rows = [(1, "Abcdefgh abcdefgh ABCDEFGH short"), (1, "Abcdefgh abcdefgh ABCDEFGH short"), (None, "nothing nothing"), (2, None), (3, ""), (4, "ÀÉÎÕÜßé àéîõüßé x" * 3), (5, "x" * 100_000 + " " + "x" * 100_000)]
    rows += [(k, "spelling variants everywhere and elsewhere") for k in range(60)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "doc_id long, text string, word string")
    got = {r["word"]: r["n"] for r in spelling.word_counts(df, drop_one_in=31).collect()}
    assert got == plain_words(rows, 31) and plain_words(rows, 31) != plain_words(rows)
    assert spelling.word_counts(df.limit(0)).count() == 0
    assert spelling.variants(spelling.word_counts(df.limit(0))).count() == 0


def test_spelling_query_equals_brute_force(spark):
    from tidemark.llm._common import documents

    rows = [(r["doc_id"], r["text"]) for r in documents(spark, SF).collect()]
    assert as_set(spelling.op12_spelling_variants(spark, SF)) == plain_variants(plain_words(rows, 31))


# ---- collocations


def plain_collocations(rows, least, top):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, 5):
                for k in range(len(words) - size + 1):
                    f[lang, *words[k : k + size]] += 1
    candidates = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    gone = set()
    for p, longer in candidates.items():
        words = p[1:]
        for size in range(2, len(words)):
            for k in range(len(words) - size + 1):
                if 100 * longer >= 80 * f[p[0], *words[k : k + size]]:
                    gone.add((p[0], *words[k : k + size]))
    by = defaultdict(list)
    for p, a in candidates.items():
        if p not in gone:
            cuts = [(2_000_000 * a // (f[p[: k + 1]] + f[p[0], *p[k + 1 :]]), k, f[p[: k + 1]], f[p[0], *p[k + 1 :]]) for k in range(1, len(p) - 1)]
            score, _, l, r = min(cuts)
            by[p[0]].append((-score, -a, " ".join(p[1:]).encode(), l, r))
    return {(lang, k, p.decode(), -a, l, r, n[lang], -score) for lang, own in by.items() for k, (score, a, p, l, r) in enumerate(sorted(own)[:top], 1)}


def mined(df, least, top, **more):
    phrases, totals = collocations.frequent_phrases(df, least=least, **more)
    rows = [tuple(r) for r in collocations.collocations(phrases, totals, least, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def phrase_rows(seed=3):
    rng = np.random.default_rng(seed)
    vocabulary = [*"abcdefg", "New", "york", "CITY", "é", "Ünder", "\x00z", " "]
    weights = np.array([1 / (k + 1) for k in range(len(vocabulary))])
    rows = []
    for k in range(120):
        words = rng.choice(vocabulary, rng.integers(0, 60), p=weights / weights.sum())
        text = "".join(w + str(rng.choice([" ", "  ", "\t", ", ", ".", "\n", " ; ", "\x0b"], p=[0.7, 0.05, 0.05, 0.05, 0.05, 0.05, 0.03, 0.02])) for w in words)
        rows.append((text + " new york city hall" * int(rng.integers(3)), [None, "en", "de"][k % 3]))
    return [*rows, (None, "en"), ("", None), ("...", "fr"), ("new york city hall " * 400, "en"), *[("same text here", "en")] * 12]


@pytest.mark.parametrize("filter_bytes", [collocations.FILTER_BYTES, 64])
def test_collocations_equal_brute_force(spark, monkeypatch, filter_bytes):
    monkeypatch.setattr(collocations, "KEY_OCCURRENCES", 50)  # several keys for frequent prefixes
    monkeypatch.setattr(collocations, "SLICE", 700)
    rows = phrase_rows()
    df = spark.createDataFrame([(*r, "extra") for r in rows], "text string, lang string, phrase string")
    want = plain_collocations(rows, 5, 40)
    assert len(want) > 60 and mined(df, 5, 40, filter_bytes=filter_bytes) == want
    assert mined(df.limit(0), 5, 40) == set()


def test_stripes_hold_totals_and_extensions(spark):
    rows = phrase_rows(9)
    df = spark.createDataFrame(rows, "text string, lang string").select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    all_ = collocations.stripes(df, range(0, 4))
    exchanges = all_._jdf.queryExecution().executedPlan().toString().count("Exchange ")
    assert exchanges == 1  # stripes are added up where they meet
    rows = all_.collect()
    stripe = defaultdict(Counter)
    for r in rows:
        stripe[r["lang"], r["prefix"]][r["next"]] += r["n"]
    for (lang, prefix), entries in stripe.items():
        if prefix:
            *before, last = prefix.split(" ")
            assert sum(entries.values()) == stripe[lang, " ".join(before)][last]


def test_collocation_query_equals_brute_force(spark):
    from tidemark.llm._common import documents

    rows = [(r["text"], r["lang"]) for r in documents(spark, SF).collect()]
    got = {tuple(r) for r in collocations.op13_collocations(spark, SF).collect()}
    assert got == plain_collocations(rows, 30, 2000) and len(got) > 20
