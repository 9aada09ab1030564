"""Operator 11. License scans: an Aho-Corasick automaton finds identifier tags and notice phrases, and a
shunting-yard parser evaluates the license expressions that follow a tag.

A text's words are runs of digits, letters and all that is not ASCII, with A-Z in lower case; one pass of the
automaton over them finds every phrase that stands in consecutive words, whatever separates these. Where a tag
(``SPDX-License-Identifier`` or ``License-Identifier``) stands, the expression after it is read from the text
itself: identifiers joined by ``and``, ``or``, ``with`` and parentheses, up to the first token that cannot go on.

An expression is evaluated to how much it binds (``TERMS``): ``or`` leaves the choice of the mildest, ``and``
obliges to the strictest, ``with`` an exception loosens strong copyleft by one step. A document's terms are the
strictest of all that is found in it. The score is 1 less the product of what each kind of evidence leaves open:
a tag 0.05, a notice phrase 0.2, a bare license name 0.5.

Null and empty texts have no words, labels or terms and score 0. Rows with a null doc_id and repeated rows each get
their result. Other columns are kept, but for those named in ``ADDED``. An empty table gives no rows. Texts are
scanned whole, however long; an expression ends at the first token that does not belong to it, so its length is
its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._common import documents, row_slices

#: Names of licenses as words, and the label of each.
NAMES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notice phrases, in words, and the label of each.
NOTICES = {
    "permission is hereby granted free of charge": "mit",
    "licensed under the apache license version 2 0": "apache-2.0",
    "apache license version 2 0": "apache-2.0",
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "gnu affero general public license": "agpl",
    "gnu lesser general public license": "lgpl",
    "mozilla public license version 2 0": "mpl-2.0",
    "redistribution and use in source and binary forms": "bsd",
    "permission to use copy modify and or distribute this software": "isc",
    "released into the public domain": "public-domain",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "cc by 4 0": "cc-by-4.0",
    "cc by sa 4 0": "cc-by-sa-4.0",
    "cc by nc 4 0": "cc-by-nc-4.0",
    "cc0 1 0": "cc0-1.0",
    "all rights reserved": "all-rights-reserved",
}
TAGS = ("spdx license identifier", "license identifier")
#: How much a license binds, mildest first.
TERMS = ("permissive", "weak-copyleft", "strong-copyleft", "non-commercial", "unknown")
#: Terms by how an identifier begins.
FAMILIES = {
    "mit": 0, "apache": 0, "bsd": 0, "isc": 0, "cc0": 0, "cc-by-nc": 3, "cc-by-sa": 2, "cc-by": 0, "unlicense": 0, "zlib": 0, "public-domain": 0,
    "lgpl": 1, "mpl": 1, "epl": 1, "agpl": 2, "gpl": 2, "all-rights-reserved": 4,
}
LEFT_OPEN = {"tag": 0.05, "notice": 0.2, "name": 0.5}
ADDED = ("_words", "_places", "_first", "_last", "_base", "_labels", "_expressions", "_terms", "_score")

#: Bytes that are no part of a word become spaces, A-Z become a-z.
WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
TAG_IN_TEXT = re.compile(r"(?:spdx[^0-9a-z\x80-\U0010ffff]+)?license[^0-9a-z\x80-\U0010ffff]+identifier[ \t]*:?[ \t]*", re.IGNORECASE | re.ASCII)
TOKEN = re.compile(r"[ \t]*([()]|[A-Za-z0-9][A-Za-z0-9.+:-]*)")
#: Operators by how closely they bind.
BINDS = {"or": 1, "and": 2, "with": 3}


def terms_of(identifier: str) -> int:
    """Place in ``TERMS``: by the longest family that begins the identifier."""
    own = identifier.lower()
    known = [f for f in FAMILIES if own == f or own.startswith((f + "-", f + "+"))]
    return FAMILIES[max(known, key=len)] if known else len(TERMS) - 1


def parse(text: str, at: int = 0) -> tuple[list[str], int]:
    """The longest license expression that begins at ``at``, in postfix order, and where it ends ([] where there is none).

    Shunting-yard: operands go out at once, an operator first sends out those that bind as closely.
    What follows the last complete expression (an operator without operand, an unclosed parenthesis) is no part of it.
    """
    out, held, want_operand, depth = [], [], True, 0
    complete, end = [], at
    while found := TOKEN.match(text, at):
        token = found[1].rstrip(".:") or found[1]
        word = token.lower()
        if want_operand:
            if token == "(":
                held.append("(")
                depth += 1
            elif token == ")" or word in BINDS:
                break
            else:
                out.append(word)
                want_operand = False
        elif word in BINDS:
            while held and held[-1] != "(" and BINDS[held[-1]] >= BINDS[word]:
                out.append(held.pop())
            held.append(word)
            want_operand = True
        elif token == ")" and depth:
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
            depth -= 1
        else:
            break
        at = found.end()
        if not want_operand and not depth:
            complete, end = [*out, *reversed(held)], at
        if len(token) < len(found[1]):
            break  # a full stop ends the sentence
    return complete, end


def evaluate(postfix: list[str]) -> tuple[int, list[str]]:
    """How much an expression binds (place in ``TERMS``), and the licenses it names, exceptions joined to theirs."""
    stack: list[tuple[int, list[str]]] = []
    for token in postfix:
        if token not in BINDS:
            stack.append((terms_of(token), [token]))
            continue
        (b, right), (a, left) = stack.pop(), stack.pop()
        if token == "with":
            stack.append((1 if a == 2 else a, [f"{x} with {y}" for x in left for y in right]))
        else:
            left.extend(right)
            stack.append((max(a, b) if token == "and" else min(a, b), left))
    return stack.pop() if stack else (0, [])


@cache
def _automaton() -> ahocorasick.Automaton:
    found: dict[str, list[tuple[str, str, int]]] = {}
    for kind, phrases in (("name", NAMES), ("notice", NOTICES), ("tag", dict.fromkeys(TAGS, ""))):
        for phrase, label in phrases.items():
            found.setdefault(phrase, []).append((kind, label, len(phrase) + 2))
    out = ahocorasick.Automaton()
    for phrase, values in found.items():
        out.add_word(f" {phrase} ", values)
    out.make_automaton()
    return out


def scan(text: str | None) -> tuple[int, int, int | None, int | None, list[str], list[str], list[str], str | None, float]:
    """What ``ADDED`` names, of one text."""
    words = (text or "").encode().translate(WORD_BYTES).split()
    if not words:
        return 0, 0, None, None, [], [], [], None, 0.0
    plain = f" {b' '.join(words).decode()} "
    places, first, last, base, labels, terms, kinds = 0, None, None, set(), set(), set(), set()
    for end, values in _automaton().iter(plain):
        for kind, label, length in values:
            kinds.add(kind)
            if kind != "tag":
                labels.add(label)
                terms.add(terms_of(label))
            if kind == "name":
                start = end - length + 1
                first, last = start if first is None else min(first, start), start if last is None else max(last, start)
                places += 1
                base.add(label)
    expressions = set()
    if "tag" in kinds:
        kinds.discard("tag")  # only one with an expression counts
        for found in TAG_IN_TEXT.finditer(text):
            postfix, end = parse(text, found.end())
            if postfix:
                bound, named = evaluate(postfix)
                labels.update(named)
                terms.add(bound)
                kinds.add("tag")
                expressions.add(text[found.end() : end].strip())
    number = lambda at: None if at is None else plain.count(" ", 0, at + 1) - 1
    open_ = 1.0
    for kind in kinds:
        open_ *= LEFT_OPEN[kind]
    return len(words), places, number(first), number(last), sorted(base), sorted(labels), sorted(expressions), TERMS[max(terms)] if terms else None, 1 - open_


def scan_licenses(df: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``df`` and those of ``ADDED``: numbers of words and of places of ``NAMES``, the first and last
    such place (in words), labels of ``NAMES``, all labels, expressions after tags, terms, score."""
    own = F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in ADDED]).alias("_row")
    kinds = [pa.int64()] * 4 + [pa.list_(pa.string())] * 3 + [pa.string(), pa.float64()]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in row_slices(batches, text):
            texts = part.column("_row").field(part.column("_row").type.get_field_index(text)).to_pylist()
            found = [scan(t) for t in texts]
            columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([part.column("_row"), *columns], ["_row", *ADDED])

    rows = df.select(own)
    added = "_words long, _places long, _first long, _last long, _base array<string>, _labels array<string>, _expressions array<string>, _terms string, _score double"
    return rows.mapInArrow(each, f"_row {rows.schema['_row'].dataType.simpleString()}, {added}").select("_row.*", *ADDED)


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.col("_words").alias("n_words"),
        F.col("_places").alias("n_base"),
        F.col("_first").alias("first_word"),
        F.col("_last").alias("last_word"),
        F.concat_ws(",", "_base").alias("base_labels"),
        F.concat_ws(",", "_labels").alias("labels"),
        F.col("_score").alias("score"),
        F.col("_terms").alias("terms"),
        F.concat_ws(" | ", "_expressions").alias("expressions"),
    )
