"""Licence scans: Aho-Corasick over words, and licence expressions by shunting-yard (operator 4).

A text becomes its words, lower-cased in ASCII and joined by one blank; one pass of the automaton
finds every base phrase, notice phrase and identifier tag as whole consecutive words. Behind each
tag the expression is read from the text itself, to where prose begins or a line ends with nothing
open (a bracket, an operator), turned into postfix order by precedence (``with`` before ``and`` before
``or``) and evaluated: its licences become labels, ``or`` takes the
more open side, ``and`` the less open one, and ``with`` eases the licence before it.

Score: how open the text's terms are, from 0 (reserved, or nothing found) to 1 (public domain):
the least of all expressions and labels found outside expressions, as all of them bind.

Defined cases: a null or empty text has no words, labels or places and the score 0; overlapping
places all count; equal texts get equal rows; an expression that doesn't parse gives the label
``unparsed`` with the openness of an unknown licence; an empty table gives no rows; columns other
than doc_id and text are ignored; repeated rows stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tessel.llm.common import portions, texts

#: Phrases that the base counts, and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Further notice phrases and the labels that they add.
NOTICES = {
    "all rights reserved": "reserved", "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd", "cc by sa": "cc-by-sa", "cc by nc nd": "cc-by-nc-nd", "cc by nc sa": "cc-by-nc-sa", "cc0 1 0": "cc0",
    "bsd license": "bsd", "boost software license": "boost", "creative commons attribution": "cc-by", "creative commons zero": "cc0", "dedicated to the public domain": "public-domain",
    "eclipse public license": "epl", "gnu affero general public license": "agpl", "gnu free documentation license": "gfdl", "gnu lesser general public license": "lgpl", "isc license": "isc",
    "mozilla public license": "mpl", "permission is hereby granted free of charge": "mit", "permission to use copy modify and or distribute this software": "isc", "released into the public domain": "public-domain",
    "redistribution and use in source and binary forms": "bsd", "this is free and unencumbered software": "unlicense", "zlib license": "zlib",
}

#: Words of identifier tags; an expression follows in the text.
TAGS = ("spdx license identifier", "license expression")
_GAP, _IN_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[0-9A-Za-z\x80-\U0010FFFF]"  # as the words are split
_TAG = re.compile(rf"(?<!{_IN_WORD})(?:spdx{_GAP}license{_GAP}identifier|license{_GAP}expression)(?!{_IN_WORD})", re.I | re.A)

#: How open the terms of a label are; UNKNOWN for others.
OPENNESS = {
    "public-domain": 1.0, "cc0": 1.0, "unlicense": 1.0, "mit": 0.9, "isc": 0.9, "bsd": 0.9, "zlib": 0.9, "boost": 0.9, "apache": 0.85, "cc-by": 0.8, "mpl": 0.6, "epl": 0.6, "lgpl": 0.55,
    "cc-by-sa": 0.5, "gfdl": 0.4, "gpl": 0.4, "agpl": 0.3, "cc-by-nd": 0.2, "cc-by-nc": 0.15, "cc-by-nc-sa": 0.15, "cc-by-nc-nd": 0.1, "reserved": 0.0,
}
UNKNOWN, EASED = 0.25, 0.5  # ``with`` halves the distance to 1

_SPLIT = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else c + 32 if 65 <= c < 91 else 32 for c in range(256))
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+:-]*")


def family(identifier: str) -> str:
    """The label of a licence identifier: its name without versions (``GPL-2.0-only`` is ``gpl``)."""
    name = re.sub(r"-v?\d.*$|v\d[\d.]*\+?$|-only$|-or-later$|\+$", "", identifier.lower())
    return {"bsl": "boost", "cc": "cc0" if "cc0" in identifier.lower() else "cc", "0bsd": "bsd"}.get(name, name)


def postfix(expression: str, begin: int = 0) -> list[str]:
    """Shunting-yard: operands and operators of the licence expression from ``begin`` in postfix order; ValueError if it isn't one."""
    line_end = expression.find("\n", begin) % (len(expression) + 1)  # the text's end without one
    out: list[str] = []
    held: list[str] = []
    operand_next = True
    for match in _TOKEN.finditer(expression, begin):
        if match.start() > line_end:
            if not (out or held) or not (operand_next or "(" in held):
                break  # nothing on the tag's line, or nothing open
            line_end = expression.find("\n", match.start()) % (len(expression) + 1)
        token = match[0]
        low = token.lower()
        if low in _PRECEDENCE:
            if operand_next:
                raise ValueError("operator without a left side")
            while held and held[-1] != "(" and _PRECEDENCE[held[-1]] >= _PRECEDENCE[low]:
                out.append(held.pop())
            held.append(low)
            operand_next = True
        elif token == "(":
            if not operand_next:
                break  # prose follows
            held.append(token)
        elif token == ")":
            if operand_next:
                raise ValueError("nothing before a closing bracket")
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                break
            held.pop()
        elif operand_next:
            out.append(token)
            operand_next = False
        else:
            break  # two operands in a row: prose follows
    if operand_next or "(" in held:
        raise ValueError("the expression doesn't end")
    return out + held[::-1]


def evaluate(expression: str, begin: int = 0) -> tuple[set[str], float]:
    """Labels of an expression and how open its terms are."""
    try:
        steps = postfix(expression, begin)
    except ValueError:
        return {"unparsed"}, UNKNOWN
    stack: list[tuple[set[str], float]] = []
    for step in steps:
        if step in _PRECEDENCE:
            (right, b), (left, a) = stack.pop(), stack.pop()
            stack.append((left, a + (1 - a) * EASED) if step == "with" else (left | right, max(a, b) if step == "or" else min(a, b)))
        else:
            label = family(step)
            stack.append(({label}, OPENNESS.get(label, UNKNOWN)))
    return stack[0]


def automaton():
    import ahocorasick

    out = ahocorasick.Automaton()
    for phrase in {*BASE, *NOTICES, *TAGS}:
        out.add_word(f" {phrase} ", phrase)
    out.make_automaton()
    return out


def scan(text: str, words) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score of one text."""
    found = text.encode().translate(_SPLIT).split()
    line = f" {b' '.join(found).decode('latin-1')} "
    starts, seen = [], set()
    for end, phrase in words.iter(line):
        seen.add(phrase)
        if phrase in BASE:
            starts.append(end - len(phrase) - 1)
    base = {BASE[p] for p in seen if p in BASE}
    labels = base | {NOTICES[p] for p in seen if p in NOTICES}
    terms = [OPENNESS[x] for x in labels]
    if seen.intersection(TAGS):
        for m in _TAG.finditer(text):
            more, open_ = evaluate(text, m.end())
            labels |= more
            terms.append(open_)
    first, last = (line.count(" ", 0, min(starts)), line.count(" ", 0, max(starts))) if starts else (None, None)
    return len(found), len(starts), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), min(terms, default=0.0)


COLUMNS = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64()}


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id and what ``scan`` finds, a row a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = automaton()
        for batch in batches:
            for part in portions(batch):
                rows = zip(*[scan(x, words) for x in part.column("text").to_pylist()], strict=True)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, t) for c, t in zip(rows, COLUMNS.values(), strict=True))], ["doc_id", *COLUMNS])

    return texts(docs).mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
