import re

import numpy as np
import pytest

from tessel.llm import licenses, queries

from .conftest import ODD

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    low = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
    words, places, labels = WORD.findall(low), [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        for k in range(len(words)):
            if words[k : k + len(p)] == p:
                places.append(k)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_op4_equals_brute_force(spark):
    text_of = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op4_license_scan(spark, SF).collect()
    assert {r["doc_id"]: tuple(r)[1:6] for r in rows} == {k: brute(t) for k, t in text_of.items()}
    for r in rows:
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_op4_odd(spark, odd, none):
    more = [(50, "Under the MIT\nLicense, apache-license; CC BY cc by\tnc"), (51, "éMIT license mit licenseé MIT  License"), (52, "x\nSPDX-License-Identifier: (MIT OR GPL-2.0-only WITH Classpath-exception-2.0) AND Apache-2.0\n")]
    docs = odd.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    rows = licenses.scan_licenses(docs).collect()
    assert sorted((r["doc_id"], *map(str, tuple(r)[1:6])) for r in rows) == sorted((i, *map(str, brute(t))) for i, t in ODD + more)
    by = {r["doc_id"]: r for r in rows}
    assert by[50]["labels"] == "apache,cc-by,cc-by-nc,mit" and by[50]["score"] == 0.15
    assert by[52]["labels"] == "apache,gpl,mit" and by[52]["score"] == 0.85
    assert by[2]["score"] == 0 and by[1]["labels"] == ""
    assert licenses.scan_licenses(none).count() == 0


@pytest.mark.parametrize(
    ("text", "want"),
    [("MIT", "MIT"), ("MIT OR BSD-3-Clause AND ISC", "MIT BSD-3-Clause ISC and or"), ("(MIT OR BSD-3-Clause) and ISC", "MIT BSD-3-Clause or ISC and"), ("GPL-2.0+ WITH X or MIT", "GPL-2.0+ X with MIT or"), ("A or B or C", "A B or C or"), ("MIT see file", "MIT")],
)
def test_postfix(text, want):
    assert licenses.postfix(text) == want.split()


@pytest.mark.parametrize("text", ["", "OR MIT", "MIT AND", "(MIT", "()", "MIT OR (BSD"])
def test_not_an_expression(text):
    assert licenses.evaluate(text) == ({"unparsed"}, licenses.UNKNOWN)


def test_families():
    assert [*map(licenses.family, ("MIT", "Apache-2.0", "GPL-3.0-or-later", "BSD-3-Clause", "CC0-1.0", "LGPL-2.1+", "CC-BY-NC-4.0", "ISC"))] == ["mit", "apache", "gpl", "bsd", "cc0", "lgpl", "cc-by-nc", "isc"]
    assert [*map(licenses.family, ("X11", "W3C-19980720", "GPLv2+", "0BSD", "BSL-1.0", "MIT-0", "bzip2-1.0.6"))] == ["x11", "w3c", "gpl", "bsd", "boost", "mit", "bzip2"]


def test_open_expressions_go_on_in_the_next_line():
    words = licenses.automaton()
    tag = "# SPDX-License-Identifier: "
    for text, want in (("(MIT OR\n#  Apache-2.0) AND\n# GPL-3.0\nBSD", "apache,gpl,mit"), ("MIT\nOR Apache-2.0", "mit"), ("MIT OR\n\nISC\nAND GPL-2.0", "isc,mit"), ("(MIT\nprose follows here)", "unparsed")):
        assert licenses.scan(tag + text, words)[-2] == want


def value(tokens):
    """Labels and openness of an expression by recursive descent."""

    def term(level):
        if level == 3:
            token = tokens.pop(0)
            if token == "(":
                inner = term(0)
                assert tokens.pop(0) == ")"
                return inner
            label = licenses.family(token)
            return {label}, licenses.OPENNESS.get(label, licenses.UNKNOWN)
        got = term(level + 1)
        while tokens and tokens[0].lower() == ("or", "and", "with")[level]:
            tokens.pop(0)
            (a, x), (b, y) = got, term(level + 1)
            got = (a | b, max(x, y)) if level == 0 else (a | b, min(x, y)) if level == 1 else (a, x + (1 - x) / 2)
        return got

    return term(0)


def test_labels_and_score_equal_brute_force(spark):
    rng, names = np.random.default_rng(3), ["MIT", "Apache-2.0", "GPL-2.0-only", "ISC", "X-Other", "CC0-1.0"]

    def expression(depth):
        kind = int(rng.integers(0, 5)) if depth else 0
        if kind == 0:
            return [str(rng.choice(names))]
        if kind == 1:
            return ["(", *expression(depth - 1), ")"]
        if kind == 2:
            return [str(rng.choice(names)), "WITH", "Some-exception"]
        return [*expression(depth - 1), ("OR", "and")[kind - 3], *expression(depth - 1)]

    phrases = {**licenses.BASE, **licenses.NOTICES}
    rows, want = [], []
    for i in range(300):
        parts = [str(x) for x in rng.choice([*phrases, "prose", "license", "cc", "by"], int(rng.integers(0, 6)))]
        labels, terms, lines = set(), [], []
        for tokens in [expression(4) for _ in range(int(rng.integers(0, 3)))]:
            lines.append("SPDX-License-Identifier: " + " ".join(tokens))
            own, open_ = value(tokens)
            labels |= own
            terms.append(open_)
        text = "\n".join([" ".join(parts), *lines, ""])
        joined = " " + " ".join(WORD.findall(text.lower())) + " "
        found = {phrases[p] for p in phrases if f" {p} " in joined}
        terms += [licenses.OPENNESS[x] for x in found]
        rows.append((i, text))
        want.append((i, ",".join(sorted(labels | found)), round(min(terms, default=0.0), 9)))
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["labels"], round(r["score"], 9)) for r in got) == want


def test_long_expressions_are_read_whole():
    words = licenses.automaton()
    long = " AND ".join(["(MIT OR Apache-2.0)"] * 40)
    for text in (f"SPDX-License-Identifier: {long} AND GPL-3.0-only", f"SPDX-License-Identifier: ({long} AND GPL-3.0-only)\nBSD", f"SPDX-License-Identifier: MIT {'prose ' * 10}SPDX-License-Identifier: {long} AND GPL-3.0\r\nx"):
        *_, labels, score = licenses.scan(text, words)
        assert set(labels.split(",")) == {"apache", "gpl", "mit"} and score == licenses.OPENNESS["gpl"]
    assert licenses.scan("SPDX-License-Identifier:\nMIT", words)[-2:] == ("unparsed", licenses.UNKNOWN)


@pytest.mark.parametrize("tag", ["SPDX License Identifier: ", "SPDX_License_Identifier=", "spdx--license\n// identifier: ", "License_Expression: ", "license / expression "])
def test_tags_with_any_separators(tag):
    words = licenses.automaton()
    assert licenses.scan(f"x {tag}GPL-3.0 OR MIT\nApache-2.0", words)[-2:] == ("gpl,mit", 0.9)
    assert licenses.scan(f"é{tag}GPL-3.0\n{tag}MIT", words)[-2:] == ("mit", 0.9)
