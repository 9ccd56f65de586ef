import re
from collections import defaultdict

import numpy as np
import pyarrow as pa

from tessel.llm import common, near_dedup, queries
from tessel.llm.common import portions
from tessel.llm.shingles import shingles, words

from .conftest import ODD

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(rows, width=5, threshold=0.8):
    """Class of each doc_id, over all pairs."""
    sets = {}
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) or frozenset([tuple(w)] if w else [("", t or "")])
    parent = {i: i for i, _ in rows}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            index[x].add(i)
    for i, s in sets.items():
        shared = defaultdict(int)
        for x in s:
            for j in index[x]:
                shared[j] += 1
        for j, n in shared.items():
            if i < j and n >= threshold * (len(s) + len(sets[j]) - n):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return {i: top(i) for i, _ in rows}


def test_shingles_equal_brute_force():
    texts = ["a b c d e f", "A  b-c, D e F g", "a b", "", "!!", "é x1 é x1 é x1 é x1 é x1"]
    word, bounds = words(pa.array(["zz", *texts]).slice(1))
    assert np.diff(bounds).tolist() == [6, 7, 2, 0, 0, 10]
    text, item, count = shingles(word, bounds, 5)
    assert np.bincount(text, minlength=6).tolist() == [2, 3, 1, 0, 0, 2]
    assert set(item[text == 0]) < set(item[text == 1])
    assert sorted(count[text == 5]) == [3, 3]


def morse(n, letters):
    """A word that polynomial hashes modulo 2**64 can't tell from its complement."""
    return "".join(letters[k.bit_count() % 2] for k in range(n))


def test_words_are_told_byte_for_byte(spark):
    rows = [(k, morse(n, x)) for k, (n, x) in enumerate((n, x) for n in (1024, 2048) for x in ("ab", "ba"))]
    rows += [(9, "one two three four five"), (10, "one two three four five six"), (11, "a\x00b c"), (12, "ab c")]
    assert {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == brute(rows)
    column = pa.array([x for n in (*range(1, 20), 63, 64, 65, 200) for x in ("a" * n, "b" * n, "a" * (n - 1) + "b")])
    word, _ = words(column)
    assert len(set(word.tolist())) == len(set(column.to_pylist()))
    assert word.tolist() == [words(pa.array([x]))[0][0] for x in column.to_pylist()]


def test_many_short_texts_in_one_batch():
    column = pa.array([f"t{k} a b c d" for k in range(70_000)])
    sizes = [len(x) for x in portions(pa.RecordBatch.from_arrays([pa.array(range(70_000)), column], ["doc_id", "text"]))]
    assert sum(sizes) == 70_000 and max(sizes) <= 1 << 15


def test_texts_under_one_id_stay_apart(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    rows = [(1, a), (1, b), (1, a), (2, a + " x"), (3, b + " x"), (None, a + " y"), (None, b + " z"), (None, "other words")]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), str(r["rep_id"]), str(r["class_id"])) for r in got) == sorted([("1", "1", "1")] * 3 + [("2", "2", "1"), ("3", "3", "1")] + [("None", "None", "1")] * 2 + [("None", "None", "None")])


def test_estimates_are_of_weighted_shingles(spark):
    a = " ".join(f"w{k}" for k in range(200))
    docs = spark.createDataFrame([(1, a), (2, a), (3, " ".join(f"w{k}" for k in range(20, 220))), (4, "other words are in this text")], "doc_id long, text string")
    got = {(r["a"], r["b"]): r["estimate"] for r in near_dedup.estimated(docs, spark.createDataFrame([(1, 2), (1, 3), (1, 4)], "a long, b long")).collect()}
    assert got[1, 2] == 1 and got[1, 4] == 0 and abs(got[1, 3] - 176 / 216) < 0.12


def test_hot_keys_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    rows = spark.createDataFrame([(k % 3 % 2, k) for k in range(30)] + [(1, None), (7, 7)], "key long, other long")
    table = spark.createDataFrame([(0, "a"), (1, "b"), (5, "c"), (7, "d")], "key long, v string")
    got = common.spread_join(rows, table, "key", "other").select("key", "other", "v")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, rows.join(table, "key").collect())))


def test_registers_estimate_probability_jaccard():
    rng = np.random.default_rng(5)
    a, b = rng.uniform(0.5, 3, 300), rng.uniform(0.5, 3, 300)
    a[:60], b[-60:] = 0, 0
    want = sum(1 / sum(max(x / a[i], y / b[i]) for x, y in zip(a, b, strict=True)) for i in range(300) if a[i] and b[i])
    got = []
    for k in range(30):
        item = rng.integers(0, 2**48, 300).astype(np.uint64)
        where = [np.flatnonzero(x) for x in (a, b)]
        r = near_dedup.prob_minhash(np.repeat([0, 1], [len(w) for w in where]), np.concatenate([item[w] for w in where]), np.concatenate([x[w] for x, w in zip((a, b), where, strict=True)]), 2)
        got.append((r[0] == r[1]).mean())
    assert abs(np.mean(got) - want) < 0.03


def test_op6_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert {r["doc_id"]: r["class_id"] for r in queries.op6_near_duplicates(spark, SF).collect()} == brute(rows)


def test_op6_large_group_and_odd(spark, odd, none):
    rng = np.random.default_rng(2)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(100, 220):
        own = list(base)
        for _ in range(int(rng.integers(0, 6))):
            own[int(rng.integers(0, 120))] = f"x{rng.integers(1 << 30)}"
        rows.append((i, " ".join(own)))
    rows += [(300, "Same words here"), (301, "same, words: here!"), (302, "???"), (303, "!!!"), (304, "???")]
    docs = odd.unionByName(spark.createDataFrame(rows, "doc_id long, text string"), allowMissingColumns=True)
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == len(ODD) + len(rows)
    assert {r["doc_id"]: r["class_id"] for r in got} == brute(ODD + rows)
    assert near_dedup.near_duplicates(none).count() == 0


def test_op6_unequal_repeats(spark):
    rows = []
    for i in range(60):
        head, own, block = ([f"{x}{i}x{k}" for k in range(n)] for x, n in (("h", 75), ("o", 8), ("b", 20)))
        rows += [(2 * i, " ".join(head + block + block[:4])), (2 * i + 1, " ".join(own + head[8:] + block * 100 + block[:4]))]
    want = brute(rows)
    assert all(want[2 * i + 1] == 2 * i for i in range(60))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == want


def test_deduplicate_leaves_one_row_each(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(None, a + " x"), (None, a + " y"), (None, b + " x"), (3, b + " y"), (2, b), (2, b), (2, c), (5, "???"), (5, "???")]
    got = near_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r["doc_id"] or 0, r["text"][0]) for r in got) == [(0, "a"), (2, "b"), (2, "c"), (5, "?")]
    assert (2, b) in map(tuple, got)


def test_deduplicate_keeps_clashing_columns(spark, clashing):
    got = near_dedup.deduplicate(clashing)
    assert got.columns == clashing.columns
    once = {r["doc_id"]: r for r in clashing.collect()}
    assert all(r == once[r["doc_id"]] for r in got.collect()) and got.count() == len(set(brute(list({r["doc_id"]: r["text"] for r in once.values()}.items())).values()))
