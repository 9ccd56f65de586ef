"""N-gram Jaccard join, whitening and ranked search against brute force, and their odd cases."""

import math
import random
import re
import tracemalloc
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessel.llm import jaccard_join, treaps, whitening
from tessel.llm.common import _made, portions, scratch
from tessel.llm.shingles import SOLID

from .conftest import ODD

DOCS = "doc_id long, text string"


def small(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def joined(rows, width=3, percent=90):
    """(number of shingles, component) of each row, over all pairs."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", small(t))
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set()))
    top = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = top[i], top[j]
                top = [min(a, b) if t in (a, b) else t for t in top]
    least = {}
    for t, (i, _) in zip(top, rows, strict=True):
        least[t] = i if least.get(t) is None else least[t] if i is None else min(i, least[t])
    return sorted(((i, len(s), least[t] if s else i) for t, s, (i, _) in zip(top, sets, rows, strict=True)), key=str)


def test_join_equals_brute_force(spark):
    rng = random.Random(5)
    common = [f"c{k}" for k in range(40)]
    rows = []
    for g in range(25):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.choice([1, 2, 3, 12, 60, 150]))]
        for _ in range(rng.choice([1, 2, 8])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                w[rng.randrange(len(w))] = f"x{rng.randrange(50)}"
            rows.append((len(rows), " ".join(common * (g % 4 == 0) + w)))
    rows += [(7, rows[3][1].upper()), (None, rows[5][1]), (None, "alone here"), (None, "alone  here")]
    got = jaccard_join.jaccard_join(spark.createDataFrame(rows, DOCS).repartition(3))
    want = joined(rows)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert len({c for _, n, c in want if n > 10}) < sum(n > 10 for _, n, _ in want)


def test_near_copies_of_near_copies_stay_linked(spark):
    base = [f"a{k}" for k in range(200)]
    rows = [(k, " ".join(base[:k] + [f"z{k}", f"y{k}"] + base[k + 2 :])) for k in range(0, 190, 3)]  # all pairs are close to the threshold
    got = jaccard_join.jaccard_join(spark.createDataFrame(rows, DOCS).repartition(4))
    assert sorted(map(tuple, got.collect()), key=str) == joined(rows)


def test_join_of_odd_texts(spark, odd, none, clashing):
    want = joined([(i, t) for i, t in ODD])
    for docs in (odd, clashing):
        assert sorted(map(tuple, jaccard_join.jaccard_join(docs).collect()), key=str) == want
    assert jaccard_join.jaccard_join(none).collect() == []


def test_prefixes_are_shared_under_every_order():
    rng = random.Random(1)
    crowded = np.array([rng.choice([0, 0, 0, 3]) for _ in range(jaccard_join.SLOTS)], np.uint8)
    base = [f"a{k}" for k in range(300)]
    for cut in (0, 4, 9):
        other = base[: 300 - cut] + [f"b{k}" for k in range(cut)]
        text, item = jaccard_join._sets(pa.array([" ".join(base), " ".join(other)]), 3)
        orders, sizes = jaccard_join.prefixes(text, item, 2, crowded)
        assert len(orders) == 3
        for names in orders:
            a, b = names[: sizes[0]], names[sizes[0] :]
            assert set(a.tolist()) & set(b.tolist()) and sizes.tolist() == [30, 30]
    assert not SOLID[[32, 9, 13]].any() and SOLID[[8, 14, 33]].all()


def test_tallies_never_differ_more_than_sets():
    rng = random.Random(3)
    for n, changed in ((40, 0), (300, 4), (300, 60), (30_000, 900)):
        base = [f"a{rng.randrange(n)}" for _ in range(n)]
        other = list(base)
        for k in rng.sample(range(n), changed):
            other[k] = f"b{k}"
        text, item = jaccard_join._sets(pa.array([" ".join(base), "", " ".join(other)]), 3)
        a, none, b = jaccard_join.tallies(text, item, 3).reshape(3, -1).astype(int)
        sets = [set(item[text == k].tolist()) for k in (0, 2)]
        assert np.abs(a - b).sum() <= len(sets[0] ^ sets[1]) and not none.any()
        assert a.sum() == len(sets[0]) or a.max() == 127


# ---- whitening

VECTORS = "vec_id long, embedding array<double>, x string, w string"


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(60, 12)) @ rng.normal(size=(12, 12)) / 8
    rows = [(k, v.tolist(), "clash", "clash") for k, v in enumerate(vectors)]
    bad = [(90, None, "", ""), (91, [], "", ""), (92, [1.0] * 11 + [None], "", ""), (93, [float("nan")] * 12, "", ""), (94, [float("inf")] * 12, "", ""), (95, [0.5] * 5, "", ""), (96, [1e30] * 12, "", "")]
    got = whitening.whiten(spark.createDataFrame(rows + bad, VECTORS).repartition(3)).toPandas()
    assert sorted(got["vec_id"].unique()) == list(range(60)) and len(got) == 480
    x = np.floor(1024 * vectors) + 100000
    values, basis = np.linalg.eigh(np.cov(x.T, bias=True))
    values, basis = values[::-1][:8], basis[:, ::-1][:, :8]
    want = (x - x.mean(0)) @ basis / np.sqrt(values)
    have = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(np.abs(have) - np.abs(want)).max() < 1e-9
    assert np.sign(have * want).prod(0).tolist() == np.sign((have * want)[0] ** 60).tolist()  # one sign for all rows
    whole = x.astype(np.int64)
    exact = ((60 * whole - whole.sum(0)) ** 2).sum(1)
    assert got.groupby("vec_id")["deviation"].first().tolist() == exact.tolist()
    share = got.groupby("component")["explained"].first().to_numpy()
    assert np.allclose(share, values / np.trace(np.cov(x.T, bias=True)), rtol=1e-9) and got["identity_error"].max() < 1e-9 and (got["n"] == 60).all()


def test_whitening_without_variance(spark):
    same = whitening.whiten(spark.createDataFrame([(1, [0.25, 0.5], "", ""), (None, [0.25, 0.5], "", "")], VECTORS)).collect()
    assert len(same) == 4 and all(r["whitened"] is None and r["explained"] is None and r["deviation"] == 0 and r["identity_error"] is None for r in same)
    line = whitening.whiten(spark.createDataFrame([(k, [k / 4, 0.5], "", "") for k in range(5)], VECTORS)).toPandas()
    assert line[line["component"] == 1]["whitened"].notna().all() and line[line["component"] == 2]["whitened"].isna().all() and line["identity_error"].max() < 1e-9
    none = whitening.whiten(spark.createDataFrame([(1, None, "", "")], VECTORS))
    assert none.collect() == [] and none.columns == whitening.whiten(spark.createDataFrame([(1, [0.5], "", "")], VECTORS)).columns


def test_deviations_beyond_a_long():
    x = np.array([[1 << 31, 0], [5, 5]], np.int64)
    assert whitening.deviations(x, 2, np.array([0, 0])).to_pylist() == [None, 200]
    assert whitening.deviations(x, 1, np.array([0, 0])).to_pylist() == [1 << 62, 50]


def test_covariance_in_several_aggregations(spark, monkeypatch):
    rows = spark.createDataFrame([([1.0, 2.0, 4.0],), ([2.0, 2.5, 3.0],), ([0.0, 7.0, 1.0],)], "v array<double>")
    whole = whitening.covariance(rows, "v", np.array([1.0, 2.0, 3.0]))
    monkeypatch.setattr(whitening, "EXPRESSIONS", 4)
    assert np.allclose(whitening.covariance(rows, "v", np.array([1.0, 2.0, 3.0])), whole) and np.allclose(whole, whole.T)


# ---- ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranked(docs, items, k=50):
    """(item_id, rank, doc_id, score) by scoring everything."""
    counted = [(i, Counter(TERM.findall(small(t)))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n, total, df = len(counted), sum(sum(c.values()) for _, c in counted), Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in counted:
            m = 100 - 50 + (50 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(TERM.findall(small(text))) if t in c)
            if score > 0:
                scores.append((-score, i is None, i if i is not None else 0))
        out += [(item, r + 1, None if void else i, -s) for r, (s, void, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


ITEMS = "item_id long, text string, doc_id string, rank string"


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(9)
    words = [f"t{int(300 * rng.random() ** 3)}" for _ in range(6000)]
    docs, at = [], 0
    while at < len(words):
        size = rng.choice([1, 3, 20, 80])
        docs.append((1000 - len(docs), " ".join(words[at : at + size])))
        at += size
    docs += [docs[4], docs[4], (None, docs[5][1]), (2000, None), (2001, ""), (2002, "?!"), (3, "T1 t1 É ß t2")]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([1, 4, 30])))) for k in range(25)] + [(50, None), (51, "?"), (52, "unheard of"), (53, "É t1 T1"), (53, "t2")]
    return docs, items


def test_search_equals_brute_force(spark, corpus):
    docs, items = corpus
    asked = spark.createDataFrame([(i, t, "clash", "clash") for i, t in items], ITEMS)
    got = treaps.ranked_search(spark.createDataFrame(docs, DOCS).repartition(5), asked)
    want = ranked(docs, [x for x in items if x[0] != 53])
    assert sorted(map(tuple, got.where("item_id <> 53").collect())) == sorted(want, key=lambda r: r[:2])  # an item and rank are there once
    assert sorted(map(tuple, got.where("item_id = 53").collect()), key=str) == sorted(ranked(docs, items[-2:-1]) + ranked(docs, items[-1:]), key=str)


def test_search_in_parts_and_small_blocks(spark, corpus):
    docs, items = corpus
    path = treaps.scratch(spark, "t")
    treaps.build(spark.createDataFrame(docs, DOCS).coalesce(1), 500).write.parquet(path)
    index = treaps.read_index(spark, path)
    assert index.count() > 10
    got = treaps.search(index, spark.createDataFrame(items[:20], "item_id long, text string"), k=3, item_terms=20)
    assert sorted(map(tuple, got.collect()), key=str) == ranked(docs, items[:20], 3)


def test_blocks_of_a_task_are_written_and_read_one_by_one(spark, monkeypatch):
    paths = []
    monkeypatch.setattr(treaps, "scratch", lambda *a: paths.append(scratch(*a)) or paths[-1])
    docs = spark.range(90_000, numPartitions=1).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("all"), F.col("id").cast("string")).alias("text"))
    got = treaps.ranked_search(docs, spark.createDataFrame([(1, "77777"), (2, "5 all")], "item_id long, text string"), k=2)
    assert sorted(map(tuple, got.select("item_id", "rank", "doc_id").collect())) == [(1, 1, 77777), (2, 1, 5)]  # what all documents hold weighs nothing
    files = [pq.ParquetFile(f).metadata for f in Path(paths[0]).glob("*.parquet")]
    assert sum(f.num_rows for f in files) == 3 and [f.row_group(k).num_rows for f in files for k in range(f.num_row_groups)] == [1, 1, 1]
    long = spark.range(400, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 200).alias("text"))
    seen, name = [], "spark.sql.execution.arrow.maxBytesPerBatch"
    monkeypatch.setattr(treaps, "build", lambda *a, f=treaps.build: seen.append(spark.conf.get(name)) or f(*a))
    before = spark.conf.get(name, None)
    treaps.write_index(long, scratch(spark, "t"), 80_000)
    sizes = [sum(r["sizes"]) * 5 for r in treaps.read_index(spark, _made[-1]).collect()]
    assert sum(sizes) == 400_000 and max(sizes) <= 91_000 and seen == [str(treaps.BATCH_BYTES)] and spark.conf.get(name, None) == before


def test_a_block_takes_little_more_memory_than_its_lists():
    rng = random.Random(3)
    texts = pa.array([" ".join(str(rng.randrange(50_000)) for _ in range(400)) for _ in range(2000)])
    tracemalloc.start()
    block = treaps._block(pa.array(range(2000)), texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    cells = sum(len(set(t.split())) for t in texts.to_pylist())
    assert sum(block.column("df").flatten().to_pylist()) == cells and peak < 40 * cells and block.nbytes < 6 * cells


def test_search_of_odd_texts(spark, odd, none, clashing):
    items = spark.createDataFrame([(1, "One mail Z"), (2, "word"), (3, None)], "item_id long, text string")
    want = ranked(ODD, [(1, "One mail Z"), (2, "word")])
    for docs in (odd, clashing):
        assert sorted(map(tuple, treaps.ranked_search(docs, items).collect()), key=str) == want
    assert treaps.ranked_search(none, items).collect() == [] and treaps.ranked_search(odd, items.where("false")).collect() == []


def test_treaps_are_search_trees_and_heaps():
    rng = np.random.default_rng(4)
    starts = np.array([0, 1, 40, 40, 400])
    doc = np.concatenate([np.sort(rng.choice(1000, n, False)) for n in np.diff(starts)])
    impact = rng.integers(1, 4, len(doc))  # many ties
    t = treaps.Treaps(starts, doc, impact)

    def walk(node, low, high):
        if node < 0:
            return 0, []
        assert low <= doc[node] <= high and all(c < 0 or impact[c] <= impact[node] for c in (t.left[node], t.right[node]))
        a, b = walk(t.left[node], low, doc[node] - 1), walk(t.right[node], doc[node] + 1, high)
        return 1 + max(a[0], b[0]), a[1] + [node] + b[1]

    for k, root in enumerate(t.root):
        depth, order = walk(root, 0, 1000)
        assert order == list(range(starts[k], starts[k + 1])) and depth < 40


def test_pruning_scores_few_documents_and_loses_none():
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["a", "b", "c", "d", "e"]) if rng.random() < 0.1 else "z" for _ in range(60)) for _ in range(3000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(texts)], ["doc_id", "text"])
    block = treaps._block(batch.column(0), batch.column(1))
    wanted = pa.array([b"a", b"b", b"c"], pa.binary())
    cells, weights = np.array([[0, 0], [0, 1], [0, 2], [1, 1]]), np.array([900, 800, 700])
    found = []
    for k, cells_at_once in ((5, 1 << 18), (5, 30), (3000, 1 << 18)):
        best = treaps.Best(2, k)
        scored = treaps._search_block(block, wanted, cells, weights, 3000, 180000, best, cells_at_once)
        found.append((scored, sorted(zip(best.item.tolist(), (-best.score).tolist(), best.doc.tolist(), strict=True))))
    assert found[0][0] < found[2][0] / 3 and found[0][1] == found[1][1]
    assert [r for r in found[2][1] if r[0] == 0][:5] == found[0][1][:5] and len(list(portions(batch))) == 1
