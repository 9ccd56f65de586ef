import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessel.llm import labelled, quality, queries, toxicity

SF = "/root/testdata/sf0.01"


def fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_held_out_fold_and_bounded_sample(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = labelled.sample(docs, labels, "quality", 100).collect()
    assert len(rows) == 100 and not any(fold(r["doc_id"]) for r in rows)
    assert rows and {r["doc_id"] for r in rows} == {r["doc_id"] for r in labelled.sample(docs.repartition(7), labels, "quality", 100).collect()}


def test_op1_on_held_out_rows(spark):
    rows = queries.op1_quality_classifier(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    assert all(r["held_out"] == fold(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    own = [r for r in rows if r["held_out"]]
    assert np.mean([r["predicted"] == r["quality"] for r in own]) > 0.95
    assert np.mean([-np.log(max(1e-9, r["score"] if r["quality"] else 1 - r["score"])) for r in own]) < 0.2


def test_op7_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"  # some hundred toxic texts to learn from
    rows = queries.op7_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").withColumnRenamed("toxic", "label"), "doc_id").collect()
    own = [r for r in rows if r["held_out"]]
    assert all(0 <= r["severity"] <= 3 and r["severity"] >= r["score"] - 1e-9 for r in rows)
    assert np.mean([r["toxic"] == r["label"] for r in own]) > 0.97
    assert sum(r["toxic"] for r in own if not r["label"]) <= 10


def test_thresholds_are_ordered_and_weights_shared():
    rng = np.random.default_rng(0)
    y = np.r_[np.zeros(300, int), np.ones(60, int)]
    rows, cols = [], []
    for k in range(360):
        for f in rng.choice(200, 20, replace=False):
            rows.append(k)
            cols.append(int(f))
        for f in range(300, 300 + (k - 300) // 10 + 1 if k >= 300 else 300):
            rows.append(k)
            cols.append(f)
    chosen, at = np.unique(cols, return_inverse=True)
    model = toxicity.learn(np.array(rows), at, y, chosen, np.where(chosen >= 300, 5.0, 0.0))
    telling = chosen >= 300
    assert (np.diff(model.theta) > 0).all() and model.weight[telling].min() > np.quantile(model.weight[~telling], 0.9)


def slope(f, p, k, eps):
    return (f(np.where(np.arange(len(p)) == k, p + eps, p)) - f(np.where(np.arange(len(p)) == k, p - eps, p))) / (2 * eps)


def test_op7_likelihood_and_gradient_equal_brute_force():
    rng = np.random.default_rng(4)
    n, m = 40, 12
    rows, at = (x.ravel() for x in np.nonzero(rng.uniform(size=(n, m)) < 0.3))
    grade, p = rng.integers(0, 4, n), np.concatenate([rng.normal(size=m), [0.3, -0.2, 0.4]])

    def loss(p):
        bounds = [p[-3], p[-3] + np.exp(p[-2]), p[-3] + np.exp(p[-2]) + np.exp(p[-1])]
        total = 0.0
        for i in range(n):
            eta = sum(p[f] for r, f in zip(rows, at, strict=True) if r == i)
            below = [0, *(1 / (1 + np.exp(eta - b)) for b in bounds), 1]
            total -= np.log(below[grade[i] + 1] - below[grade[i]])
        return total / n + toxicity.DECAY / 2 * sum(x * x for x in p[:-3])

    got, grad = toxicity.objective(p, rows, at, grade)
    assert abs(got - loss(p)) < 1e-9
    assert np.allclose(grad, [slope(loss, p, k, 1e-5) for k in range(len(p))], atol=1e-6)


def test_op7_severity_is_the_expected_grade(spark):
    model = toxicity.Model()
    column = pa.array(["vile vile words", "kind words", ""])
    text, feature = toxicity.features(column)
    model.chosen = np.unique(feature)
    model.weight, model.theta = np.linspace(-1, 2, len(model.chosen)), np.array([0.5, 1.5, 3.0])
    docs = spark.createDataFrame([(k, x) for k, x in enumerate(column.to_pylist())], "doc_id long, text string")
    for r in toxicity.severity(docs, model).collect():
        eta = sum(w for f, w in zip(model.chosen, model.weight, strict=True) if f in feature[text == r["doc_id"]])
        below = [0, *(1 / (1 + np.exp(eta - b)) for b in model.theta), 1]
        each = np.diff(below)
        assert abs(r["severity"] - sum(k * x for k, x in enumerate(each))) < 1e-9 and abs(r["score"] - (1 - below[1])) < 1e-9 and r["grade"] == each.argmax()


def test_op1_vectors_equal_brute_force():
    texts = ["One two three two.", "two THREE one", "", "x"]
    slot, bounds, _, _ = quality.tokens(pa.array(texts))
    context = np.zeros((quality.SLOTS, quality.DIM))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        for i in range(a, b):
            for j in range(max(a, i - quality.WINDOW), min(b, i + quality.WINDOW + 1)):
                if i != j:
                    context[slot[i]] += quality.INDEX[slot[j]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4)), pa.array(texts)], ["doc_id", "text"])
    got = quality.context_sums([batch])
    assert np.allclose(got, context, atol=1e-5)
    rows = quality.pooled(pa.array(texts), got)
    for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        want = [np.concatenate([context[s], quality.INDEX[s]]) for s in slot[a:b]]
        assert np.allclose(rows[k, : 2 * quality.DIM], np.mean(want, 0) if want else 0, atol=1e-5)
    assert slot[0] == slot[6] and slot[1] == slot[3] == slot[4] and len(slot) == 8


def test_op1_network_and_temperature_equal_brute_force():
    rng = np.random.default_rng(2)
    z, t = rng.normal(size=(20, 5)), rng.integers(0, 2, 20).astype(float)
    shapes = [(5, 3), (3,), (3,), ()]
    flat = rng.normal(size=5 * 3 + 3 + 3 + 1)

    def parts(v):
        cuts = np.split(v, np.cumsum([int(np.prod(s)) for s in shapes])[:-1])
        return [c.reshape(s) for c, s in zip(cuts, shapes, strict=True)]

    def loss(v):
        w1, b1, w2, b2 = parts(v)
        total = 0.0
        for x, y in zip(z, t, strict=True):
            p = 1 / (1 + np.exp(-(sum(w2[j] * np.tanh(x @ w1[:, j] + b1[j]) for j in range(3)) + b2)))
            total -= np.log(p if y else 1 - p)
        return total / 20 + quality.DECAY / 2 * ((w1**2).sum() + (w2**2).sum())

    got, grads = quality.cross_entropy(parts(flat), z, t)
    assert abs(got - loss(flat)) < 1e-9
    assert np.allclose(np.concatenate([np.ravel(g) for g in grads]), [slope(loss, flat, k, 1e-5) for k in range(len(flat))], atol=1e-6)
    x, y = rng.normal(size=(600, 5)).astype(np.float32), rng.integers(0, 2, 600)
    y[:500] = x[:500, 0] + rng.normal(size=500) > 0
    model = quality.Model(0.5)
    model.learn(x, y, np.arange(600) % 3 == 0)
    logit, truth = model.logits(x[::3]).astype(float), y[::3]
    cost = {v: -np.mean(np.log(np.where(truth == 1, 1 / (1 + np.exp(-logit / v)), 1 / (1 + np.exp(logit / v))))) for v in np.geomspace(0.25, 8, 60)}
    assert model.temperature == pytest.approx(min(cost, key=cost.get))


@pytest.mark.parametrize("labels", [[], [(1, 1, 0), (2, 1, 0)], [(4, None, None)]])
def test_labels_of_one_kind_or_none(spark, odd, none, labels):
    given = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model, tox = quality.fit(odd, given), toxicity.fit(odd, given)
    assert {r["score"] for r in quality.score(odd, model).collect()} == {1.0 if labels and labels[0][1] else 0.5}
    assert toxicity.severity(odd, tox).agg(F.max("severity")).first()[0] < 1e-6
    assert quality.score(none, model).count() == toxicity.severity(none, tox).count() == 0


def test_odd_texts_score(spark, odd, clashing):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    rows = quality.score(odd, model).collect()
    assert len(rows) == odd.count() and len({r["score"] for r in rows if r["doc_id"] in (1, 2)}) == 1
    assert quality.keep(odd, model).columns == odd.columns
    kept = {(r["doc_id"], r["_slot"], r["a.b"]) for r in quality.keep(clashing, model).collect()}
    assert kept == {(r["doc_id"], r["_slot"], r["a.b"]) for r in clashing.join(quality.score(odd, model).where("score >= 0.7").select("doc_id"), "doc_id").collect()}
    column = pa.array(["", "x", "One two. !!! UP"])
    together, apart = quality.pooled(column, model.context), np.concatenate([quality.pooled(column.slice(k, 1), model.context) for k in range(3)])
    assert np.allclose(together, apart, atol=1e-5)
    assert toxicity.severity(odd, toxicity.fit(docs, labels)).where("toxic = 1").count() == 0
