"""Toxicity by cumulative-link ordinal regression over sparse text features (operator 7).

Features of a text: its different words, those that it says again, and beginnings of words of 5 to
8 bytes, hashed. Labels say
toxic or not; severity grades come from them: among toxic documents of the sample, grade 1 to 3 by
how many different telling features (log-odds) a text has. One weight vector is shared by all
ordered thresholds: P(grade > k) = sigmoid(w.x - theta_k), with theta_1 < theta_2 < theta_3. The
outcome is the expected severity, P(grade > 0) and the likeliest grade.

The fit takes a bounded sample outside the held-out fold and keeps at most ``KEPT`` features, so
the model has a fixed size; scoring is one pass without a shuffle.

Defined cases: a text without words (null, empty, blank) has no features and gets the lowest
severity; with labels of one value only, or none, every severity is 0 and nothing is toxic; equal
texts have equal rows; an empty table gives no rows; repeated rows stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import eights, portions, texts
from tessel.llm.labelled import SAMPLE, held_out, sample
from tessel.llm.shingles import SMALL, WORD, hashes, mix, spans, texts_of

SPACE, KEPT, LEAST = 1 << 20, 4096, 3
PREFIXES = (5, 6, 7, 8)
DECAY = 5e-6


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Different features of the texts as (text number, feature below SPACE), sorted."""
    raw, offsets = texts_of(column)
    raw = SMALL[raw]
    begins, ends = spans(WORD[raw], offsets)
    keys, head = [], eights(raw, begins)
    text = np.searchsorted(offsets, begins, "right") - 1
    for size in (0, *PREFIXES):
        long = np.flatnonzero(ends - begins > size) if size else np.arange(len(begins))
        hashed = head[long] & np.uint64(2 ** (8 * size) - 1) ^ np.uint64(size << 58) if size else hashes(raw, begins, ends)
        keys.append(text[long] * SPACE + (mix(hashed) % np.uint64(SPACE)).astype(np.int64))
    whole, count = np.unique(keys[0], return_counts=True)
    keys.append((whole // SPACE * SPACE + (whole * 40503 + 7) % SPACE)[count > 1])  # said again
    keys = np.sort(np.concatenate(keys))
    keys = keys[np.r_[True, keys[1:] != keys[:-1]]] if len(keys) else keys
    return keys // SPACE, keys % SPACE


class Model:
    """Chosen features (sorted) with weights, and thresholds."""

    def __init__(self):
        self.chosen, self.weight, self.theta = np.zeros(0, np.int64), np.zeros(0), np.array([30.0, 31.0, 32.0])

    def above(self, column: pa.Array) -> np.ndarray:
        """P(grade > k) for k = 0, 1, 2 (n, 3)."""
        text, feature = features(column)
        eta = np.zeros(len(column))
        if len(self.chosen) and len(text):
            at = np.searchsorted(self.chosen, feature).clip(max=len(self.chosen) - 1)
            hit = self.chosen[at] == feature
            eta = np.bincount(text[hit], self.weight[at[hit]], len(column))
        return 1 / (1 + np.exp(np.clip(self.theta - eta[:, None], -30, 30)))


def objective(p: np.ndarray, rows: np.ndarray, at: np.ndarray, grade: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean negative log-likelihood of grades 0 to 3, with weight decay, and its gradient.

    ``p`` has the weights, then theta_1 and the logs of the steps to the other thresholds.
    """
    w, theta, n = p[:-3], p[-3:], len(grade)
    eta, steps = np.bincount(rows, w[at], n), np.exp(theta[1:])
    s = 1 / (1 + np.exp(-np.clip(np.cumsum([theta[0], *steps])[None, :] - eta[:, None], -30, 30)))  # P(grade <= k)
    upper = np.concatenate([s, np.ones((n, 1))], 1)[np.arange(n), grade]
    lower = np.concatenate([np.zeros((n, 1)), s], 1)[np.arange(n), grade]
    prob = np.maximum(upper - lower, 1e-9)
    up, low = upper * (1 - upper) / prob, lower * (1 - lower) / prob
    d_bound = np.array([(-(up * (grade == k)).sum() + (low * (grade == k + 1)).sum()) / n for k in range(3)])
    d_theta = np.array([d_bound.sum(), d_bound[1:].sum() * steps[0], d_bound[2] * steps[1]])
    loss = -np.log(prob).mean() + DECAY / 2 * (w @ w)
    return float(loss), np.concatenate([np.bincount(at, ((up - low) / n)[rows], len(w)) + DECAY * w, d_theta])


def learn(rows: np.ndarray, at: np.ndarray, y: np.ndarray, chosen: np.ndarray, odds: np.ndarray) -> Model:
    """Fit on incidences (row, place in ``chosen``) and labels 0 or 1; ``odds`` are log-odds of the features."""
    model, n = Model(), len(y)
    if not len(chosen) or not 0 < y.mean() < 1:
        return model
    hits = np.bincount(rows, (odds > 3)[at], n)
    toxic = y == 1
    cut = np.quantile(hits[toxic], [1 / 3, 2 / 3])
    grade = np.where(toxic, 1 + np.searchsorted(cut, hits, "left").clip(max=2), 0)
    w, theta = np.zeros(len(chosen)), np.array([1.0, 0.0, 0.0])  # theta_1 and the logs of the steps to the others
    m = [np.zeros(len(w) + 3), np.zeros(len(w) + 3)]
    for step in range(1, 1501):
        _, grad = objective(np.concatenate([w, theta]), rows, at, grade)
        m[0], m[1] = 0.9 * m[0] + 0.1 * grad, 0.999 * m[1] + 0.001 * grad**2
        move = 0.05 * m[0] / (1 - 0.9**step) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-9)
        w, theta = w - move[: len(w)], theta - move[len(w) :]
    model.chosen, model.weight, model.theta = chosen, w, np.cumsum([theta[0], *np.exp(theta[1:])])
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", bound: int = SAMPLE) -> Model:
    """Learn from at most ``bound`` labelled documents; the driver gets ``KEPT`` features and their incidences."""
    rows = sample(docs, labels, label, bound).withColumn("label", F.col("label").cast("int"))

    def incidences(chosen: np.ndarray | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in portions(batch, 1 << 20):
                    text, feature = features(part.column("text"))
                    if chosen is not None:
                        place = np.searchsorted(chosen, feature).clip(max=len(chosen) - 1)
                        hit = chosen[place] == feature
                        text, feature = text[hit], place[hit]
                    bounds = pa.array(np.searchsorted(text, np.arange(len(part) + 1)), pa.int32())
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.ListArray.from_arrays(bounds, pa.array(feature, pa.int64()))], ["doc_id", "label", "features"])

        return rows.mapInArrow(run, "doc_id long, label int, features array<long>")

    toxic, total = rows.agg(F.sum("label"), F.count(F.lit(1))).first()
    if not toxic or toxic == total:
        return Model()
    seen = incidences(None).select("label", F.explode("features").alias("f")).groupBy("f").agg(F.sum("label").alias("pos"), F.count(F.lit(1)).alias("n")).where(F.col("pos") >= LEAST)
    pos, neg = F.col("pos") + 0.5, F.col("n") - F.col("pos") + 0.5
    rated = seen.withColumn("odds", F.log(pos / (toxic + 1)) - F.log(neg / (total - toxic + 1))).withColumn("sure", F.col("odds") / F.sqrt(1 / pos + 1 / neg))
    kept = rated.where("sure > 3").orderBy(F.desc("sure"), "f").limit(KEPT).select("f", "odds").toPandas().sort_values("f")
    if not len(kept):
        return Model()
    chosen = kept["f"].to_numpy(np.int64)
    got = incidences(chosen).toPandas().sort_values("doc_id", kind="stable")
    sizes = [*map(len, got["features"])]
    return learn(np.repeat(np.arange(len(got)), sizes), np.concatenate([*got["features"]]).astype(np.int64), got["label"].to_numpy(), chosen, kept["odds"].to_numpy())


def severity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, severity (expected grade, 0 to 3), score (P(grade > 0)), grade (likeliest), toxic (score of 0.5 or more)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, 2 << 20):
                above = model.above(part.column("text"))
                each = -np.diff(np.concatenate([np.ones((len(above), 1)), above, np.zeros((len(above), 1))], 1), axis=1)
                columns = [above.sum(1), above[:, 0], each.argmax(1).astype(np.int32), (above[:, 0] >= 0.5).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, columns)], ["doc_id", "severity", "score", "grade", "toxic"])

    rows = texts(docs).mapInArrow(run, "doc_id long, severity double, score double, grade int, toxic int")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "severity", "score", "grade", "toxic")
