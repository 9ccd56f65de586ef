"""Quality classifier: random indexing, pooling, and a small calibrated network (operator 1).

Tokens of a text are its words (hashed into ``SLOTS``) and signs of form: runs of symbols, the case
of words, line ends, a word that repeats the one before, a five-word shingle that came before.
Random indexing gives every slot a sparse ternary index vector; the context vector of a word is
the sum of the index vectors of its neighbours in the sample. A document is the mean of its words'
context and index vectors beside the mean of the index vectors of its signs. A network with one
hidden layer in numpy turns that into a logit, and a temperature, fitted on documents that the
network did not learn from, into a probability.

Only the fit sees labels, on a bounded sample outside the held-out fold; ids, language and source
are never inputs. The word vectors and weights have a fixed size.

Defined cases: a text without tokens (null, empty, blank) is a zero vector and gets the score of
one; with labels of one value only, or none, every score is the share of label 1, or 0.5; equal
texts have equal scores; an empty table gives no rows; repeated rows stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import portions, texts
from tessel.llm.labelled import SAMPLE, held_out, sample
from tessel.llm.shingles import SMALL, hashes, shingles, spans, texts_of

SLOTS, DIM, SIGNS, SIGN_DIM, WINDOW, HIDDEN = 1 << 14, 32, 1 << 10, 64, 2, 24
DECAY = 1e-4
#: Byte classes: 0 blank, 1 lower-case, 2 upper-case, 3 digit, 4 non-ASCII, 5 symbol, 6 line end.
_CLASS = np.array([6 if c == 10 else 0 if c <= 32 or c == 127 else 1 if 97 <= c < 123 else 2 if 65 <= c < 91 else 3 if 48 <= c < 58 else 4 if c >= 128 else 5 for c in range(256)], np.uint8)


def index_vectors(n: int, dim: int, seed: int) -> np.ndarray:
    """Sparse ternary vectors of length 1: four entries of each sign at most."""
    rng = np.random.default_rng(seed)
    out = np.zeros((n, dim), np.float32)
    for sign in (1, -1):
        for _ in range(4):
            out[np.arange(n), rng.integers(0, dim, n)] = sign
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1)


INDEX, SIGN_INDEX = index_vectors(SLOTS, DIM, 1), index_vectors(SIGNS, SIGN_DIM, 2)


def _means(rows: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The mean of the rows of each text; zero where it has none."""
    at = bounds.tolist()
    out = np.array([rows[a:b].sum(0) for a, b in pairwise(at)], np.float32).reshape(len(at) - 1, rows.shape[1])
    return out / np.maximum(np.diff(bounds), 1)[:, None].astype(np.float32)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Slots of words and bounds of texts among them; means of signs (n, SIGN_DIM) and counts (n, 3)."""
    raw, offsets = texts_of(column)
    kind = _CLASS[raw]
    small = SMALL[raw]
    begins, ends = spans((kind > 0) & (kind < 5), offsets)
    word = hashes(small, begins, ends)
    bounds = np.searchsorted(begins, offsets)
    upper, lower = (np.r_[0, np.cumsum(kind == k)] for k in (2, 1))
    caps, smalls = upper[ends] - upper[begins], lower[ends] - lower[begins]
    case = np.where(caps == 0, 0, np.where((smalls == 0) & (caps > 1), 1, np.where(_CLASS[raw[begins]] == 2, 2, 3)))
    again = np.r_[False, word[1:] == word[:-1]] if len(word) else np.zeros(0, bool)
    size = np.minimum(ends - begins, 31) // 4
    glued = kind[np.minimum(ends, len(kind) - 1)] == 5 if len(kind) else np.zeros(0, bool)
    form = (case * 2 + again) * 16 + size * 2 + glued
    marks, after = spans(kind == 5, offsets)
    symbol = 256 + (hashes(raw, marks, after) % np.uint64(SIGNS - 256)).astype(np.int64)
    lines = np.flatnonzero(kind == 6)
    texts_ = len(bounds) - 1
    of = [np.repeat(np.arange(texts_), np.diff(np.searchsorted(at, offsets))) for at in (begins, marks, lines)]
    sign = np.concatenate([form, symbol, np.full(len(lines), 255)]) + SIGNS * np.concatenate(of)
    seen = np.bincount(sign, minlength=SIGNS * texts_).reshape(texts_, SIGNS).astype(np.float32)
    means = seen @ SIGN_INDEX / np.maximum(seen.sum(1, keepdims=True), 1)
    text, _, _ = shingles(word, bounds, 5)
    n, different = np.diff(bounds), np.bincount(text, minlength=texts_)
    repeats = 1 - different / np.maximum(n - 4, 1).clip(1)
    keys = np.sort(of[0].astype(np.uint64) << np.uint64(40) | word >> np.uint64(24))
    unlike = np.bincount((keys[np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])] >> np.uint64(40)).astype(np.int64), minlength=texts_) / np.maximum(n, 1)
    counts = np.stack([repeats.clip(0, 1) * (n > 4), unlike, np.log1p(n) / 10], 1).astype(np.float32)
    return (word % np.uint64(SLOTS)).astype(np.int64), bounds, means, counts


def pooled(column: pa.Array, context: np.ndarray) -> np.ndarray:
    """One row a text: context, index and sign means, and the counts."""
    slot, bounds, means, counts = tokens(column)
    both = np.concatenate([context, INDEX], 1)
    return np.concatenate([_means(both[slot], bounds), means, counts], 1)


def context_sums(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
    """Sums of the index vectors of neighbours, by slot."""
    out = np.zeros((SLOTS, DIM), np.float32)
    for batch in batches:
        for part in portions(batch, 1 << 20):
            slot, bounds, *_ = tokens(part.column("text"))
            text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            for gap in range(1, WINDOW + 1):
                near = np.flatnonzero(text[gap:] == text[:-gap])
                for a, b in ((slot[near], slot[near + gap]), (slot[near + gap], slot[near])):
                    for d in range(DIM):
                        out[:, d] += np.bincount(a, INDEX[b, d], SLOTS).astype(np.float32)
    return out


def cross_entropy(p: list[np.ndarray], z: np.ndarray, t: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean loss of a tanh layer and a logistic one, with weight decay, and its gradient."""
    h = np.tanh(z @ p[0] + p[1])
    logit = np.clip(h @ p[2] + p[3], -30, 30)
    d = (1 / (1 + np.exp(-logit)) - t) / len(t)
    back = np.outer(d, p[2]) * (1 - h * h)
    loss = np.logaddexp(0, np.where(t == 1, -1, 1) * logit).mean() + DECAY / 2 * ((p[0] ** 2).sum() + (p[2] ** 2).sum())
    return float(loss), [z.T @ back + DECAY * p[0], back.sum(0), h.T @ d + DECAY * p[2], d.sum()]


class Model:
    """What scoring needs: word vectors, scaling, two layers and a temperature; or a constant."""

    def __init__(self, share: float):
        self.share, self.layers, self.context = share, None, np.zeros((SLOTS, DIM), np.float32)

    def logits(self, x: np.ndarray) -> np.ndarray:
        (w1, b1, w2, b2), mean, scale = self.layers
        return np.tanh((x - mean) / scale @ w1 + b1) @ w2 + b2

    def score(self, column: pa.Array) -> np.ndarray:
        if self.layers is None:
            return np.full(len(column), self.share)
        return 1 / (1 + np.exp(-np.clip(self.logits(pooled(column, self.context)) / self.temperature, -30, 30).astype(np.float64)))

    def learn(self, x: np.ndarray, y: np.ndarray, tuning: np.ndarray) -> None:
        """Adam on cross entropy with weight decay, then the temperature on the tuning rows."""
        rng = np.random.default_rng(7)
        train = ~tuning if 0 < y[~tuning].mean() < 1 else np.ones(len(y), bool)
        mean, scale = x[train].mean(0), x[train].std(0) + 1e-2
        z, t = (x[train] - mean) / scale, y[train].astype(np.float32)
        p = [rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(())]
        p = [v.astype(np.float32) for v in p]
        first, second, step = [np.zeros_like(v) for v in p], [np.zeros_like(v) for v in p], 0
        for epoch in range(40):
            order = rng.permutation(len(z))
            for at in range(0, len(z), 256):
                k = order[at : at + 256]
                _, grads = cross_entropy(p, z[k], t[k])
                step += 1
                rate = 3e-3 * 0.95**epoch
                for j, g in enumerate(grads):
                    first[j] = 0.9 * first[j] + 0.1 * g
                    second[j] = 0.999 * second[j] + 0.001 * g * g
                    p[j] = p[j] - rate * first[j] / (1 - 0.9**step) / (np.sqrt(second[j] / (1 - 0.999**step)) + 1e-8)
        self.layers = [v.astype(np.float32) for v in p], mean, scale
        fitting = tuning if tuning.sum() >= 30 else train
        logit, truth = self.logits(x[fitting]).astype(np.float64), y[fitting]
        loss = lambda v: np.logaddexp(0, np.where(truth == 1, -1, 1) * logit / v).mean()
        self.temperature = float(min(np.geomspace(0.25, 8, 60), key=loss))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = SAMPLE) -> Model:
    """Learn from at most ``bound`` labelled documents; the driver gets vectors of fixed size."""
    rows = sample(docs, labels, label, bound)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = context_sums(batches)
        used = np.flatnonzero(out.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(list(out[used]), pa.list_(pa.float32()))], ["slot", "v"])

    each = rows.select("text").mapInArrow(sums, "slot long, v array<float>")
    added = each.groupBy("slot").agg(F.array(*[F.sum(F.col("v")[d]).cast("float") for d in range(DIM)]).alias("v")).toPandas()
    model = Model(0.5)
    if len(added):
        context = np.zeros((SLOTS, DIM), np.float32)
        context[added["slot"]] = np.stack(added["v"])
        model.context = context / np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-6)

    context = model.context

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, 1 << 20):
                x = [v.tobytes() for v in pooled(part.column("text"), context).astype("<f4")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(x, pa.binary()), part.column("label"), part.column("tuning")], ["doc_id", "x", "label", "tuning"])

    got = rows.withColumn("label", F.col("label").cast("int")).mapInArrow(vectors, "doc_id long, x binary, label int, tuning boolean").toPandas().sort_values(["doc_id", "x"])
    if len(got):
        y = got["label"].to_numpy()
        model.share = float(y.mean())
        if 0 < y.mean() < 1:
            model.learn(np.stack([np.frombuffer(v, "<f4") for v in got["x"]]), y, got["tuning"].to_numpy(bool))
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, 2 << 20):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.score(part.column("text")).astype(np.float64))], ["doc_id", "score"])

    rows = texts(docs).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose text scores ``threshold`` or more, all columns as they are."""

    place = docs.columns.index("text")
    plain = docs.toDF(*["text" if k == place else f"c{k}" for k in range(len(docs.columns))])  # names may have dots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for part in portions(batch.set_column(place, "text", batch.column(place).fill_null("")), 1 << 20):
                good = model.score(part.column("text")) >= threshold
                yield batch.slice(done, len(part)).filter(pa.array(good))
                done += len(part)

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
