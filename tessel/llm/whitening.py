"""Whitening of embedding vectors by column aggregates (operator 12).

Entries c become whole numbers ``floor(1024 * c) + 100000``, so sums are exact. The covariance is
one aggregation: for every pair of dimensions of the upper triangle a generated SQL expression
sums the product of their centred values, in each task before anything moves (``EXPRESSIONS``
pairs an aggregation; with more dimensions than that allows, some more). The driver
assembles the matrix, which is as large as the dimensions ask for however many vectors there are,
and decomposes it with LAPACK. Vectors are then projected in Arrow batches, one matrix product
each, and the covariance of the result comes from the same aggregation.

Defined cases: rows whose vector is null, empty, or holds null, NaN or infinite entries are left
out, and so are vectors whose length isn't the commonest one (of several such lengths the largest)
and those with an entry of 2**30 or more, for which sums of whole numbers would overflow; repeated
rows count as often as they stand; a vec_id may be null; ``deviation`` is null where it exceeds a
long. Components without variance, numerically, can't be scaled: ``whitened`` is null there, and
``identity_error`` is over the others (null if there are none). With fewer dimensions than components, there are
as many as dimensions. A table without a usable vector gives no rows. Columns other than vec_id
and embedding are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import settle

COMPONENTS, SCALE, SHIFT, MOST = 8, 1024, 100_000, 1 << 30
EXPRESSIONS = 10_000  # pairs of dimensions in one aggregation; 140 dimensions have fewer


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and x (array of long) of all usable vectors of one length."""
    entry = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < MOST)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v")).where((F.size("v") > 0) & F.forall("v", entry))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    commonest = sizes.orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    d = commonest[0]["d"] if commonest else 0
    whole = F.transform("v", lambda c: F.floor(SCALE * c.cast("double")).cast("long") + SHIFT)
    return rows.where(F.size("v") == d).select("vec_id", whole.alias("x"))


def sums(rows: DataFrame, d: int) -> tuple[int, np.ndarray]:
    """Number of rows and the exact sum of each entry of ``x``."""
    got = rows.agg(F.count(F.lit(1)), *[F.sum(F.get("x", F.lit(i))) for i in range(d)]).first()
    return got[0], np.array([s or 0 for s in got[1:]], np.int64)


def covariance(rows: DataFrame, column: str, means: np.ndarray) -> np.ndarray:
    """Covariance (divisor: the number of rows) of the entries of an array ``column``, centred by ``means`` before they are multiplied."""
    d = len(means)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    centred = rows.select(*[(F.get(column, F.lit(i)).cast("double") - F.lit(float(m))).alias(f"c{i}") for i, m in enumerate(means)])
    out = np.zeros((d, d))
    for begin in range(0, len(pairs), EXPRESSIONS):
        part = pairs[begin : begin + EXPRESSIONS]
        got = centred.selectExpr("count(*)", *[f"sum(c{i} * c{j})" for i, j in part]).first()
        for (i, j), s in zip(part, got[1:], strict=True):
            out[i, j] = out[j, i] = (s or 0.0) / max(got[0], 1)
    return out


@dataclass
class Whitening:
    """What is fitted: sizes of all arrays depend on the dimensions only."""

    n: int
    sums: np.ndarray
    values: np.ndarray  # eigenvalues, falling, of the first components
    vectors: np.ndarray  # a column each
    trace: float

    @property
    def scales(self) -> np.ndarray:
        """1 / sqrt(eigenvalue), NaN where there is no variance to scale."""
        some = self.values > len(self.sums) * np.finfo(float).eps * max(self.trace, 0.0)
        return np.where(some, 1 / np.sqrt(np.where(some, self.values, 1.0)), np.nan)


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Fit on all ``rows`` of ``usable``; None without any."""
    first = rows.select(F.size("x").alias("d")).first()
    if first is None:
        return None
    n, total = sums(rows, first["d"])
    matrix = covariance(rows, "x", total / n)
    values, vectors = np.linalg.eigh(matrix)
    order = np.argsort(-values, kind="stable")[:components]
    return Whitening(n, total, values[order], vectors[:, order], float(np.trace(matrix)))


def deviations(x: np.ndarray, n: int, total: np.ndarray) -> pa.Array:
    """For each row of ``x`` the sum of (n * x - S)**2, exact; null where a long can't hold it."""
    rough = n * x.astype(float) - total
    fits = (rough * rough).sum(1) < 2.0**62
    out = np.zeros(len(x), np.int64)
    d = n * x[fits] - total
    out[fits] = (d * d).sum(1)
    listed = out.astype(object)
    for k in np.flatnonzero(~fits).tolist():
        exact = sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[k], total, strict=True))
        listed[k] = exact if exact < 1 << 63 else None
    return pa.array(listed.tolist() if (~fits).any() else out, pa.int64())


def project(rows: DataFrame, fitted: Whitening) -> DataFrame:
    """vec_id, deviation and w (whitened components; NaN where there is no variance)."""
    n, total, scales = fitted.n, fitted.sums, fitted.scales
    basis, means, d = fitted.vectors * np.where(np.isnan(scales), np.nan, scales), fitted.sums / fitted.n, len(fitted.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, d)
            w = (x - means) @ basis
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * basis.shape[1], pa.int32()), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), deviations(x, n, total), lists], ["vec_id", "deviation", "w"])

    return rows.mapInArrow(run, "vec_id long, deviation long, w array<double>")


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each usable vector and component."""
    rows = settle(usable(vectors), "op12-vectors")
    fitted = fit(rows, components)
    if fitted is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    done = settle(project(rows, fitted), "op12-whitened")
    scaled = np.flatnonzero(~np.isnan(fitted.scales)).tolist()
    error = None
    if scaled:
        kept = done.select(F.array(*[F.get("w", F.lit(k)) for k in scaled]).alias("w"))
        means = kept.agg(*[F.avg(F.get("w", F.lit(k))) for k in range(len(scaled))]).first()
        error = float(np.abs(covariance(kept, "w", np.array(means)) - np.eye(len(scaled))).max())
    share = [float(e / fitted.trace) if fitted.trace > 0 else None for e in fitted.values]
    each = done.select("vec_id", "deviation", F.posexplode("w").alias("at", "w"))
    explained = F.get(F.array(*[F.lit(e).cast("double") for e in share]), F.col("at"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(fitted.n).cast("long").alias("n"), "deviation", F.nanvl("w", F.lit(None).cast("double")).alias("whitened"), explained.alias("explained"), F.lit(error).cast("double").alias("identity_error"))
