"""Exact vector search and its report."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessel.functions.text import excerpt, number_of_line

K = 8


def query_text(text: Column, size: int = 6000) -> Column:
    """What of a query is embedded: no more than a chunk."""
    return F.left(text, F.lit(size))


QUERIES = 1000  # vectors that go to every task at once; ``top_many`` takes any number, in blocks of about that


def scored(chunks: DataFrame, query: DataFrame, vector: str = "embedding", query_id: str | None = None) -> DataFrame:
    """``chunks`` without their vectors, with ``score`` against each row of ``query``; NaN scores and vectors of other sizes go.

    ``query_id`` names the rows of ``query``, and each chunk has a row for each; without it the
    query is one row. The vectors of a query go to every task, which multiplies whole batches, in
    double precision.
    """
    asked = query.select(*([query_id] if query_id else []), F.col(vector).cast("array<double>").alias("_q")).limit(QUERIES + 1).collect()
    if len(asked) > QUERIES or (query_id is None and len(asked) != 1):
        raise ValueError(f"scores are made for one vector, or for up to {QUERIES} with a query_id; top_many searches for more")
    names = [c for c in chunks.columns if c != vector]
    schema = T.StructType([chunks.schema[c] for c in names] + ([query.schema[query_id]] if query_id else []) + [T.StructField("score", T.DoubleType())])
    asked = [(x[0], np.array(x["_q"] if x["_q"] is not None else [], float)) for x in asked]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, rest = batch.column(batch.num_columns - 1), batch.select(range(batch.num_columns - 1))
            sizes = pc.list_value_length(vectors).fill_null(-1).to_numpy(zero_copy_only=False)
            for own, q in asked:
                fits = np.flatnonzero(sizes == len(q))
                if len(fits) and len(q):
                    part = vectors.take(pa.array(fits)).flatten().cast(pa.float64())
                    score = part.fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(len(fits), -1) @ q
                    good = np.flatnonzero(~np.isnan(score))
                    columns = [*rest.take(pa.array(fits[good])).columns, *([pa.array([own] * len(good), kind)] if query_id else []), pa.array(score[good])]
                    yield pa.RecordBatch.from_arrays(columns, schema.names)

    kind = to_arrow_type(query.schema[query_id].dataType) if query_id else None
    return chunks.select(*names, vector).mapInArrow(run, schema)


def top_of_each(rows: DataFrame, query_id: str, *ties: str, k: int = K) -> DataFrame:
    """The first ``k`` of each query by score, with their ``place`` from 1; each task keeps no more than that of a query."""
    order = Window.partitionBy(query_id).orderBy(F.desc("score"), *ties)
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def _best(score: np.ndarray, rank: np.ndarray, k: int) -> np.ndarray:
    """Where the ``k`` largest scores stand, the first by ``rank`` among equal ones; NaN never does."""
    known = np.flatnonzero(~np.isnan(score))
    if len(known) > k:
        least = np.partition(score[known], len(known) - k)[len(known) - k]
        known = known[score[known] >= least]
    return known[np.lexsort((rank[known], -score[known]))[:k]]


def top_many(chunks: DataFrame, query: DataFrame, query_id: str, *ties: str, k: int = K, vector: str = "embedding", block: int = QUERIES) -> DataFrame:
    """The ``k`` best ``chunks`` (without their vectors) for each row of ``query``: query_id, score, and their ``place`` from 1.

    Queries are taken in blocks of about ``block`` by a hash of their id, which go to every task.
    There a batch of chunks and the block are one matrix product in double precision, of which no
    more than ``k`` rows a query leave Python; Spark cuts again before the rest meets per query.
    Ties are in the order of the columns given, nulls first. NaN scores and vectors of other sizes
    go; so do queries without an id or a vector, and ids are expected once each.
    """
    names = [c for c in chunks.columns if c != vector]
    schema = T.StructType([chunks.schema[c] for c in names] + [query.schema[query_id], T.StructField("score", T.DoubleType())])
    kind, fields = to_arrow_type(query.schema[query_id].dataType), schema.names
    asked = query.select(F.col(query_id).alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and size(v) > 0")
    parts = -(-asked.count() // block)
    found = []
    for part in range(parts):
        rows = asked.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part).collect()
        sizes: dict[int, list] = {}
        for row in rows:
            sizes.setdefault(len(row["v"]), []).append(row)
        blocks = [(size, [r["id"] for r in own], np.array([r["v"] for r in own], float).T) for size, own in sizes.items()]

        def run(batches: Iterator[pa.RecordBatch], blocks=blocks) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                vectors, rest = batch.column(batch.num_columns - 1), batch.select(range(batch.num_columns - 1))
                order = pc.sort_indices(rest, sort_keys=[(names.index(c), "ascending") for c in ties], null_placement="at_start").to_numpy() if ties else np.arange(len(batch))
                rank = np.empty(len(batch), np.int64)
                rank[order] = np.arange(len(batch))
                long = pc.list_value_length(vectors).fill_null(-1).to_numpy(zero_copy_only=False)
                for size, ids, matrix in blocks:
                    fits = np.flatnonzero(long == size)
                    if len(fits):
                        part = vectors.take(pa.array(fits)).flatten().cast(pa.float64()).fill_null(float("nan"))
                        scores = part.to_numpy(zero_copy_only=False).reshape(len(fits), size) @ matrix
                        chosen = [_best(scores[:, q], rank[fits], k) for q in range(len(ids))]
                        at = np.concatenate(chosen)
                        of = np.repeat(np.arange(len(ids)), [len(c) for c in chosen])
                        yield pa.RecordBatch.from_arrays([*rest.take(pa.array(fits[at])).columns, pa.array([ids[q] for q in of.tolist()], kind), pa.array(scores[at, of])], fields)

        found.append(chunks.select(*names, vector).mapInArrow(run, schema))
    rows = reduce(DataFrame.unionByName, found) if found else chunks.sparkSession.createDataFrame([], schema)
    return top_of_each(rows, query_id, *ties, k=k)


def best_chunks(chunks: DataFrame, key: str, order: str) -> DataFrame:
    """key, score, chunk_index of the best chunk of each key; the lowest index wins ties.

    One aggregation that sums up in each task first: a key with many chunks costs no more.
    """
    best = F.max(F.struct("score", (-F.col(order)).alias("late")))
    return chunks.groupBy(key).agg(best.alias("b"), F.min(order).alias("ordinal")).select(key, "b.score", (-F.col("b.late")).alias("chunk_index"), "ordinal")


def with_empty(best: DataFrame, entries: DataFrame, key: str) -> DataFrame:
    """Entries without chunks (or with NaN scores only) rank last with -Infinity and -1."""
    found = entries.join(best, key, "left")
    return found.select(*entries.columns, F.coalesce("score", F.lit(float("-inf"))).alias("score"), F.coalesce("chunk_index", F.lit(-1)).alias("chunk_index"))


def top(rows: DataFrame, *ties: str, k: int = K) -> DataFrame:
    """The first ``k`` by score; ties in the order of the columns given."""
    return rows.orderBy(F.desc("score"), *ties).limit(k)


def keyword_score(text: Column, keyword: str) -> Column:
    """How often a keyword occurs, in lower case."""
    return F.regexp_count(F.lower(text), F.lit(keyword)).cast("double")


REPORT = 1000  # results of one report, at most


def _with_texts(best: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """The results (a top-k, made once) with their texts; they go to every task, which picks their texts, so no other text moves."""
    made = best.limit(REPORT + 1).collect()
    if len(made) > REPORT:
        raise ValueError(f"a report takes up to {REPORT} results: take a top-k first")
    few = best.sparkSession.createDataFrame(made, best.schema)
    return few.join(docs.select(key, "text").join(F.broadcast(few.select(key)), key, "left_semi"), key, "left")


def _places(text: Column) -> dict[str, Column]:
    """First and last line and the text of a result; all of a text for one without offsets."""
    start, end = F.col("start_offset"), F.col("end_offset")
    last = F.when((start <= 0) & (end <= 0), F.length(text)).otherwise(end)
    return {"start_line": number_of_line(text, start), "end_line": number_of_line(text, last), "chunk": excerpt(text, start, end)}


def report(best: DataFrame, docs: DataFrame, key: str = "doc_id", width: int = 40) -> DataFrame:
    """Results (few: a top-k) joined with their texts: lines, excerpt, score as text; Not Found without a text."""
    part = _places(F.col("text"))
    return _with_texts(best, docs, key).select(
        key, "chunk_index", F.format_string("%.4f", "score").alias("score"), part["start_line"].alias("start_line"), part["end_line"].alias("end_line"),
        F.coalesce(F.left(part["chunk"], F.lit(width)), F.lit("Not Found")).alias("excerpt"),
    )


#: The parts of a report, so that it reads like those of other tools.
SUMMARY, DETAILS = "# Search Results\n\n## Summary\n| Source | Score | Range (Lines) |\n|---|---|---|\n", "\n## Details\n"


def markdown(best: DataFrame, docs: DataFrame, key: str = "doc_id", limit: int = 20) -> DataFrame:
    """One row: a report in Markdown of at most ``limit`` results, the best first: a table of all, then the texts of those that have one.

    ``best`` has the key, score, start_offset and end_offset; ``docs`` the key and text. Details are numbered
    among themselves. Ties are in the order of the key, then of the offsets.
    """
    first = best.orderBy(F.desc("score"), key, "start_offset", "end_offset").limit(limit)
    rows = _with_texts(first, docs, key).withColumns(_places(F.col("text")))
    name, found = F.col(key).cast("string"), F.col("text").isNotNull()
    lines = F.concat(F.col("start_line").cast("string"), F.lit(".."), F.col("end_line").cast("string"))
    entry = F.concat(F.lit("| "), name, F.lit(" | "), F.format_string("%.4f", "score"), F.lit(" | "), F.when(found, lines).otherwise("Not Found"), F.lit(" |\n"))
    detail = F.when(found, F.concat(name, F.lit(" (Lines "), lines, F.lit(")\n```text\n"), F.coalesce("chunk", F.lit("")), F.lit("\n```\n\n")))
    order = F.struct((-F.col("score")).alias("s"), F.col(key).alias("k"), "start_offset", "end_offset", entry.alias("entry"), detail.alias("detail"))
    all_of = F.array_sort(F.collect_list(order))
    details = F.filter(F.transform(all_of, lambda x: x["detail"]), lambda x: x.isNotNull())
    numbered = F.transform(details, lambda x, n: F.concat(F.lit("### "), (n + 1).cast("string"), F.lit(". "), x))
    return rows.agg(F.concat(F.lit(SUMMARY), F.array_join(F.transform(all_of, lambda x: x["entry"]), ""), F.lit(DETAILS), F.array_join(numbered, "")).alias("markdown"))
