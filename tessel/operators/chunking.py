"""Overlapping chunks that end at sentences, and a deterministic embedder for them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that Java counts as white space, beside Unicode's separators without the no-break ones.
_BLANK = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f               　"
CHUNK, OVERLAP, LOOKBACK = 6000, 480, 240


def good_end(text: str, limit: int, lookback: int) -> int:
    """Where to cut before ``limit``: behind a sentence, else behind a line end, else at the limit."""
    low = max(0, limit - lookback)
    for k in range(limit - 1, low - 1, -1):
        if text[k] in ".!?" and (k + 1 == limit or text[k + 1] in _BLANK):
            return k + 1
    line = max(text.rfind("\n", low, limit), text.rfind("\r", low, limit))
    return line + 1 if line >= 0 else limit


def cut(text: str, size: int, overlap: int, lookback: int) -> list[tuple[int, int]]:
    """(start, end) of each chunk."""
    out, at = [], 0
    while at < len(text):
        end = min(at + size, len(text))
        if end < len(text):
            end = good_end(text, end, lookback)
        out.append((at, end))
        if end >= len(text):
            break
        again = end - overlap
        at = end if again <= at else max(at + 1, good_end(text, again, lookback))
    return out


def chunks(docs: DataFrame, size: int = CHUNK, overlap: int = OVERLAP, lookback: int = LOOKBACK, key: str = "doc_id") -> DataFrame:
    """key, chunk_index, start_offset, end_offset, chunk; offsets in code points. An empty text has no chunk."""
    if size <= 0 or overlap < 0 or lookback < 0 or lookback > size:
        raise ValueError("a chunk needs 0 < size, 0 <= overlap and 0 <= lookback <= size")
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                rows = [(k, n, a, b, t[a:b]) for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for n, (a, b) in enumerate(cut(t, size, overlap, lookback))]
                columns = [*zip(*rows, strict=True)] or [[]] * 5
                kinds = [batch.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [key, "chunk_index", "start_offset", "end_offset", "chunk"])

    given = docs.select(key, F.coalesce("text", F.lit("")).alias("text"))
    return given.mapInArrow(run, f"{key} {kind}, chunk_index int, start_offset int, end_offset int, chunk string")


DIMENSIONS = 16


def embedded(pieces: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_chunks, n_tokens, v0 to v15: words of all chunks of an entry, counted by the first hex digit of their MD5.

    This stands in for a remote embedder, whose answer would be as deterministic per chunk. Words
    are rows that each task sums up before they move.
    """
    words = pieces.select(key, F.posexplode_outer(F.split(F.lower("chunk"), "[^a-z0-9]+")).alias("pos", "w"))
    rows = words.select(key, (F.coalesce("pos", F.lit(0)) == 0).alias("first"), F.when(F.col("w") != "", F.substring(F.md5(F.col("w").cast("binary")), 1, 1)).alias("digit"))
    counts = [F.count_if(F.col("digit") == f"{d:x}").alias(f"v{d}") for d in range(DIMENSIONS)]
    return rows.groupBy(key).agg(F.count_if("first").alias("n_chunks"), F.count("digit").alias("n_tokens"), *counts)


def embed_with(pieces: DataFrame, embedder: Callable[[list[str]], tuple[list[int], np.ndarray]], text: str = "chunk", batch_size: int = 64) -> DataFrame:
    """``pieces`` with n_tokens and embedding by any ``embedder`` of lists of texts (chunks or queries), in batches.

    It gives token counts and a matrix with a row a text, and must be deterministic, as tasks may run again.
    """
    schema = T.StructType([*pieces.schema.fields, T.StructField("n_tokens", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])
    place = pieces.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, batch_size):
                part = batch.slice(begin, batch_size)
                tokens, rows = embedder([x or "" for x in part.column(place).to_pylist()])
                vectors = pa.array(list(np.asarray(rows, np.float32)), pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(tokens, pa.int64()), vectors], schema.names)

    return pieces.mapInArrow(run, schema)
