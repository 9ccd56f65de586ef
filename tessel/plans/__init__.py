"""Whole jobs made of operators: ingest and search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.operators import chunking, search, store


def ingest(old: DataFrame, files: DataFrame) -> DataFrame:
    """The store after files (key, mod_ts, size, text): changed ones are chunked and embedded, others stay."""
    fresh = files.join(old.select("key", "mod_ts", "size"), ["key", "mod_ts", "size"], "left_anti")
    vectors = chunking.embedded(chunking.chunks(fresh, key="key"), "key")
    rows = fresh.select("key", "mod_ts", "size").join(vectors, "key", "left")
    new = rows.select("key", "mod_ts", "size", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.array(*[F.coalesce(f"v{d}", F.lit(0)).cast("float") for d in range(chunking.DIMENSIONS)]).alias("embedding"))
    return store.upsert(old, new).drop("status")


def find(entries: DataFrame, query: DataFrame, k: int = search.K) -> DataFrame:
    """The best ``k`` entries for a query row."""
    return search.top(search.scored(entries, query), "key", k=k)
