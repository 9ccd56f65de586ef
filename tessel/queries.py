"""Registered queries of the engine and their SQL counterparts (DuckDB)."""

from __future__ import annotations

import gzip
import io
import uuid
import zipfile
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessel.functions import text as text_
from tessel.functions import vectors
from tessel.operators import artifacts, chunking, events, glossary, search, store, textfiles, tools, usage
from tessel.session import shared_folder
from tessel.sources.files import resolved_settings, resources, table
from tessel.streaming import drained, log, sessions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Register a query under its function's name, with its SQL."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return put


_DOT = "list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE))"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return search.scored(e, e.where("vec_id = 0"))


@query(f"""
SELECT e.vec_id, round({_DOT}, 9) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY {_DOT} DESC, e.vec_id LIMIT 8""")
def search_topk(spark, sf_dir):
    """The eight vectors nearest to vector 0."""
    return search.top(_scored(spark, sf_dir), "vec_id").select("vec_id", F.round("score", 9).alias("score"))


@query(f"""
SELECT query_id, place, vec_id, round(score, 9) AS score FROM (SELECT q.vec_id AS query_id, e.vec_id, {_DOT} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DOT} DESC, e.vec_id)::INTEGER AS place
FROM embeddings e, (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 50 = 0) q) WHERE place <= 8""")
def search_many(spark, sf_dir):
    """The eight vectors nearest to each vector whose number divides by 50."""
    e = table(spark, sf_dir, "embeddings")
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return search.top_many(e.select("vec_id", "embedding"), asked, "query_id", "vec_id").select("query_id", "place", "vec_id", F.round("score", 9).alias("score"))


@query(f"""
WITH s AS (SELECT label AS key, vec_id, {_DOT} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)
SELECT key, round(score, 9) AS score, vec_id AS chunk_index FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, vec_id) AS n FROM s WHERE NOT isnan(score)) WHERE n = 1""")
def search_best_chunk(spark, sf_dir):
    """The best chunk of each entry (label)."""
    return search.best_chunks(_scored(spark, sf_dir), "label", "vec_id").select(F.col("label").alias("key"), F.round("score", 9).alias("score"), "chunk_index")


def _split_sql(text: str, limit: str, lookback: int) -> str:
    region = f"reverse(substr({text}, greatest(0, {limit} - {lookback}) + 1, {limit} - greatest(0, {limit} - {lookback})))"
    return f"""(CASE WHEN regexp_matches({region}, '(?s)^(?:.*?\\s)??[.!?]') THEN {limit} - length(regexp_extract({region}, '(?s)^(?:.*?\\s)??[.!?]')) + 1
        WHEN regexp_matches({region}, '[\\n\\r]') THEN {limit} - length(regexp_extract({region}, '^[^\\n\\r]*[\\n\\r]')) + 1 ELSE {limit} END)"""


def _chunks_sql(size: int, overlap: int, lookback: int) -> str:
    return f"""
WITH RECURSIVE walk AS (
    SELECT doc_id, text, 0 AS n, 0::BIGINT AS pos, (CASE WHEN {size} < length(text) THEN {_split_sql("text", str(size), lookback)} ELSE length(text) END)::BIGINT AS stop
    FROM documents WHERE length(text) > 0
  UNION ALL
    SELECT doc_id, text, n + 1, start, CASE WHEN start + {size} < length(text) THEN {_split_sql("text", f"(start + {size})", lookback)} ELSE length(text) END
    FROM (SELECT *, CASE WHEN stop - {overlap} <= pos THEN stop ELSE greatest(pos + 1, {_split_sql("text", f"(stop - {overlap})", lookback)}) END AS start FROM walk WHERE stop < length(text))
)"""


_CHUNK_COLUMNS = "SELECT doc_id, n::INTEGER AS chunk_index, pos::INTEGER AS start_offset, stop::INTEGER AS end_offset FROM walk"


@query(_chunks_sql(6000, 480, 240) + _CHUNK_COLUMNS)
def chunk_documents(spark, sf_dir):
    """Chunks with the default sizes."""
    return chunking.chunks(table(spark, sf_dir, "documents")).drop("chunk")


@query(_chunks_sql(500, 80, 60) + _CHUNK_COLUMNS)
def chunk_small(spark, sf_dir):
    """Chunks with small sizes."""
    return chunking.chunks(table(spark, sf_dir, "documents"), 500, 80, 60).drop("chunk")


@query(
    _chunks_sql(6000, 480, 240)
    + ", w AS (SELECT doc_id, n, list_filter(string_split_regex(lower(substr(text, pos + 1, stop - pos)), '[^a-z0-9]+'), lambda x: x <> '') AS words FROM walk), s AS (SELECT doc_id, len(words) AS k, list_transform(words, lambda x: strpos('0123456789abcdef', md5(x)[1]) - 1) AS s FROM w)"
    + "SELECT doc_id, count(*)::BIGINT AS n_chunks, sum(k)::BIGINT AS n_tokens, "
    + ", ".join(f"sum(len(list_filter(s, lambda x: x = {d})))::BIGINT AS v{d}" for d in range(16))
    + " FROM s GROUP BY doc_id"
)
def embed_hash(spark, sf_dir):
    """Chunks embedded by hashed word counts, summed by document."""
    return chunking.embedded(chunking.chunks(table(spark, sf_dir, "documents")))


@query("""
WITH o AS (SELECT doc_id AS key, n_chars AS mod_ts, n_chars AS size FROM documents WHERE doc_id % 2 = 0),
n AS (SELECT doc_id AS key, n_chars + (CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END) AS mod_ts, n_chars AS size FROM documents WHERE doc_id % 5 <> 4)
SELECT coalesce(n.key, o.key) AS key, coalesce(n.mod_ts, o.mod_ts) AS mod_ts, coalesce(n.size, o.size) AS size, CASE WHEN n.key IS NULL THEN 'kept' WHEN o.key IS NULL THEN 'inserted' WHEN o.mod_ts = n.mod_ts AND o.size = n.size THEN 'kept' ELSE 'updated' END AS status FROM n FULL JOIN o ON o.key = n.key""")
def incremental_upsert(spark, sf_dir):
    """A store of the even documents after four fifths of all documents come, a third of them changed."""
    docs = table(spark, sf_dir, "documents")
    old = docs.where("doc_id % 2 = 0").select(F.col("doc_id").alias("key"), F.col("n_chars").alias("mod_ts"), F.col("n_chars").alias("size"))
    new = docs.where("doc_id % 5 <> 4").select(F.col("doc_id").alias("key"), (F.col("n_chars") + F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0)).alias("mod_ts"), F.col("n_chars").alias("size"))
    return store.upsert(old, new)


_Q8_SQL = """
WITH b AS (SELECT vec_id, unnest(range(8)) AS block, list_concat(embedding, list_transform(range(256 - len(embedding)), lambda x: 0::FLOAT)) AS v FROM embeddings),
p AS (SELECT vec_id, block, v[block * 32 + 1:block * 32 + 32] AS part FROM b),
s AS (SELECT vec_id, block, part, (CASE WHEN list_max(list_transform(part, lambda x: abs(x))) = 0 THEN 1::FLOAT ELSE (list_max(list_transform(part, lambda x: abs(x))) / 127::FLOAT)::FLOAT END) AS scale FROM p),
q AS (SELECT vec_id, block, part, scale, list_transform(part, lambda x: greatest(-128, least(127, floor((x / scale)::FLOAT::DOUBLE + 0.5)))::INTEGER) AS q FROM s)"""


@query(_Q8_SQL + "SELECT vec_id, block::INTEGER AS block, scale::DOUBLE AS scale, array_to_string(q, ',') AS q FROM q")
def q8_quantize(spark, sf_dir):
    """Vectors, filled up to 256 values, as blocks of 8-bit values."""
    full = table(spark, sf_dir, "embeddings").select("vec_id", vectors.checked(vectors.padded(F.col("embedding"))).alias("v"))
    rows = full.select("vec_id", F.posexplode(vectors.blocks(F.col("v"))).alias("block", "b"))
    return rows.select("vec_id", "block", F.col("b.scale").cast("double").alias("scale"), F.array_join(F.transform("b.q", lambda x: x.cast("string")), ",").alias("q"))


@query(
    _Q8_SQL
    + """, h AS (SELECT *, round_even(scale::DOUBLE / pow(2, floor(log2(scale::DOUBLE)) - 10), 0) * pow(2, floor(log2(scale::DOUBLE)) - 10) AS half FROM q)
SELECT vec_id, round(max(list_max(list_transform(list_zip(part, q), lambda x: abs(x[1]::DOUBLE - (x[2] * half)::FLOAT::DOUBLE)))), 9) AS max_error FROM h GROUP BY vec_id"""
)
def q8_roundtrip(spark, sf_dir):
    """The largest error of each vector through its stored bytes."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", vectors.padded(F.col("embedding")).alias("v")).withColumn("d", vectors.q8_values(vectors.q8_bytes("v")))
    return rows.select("vec_id", F.round(F.array_max(F.zip_with("v", "d", lambda a, b: F.abs(a.cast("double") - b.cast("double")))), 9).alias("max_error"))


@query("""
SELECT 'vec;"' || vec_id AS key, 7::BIGINT AS size, 1::INTEGER AS n_chunks, len(embedding)::INTEGER AS n_values, embedding[1]::DOUBLE AS first_value, embedding[-1]::DOUBLE AS last_value FROM embeddings""")
def db_roundtrip(spark, sf_dir):
    """Entries as lines of text and back."""
    piece = F.array(F.struct(F.lit(0).alias("start"), F.lit(9).alias("end"), F.col("embedding").alias("vec")))
    entries = table(spark, sf_dir, "embeddings").select(F.concat(F.lit('vec;"'), F.col("vec_id").cast("string")).alias("key"), F.lit(5).cast("long").alias("mod_ts"), F.lit(7).cast("long").alias("size"), F.lit(1).alias("prompt_tokens"), F.lit(2).alias("total_tokens"), piece.alias("chunks"))
    back = store.from_lines(store.to_lines(entries).withColumn("ordinal", F.monotonically_increasing_id()))
    return back.select("key", "size", (F.col("chunk_index") + 1).alias("n_chunks"), F.size("vec").alias("n_values"), F.element_at("vec", 1).cast("double").alias("first_value"), F.element_at("vec", -1).cast("double").alias("last_value"))


@query("""
SELECT vec_id, (3 + vec_id % 5)::INTEGER AS prompt_tokens, 0::INTEGER AS total_tokens, len(embedding)::INTEGER AS n_values, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 9) AS total FROM embeddings""")
def embedding_response(spark, sf_dir):
    """A service's JSON answers, read by pattern; a count that isn't there is 0."""
    numbers = F.array_join(F.transform("embedding", lambda x: x.cast("string")), ", ")
    json = F.concat(F.lit('{"usage": {"prompt_tokens": '), (3 + F.col("vec_id") % 5).cast("string"), F.lit('}, "data": [{"embedding": ['), numbers, F.lit("]}]}"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", json.alias("j")).select("vec_id", text_.json_int(F.col("j"), "prompt_tokens").alias("prompt_tokens"), text_.json_int(F.col("j"), "total_tokens").alias("total_tokens"), text_.json_floats(F.col("j"), "embedding").alias("v"))
    return rows.select("vec_id", "prompt_tokens", "total_tokens", F.size("v").alias("n_values"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double")), 9).alias("total"))


@query("""
SELECT vec_id, len(embedding)::INTEGER AS n, embedding[1]::DOUBLE AS a1, embedding[2]::DOUBLE AS a2, embedding[3]::DOUBLE AS a3, embedding[-3]::DOUBLE AS z1, embedding[-2]::DOUBLE AS z2, embedding[-1]::DOUBLE AS z3 FROM embeddings""")
def vector_stats(spark, sf_dir):
    """Size, first and last values."""
    at = {"a1": 1, "a2": 2, "a3": 3, "z1": -3, "z2": -2, "z3": -1}
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size("embedding").alias("n"), *[F.element_at("embedding", k).cast("double").alias(n) for n, k in at.items()])


@query(
    _chunks_sql(500, 80, 60)
    + """, s AS (SELECT doc_id, n, pos, stop, ((length(c) - length(replace(c, 'th', ''))) / 2)::DOUBLE AS score FROM (SELECT *, lower(substr(text, pos + 1, stop - pos)) AS c FROM walk)),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, n) AS k FROM s) WHERE k = 1 ORDER BY score DESC, doc_id LIMIT 8),
t AS (SELECT b.*, text, length(text) AS size FROM b JOIN documents USING (doc_id))
SELECT doc_id, n::INTEGER AS chunk_index, printf('%.4f', score) AS score,
  (CASE WHEN pos <= 0 THEN 1 ELSE 1 + length(left(text, least(pos, size - 1))) - length(replace(left(text, least(pos, size - 1)), chr(10), '')) END)::INTEGER AS start_line,
  (CASE WHEN stop <= 0 THEN 1 ELSE 1 + length(left(text, CASE WHEN stop >= size THEN size - 1 ELSE stop END)) - length(replace(left(text, CASE WHEN stop >= size THEN size - 1 ELSE stop END), chr(10), '')) END)::INTEGER AS end_line,
  left(substr(text, pos + 1, least(stop, size) - pos), 40) AS excerpt FROM t"""
)
def search_report(spark, sf_dir):
    """The best chunks by a keyword with their lines and excerpts."""
    docs = table(spark, sf_dir, "documents")
    pieces = chunking.chunks(docs, 500, 80, 60).withColumn("score", search.keyword_score(F.col("chunk"), "th"))
    best = pieces.groupBy("doc_id").agg(F.max(F.struct("score", (-F.col("chunk_index")).alias("late"), "start_offset", "end_offset")).alias("b"))
    few = search.top(best.select("doc_id", "b.score", (-F.col("b.late")).alias("chunk_index"), "b.start_offset", "b.end_offset"), "doc_id")
    return search.report(few, docs)


_PATH_SQL = "regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '')"


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path"), F.length("html").cast("long").alias("size"))


@query(f"""
SELECT path, size FROM (SELECT {_PATH_SQL} AS path, length(html)::BIGINT AS size FROM pages)
WHERE regexp_full_match(path, '(?s).*/[^/]*[0-9](?:\\.html|[^/])') AND NOT regexp_matches(path, '^(?:www\\.[^/]*|m\\.[^/]*)(?:/|$)') AND NOT regexp_full_match(path, '[^/]*/fr(?:/.*)?')""")
def find_files_glob(spark, sf_dir):
    """Paths by glob, without excluded directories."""
    return textfiles.find_by_glob(_paths(spark, sf_dir), "**/*[0-9]{.html,?}", r"www\.[^/]*|m\.[^/]*|[^/]*/fr").select("path", "size")


@query(f"""
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'other/x' ELSE 'base/' || array_to_string(list_filter(string_split({_PATH_SQL}, '/'), lambda x: x <> ''), '/') END AS normal, page_id % 3 <> 0 AS allowed FROM pages""")
def path_guard(spark, sf_dir):
    """Paths that may leave their base directory, normalised and judged."""
    rows = _paths(spark, sf_dir)
    parts = F.size(F.filter(F.split("path", "/"), lambda x: x != ""))
    up = F.concat(F.lit("./"), "path", F.lit("/"), F.array_join(F.array_repeat(F.lit(".."), parts + 1), "/"), F.lit("/other//x"))
    rows = rows.select("page_id", F.when(F.col("page_id") % 3 == 0, up).otherwise(F.col("path")).alias("path"))
    return textfiles.allowed(rows, "base", ".*").select("page_id", "normal", "allowed")


@query("""
WITH l AS (SELECT doc_id, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS l FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), '\\r\\n|\\r|\\n') AS l FROM documents))
SELECT doc_id, 'Lines 2-' || least(5, len(l)) || ' of ' || len(l) AS header, coalesce(array_to_string(l[2:5], chr(10)), '') AS body, len(l[2:5])::INTEGER AS lines_read, len(l)::INTEGER AS total_lines, len(l) > 5 AS truncated, (CASE WHEN len(l) > 5 THEN 6 END)::INTEGER AS next_line FROM l""")
def line_range(spark, sf_dir):
    """Lines 2 to 5 of every document."""
    return textfiles.line_range(table(spark, sf_dir, "documents"), 2, 5)


@query("""
SELECT doc_id, ((length(text) - length(replace(text, 'the', ''))) / 3)::INTEGER AS replacements, md5(replace(text, 'the', '<THE>')) AS digest FROM documents""")
def edit_replace_all(spark, sf_dir):
    """A literal replaced everywhere."""
    return textfiles.replace_all(table(spark, sf_dir, "documents"), "the", "<THE>").select("doc_id", "replacements", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("""
SELECT doc_id, (CASE WHEN strpos(text, '. ') > 0 THEN 1 ELSE 0 END)::INTEGER AS replacements, md5(CASE WHEN strpos(text, '. ') > 0 THEN left(text, strpos(text, '. ') - 1) || '! ' || substr(text, strpos(text, '. ') + 2) ELSE text END) AS digest FROM documents""")
def edit_replace_first(spark, sf_dir):
    """A literal replaced once."""
    return textfiles.replace_first(table(spark, sf_dir, "documents"), ". ", "! ").select("doc_id", "replacements", F.md5(F.col("text").cast("binary")).alias("digest"))


_NEEDLE = "the zzq"


def _prefix_sql() -> str:
    cases = "".join(f" WHEN regexp_matches(text, '(?s){_NEEDLE[:n]}[^{_NEEDLE[n]}]') THEN {n}" for n in reversed(range(len(_NEEDLE))))
    places = "".join(f" WHEN {n} THEN length(regexp_extract(text, '(?s)^(.*){_NEEDLE[:n]}[^{_NEEDLE[n]}]', 1))" for n in range(len(_NEEDLE)))
    return f"""
SELECT doc_id, n::INTEGER AS prefix_length, place::INTEGER AS position, '{_NEEDLE}'[n + 1] AS expected, substr(text, place + n + 1, 1) AS actual FROM (
SELECT *, CASE n {places} END AS place FROM (SELECT doc_id, text, CASE {cases} END AS n FROM documents))"""


@query(_prefix_sql())
def edit_longest_prefix(spark, sf_dir):
    """How far a text that isn't there matches at best."""
    return textfiles.longest_prefix(table(spark, sf_dir, "documents"), _NEEDLE).drop("actual_code")


@query("""
SELECT p_partkey, p_name FROM part WHERE contains(replace(lower(p_name), ' ', ''), 'redwid') OR contains(replace(lower(p_name), ' ', ''), 'gear')""")
def keyword_search(spark, sf_dir):
    """Titles with any of some keywords; an underscore in a keyword stays."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".mp4")).alias("file"))
    return textfiles.keyword_hits(rows, F.col("file"), ["Red wid", "GEAR", "blue_bolt"]).select("p_partkey", "p_name")


def _glossary(spark: SparkSession, sf_dir: str, resolve_references: bool = False) -> DataFrame:
    entry = F.concat(F.lit("# "), "p_name", F.lit("\n"), F.when(F.col("p_partkey") % 7 == 0, F.lit("-> red widget")).otherwise(F.concat("p_type", F.lit("\n## "), F.col("p_size").cast("string"))), F.lit("\n"))
    entries = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", entry.alias("t")))), lambda x: x["t"]), "")
    files = table(spark, sf_dir, "part").groupBy(F.floor(F.col("p_partkey") / 100).alias("file")).agg(F.concat(F.lit("text before\n"), entries).alias("text"))
    return glossary.parse(files, resolve_references)


_GLOSSARY_SQL = """
WITH g AS (SELECT regexp_replace(lower(p_name), '[ _-]', '', 'g') AS key, p_name AS term, p_type || chr(10) || '## ' || p_size AS description FROM (
SELECT *, row_number() OVER (PARTITION BY regexp_replace(lower(p_name), '[ _-]', '', 'g') ORDER BY p_partkey) AS n FROM part WHERE p_partkey % 7 <> 0) WHERE n = 1)"""


@query(_GLOSSARY_SQL + "SELECT key, term, description FROM g")
def glossary_parse(spark, sf_dir):
    """Entries of Markdown files; the first of equal keys stays, references go."""
    return _glossary(spark, sf_dir).select("key", "term", "description")


@query(_GLOSSARY_SQL + "SELECT min(pos)::INTEGER AS pos, key, any_value(term) AS term, any_value(description) AS description FROM (VALUES (1, 'redwidget'), (3, 'bluebolt'), (4, 'redwidget'), (5, 'hotgear'), (0, 'zz')) w(pos, key) JOIN g USING (key) GROUP BY key")
def glossary_lookup(spark, sf_dir):
    """Words looked up by key, each key once."""
    words = spark.createDataFrame([(0, "zz"), (1, "Red_Widget"), (2, None), (3, '"blue bolt"'), (4, "red-widget"), (5, "HOT gear")], "pos int, word string")
    return glossary.look_up(_glossary(spark, sf_dir), words)


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    kind, value = F.col("event_type"), F.col("value")
    server = kind == "purchase"
    return table(spark, sf_dir, "events").select(
        "event_id", k.alias("prompt_tokens"), (k % 13).alias("completion_tokens"), (k + k % 13).alias("total_tokens"), F.replace(F.col("ts").cast("string"), F.lit(" "), F.lit("T")).alias("ts_start"), (k % 5).alias("cached_tokens"),
        F.format_string('{"prompt_tokens":%d,"prompt_tokens_details":{"cached_tokens":%d}}', k, k % 5).alias("usage"), kind.alias("model"),
        F.when(server, value * 10).alias("prompt_ms"), F.when(server, value * 3).alias("predicted_ms"), F.when(server, value).alias("prompt_per_second"), F.when(server, value / 2).alias("predicted_per_second"),
        F.when(kind == "view", F.floor(value * 7).cast("long")).alias("first_ms"), F.floor(value * 20).cast("long").alias("total_ms"),
    )


_CALLS_SQL = """
WITH c AS (SELECT event_id, event_type AS model, value, (props->>'$.k')::BIGINT AS p, (props->>'$.k')::BIGINT % 13 AS g, floor(value * 7)::BIGINT AS first_ms, floor(value * 20)::BIGINT AS total_ms FROM events),
w AS (SELECT *, CASE WHEN total_ms > 0 AND g > 0 THEN 1000.0::DOUBLE * (p / 5.0::DOUBLE + g) / total_ms ELSE 0 END AS r FROM c)"""


@query(
    _CALLS_SQL
    + """
SELECT event_id,
  CASE model WHEN 'purchase' THEN floor(value * 10 + 0.5)::BIGINT WHEN 'view' THEN first_ms ELSE (CASE WHEN r > 0 AND p > 0 THEN floor(p * 1000.0::DOUBLE / (5 * r) + 0.5)::BIGINT ELSE total_ms END) END AS millis_pp,
  CASE model WHEN 'purchase' THEN floor(value * 3 + 0.5)::BIGINT WHEN 'view' THEN total_ms - first_ms ELSE (CASE WHEN r > 0 AND g > 0 THEN floor(g * 1000.0::DOUBLE / r + 0.5)::BIGINT ELSE total_ms END) END AS millis_tg,
  round(CASE model WHEN 'purchase' THEN value WHEN 'view' THEN (CASE WHEN first_ms > 0 AND p > 0 THEN p * 1000.0::DOUBLE / first_ms ELSE 0 END) ELSE 5 * r END, 6) AS pp_tps,
  round(CASE model WHEN 'purchase' THEN value / 2 WHEN 'view' THEN (CASE WHEN total_ms - first_ms > 0 AND g > 0 THEN g * 1000.0::DOUBLE / (total_ms - first_ms) ELSE 0 END) ELSE r END, 6) AS tg_tps FROM w"""
)
def usage_rates(spark, sf_dir):
    """Rates of calls by server timings, stream or buffer."""
    return usage.rates(_calls(spark, sf_dir)).select("event_id", "millis_pp", "millis_tg", F.round("pp_tps", 6).alias("pp_tps"), F.round("tg_tps", 6).alias("tg_tps"))


@query(
    _CALLS_SQL
    + """, r AS (SELECT *,
  CASE model WHEN 'purchase' THEN floor(value * 10 + 0.5)::BIGINT WHEN 'view' THEN first_ms ELSE (CASE WHEN r > 0 AND p > 0 THEN floor(p * 1000.0::DOUBLE / (5 * r) + 0.5)::BIGINT ELSE total_ms END) END AS millis_pp,
  CASE model WHEN 'purchase' THEN floor(value * 3 + 0.5)::BIGINT WHEN 'view' THEN total_ms - first_ms ELSE (CASE WHEN r > 0 AND g > 0 THEN floor(g * 1000.0::DOUBLE / r + 0.5)::BIGINT ELSE total_ms END) END AS millis_tg,
  CASE model WHEN 'purchase' THEN value WHEN 'view' THEN (CASE WHEN first_ms > 0 AND p > 0 THEN p * 1000.0::DOUBLE / first_ms ELSE 0 END) ELSE 5 * r END AS pp,
  CASE model WHEN 'purchase' THEN value / 2 WHEN 'view' THEN (CASE WHEN total_ms - first_ms > 0 AND g > 0 THEN g * 1000.0::DOUBLE / (total_ms - first_ms) ELSE 0 END) ELSE r END AS tg FROM w)
SELECT 'llm-request' AS type, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS "tsStart", millis_pp AS "millisPP", millis_tg AS "millisTG", model, p AS "promptTokens", g AS "completionTokens", p + g AS "totalTokens", p % 5 AS "cachedTokens",
  round(pp::FLOAT::DOUBLE, 3) AS "ppTPS", round(tg::FLOAT::DOUBLE, 3) AS "tgTPS", p AS "raw_prompt", p % 5 AS "raw_cached", 12::INTEGER AS n_fields FROM r JOIN (SELECT event_id, ts FROM events) USING (event_id)"""
)
def usage_jsonl(spark, sf_dir):
    """Calls as lines of JSON, all twelve fields read back."""
    value, of = F.parse_json("value"), {"type": "string", "tsStart": "string", "millisPP": "bigint", "millisTG": "bigint", "model": "string", "promptTokens": "bigint", "completionTokens": "bigint", "totalTokens": "bigint", "cachedTokens": "bigint", "ppTPS": "double", "tgTPS": "double"}
    rows = usage.as_json(usage.rates(_calls(spark, sf_dir))).withColumn("v", value)
    fields = [F.try_variant_get("v", f"$.{n}", t).alias(n) for n, t in of.items()]
    raw = [F.try_variant_get("v", f"$.usage.{p}", "bigint").alias(n) for p, n in (("prompt_tokens", "raw_prompt"), ("prompt_tokens_details.cached_tokens", "raw_cached"))]
    whole = rows.select(*fields, *raw, F.size(F.json_object_keys("value")).alias("n_fields"))
    return whole.withColumns({"tsStart": F.substring("tsStart", 1, 19), **{c: F.round(F.col(c).cast("float").cast("double"), 3) for c in ("ppTPS", "tgTPS")}})


@query(_CALLS_SQL + "SELECT count(*) AS n_calls, sum(p)::BIGINT AS prompt_tokens, sum(g)::BIGINT AS completion_tokens, sum(p + g)::BIGINT AS total_tokens, count(*) || ' calls' AS message FROM c")
def usage_totals(spark, sf_dir):
    """Totals of all calls."""
    return usage.totals(_calls(spark, sf_dir))


@query("""
SELECT user_id, strftime(min(ts) FILTER (event_type = 'view'), '%Y-%m-%d %H:%M:%S.%f') AS first_at, arg_max(value, (ts, value)) FILTER (event_type = 'purchase') AS last_value FROM events GROUP BY user_id""")
def stream_first_last(spark, sf_dir):
    """First view and last purchase of each user."""
    rows = events.first_and_last(table(spark, sf_dir, "events"), "user_id", "ts", "value", F.col("event_type") == "view", F.col("event_type") == "purchase")
    return rows.withColumn("first_at", F.date_format("first_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query("""
SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS pos, '{"turn":' || turn || ',"role":"' || role || '","size":' || length(text) || '}' AS payload FROM conversations""")
def sse_parse(spark, sf_dir):
    """Payloads of event streams that were cut anywhere."""
    line = F.concat(F.lit('data: {"turn":'), F.col("turn").cast("string"), F.lit(',"role":"'), "role", F.lit('","size":'), F.length("text").cast("string"), F.lit("}\r\n\r\n"))
    whole = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), ": ping\n"), F.lit("data: [DONE]\n")).alias("s"))
    pieces = whole.select("conv_id", F.posexplode(F.transform(F.sequence(F.lit(0), ((F.length("s") - 1) / 17).cast("int")), lambda k: F.substring(F.col("s"), k * 17 + 1, F.lit(17)))).alias("seq", "piece"))
    return events.payloads(pieces, "conv_id")


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT user_id, epoch_us(ts) // 1000 AS "at" FROM events), walk AS (
    SELECT user_id, min("at") AS "at" FROM e GROUP BY user_id
  UNION ALL
    SELECT w.user_id, min(e."at") AS "at" FROM walk w JOIN e ON e.user_id = w.user_id AND e."at" >= w."at" + 3600000 GROUP BY w.user_id, w."at"
) SELECT user_id, "at" FROM walk""")
def throttle(spark, sf_dir):
    """Events of each user at least an hour apart."""
    rows = table(spark, sf_dir, "events").select("user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"))
    return events.throttled(rows, "user_id", "at", 3600)


@query("""
SELECT conv_id, count(*)::INTEGER AS n_turns, md5(string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn)) AS history, arg_max(text, turn) FILTER (role = 'assistant') AS last_answer FROM conversations GROUP BY conv_id""")
def conversation_state(spark, sf_dir):
    """Conversations in order, and their last answers."""
    return events.conversations(table(spark, sf_dir, "conversations")).withColumn("history", F.md5(F.col("history").cast("binary")))


@query("""
SELECT event_type AS name, count(*) AS call_count, count(*) FILTER (value >= 5) AS calls_ok, arg_max(user_id % 2 = 0, (ts, event_id)) AS is_active FROM events GROUP BY event_type ORDER BY 1""")
def registry_table(spark, sf_dir):
    """Counters of each tool, and whether it is on."""
    e = table(spark, sf_dir, "events")
    toggles = e.select(F.col("event_type").alias("name"), (F.col("user_id") % 2 == 0).alias("active"), F.struct("ts", "event_id").alias("ts"))
    return events.tool_table(e.select(F.col("event_type").alias("name"), (F.col("value") >= 5).alias("ok")), toggles)


def _jars(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, version = F.replace("p_name", F.lit(" "), F.lit("-")), F.concat(F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 4).cast("string"))
    folder = F.concat(F.lit("/home/u/repository/org/"), F.lower("p_type"), F.lit("/"), name, F.lit("/"), version, F.lit("/"))
    good = F.concat(folder, name, F.lit("-"), version, F.when(F.col("p_partkey") % 3 == 0, "-sources").otherwise(""), F.lit(".jar"))
    loose = F.concat(F.lit("/lib/"), name, F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("-"), version)).otherwise(""), F.lit(".jar"))
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", F.when(F.col("p_partkey") % 5 == 0, loose).otherwise(good).alias("path"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN 'org.' || lower(p_type) END AS group_id, CASE WHEN p_partkey % 5 <> 0 THEN replace(p_name, ' ', '-') END AS artifact_id,
  CASE WHEN p_partkey % 5 <> 0 OR p_partkey % 2 = 0 THEN p_size || '.' || (p_partkey % 4) ELSE 'unknown' END AS version FROM part""")
def artifact_coords(spark, sf_dir):
    """Coordinates and versions of archive paths."""
    rows = _jars(spark, sf_dir).withColumn("c", artifacts.coordinates(F.col("path"), "/home/u/repository"))
    return rows.select("p_partkey", "c.group_id", "c.artifact_id", artifacts.version(F.col("path")).alias("version"))


@query("""
WITH e AS (SELECT 'pkg.' || replace(p_name, ' ', '_') AS class_name, p_partkey % 3 AS tier, p_partkey AS ordinal FROM part WHERE p_size > 20),
w AS (SELECT DISTINCT 'pkg.' || replace(p_name, ' ', '_') AS class_name FROM part UNION ALL VALUES ('pkg.none'), ('not a class'))
SELECT class_name, CASE WHEN class_name = 'not a class' THEN 'error' WHEN b IS NULL THEN 'not_found' ELSE 'success' END AS status, 'jar-' || b.ordinal AS path, b.tier AS tier
FROM w LEFT JOIN (SELECT class_name, min({'tier': tier, 'ordinal': ordinal}) AS b FROM e GROUP BY class_name) USING (class_name)""")
def resolve_priority(spark, sf_dir):
    """Each class from the first archive that has it; failures stay with their class."""
    part = table(spark, sf_dir, "part").select(F.concat(F.lit("pkg."), F.replace("p_name", F.lit(" "), F.lit("_"))).alias("class_name"), (F.col("p_partkey") % 3).alias("tier"), F.col("p_partkey").alias("ordinal"), "p_size")
    wanted = part.select("class_name").distinct().unionByName(spark.createDataFrame([("pkg.none",), ("not a class",)], "class_name string"))
    return artifacts.resolve(wanted, part.where("p_size > 20").select("class_name", "tier", "ordinal", F.concat(F.lit("jar-"), F.col("ordinal").cast("string")).alias("path")))


@query("""
SELECT doc_id, md5(replace(replace(replace(replace(replace(replace(replace(coalesce(text, ''), '\\', '\\\\'), '"', '\\"'), chr(8), '\\b'), chr(12), '\\f'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t')) AS digest FROM documents""")
def json_escape(spark, sf_dir):
    """Texts escaped for JSON."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text_.json_escape(F.col("text")).cast("binary")).alias("digest"))


@query("""
SELECT event_id, (props->>'$.k')::BIGINT AS k, 0::BIGINT AS missing, true AS is_object FROM events""")
def json_variant(spark, sf_dir):
    """JSON read as a nested value, with defaults; every third one is held in a string."""
    quoted = F.concat(F.lit('"'), text_.json_escape(F.col("props")), F.lit('"'))
    v = text_.json_arguments(F.when(F.col("event_id") % 3 == 0, quoted).otherwise(F.col("props")))
    rows = table(spark, sf_dir, "events").select("event_id", v.alias("v"))
    return rows.select("event_id", F.try_variant_get("v", "$.k", "bigint").alias("k"), F.coalesce(F.try_variant_get("v", "$.none", "bigint"), F.lit(0)).cast("long").alias("missing"), F.schema_of_variant("v").startswith("OBJECT").alias("is_object"))


@query(f"""
SELECT page_id, CASE lower(regexp_extract(p, '[^.]*$')) WHEN 'html' THEN 'text/html' WHEN 'css' THEN 'text/css' WHEN 'js' THEN 'application/javascript' WHEN 'json' THEN 'application/json' WHEN 'png' THEN 'image/png' WHEN 'jpg' THEN 'image/jpeg' WHEN 'svg' THEN 'image/svg+xml' WHEN 'ico' THEN 'image/x-icon' ELSE 'application/octet-stream' END AS content_type FROM (SELECT page_id, {_PATH_SQL} AS p FROM pages)""")
def content_type(spark, sf_dir):
    """Content types of paths."""
    return _paths(spark, sf_dir).select("page_id", text_.content_type(F.col("path")).alias("content_type"))


@query("""
SELECT event_id, strftime(ts + CASE WHEN ts >= TIMESTAMP '2024-03-31 01:00:00' AND ts < TIMESTAMP '2024-10-27 01:00:00' THEN INTERVAL 2 HOUR ELSE INTERVAL 1 HOUR END, '%Y%m%d') AS day FROM events""")
def date_basic_iso(spark, sf_dir):
    """Dates of instants in a zone."""
    return table(spark, sf_dir, "events").select("event_id", text_.basic_date(F.unix_millis(F.col("ts").cast("timestamp"))).alias("day"))


@query(f"""
SELECT * FROM (SELECT CASE WHEN starts_with({_PATH_SQL}, 'm.') THEN 'm/' ELSE 'x/' END || {_PATH_SQL} AS path, length(html)::BIGINT AS size FROM pages)
WHERE starts_with(path, 'm/') AND regexp_full_match(path, '(?s).*/[^/]*[.][^/]*') ORDER BY path, size LIMIT 25""")
def find_files_below(spark, sf_dir):
    """The first paths below one directory, up to a limit."""
    top = F.when(F.col("path").startswith("m."), "m/").otherwise("x/")
    return textfiles.find_by_glob(_paths(spark, sf_dir).select(F.concat(top, "path").alias("path"), "size"), "**/*.*", below="m", limit=25)


@query("""
WITH r AS (SELECT *, regexp_replace(lower(p_name), '[ _-]', '', 'g') AS key, p_partkey % 7 = 0 AS refers FROM part),
g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY p_partkey) AS n FROM r) WHERE n = 1)
SELECT key AS asked, CASE WHEN refers THEN 'redwidget' ELSE key END AS key FROM g""")
def glossary_references(spark, sf_dir):
    """Each key of the glossary with the one that it refers to."""
    return _glossary(spark, sf_dir, resolve_references=True).select(F.col("key").alias("asked"), F.coalesce("reference", "key").alias("key"))


@query("""
WITH w AS (SELECT doc_id, string_split_regex(regexp_replace(regexp_replace(coalesce(text, ''), ' ', ',', 'g'), '( *, *)+$', ''), ' *, *') AS w FROM documents)
SELECT doc_id, len(w) AS n_words, w[1] AS first, w[-1] AS last FROM w""")
def word_list(spark, sf_dir):
    """Texts as lists with commas for blanks."""
    rows = table(spark, sf_dir, "documents").select("doc_id", text_.word_list(F.replace(F.coalesce("text", F.lit("")), F.lit(" "), F.lit(","))).alias("w"))
    return rows.select("doc_id", F.size("w").cast("long").alias("n_words"), F.element_at("w", 1).alias("first"), F.element_at("w", -1).alias("last"))


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.col("turn") % 2 == 1
    return table(spark, sf_dir, "conversations").select("conv_id", F.when(odd, "function_call_output").otherwise("function_call").alias("type"), F.floor(F.col("turn") / 2).cast("string").alias("call_id"), F.md5(F.col("text").cast("binary")).alias("text"))


@query("""
WITH h AS (SELECT conv_id, turn // 2 AS c, turn % 2 AS o, md5(text) AS t FROM conversations)
SELECT a.conv_id, a.c::VARCHAR AS call_id, a.t AS call, b.t AS output FROM h a LEFT JOIN h b ON b.conv_id = a.conv_id AND b.c = a.c AND b.o = 1 WHERE a.o = 0""")
def call_pairs(spark, sf_dir):
    """Tool calls with their outputs."""
    return events.call_pairs(_history(spark, sf_dir)).select("conv_id", "call_id", "call", "output")


@query("""
SELECT conv_id, least(coalesce(min(turn) FILTER (role = 'system'), max(turn)) + 1, 20)::BIGINT AS rounds FROM conversations GROUP BY conv_id""")
def tool_loop(spark, sf_dir):
    """Rounds of each conversation up to the first that isn't a call."""
    return events.tool_loop(table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("round"), (F.col("role") != "system").alias("has_call")))


@query("""
SELECT conv_id, md5(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'user'), '')) AS reasoning, md5(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS output,
  md5(CASE WHEN coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '') <> '' THEN string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant') ELSE coalesce(arg_max(text, turn) FILTER (role = 'system'), '') END) AS final FROM conversations GROUP BY conv_id""")
def stream_deltas(spark, sf_dir):
    """Texts of streamed answers, put together by type."""
    kind = F.when(F.col("role") == "user", "response.reasoning_text.delta").when(F.col("role") == "assistant", "response.output_text.delta").otherwise("response.completed")
    field = F.when(F.col("role") == "system", F.to_json(F.struct(kind.alias("type"), "text"))).otherwise(F.to_json(F.struct(kind.alias("type"), F.col("text").alias("delta"))))
    rows = events.deltas(table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("pos"), field.alias("payload")), "conv_id")
    return rows.select("conv_id", *[F.md5(F.col(c).cast("binary")).alias(c) for c in ("reasoning", "output", "final")])


@query("""
SELECT event_type AS name, count(*) AS call_count, count(*) FILTER (value >= 5) AS calls_ok, true AS is_active FROM events GROUP BY event_type HAVING arg_max(user_id % 2 = 0, (ts, event_id)) ORDER BY 1""")
def registry_active(spark, sf_dir):
    """The tools that are on."""
    e = table(spark, sf_dir, "events")
    toggles = e.select(F.col("event_type").alias("name"), (F.col("user_id") % 2 == 0).alias("active"), F.struct("ts", "event_id").alias("ts"))
    return events.tool_table(e.select(F.col("event_type").alias("name"), (F.col("value") >= 5).alias("ok")), toggles, active_only=True)


@query("""
SELECT doc_id, md5(CASE WHEN length(text) < 80 THEN text ELSE '[...]' || right(text, 80) END) AS tail, md5(left(text, 6000)) AS query FROM documents""")
def progress_tail(spark, sf_dir):
    """The ends that progress messages show, and what of a query is embedded."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text_.tail(F.col("text")).cast("binary")).alias("tail"), F.md5(search.query_text(F.col("text")).cast("binary")).alias("query"))


@query(f"""
SELECT page_id, rtrim(url, '/') || '/v1/x' AS joined, CASE WHEN page_id % 2 = 0 THEN 'http://h/responses' ELSE 'http://h/p' || page_id || '/responses' END AS answers, 'pkg/C' || page_id || '.class' AS entry FROM pages""")
def addresses(spark, sf_dir):
    """Addresses of services and entries of classes."""
    base = F.when(F.col("page_id") % 2 == 0, F.lit("http://h/responses")).when(F.col("page_id") % 4 == 1, F.concat(F.lit("http://h/p"), F.col("page_id").cast("string"), F.lit("/"))).otherwise(F.concat(F.lit("http://h/p"), F.col("page_id").cast("string")))
    entry = artifacts.entry_path(F.concat(F.lit("pkg.C"), F.col("page_id").cast("string")))
    return table(spark, sf_dir, "pages").select("page_id", text_.join_url(F.col("url"), F.lit("/v1/x")).alias("joined"), text_.responses_url(base).alias("answers"), entry.alias("entry"))


@query("""
WITH j AS (SELECT 'org.' || lower(p_type) AS group_id, replace(p_name, ' ', '-') AS artifact_id, p_size || '.' || (p_partkey % 4) AS version, p_partkey FROM part WHERE p_partkey % 5 <> 0)
SELECT group_id, artifact_id, arg_max(version, p_partkey) AS version FROM j GROUP BY ALL""")
def classpath(spark, sf_dir):
    """The last archive of each artifact, and its version."""
    jars = artifacts.classpath(_jars(spark, sf_dir).withColumnRenamed("p_partkey", "ordinal"), "/home/u/repository")
    return jars.select("group_id", "artifact_id", artifacts.version(F.col("path")).alias("version"))


def _line_sql(offset: str) -> str:
    return f"(CASE WHEN {offset} <= 0 THEN 1 ELSE 1 + length(left(text, least({offset}, size - 1))) - length(replace(left(text, least({offset}, size - 1)), chr(10), '')) END)"


@query(
    _chunks_sql(500, 80, 60)
    + f""", s AS (SELECT doc_id, n, pos, stop, ((length(c) - length(replace(c, 'th', ''))) / 2)::DOUBLE AS score FROM (SELECT *, lower(substr(text, pos + 1, stop - pos)) AS c FROM walk)),
b AS (SELECT doc_id, pos, CASE WHEN doc_id % 3 = 1 THEN 0 ELSE stop END AS stop, score FROM s WHERE doc_id % 3 <> 1 OR n = 0 ORDER BY score DESC, doc_id, pos, stop LIMIT 20),
t AS (SELECT *, CASE WHEN pos <= 0 AND stop <= 0 THEN size ELSE stop END AS last FROM (SELECT b.*, text, length(text) AS size FROM b LEFT JOIN (SELECT doc_id, text FROM documents WHERE doc_id % 4 <> 2) USING (doc_id))),
r AS (SELECT *, {_line_sql("pos")} || '..' || {_line_sql("last")} AS lines, row_number() OVER (ORDER BY text IS NULL, score DESC, doc_id, pos, stop) AS place FROM t)
SELECT '# Search Results' || chr(10) || chr(10) || '## Summary' || chr(10) || '| Source | Score | Range (Lines) |' || chr(10) || '|---|---|---|' || chr(10)
  || string_agg('| ' || doc_id || ' | ' || printf('%.4f', score) || ' | ' || CASE WHEN text IS NULL THEN 'Not Found' ELSE lines END || ' |' || chr(10), '' ORDER BY score DESC, doc_id, pos, stop) || chr(10) || '## Details' || chr(10)
  || string_agg('### ' || place || '. ' || doc_id || ' (Lines ' || lines || ')' || chr(10) || '```text' || chr(10) || substr(text, pos + 1, least(last, size) - pos) || chr(10) || '```' || chr(10) || chr(10), '' ORDER BY place) FILTER (text IS NOT NULL) AS markdown FROM r"""
)
def report_markdown(spark, sf_dir):
    """A report of the twenty best chunks as Markdown: some with offsets, some of whole texts, some whose texts are gone."""
    docs = table(spark, sf_dir, "documents")
    pieces = chunking.chunks(docs, 500, 80, 60).withColumn("score", search.keyword_score(F.col("chunk"), "th"))
    whole = F.col("doc_id") % 3 == 1
    best = pieces.where(~whole | (F.col("chunk_index") == 0)).select("doc_id", "start_offset", F.when(whole, 0).otherwise(F.col("end_offset")).alias("end_offset"), "score")
    return search.markdown(best, docs.where("doc_id % 4 <> 2"))


def _archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive for each document: sources of class pkg.D<doc_id> in even ones, a class without sources in odd ones."""

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = io.BytesIO()
                with zipfile.ZipFile(data, "w") as archive:
                    for name, body in [(f"pkg/D{doc_id}.java", text or "")] if doc_id % 2 == 0 else [(f"pkg/D{doc_id}.class", "class")]:
                        archive.writestr(zipfile.ZipInfo(name, (2024, 1, 2, 3, 4, 6)), body)
                rows.append({"path": f"r/d-{doc_id}{'' if doc_id % 2 else '-sources'}.jar", "content": data.getvalue(), "ordinal": doc_id, "on_classpath": doc_id % 3 == 0})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("content", pa.binary()), ("ordinal", pa.int64()), ("on_classpath", pa.bool_())]))

    return table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(run, "path string, content binary, ordinal long, on_classpath boolean")


@query("""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, CASE doc_id % 4 WHEN 3 THEN 'read_metadata' ELSE 'read_source' END AS command FROM documents),
l AS (SELECT *, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS lines FROM (SELECT *, string_split_regex(text, '\r\n|\r|\n') AS l FROM d))
SELECT 'pkg.D' || doc_id AS class_name, command, CASE WHEN doc_id % 2 = 0 OR command = 'read_metadata' THEN 'success' ELSE 'sources_not_available' END AS status,
  'r/d-' || doc_id || CASE doc_id % 2 WHEN 0 THEN '-sources' ELSE '' END || '.jar' AS path, (CASE doc_id % 2 WHEN 0 THEN strlen(text) ELSE 5 END)::BIGINT AS size, '2024-01-02T03:04:06Z' AS modified, 'STORED' AS method,
  CASE WHEN doc_id % 2 = 0 THEN md5('--- File: pkg/D' || doc_id || '.java ---' || chr(10) || 'Lines 2-' || least(4, len(lines)) || ' of ' || len(lines) || chr(10) || chr(10) || coalesce(array_to_string(list_transform(range(2, least(4, len(lines)) + 1), lambda i: lpad(i::VARCHAR, 4, ' ') || ' | ' || lines[i]), chr(10)), '')) END AS text,
  CASE WHEN doc_id % 2 = 0 THEN len(lines[2:4])::INTEGER END AS lines_read, CASE WHEN doc_id % 2 = 0 THEN len(lines) > 4 END AS truncated FROM l
UNION ALL VALUES ('pkg.None', 'read_source', 'not_found', NULL, NULL, NULL, NULL, NULL, NULL, NULL), ('pkg.D1', 'run', 'error', NULL, NULL, NULL, NULL, NULL, NULL, NULL)""")
def read_source(spark, sf_dir):
    """Lines 2 to 4 of classes from the archives that have them, and what is known of those without sources."""
    ids = table(spark, sf_dir, "documents").select("doc_id")
    wanted = ids.select(F.concat(F.lit("pkg.D"), F.col("doc_id").cast("string")).alias("class_name"), F.when(F.col("doc_id") % 4 == 3, "read_metadata").otherwise("read_source").alias("command"))
    wanted = wanted.unionByName(spark.createDataFrame([("pkg.None", "read_source"), ("pkg.D1", "run")], "class_name string, command string"))
    rows = artifacts.read_classes(wanted.withColumns({"start_line": F.lit(2), "end_line": F.lit(4)}), _archives(spark, sf_dir))
    return rows.select("class_name", "command", "status", "path", "size", "modified", "method", F.md5(F.col("text").cast("binary")).alias("text"), "lines_read", "truncated")


@query("""
WITH h AS (SELECT conv_id, turn, role, text, turn % 3 AS k, (turn // 3)::VARCHAR AS call_id FROM conversations),
m AS (SELECT conv_id, count(*) AS n, string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS history, arg_max(text, turn) FILTER (role = 'assistant') AS last_answer FROM h WHERE k = 0 GROUP BY conv_id),
c AS (SELECT a.conv_id, string_agg(a.call_id || '=' || md5(a.text) || '>' || coalesce(md5(b.text), ''), ',' ORDER BY a.turn) AS calls, count(*) AS n_calls FROM h a LEFT JOIN h b ON b.conv_id = a.conv_id AND b.call_id = a.call_id AND b.k = 2 WHERE a.k = 1 GROUP BY a.conv_id)
SELECT conv_id, coalesce(n, 0)::INTEGER AS n_turns, md5(coalesce(history, '')) AS history, last_answer, coalesce(n_calls, 0)::INTEGER AS n_calls, md5(coalesce(calls, '')) AS calls FROM m FULL JOIN c USING (conv_id)""")
def conversation_sessions(spark, sf_dir):
    """Conversations whose turns hold tool calls and their outputs too."""
    return _session_digests(events.sessions(_items(spark, sf_dir)))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("turn") % 3
    kind = F.when(k == 1, "function_call").when(k == 2, "function_call_output").otherwise("message")
    return table(spark, sf_dir, "conversations").withColumns({"type": kind, "call_id": F.floor(F.col("turn") / 3).cast("string")})


def _session_digests(rows: DataFrame) -> DataFrame:
    pair = lambda x: F.concat(x["call_id"], F.lit("="), F.md5(x["call"].cast("binary")), F.lit(">"), F.coalesce(F.md5(x["output"].cast("binary")), F.lit("")))
    return rows.select("conv_id", "n_turns", F.md5(F.col("history").cast("binary")).alias("history"), "last_answer", F.size("calls").alias("n_calls"), F.md5(F.array_join(F.transform("calls", pair), ",").cast("binary")).alias("calls"))


@query("""
WITH c AS (SELECT event_type AS name, event_id AS seq, CASE WHEN event_id % 11 = 0 THEN 'register' WHEN event_id % 11 < 4 THEN 'on' WHEN event_id % 11 < 7 THEN 'off' ELSE 'toggle' END AS action, user_id % 2 = 0 AS active FROM events),
t AS (SELECT *, coalesce(sum((action = 'toggle')::INTEGER) OVER w, 0) AS flips, max(seq) FILTER (action = 'register') OVER w AS known FROM c WINDOW w AS (PARTITION BY name ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s AS (SELECT *, CASE action WHEN 'on' THEN 1 WHEN 'off' THEN 0 WHEN 'register' THEN active::INTEGER END AS wanted FROM t),
l AS (SELECT *, coalesce((last_value((wanted + flips) % 2 IGNORE NULLS) OVER (PARTITION BY name ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + flips) % 2, 0) = 1 AS was FROM s),
n AS (SELECT *, CASE action WHEN 'toggle' THEN NOT was ELSE wanted = 1 END AS now FROM l)
SELECT name, seq, CASE WHEN now THEN 'activated' ELSE 'deactivated' END AS change FROM n WHERE CASE WHEN action = 'register' THEN now WHEN known IS NULL THEN false ELSE now <> was END""")
def registry_transitions(spark, sf_dir):
    """Where tools really go on or off under a feed of changes."""
    return events.transitions(_changes(spark, sf_dir))


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 11
    action = F.when(k == 0, "register").when(k < 4, "on").when(k < 7, "off").otherwise("toggle")
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), F.col("event_id").alias("seq"), action.alias("action"), (F.col("user_id") % 2 == 0).alias("active"))


@query("""
WITH s AS (SELECT 0 AS source, p_name AS key, 'a' || min(p_partkey) AS value FROM part WHERE p_size % 5 = 0 GROUP BY p_name UNION ALL SELECT 0, p_brand, 'b' || min(p_partkey) FROM part WHERE p_size = 7 GROUP BY p_brand UNION ALL SELECT 1, p_brand, 'c' || min(p_partkey) FROM part WHERE p_size % 2 = 0 GROUP BY p_brand),
w AS (SELECT p_partkey, unnest([p_brand, p_name]) AS key, unnest([0, 1]) AS place FROM part),
f AS (SELECT p_partkey, min({'source': source, 'place': place, 'value': value}) AS s FROM w JOIN s USING (key) GROUP BY p_partkey)
SELECT p_partkey AS name, coalesce(s.value, 'd' || p_size) AS value, s.source AS source FROM part LEFT JOIN f USING (p_partkey)""")
def settings_resolved(spark, sf_dir):
    """Settings by several names from two sources, else a fallback."""
    part = table(spark, sf_dir, "part")
    found = lambda source, rows, key, mark: rows.groupBy(F.col(key).alias("key")).agg(F.concat(F.lit(mark), F.min("p_partkey").cast("string")).alias("value")).select(F.lit(source).alias("source"), "key", "value")
    settings = found(0, part.where("p_size % 5 = 0"), "p_name", "a").unionByName(found(0, part.where("p_size = 7"), "p_brand", "b")).unionByName(found(1, part.where("p_size % 2 = 0"), "p_brand", "c"))
    wanted = part.select(F.col("p_partkey").alias("name"), F.array("p_brand", "p_name").alias("keys"), F.concat(F.lit("d"), F.col("p_size").cast("string")).alias("fallback"))
    return resolved_settings(wanted, settings)


@query("""
SELECT 'r/' || doc_id || '.txt' AS resource, doc_id % 3 = 0 AS is_gzipped, md5(coalesce(text, '') || CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'plain' END) AS digest FROM documents WHERE doc_id % 3 = 0 OR doc_id % 2 = 0""")
def gzip_resources(spark, sf_dir):
    """Resources as plain and packed files; the packed form of one is preferred, and unpacked."""

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += [(f"r/{doc_id}.txt", (text + "plain").encode())] if doc_id % 2 == 0 else []
                rows += [(f"r/{doc_id}.txt.gz", gzip.compress(text.encode(), 1))] if doc_id % 3 == 0 else []
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], ["path", "content"])

    files = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "path string, content binary")
    return resources(files).select("resource", "is_gzipped", F.md5("content").alias("digest"))


@query("""
WITH j AS (SELECT *, CASE WHEN p_partkey % 5 = 0 THEN '/lib/' ELSE 'm' END AS kind FROM part WHERE p_size > 20),
b AS (SELECT 'pkg.' || replace(p_name, ' ', '_') AS class_name, arg_min({'k': p_partkey, 'n': p_name, 't': p_type, 's': p_size}, (p_partkey % 3, p_partkey)) AS b FROM j GROUP BY 1)
SELECT class_name, CASE WHEN b.k % 5 <> 0 THEN 'org.' || lower(b.t) END AS group_id, CASE WHEN b.k % 5 <> 0 THEN replace(b.n, ' ', '-') END AS artifact_id, CASE WHEN b.k % 5 <> 0 OR b.k % 2 = 0 THEN b.s || '.' || (b.k % 4) ELSE 'unknown' END AS version FROM b""")
def class_artifacts(spark, sf_dir):
    """The artifact of the first archive that has a class."""
    part = _jars(spark, sf_dir).join(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey")
    rows = part.select(F.concat(F.lit("pkg."), F.replace("p_name", F.lit(" "), F.lit("_"))).alias("class_name"), (F.col("p_partkey") % 3).alias("tier"), F.col("p_partkey").alias("ordinal"), "path", "p_size")
    found = artifacts.resolve(rows.select("class_name").distinct(), rows.where("p_size > 20").drop("p_size"))
    return artifacts.artifact_of(found, "/home/u/repository")


@query("""
WITH r AS (SELECT *, regexp_replace(lower(p_name), '[ _-]', '', 'g') AS key, p_partkey % 7 = 0 AS refers FROM part),
g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY p_partkey) AS n FROM r) WHERE n = 1),
w AS (SELECT r.p_partkey AS pos, CASE WHEN g.refers THEN 'redwidget' ELSE g.key END AS key FROM r JOIN g USING (key))
SELECT min(pos)::INTEGER AS pos, key, any_value(p_name) AS term, any_value(p_type || chr(10) || '## ' || p_size) AS description FROM w JOIN (SELECT key, p_name, p_type, p_size FROM g WHERE NOT refers) USING (key) GROUP BY key""")
def glossary_redirects(spark, sf_dir):
    """All names looked up; a term that refers to another one leads there."""
    words = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("pos"), F.concat(F.lit('"'), F.upper("p_name"), F.lit('"')).alias("word"))
    return glossary.look_up(_glossary(spark, sf_dir, resolve_references=True), words)


@query("""
WITH l AS (SELECT doc_id, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS lines FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), '\r\n|\r|\n') AS l FROM documents))
SELECT 'pkg.D' || doc_id AS class_name, CASE doc_id % 2 WHEN 0 THEN 'success' ELSE 'error' END AS status, CASE WHEN doc_id % 2 = 0 THEN md5('--- File: pkg/D' || doc_id || '.java ---' || chr(10) || 'Lines 1-' || least(1000, len(lines)) || ' of ' || len(lines) || chr(10) || chr(10) || coalesce(array_to_string(lines[1:1000], chr(10)), '')) END AS text, CASE WHEN doc_id % 2 = 0 THEN len(lines)::INTEGER END AS total_lines FROM l WHERE doc_id % 2 = 1 OR doc_id % 6 = 0""")
def read_structure(spark, sf_dir):
    """The structure of classes: from sources on the class path; classes without sources have an error."""
    ids = table(spark, sf_dir, "documents").select("doc_id").where("doc_id % 2 = 1 OR doc_id % 6 = 0")
    wanted = ids.select(F.concat(F.lit("pkg.D"), F.col("doc_id").cast("string")).alias("class_name"), F.lit("read_class_structure").alias("command"), F.lit(None).cast("int").alias("start_line"), F.lit(None).cast("int").alias("end_line"))
    # Structures are looked for in archives of the class path first, so sources lie there too.
    archives = _archives(spark, sf_dir).withColumn("path", F.replace("path", F.lit("-sources"), F.lit("")))
    rows = artifacts.read_classes(wanted, archives)
    return rows.select("class_name", "status", F.md5(F.col("text").cast("binary")).alias("text"), "total_lines")


@query("""
SELECT doc_id, length(coalesce(text, '')) - length(replace(coalesce(text, ''), ' ', '')) + 1 AS n_tokens, length(coalesce(text, ''))::DOUBLE AS v0, (length(coalesce(text, '')) - length(replace(coalesce(text, ''), 'e', '')))::DOUBLE AS v1 FROM documents""")
def embed_texts(spark, sf_dir):
    """Texts embedded by an embedder of lists of texts, which counts."""

    def embedder(texts):
        return [t.count(" ") + 1 for t in texts], np.array([[len(t), t.count("e")] for t in texts], np.float32)

    rows = chunking.embed_with(table(spark, sf_dir, "documents").select("doc_id", "text"), embedder, text="text")
    return rows.select("doc_id", "n_tokens", *[F.element_at("embedding", k + 1).cast("double").alias(f"v{k}") for k in (0, 1)])


def _tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A call of a tool for each document: lines, an edit, a look-up, a search for files; some of them can't work."""
    docs, k, path = table(spark, sf_dir, "documents"), F.col("doc_id") % 4, F.concat(F.lit("d/"), F.col("doc_id").cast("string"))
    name = F.when(k == 0, "get_file_text_by_path").when(k == 1, "edit_file").when(k == 2, "glossary-tool").otherwise("find_files_by_glob")
    odd = F.col("doc_id") % 8 > 3
    arguments = (
        F.when(k == 0, F.to_json(F.struct(F.when(odd, F.lit("none")).otherwise(path).alias("pathInProject"), F.lit(2).alias("start_line"), F.lit(3).alias("end_line"))))
        .when(k == 1, F.to_json(F.struct(path.alias("pathInProject"), F.lit("the").alias("oldString"), F.lit("<THE>").alias("newString"), odd.alias("replaceAll"))))
        .when(k == 2, F.when(odd, '{"words":["zz"]}').otherwise('{"words":["blue bolt","zz","Red_Widget"]}'))
        .otherwise(F.when(odd, "{}").otherwise(F.lit(r'{"globPattern":"**/*[0-9]{.html,?}","excludeRegex":"www\\.[^/]*|m\\.[^/]*|[^/]*/fr","fileCountLimit":3}')))
    )
    calls = docs.select(F.col("doc_id").alias("call_id"), name.alias("name"), arguments.alias("arguments"))
    return tools.run_calls(calls, {"files": _paths(spark, sf_dir), "texts": docs.select(path.alias("path"), "text"), "glossary": _glossary(spark, sf_dir)})


_TOOLS_SQL = (
    _GLOSSARY_SQL
    + f""", d AS (SELECT doc_id, doc_id % 8 > 3 AS odd, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, odd, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS l FROM (SELECT *, string_split_regex(text, '\\r\\n|\\r|\\n') AS l FROM d WHERE doc_id % 4 = 0)),
e AS (SELECT doc_id, text, odd, CASE WHEN odd THEN (length(text) - length(replace(text, 'the', ''))) // 3 ELSE contains(text, 'the')::INTEGER END AS n, CASE WHEN odd THEN replace(text, 'the', '<THE>') ELSE left(text, strpos(text, 'the') - 1) || '<THE>' || substr(text, strpos(text, 'the') + 3) END AS new FROM d WHERE doc_id % 4 = 1),
f AS (SELECT list(path ORDER BY path, size)[1:3] AS f FROM (SELECT {_PATH_SQL} AS path, length(html) AS size FROM pages)
  WHERE regexp_full_match(path, '(?s).*/[^/]*[0-9](?:\\.html|[^/])') AND NOT regexp_matches(path, '^(?:www\\.[^/]*|m\\.[^/]*)(?:/|$)') AND NOT regexp_full_match(path, '[^/]*/fr(?:/.*)?')),
w AS (SELECT string_agg('# ' || term || chr(10) || description, chr(10) || chr(10) ORDER BY CASE key WHEN 'bluebolt' THEN 0 ELSE 2 END) AS t FROM g WHERE key IN ('bluebolt', 'redwidget')),
r AS (SELECT doc_id AS call_id, 'get_file_text_by_path' AS name, NOT odd AS ok, CASE WHEN NOT odd THEN coalesce(array_to_string(l[2:3], chr(10)), '') END AS t, CASE WHEN odd THEN 'no such file' END AS error FROM l
  UNION ALL SELECT doc_id, 'edit_file', n > 0, CASE WHEN n > 0 THEN n || ':' || new END, CASE WHEN n = 0 THEN 'no such text in the file' END FROM e
  UNION ALL SELECT doc_id, 'glossary-tool', NOT odd AND t IS NOT NULL, CASE WHEN NOT odd THEN t END, CASE WHEN odd OR t IS NULL THEN 'no term was found' END FROM d, w WHERE doc_id % 4 = 2
  UNION ALL SELECT doc_id, 'find_files_by_glob', NOT odd, CASE WHEN NOT odd THEN coalesce(array_to_string(f, ','), '') END, CASE WHEN odd THEN 'missing argument: globPattern' END FROM d, f WHERE doc_id % 4 = 3)"""
)


@query(_TOOLS_SQL + "SELECT call_id, name, ok, md5(t) AS result, error FROM r")
def tool_calls(spark, sf_dir):
    """Calls of several tools in one table, run in one plan."""
    rows, field = _tool_calls(spark, sf_dir), lambda name: F.get_json_object("result", f"$.{name}")
    files = F.array_join(F.transform(F.from_json(field("files"), "array<struct<path string>>"), lambda x: x["path"]), ",")
    text = F.when(F.col("name") == "find_files_by_glob", files).when(F.col("name") == "edit_file", F.concat_ws(":", field("replacements"), field("text"))).otherwise(field("text"))
    return rows.select("call_id", "name", "ok", F.when(F.col("ok"), F.md5(text.cast("binary"))).alias("result"), "error")


@query(_TOOLS_SQL + "SELECT name, count(*) AS call_count, count(*) FILTER (ok) AS calls_ok, true AS is_active FROM r GROUP BY name ORDER BY name")
def tool_outcomes(spark, sf_dir):
    """Counters of each tool from what its calls came to."""
    return events.tool_table(_tool_calls(spark, sf_dir))


def _fed(rows: DataFrame, order: str, name: str, parts: int = 3) -> tuple[DataFrame, str]:
    """``rows`` as a stream, whose micro-batches take them in order of a number, and a folder for what comes of it."""
    spark, folder = rows.sparkSession, f"{shared_folder(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    last = rows.agg(F.max(order)).first()[0] or 0
    for part in range(parts):
        rows.where(F.floor(F.col(order) * parts / (last + 1)) == part).write.mode("append").parquet(f"{folder}/in/part={part}")
    return spark.readStream.schema(T.StructType([*rows.schema.fields, T.StructField("part", T.IntegerType())])).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in").drop("part"), folder


@query(ORACLES["conversation_sessions"])
def stream_sessions(spark, sf_dir):
    """The same from a stream with keyed state: what the last batch that touches a conversation gives."""
    stream, folder = _fed(_items(spark, sf_dir), "turn", "sessions")
    rows = drained(sessions.sessions(stream), folder, "update")
    fields = [c for c in rows.columns if c not in ("conv_id", "batch")]
    return _session_digests(rows.groupBy("conv_id").agg(F.max_by(F.struct(*fields), "batch").alias("s")).select("conv_id", "s.*"))


@query(ORACLES["registry_transitions"])
def stream_transitions(spark, sf_dir):
    """The same from a stream of changes that come in order."""
    stream, folder = _fed(_changes(spark, sf_dir).repartitionByRange(1, "seq"), "seq", "transitions")
    return drained(sessions.transitions(stream), folder).drop("batch")


@query(_CALLS_SQL + "SELECT count(*) AS n_calls, sum(p)::BIGINT AS prompt_tokens, sum(g)::BIGINT AS completion_tokens, sum(p + g)::BIGINT AS total_tokens, count(*) AS n_lines FROM c")
def stream_log(spark, sf_dir):
    """Totals and lines of a usage log that a stream of calls was written to."""
    stream, folder = _fed(usage.rates(_calls(spark, sf_dir)), "event_id", "log")
    log.start_log(stream, f"{folder}/log", availableNow=True).awaitTermination()
    lines = log.read_log(spark, f"{folder}/log").agg(F.count(F.lit(1)).alias("n_lines"))
    return log.log_totals(spark, f"{folder}/log").join(lines, F.lit(True))  # a row each
