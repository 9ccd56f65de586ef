"""Registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm import byte_bpe, exact_dedup, jaccard_join, jpeg, licenses, near_dedup, packing, pii, quality, token_files, toxicity, treaps, whitening
from tessel.llm.common import public_tokenizer, read_documents, read_labels, scratch

WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.tiktoken"


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    return quality.score(docs, quality.fit(docs, read_labels(spark, sf_dir)))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(read_documents(spark, sf_dir))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.from_media(jpeg.to_media(read_documents(spark, sf_dir)))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read_documents(spark, sf_dir))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.report(spark, f"{sf_dir}/documents.parquet")


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read_documents(spark, sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    return toxicity.severity(docs, toxicity.fit(docs, read_labels(spark, sf_dir)))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_documents(spark, sf_dir), public_tokenizer(WORD_BPE), end_id=1, capacity=4096)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "op9-files")
    token_files.write_token_files(read_documents(spark, sf_dir), path, public_tokenizer(WORD_BPE), end_id=2)
    rows = token_files.read_token_files(spark, path)
    return rows.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = public_tokenizer(BYTE_BPE), public_tokenizers.PATTERN
    rows = byte_bpe.decode_bytes(byte_bpe.encode_bytes(read_documents(spark, sf_dir), path, pattern), path, pattern)
    return rows.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(read_documents(spark, sf_dir))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return treaps.ranked_search(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_pii": op2_pii,
    "op3_media_columns": op3_media_columns,
    "op4_license_scan": op4_license_scan,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_toxicity": op7_toxicity,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_token_files": op9_token_files,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_ngram_jaccard_join": op11_ngram_jaccard_join,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_ranked_search": op13_ranked_search,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_KINDS = {1: ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), 2: ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), 3: ("card", r"[0-9]([\x20-]?[0-9])+"), 4: ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")}
_WORDS = r"[\p{L}\p{N}]+"


def _placed_sql(columns: str, pattern: str, source: str, text: str = "text") -> str:
    """Rows of the matches of a pattern: columns, a (start), b (end), v."""
    return f"""SELECT {columns}, list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS a, m[i] AS v
    FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT *, regexp_extract_all({text}, '{pattern}') AS m, string_split_regex({text}, '{pattern}') AS p FROM {source}))"""


_PII = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
f AS ({" UNION ALL ".join(_placed_sql(f"doc_id, text, {k} AS n, '{kind}' AS kind", pattern, "d") for k, (kind, pattern) in _KINDS.items())}),
g AS (SELECT *, a + length(v) AS b, regexp_replace(v, '[^0-9]', '', 'g') AS digits FROM f),
s AS (SELECT *, unnest([kind || ':' || lower(v), CASE kind WHEN 'email' THEN 'domain:' || regexp_extract(lower(v), '[^@]*$') WHEN 'ip' THEN 'network:' || regexp_extract(v, '^[0-9]+.[0-9]+.[0-9]+') WHEN 'card' THEN 'issuer:' || left(digits, 6) ELSE 'prefix:' || left(digits, -7) END]) AS entity FROM g WHERE CASE kind WHEN 'email' THEN true
    WHEN 'ip' THEN len(list_filter(string_split(v, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(try_cast(x AS BIGINT), 999) > 255)) = 0
    WHEN 'phone' THEN length(digits) BETWEEN 8 AND 15
    ELSE length(digits) BETWEEN 16 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda i: CASE WHEN i % 2 = 1 THEN digits[-i]::INTEGER ELSE digits[-i]::INTEGER * 2 - CASE WHEN digits[-i]::INTEGER > 4 THEN 9 ELSE 0 END END)) % 10 = 0 END),
h AS (SELECT doc_id, text FROM d WHERE doc_id IN (SELECT doc_id FROM s)),
t AS (SELECT *, a + length(v) AS b, lower(v) AS term FROM ({_placed_sql("doc_id, text", _WORDS, "h")})),
near AS (SELECT DISTINCT t.doc_id, t.text, entity, term, t.a, t.b FROM t JOIN s USING (doc_id) WHERE length(term) >= 3
    AND ((t.a >= s.a - {pii.NEAR} AND t.b <= s.a AND (t.a > s.a - {pii.NEAR} OR t.a = 0)) OR (t.a >= s.b AND t.b <= s.b + {pii.NEAR} AND (t.b < s.b + {pii.NEAR} OR t.b = length(t.text))))
    AND NOT EXISTS (SELECT 1 FROM s o WHERE o.doc_id = t.doc_id AND o.a < t.b AND t.a < o.b)),
te AS (SELECT entity, term, count(DISTINCT doc_id) AS n_te FROM near GROUP BY ALL HAVING count(DISTINCT text) >= {pii.SUPPORT}),
e AS (SELECT entity, count(DISTINCT doc_id) AS n_e FROM s GROUP BY entity),
w AS (SELECT term, count(DISTINCT doc_id) AS n_t FROM near GROUP BY term),
told AS (SELECT entity, term FROM te JOIN e USING (entity) JOIN w USING (term) WHERE n_te / n_t >= pow(n_e / (SELECT count(DISTINCT doc_id) FROM s)::DOUBLE, 1 - {pii.ALPHA})),
x AS (SELECT DISTINCT doc_id, 5 AS n, 'term' AS kind, a, b FROM near JOIN told USING (entity, term)),
o AS (SELECT doc_id, count(*) FILTER (n = 1) AS n_email, count(*) FILTER (n = 2) AS n_ip, count(*) FILTER (n = 3) AS n_card, count(*) FILTER (n = 4) AS n_phone, count(*) FILTER (n = 5) AS n_terms,
    string_agg(kind || ':' || a || ':' || b, ',' ORDER BY n, a) FILTER (n < 5) AS base, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY n, a) AS spans FROM (SELECT DISTINCT doc_id, n, kind, a, b FROM s UNION ALL SELECT * FROM x) GROUP BY doc_id)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, coalesce(n_terms, 0) AS n_terms, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN o USING (doc_id)"""

#: Where SQL expresses an operator. The others are tested against brute force, round trips or held-out rows.
ORACLES: dict[str, str] = {
    "op2_pii": _PII,
    "op5_exact_dedup": r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS content FROM documents),
g AS (SELECT *, count(*) OVER (PARTITION BY content) AS group_size, first_value(doc_id) OVER (PARTITION BY content ORDER BY n DESC, doc_id) AS keep_id FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(content) AS text_sha256 FROM g""",
    "op6_near_duplicates": rf"""
WITH RECURSIVE w AS (SELECT doc_id, text, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
k AS (SELECT doc_id, w, CASE WHEN len(w) > 0 THEN 'w' || array_to_string(w, ' ') ELSE 't' || coalesce(text, '') END AS k FROM w),
r AS (SELECT k, min(doc_id) AS rep_id, any_value(w) AS w FROM k GROUP BY k),
s AS (SELECT rep_id AS id, unnest(list_distinct(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS x FROM r WHERE len(w) > 0),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.id < b.id GROUP BY a.id, b.id),
l AS (SELECT a, b FROM p JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE c >= 0.8 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT rep_id AS id, rep_id AS other FROM r UNION SELECT reach.id, e.b FROM reach JOIN e ON e.a = reach.other)
SELECT doc_id, rep_id, class_id FROM k JOIN r USING (k) JOIN (SELECT id, min(other) AS class_id FROM reach GROUP BY id) c ON c.id = rep_id""",
    "op11_ngram_jaccard_join": rf"""
WITH RECURSIVE k AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
r AS (SELECT w, min(doc_id) AS rep_id FROM k WHERE len(w) > 0 GROUP BY w),
s AS (SELECT rep_id AS id, unnest(list_distinct(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END)) AS x FROM r),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.id < b.id GROUP BY a.id, b.id),
l AS (SELECT a, b FROM p JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT rep_id AS id, rep_id AS other FROM r UNION SELECT reach.id, e.b FROM reach JOIN e ON e.a = reach.other)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id FROM k LEFT JOIN r USING (w) LEFT JOIN n ON n.id = rep_id LEFT JOIN (SELECT id, min(other) AS component_id FROM reach GROUP BY id) c ON c.id = rep_id""",
    "op13_ranked_search": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
q AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term FROM benchmark),
c AS (SELECT count(*) FILTER (len(w) > 0) AS n, sum(len(w))::BIGINT AS l FROM d),
t AS (SELECT doc_id, term, count(*) AS tf, any_value(size) AS size FROM (SELECT doc_id, len(w) AS size, unnest(w) AS term FROM d) GROUP BY doc_id, term),
f AS (SELECT term, floor(1000 * ln((2 * n + 2) / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM t GROUP BY term), c),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * size * n) // l))))::BIGINT AS score FROM q JOIN t USING (term) JOIN f USING (term), c GROUP BY item_id, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 50""",
}
