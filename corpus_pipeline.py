"""Corpus preparation: from raw documents to packed token sequences.

Each stage takes what its predecessor kept, as a table with the columns of ``documents``, and
returns such a table; the last returns pieces with their places. Stages read nothing but their
input (and labels, for the classifier), so each can be run again from the table before it. Once a
stage's table is written, those that it came from are removed.

1. quality: documents that the classifier rejects go.
2. exact_dedup: of equal texts one stays.
3. near_dedup: of each group of near duplicates the smallest doc_id stays.
4. pii: personal data, and terms that disclose it, are generalised or removed in the text.
5. packing: best-fit packing into sequences of 4096 tokens.

Defined cases: a null text counts as empty throughout, and so may be judged, deduplicated and packed
(as its end id); without any usable label each text scores alike, as ``quality`` states; of rows that are equal in
text one stays, with or without a doc_id, and so does one of several rows under one doc_id whose
texts are near each other, while different texts under one doc_id are texts of their own; texts of any
length pass whole; an empty table gives an empty one; other columns go along to the last stage
under whatever names, which drops them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm import exact_dedup, near_dedup, packing, pii, quality
from tessel.llm.common import discard, made, public_tokenizer, read_documents, read_labels, settle


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: rows that score 0.7 or more."""
    return quality.keep(docs, quality.fit(docs, read_labels(spark, sf_dir)))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: one row of each group of equal texts."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: one row of each group of near duplicates."""
    return near_dedup.deduplicate(docs)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: texts without personal data; n_chars follows the text."""
    clean = pii.sanitise(docs)
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return packing.pack_documents(docs, public_tokenizer("word_bpe_49k.json"), end_id=1, capacity=4096)


STAGES = [("quality", keep_quality), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("pii", sanitise), ("packing", pack)]

#: SQL can't express the classifier; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's table is written to the shared folder and read again."""
    docs, begin = read_documents(spark, sf_dir), made()
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(spark, begin, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
