"""Rows without an id: no operator fails on them or loses them."""

import pytest

from tessel.llm import byte_bpe, exact_dedup, jaccard_join, jpeg, licenses, near_dedup, packing, pii, quality, queries, token_files, toxicity
from tessel.llm.common import public_tokenizer, scratch

ROWS = [(None, "Same words of a text that two rows have"), (7, "Same words of a text that two rows have"), (None, None), (8, "other words entirely here are, in a text"), (None, "alone")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string")


def test_rows_stay(spark, docs):
    words, ranks = public_tokenizer("word_bpe_49k.json"), public_tokenizer("byte_bpe_50k.tiktoken")
    path, files = scratch(spark, "t"), scratch(spark, "t")
    docs.write.parquet(path)
    token_files.write_token_files(docs, files, words, 2)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    import public_tokenizers

    for rows in (
        quality.score(docs, quality.fit(docs, labels)), pii.report(docs), jpeg.from_media(jpeg.to_media(docs)), licenses.scan_licenses(docs), exact_dedup.report(spark, path), near_dedup.near_duplicates(docs),
        toxicity.severity(docs, toxicity.fit(docs, labels)), packing.pack_documents(docs, words, 1), token_files.read_token_files(spark, files), byte_bpe.encode_bytes(docs, ranks, public_tokenizers.PATTERN),
        jaccard_join.jaccard_join(docs),
    ):
        assert sorted(str(r["doc_id"]) for r in rows.collect()) == ["7", "8", "None", "None", "None"]
    assert len(queries.QUERIES) == 13


def test_named_rows_win(spark, docs):
    path = scratch(spark, "t")
    docs.write.parquet(path)
    assert {r["keep_id"] for r in exact_dedup.report(spark, path).where("group_size = 2").collect()} == {7}
    assert {r["class_id"] for r in near_dedup.near_duplicates(docs).where("rep_id = 7").collect()} == {7}
    assert near_dedup.deduplicate(docs).count() == 4 and exact_dedup.deduplicate(docs).count() == 4


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '/root/testdata/sf0.001/{table}.parquet'")
    got = queries.QUERIES[name](spark, "/root/testdata/sf0.001").toPandas()
    want = con.execute(queries.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    order = [c for c in ("item_id", "rank", "doc_id") if c in columns]
    assert got[columns].sort_values(order).values.tolist() == want[columns].sort_values(order).values.tolist()
