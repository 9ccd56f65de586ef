import re

import numpy as np

import corpus_pipeline
from tessel.llm import pii, quality
from tessel.llm.common import settle

from . import test_exact, test_near, test_pii, test_tokens

SF = "/root/testdata/sf0.01"


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(settle(stage(spark, tables[-1], SF), f"t-{name}"))
    for table in tables[1:-1]:
        assert table.columns == docs.columns
    kept = dict(pairs(tables[1]))
    clean, bad = ([i for i, q in labels.items() if q == k] for k in (1, 0))
    assert sum(i in kept for i in clean) >= 0.97 * len(clean) and sum(i in kept for i in bad) <= 0.1 * len(bad)
    once = pairs(tables[2])
    assert sorted(i for i, _ in once) == sorted({k for _, k, *_ in test_exact.brute(list(kept.items()))})
    apart = dict(pairs(tables[3]))
    assert set(apart) == set(test_near.brute(once).values())
    spans = {r[0]: r[6] for r in test_pii.expected(list(apart.items()))}
    after = dict(pairs(tables[4]))
    assert set(after) == set(apart)
    for i, text in apart.items():
        assert (after[i] == text) == (not spans[i])
        if spans[i]:
            assert not test_pii.base(after[i]) and re.search(r"\[(EMAIL|IP|CARD|PHONE)\]", after[i])
    assert tables[4].where("n_chars <> length(text)").count() == 0
    test_tokens.check_packing(tables[5].collect(), after, 4096)


def test_repeated_rows_and_clashing_names(spark, clashing, monkeypatch):
    docs = settle(clashing.unionByName(clashing).where("doc_id in (4, 5, 8, 11)"), "t")
    monkeypatch.setattr(quality.Model, "score", lambda self, column: np.ones(len(column)))
    table = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        table = settle(stage(spark, table, "/root/testdata/sf0.001"), f"t-{name}")
        assert table.columns == docs.columns
    rows = {r["doc_id"]: r for r in table.collect()}
    assert table.count() == len(rows) and set(rows) == {4, 8, 11}
    first = {r["doc_id"]: r for r in docs.collect()}
    changed = {"text", "n_chars"}
    assert all({**r.asDict(), **dict.fromkeys(changed)} == {**first[i].asDict(), **dict.fromkeys(changed)} for i, r in rows.items())
    assert rows[11]["text"] == "mail [EMAIL], call [PHONE]" and rows[4]["text"] == first[4]["text"]
    packed = corpus_pipeline.STAGES[-1][1](spark, table, "/root/testdata/sf0.001").collect()
    assert {r["doc_id"] for r in packed} == {4, 8, 11}


def test_odd_tables_pass_all_stages(spark, odd, none):
    docs = odd.drop("ids")
    for table in (docs, none.drop("ids")):
        for name, stage in corpus_pipeline.STAGES:
            table = settle(stage(spark, table, "/root/testdata/sf0.001"), f"t-{name}")
        table.collect()
    assert pii.sanitise(odd).count() == odd.count()
