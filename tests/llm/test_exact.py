import hashlib
import re
from collections import defaultdict

import pytest

from tessel.llm import exact_dedup, queries
from tessel.llm.common import scratch

from .conftest import ODD

SF = "/root/testdata/sf0.01"


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc_id))
    return sorted((i, min(g)[1], len(g), i == min(g)[1], hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for _, i in g)


def test_op5_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.op5_exact_dedup(spark, SF).collect())) == brute(rows)


MORE = [(60, "A b"), (61, "Ab "), (62, "Ab"), (63, "A b"), (64, "A b"), (65, "ba")]


@pytest.mark.parametrize(("bits", "files"), [(256, 1), (4, 1), (4, 1000)])
def test_op5_odd(spark, odd, bits, files):
    docs = odd.unionByName(spark.createDataFrame(MORE, "doc_id long, text string"), allowMissingColumns=True)
    path = scratch(spark, "t")
    docs.repartition(3).write.parquet(path)
    assert sorted(map(tuple, exact_dedup.report(spark, path, bits, files).collect())) == brute(ODD + MORE)


def test_state_lasts_over_runs(spark):
    work = scratch(spark, "t")
    for batch in ([(5, "x y"), (6, "z")], [(3, "xy"), (9, "x  y ")], [(1, "zz")]):
        spark.createDataFrame(batch, "doc_id long, text string").coalesce(1).write.mode("append").parquet(f"{work}/in")
        exact_dedup.watch(spark, f"{work}/in", f"{work}/out", f"{work}/cp")
    got = {(r["keep_id"], r["group_size"]) for r in exact_dedup.state(spark, f"{work}/out").collect()}
    assert got == {(9, 3), (6, 1), (1, 1)}
    assert spark.read.parquet(f"{work}/out").where("batch = 2").count() == 1
    assert {(r["keep_id"], r["group_size"]) for r in exact_dedup.compacted(spark, f"{work}/out", f"{work}/state").collect()} == got
    assert exact_dedup._numbers(spark, f"{work}/out", "batch") == [] and exact_dedup._numbers(spark, f"{work}/state", "upto") == [2]


def test_reports_last_over_runs(spark):
    work, rows = scratch(spark, "t"), []
    for batch in ([(5, "x y"), (6, "z")], [(3, "xy"), (9, "x  y "), (6, "z")], [], [(1, "zz"), (2, None)]):
        rows += batch
        spark.createDataFrame(batch, "doc_id long, text string").coalesce(1).write.mode("append").parquet(f"{work}/in")
        assert sorted(map(tuple, exact_dedup.report(spark, f"{work}/in", work=f"{work}/state").collect())) == brute(rows)
    spark.createDataFrame([(4, "z ")], "doc_id long, text string").coalesce(1).write.mode("append").parquet(f"{work}/in")
    got = exact_dedup.report(spark, f"{work}/in", bits=256, work=f"{work}/state")
    assert sorted(map(tuple, got.collect())) == brute([*rows, (4, "z ")])
    assert 2 <= len(exact_dedup.state(spark, f"{work}/state/changed", f"{work}/state/state").select("locator").distinct().collect()) <= 4


def seen_by(rows, own):
    """The rows of ``own`` among groups over all ``rows``."""
    want = brute(rows)
    return sorted({r[0]: r for r in want}[i] for i, _ in own)


@pytest.mark.parametrize("bits", [256, 4])
def test_runs_over_several_folders_and_gone_files(spark, bits):
    work, first, second = (scratch(spark, "t") for _ in range(3))
    a = [(1, "aa"), (2, "b b"), (10, "only here")]
    b = [(3, "aa"), (4, "c"), (5, "b  b")]
    c = [(6, "a a"), (7, "c "), (8, "d")]
    write = lambda rows, path: spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(path)
    run = lambda path: sorted(map(tuple, exact_dedup.report(spark, path, bits, work=work).collect()))
    write(a, first)
    assert run(first) == brute(a)
    write(b, second)  # another folder: earlier rows count
    assert run(second) == seen_by(a + b, b)
    assert run(first) == seen_by(a + b, a)
    exact_dedup._remove(spark, first)  # the first folder's files are gone
    write(c, second)
    assert run(second) == seen_by(a + b + c, b + c)
    assert len(exact_dedup._numbers(spark, f"{work}/state", "upto")) == 1 and exact_dedup._numbers(spark, f"{work}/changed", "batch") == []


def test_a_later_run_reads_new_files_only(spark):
    work, path = scratch(spark, "t"), scratch(spark, "t")
    write = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(path)
    write([(k, f"text {k}") for k in range(1000)])
    exact_dedup.report(spark, path, work=work).count()
    write([(2000, "text 5"), (2001, "new")])
    got = exact_dedup.report(spark, path, work=work)
    assert spark.read.parquet(f"{work}/rows/run=1").count() == 2  # what the second run read and wrote
    assert {tuple(r)[:4] for r in got.where("group_size > 1").collect()} == {(5, 5, 2, True), (2000, 5, 2, False)}
    assert got.count() == 1002


def test_deduplicate(spark, odd, none, clashing):
    for docs in (odd, clashing):
        got = exact_dedup.deduplicate(docs)
        assert got.columns == docs.columns
        stays = {k for _, k, *_ in brute(ODD)}
        want = {r["doc_id"]: r for r in docs.collect() if r["doc_id"] in stays}
        assert sorted(map(str, got.collect())) == sorted(map(str, want.values()))
    assert exact_dedup.deduplicate(none).count() == 0


def test_deduplicate_leaves_one_row_each(spark, odd):
    assert sorted(r["doc_id"] for r in exact_dedup.deduplicate(odd).collect()) == sorted({k for _, k, *_ in brute(ODD)})
    rows = [(None, "null"), (None, "nul l"), (None, "nul l"), (12, "pq"), (12, "p q"), (12, "p q"), (13, "pq"), (12, "other"), (None, "v"), (14, "v")]
    got = exact_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(None, "nul l"), (12, "p q"), (12, "other"), (14, "v")]))
