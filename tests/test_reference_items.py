"""Tool calls, pruned listings, settings, searches for many queries, and inputs that once failed whole jobs."""

import gzip
import io
import random
import time
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessel.functions import text as text_
from tessel.functions import vectors
from tessel.operators import events, glossary, search, textfiles, tools
from tessel.sources import files

CALLS = "call_id long, name string, arguments string"


def test_tool_calls_in_one_table(spark):
    calls = [
        (1, "find_files_by_glob", '{"globPattern":"**/*.txt","excludeRegex":"a/x"}'), (2, "find_files_by_glob", '{"globPattern":"*.md","fileCountLimit":1}'), (3, "find_files_by_glob", '{"globPattern":"**/*","subDirectoryRelativePath":"a/x/"}'),
        (4, "get_file_text_by_path", '{"pathInProject":"a/b.txt","start_line":2}'), (5, "edit_file", '{"pathInProject":"a/b.txt","oldString":"l","newString":"L","replaceAll":true}'), (6, "edit_file", '{"pathInProject":"a/b.txt","oldString":"l","newString":"L"}'),
        (7, "edit_file", '{"pathInProject":"no","oldString":"l","newString":"L"}'), (8, "edit_file", '{"pathInProject":"a/b.txt","oldString":"zz","newString":""}'), (9, "edit_file", '{"pathInProject":"a/b.txt","oldString":"","newString":"x"}'),
        (10, "glossary-tool", '{"words":["Red Tape",null,"none","red-tape"]}'), (11, "glossary-tool", '{"words":[]}'), (12, "nope", "{}"), (13, None, None), (14, "edit_file", '{"pathInProject":3,"oldString":"l","newString":"L"}'), (15, "edit_file", '{"pathInProject":"a/b.txt","oldString":"l"}'),
        (16, "find_files_by_glob", '{"globPattern":"a["}'), (17, "find_files_by_glob", '{"globPattern":"**/*.txt","fileCountLimit":"3"}'), (18, "get_file_text_by_path", "no json"), (19, "find_files_by_glob", '"{\\"globPattern\\":\\"r*\\",\\"excludeRegex\\":null}"'), (20, "find_files_by_glob", '{"globPattern":"*","fileCountLimit":0}'),
    ]
    data = {
        "files": spark.createDataFrame([("a/b.txt", 3), ("a/x/c.txt", 4), ("r.md", 1), ("s.md", 2)], "path string, size long"),
        "texts": spark.createDataFrame([("a/b.txt", "line one\nline two\nthree"), ("r.md", None)], "path string, text string"),
        "glossary": glossary.parse(spark.createDataFrame([("f", "# Red_tape\nlong\n# Other\nx")], "file string, text string")),
    }
    rows = {r["call_id"]: (r["ok"], r["result"], r["error"]) for r in tools.run_calls(spark.createDataFrame(calls, CALLS), data).collect()}
    good = {
        1: '{"files":[{"path":"a/b.txt","size":3}]}', 2: '{"files":[{"path":"r.md","size":1}]}', 3: '{"files":[{"path":"a/x/c.txt","size":4}]}', 4: '{"text":"line two\\nthree","lines_read":2,"total_lines":3,"truncated":false}',
        5: '{"replacements":2,"text":"Line one\\nLine two\\nthree"}', 6: '{"replacements":1,"text":"Line one\\nline two\\nthree"}', 10: '{"text":"# Red_tape\\nlong"}', 19: '{"files":[{"path":"r.md","size":1}]}', 20: '{"files":[]}',
    }
    bad = {
        7: "no such file", 8: "no such text in the file", 9: "the text to look for is empty", 11: "no term was found", 12: "unknown tool: nope", 13: "unknown tool: ", 14: "wrong type: pathInProject", 15: "missing argument: newString",
        16: "a pattern can't be read", 17: "wrong type: fileCountLimit", 18: "missing argument: pathInProject",
    }
    assert rows == {k: (True, r, None) for k, r in good.items()} | {k: (False, None, e) for k, e in bad.items()}


def test_many_calls_of_one_file_search(spark, monkeypatch):
    # 12,000 calls and 12,000 files met as 144 million rows once.
    calls = spark.range(12_000).select(F.col("id").alias("call_id"), F.lit("find_files_by_glob").alias("name"), F.when(F.col("id") < 10, F.format_string('{"globPattern":"**/*.txt","subDirectoryRelativePath":"%d/","fileCountLimit":2,"excludeRegex":".*1"}', "id")).otherwise('{"globPattern":"**/*.txt","fileCountLimit":2}').alias("arguments"))
    paths = spark.range(12_000).select(F.format_string("%d/%05d.txt", F.col("id") % 7, F.col("id") - F.col("id") % 14).alias("path"), (-F.col("id")).alias("size"))
    began = time.monotonic()
    rows = tools.run_calls(calls, {"files": paths, "texts": spark.createDataFrame([], "path string, text string"), "glossary": glossary.parse(spark.createDataFrame([], "file string, text string"))}).collect()
    assert time.monotonic() - began < 40
    listed = lambda below: '{"files":[' + ",".join(f'{{"path":"{below}/00000.txt","size":{-k}}}' for k in (below + 7, below)) + "]}"
    want = {k: listed(k) if k < 7 and k != 1 else '{"files":[]}' for k in range(10)} | dict.fromkeys(range(10, 12_000), listed(0))
    assert {r["call_id"]: (r["ok"], r["result"]) for r in rows} == {k: (True, r) for k, r in want.items()} and len(rows) == 12_000
    few = [("**/*.txt", "", "", 2**31 - 1, 1), ("**/*.txt", "", "", 3, 10_000), ("**/*.txt", "", "6", 0, 1), ("**/*", "", "6", 1, 1)]
    searches = spark.createDataFrame(few, "globPattern string, out string, below string, most int, n long")
    monkeypatch.setattr(tools, "PATTERNS", 1)
    monkeypatch.setattr(tools, "SEARCHES", 1)
    found, hot = tools._matches(paths.coalesce(1), searches)
    n = {(g, b, m): c for g, b, m, c in found.groupBy("globPattern", "below", "most").count().collect()}
    assert hot == [few[1][:4]] and n.pop(("**/*.txt", "", 2**31 - 1)) == 12_000 and set(n) == {("**/*.txt", "", 3), ("**/*", "6", 1)} and max(n.values()) <= 8


def test_walk_never_opens_what_is_excluded(spark, tmp_path):
    paths = ["a/1.txt", "a/skip/2.txt", "a/skip/deep/er/3.txt", "a/b/c/4.txt", "5.txt", "b/skip/6.txt"]
    for p in paths:
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x" * 3)
    (tmp_path / "empty").mkdir()
    opened = spark.sparkContext.accumulator(0)
    rows = files.walk(spark, str(tmp_path), r".*/skip|5\.txt", opened)
    got = sorted(map(tuple, rows.collect()))
    assert got == [("a", 0, True), ("a/1.txt", 3, False), ("a/b", 0, True), ("a/b/c", 0, True), ("a/b/c/4.txt", 3, False), ("b", 0, True), ("empty", 0, True)]
    assert opened.value == 6  # the root, a, a/b, a/b/c, b, empty
    every = files.with_directories(spark.createDataFrame([(p, 3) for p in paths], "path string, size long"))
    want = {r["path"] for r in textfiles.find_by_glob(every, "**/*", exclude=r".*/skip").collect()}
    assert {r["path"] for r in textfiles.find_by_glob(files.walk(spark, str(tmp_path), r".*/skip"), "**/*").collect()} == want
    assert files.walk(spark, str(tmp_path / "none")).collect() == []


def test_gzip_resources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("plain a")
    (tmp_path / "a.txt.gz").write_bytes(gzip.compress("packed ä".encode()))
    (tmp_path / "b.txt").write_text("plain b")
    (tmp_path / "c.gz").write_bytes(b"no gzip at all")
    texts = {r["path"].rsplit("/", 1)[1]: r["text"] for r in files.whole_texts(spark, str(tmp_path)).collect()}
    assert texts == {"a.txt": "plain a", "a.txt.gz": "packed ä", "b.txt": "plain b", "c.gz": None}
    listed = spark.read.format("binaryFile").load(str(tmp_path))
    rows = {r["resource"].rsplit("/", 1)[1]: (r["is_gzipped"], r["content"]) for r in files.resources(listed).collect()}
    assert rows == {"a.txt": (True, bytearray("packed ä".encode())), "b.txt": (False, bytearray(b"plain b")), "c": (True, None)}


def test_settings_in_order(spark, monkeypatch):
    monkeypatch.setenv("tessel.second", "env")
    spark.conf.set("tessel.first", "session")
    assert files.setting(spark, "tessel.first", "tessel.second") == "env"
    assert files.setting(spark, "tessel.first", default="x") == "session"
    assert files.setting(spark, "tessel.none", default="x") == "x" and files.setting(spark, "tessel.none") is None
    spark.conf.unset("tessel.first")
    settings = spark.createDataFrame([(1, "a-b", "1"), (0, "aB", "2"), (0, "c", None), (1, "c", "3")], "source int, key string, value string")
    wanted = spark.createDataFrame([("x", ["a-b", "aB"], "d"), ("y", ["c"], "d"), ("z", ["q"], "d"), ("n", [], None)], "name string, keys array<string>, fallback string")
    assert sorted(map(tuple, files.resolved_settings(wanted, settings).collect()), key=str) == [("n", None, None), ("x", "2", 0), ("y", "3", 1), ("z", "d", None)]


def brute_prefix(text, needle):
    best = None
    for i in range(len(text)):
        n = 0
        while n < len(needle) and i + n < len(text) and needle[n] == text[i + n]:
            n += 1
        if n < len(needle) and i + n < len(text) and (best is None or (n, i) >= best):
            best = (n, i)
    return best


def test_longest_prefix_equals_brute_force_in_linear_time(monkeypatch):
    rng = random.Random(2)
    for tries in (0, 2, textfiles.TRIES):
        monkeypatch.setattr(textfiles, "TRIES", tries)
        for _ in range(1500):
            text, needle = ("".join(rng.choice("ab") for _ in range(rng.randrange(n))) for n in (14, 9))
            if needle and needle not in text:
                assert textfiles.farthest(text, needle) == brute_prefix(text, needle), (text, needle)
    for text, needle in (("a" * 100_000, "a" * 100_001), ("ab" * 50_000, "ab" * 50_000 + "c"), ("a" * 100_000, "b" + "a" * 50_000), ("a" * 99_999 + "b", "a" * 100_001)):
        began = time.time()
        textfiles.farthest(text, needle)
        assert time.time() - began < 1.5


def test_top_of_many_queries(spark):
    rng = np.random.default_rng(1)
    v = rng.integers(-3, 4, (400, 6)).astype(float)  # many ties
    v[7, 2] = np.nan
    chunks = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)] + [(900, None), (901, [1.0]), (None, [3.0] * 6)], "id long, embedding array<double>").repartition(5)
    q = rng.integers(-3, 4, (5000, 6)).astype(float)
    asked = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(q)] + [(None, [1.0] * 6), (9000, None), (9001, [2.0])], "q long, embedding array<double>")
    got = {}
    for r in search.top_many(chunks, asked, "q", "id", k=3).collect():
        got.setdefault(r["q"], {})[r["place"]] = (r["id"], r["score"])
    assert len(got) == 5001 and got[9001] == {1: (901, 2.0)}
    for k in range(0, 5000, 97):
        scores = sorted([(-float(x @ q[k]), i) for i, x in enumerate(v) if i != 7] + [(-float(3 * q[k].sum()), -1)])[:3]
        assert got[k] == {p + 1: (None if i < 0 else i, -s) for p, (s, i) in enumerate(scores)}
    assert search.top_many(chunks, asked.where("false"), "q", "id").collect() == []


def test_report_is_bounded_and_whole(spark):
    docs = spark.createDataFrame([(1, "one\ntwo\nthree"), (2, "x"), (4, "")], "doc_id long, text string")
    best = spark.createDataFrame([(1, 4, 7, 2.0), (3, 0, 5, 3.0), (2, 0, 0, 2.0), (4, 0, 0, 1.0)], "doc_id long, start_offset int, end_offset int, score double")
    want = "# Search Results\n\n## Summary\n| Source | Score | Range (Lines) |\n|---|---|---|\n| 3 | 3.0000 | Not Found |\n| 1 | 2.0000 | 2..2 |\n| 2 | 2.0000 | 1..1 |\n| 4 | 1.0000 | 1..1 |\n\n## Details\n### 1. 1 (Lines 2..2)\n```text\ntwo\n```\n\n### 2. 2 (Lines 1..1)\n```text\nx\n```\n\n### 3. 4 (Lines 1..1)\n```text\n\n```\n\n"
    assert search.markdown(best, docs).first()[0] == want
    many = spark.range(search.REPORT + 1).selectExpr("id AS doc_id", "0 AS chunk_index", "1D AS score", "0 AS start_offset", "0 AS end_offset")
    with pytest.raises(ValueError, match="top-k"):
        search.report(many, docs)


def test_subnormal_blocks(spark):
    v = [1e-45, -1e-45, 0.0, float("nan")] + [0.0] * 252
    b = spark.createDataFrame([(v,)], "v array<float>").select(vectors.blocks(F.col("v")).alias("b")).first()["b"]
    want = [127, -128, 0, 0] + [0] * 28
    assert b[0]["q"] == want and b[0]["scale"] == 0 and b[1]["scale"] == 1
    stored = vectors.q8_encode(np.array(v, np.float32))
    assert list(np.frombuffer(stored[2:34], np.int8)) == want


def test_damaged_archives_have_no_entries(spark):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("p/A.java", "class A")
    whole = data.getvalue()
    strange = bytearray(whole)
    strange[whole.index(b"PK\x01\x02") + 6] = 128  # a version that isn't known
    rows = spark.createDataFrame([("good", bytearray(whole), ["p/A.java"]), ("strange", strange, ["p/A.java"]), ("cut", bytearray(whole[:-30]), ["p/A.java"]), ("none", None, ["p/A.java"])], "path string, content binary, names array<string>")
    assert [r["archive"] for r in files.archive_entries(rows).collect()] == ["good"]
    assert [r["path"] for r in files.entry_texts(rows).collect()] == ["good"]


def test_brackets_never_match_a_separator(spark):
    rows = spark.createDataFrame([("a/b",), ("a.b",), ("a0b",), ("axb",)], "p string")
    hit = lambda pattern: {r["p"] for r in rows.where(F.col("p").rlike(text_.glob_regex(pattern))).collect()}
    assert hit("a[.-0]b") == {"a.b", "a0b"} and hit("a[!.]b") == {"a0b", "axb"} and hit("a[/x]b") == {"axb"}


def test_embedded_sessions_without_calls(spark):
    items = spark.createDataFrame([(1, 0, "user", "hi", None, None), (2, 1, None, "f()", "function_call", "x")], "conv_id long, turn long, role string, text string, type string, call_id string")
    rows = {r["conv_id"]: (r["n_turns"], r["history"], r["last_answer"], [tuple(c) for c in r["calls"]]) for r in events.sessions(items).collect()}
    assert rows == {1: (1, "user: hi", None, []), 2: (0, "", None, [("x", "f()", None)])}
