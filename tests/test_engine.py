"""Golden cases of the engine's operators, worked out by hand, and properties."""

import io
import zipfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessel.functions import text as text_
from tessel.functions import vectors
from tessel.operators import artifacts, chunking, events, glossary, search, store, textfiles, usage
from tessel.sources import files, sinks


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "sizes", "want"),
    [
        ("Aaa. Bbb! Ccc? Ddd", (8, 3, 4), [(0, 8), (4, 9), (5, 13), (9, 14), (10, 18)]), ("abcdefghij", (4, 1, 0), [(0, 4), (3, 7), (6, 10)]), ("abcdefghij", (4, 9, 0), [(0, 4), (4, 8), (8, 10)]),
        ("one\ntwo\nthree", (6, 0, 4), [(0, 4), (4, 8), (8, 13)]), ("Hi. there", (4, 0, 4), [(0, 3), (3, 7), (7, 9)]), ("", (10, 2, 2), []), ("abc", (10, 2, 2), [(0, 3)]),
    ],
)
def test_chunks(text, sizes, want):
    assert chunking.cut(text, *sizes) == want


@settings(max_examples=200, deadline=None)
@given(st.text("ab. \n!", max_size=200), st.integers(1, 20), st.integers(0, 25), st.integers(0, 20))
def test_chunks_cover_the_text(text, size, overlap, lookback):
    got = chunking.cut(text, size, overlap, min(lookback, size))
    assert not text or (got[0][0] == 0 and got[-1][1] == len(text))
    assert all(a[0] < b[0] <= a[1] for a, b in zip(got, got[1:], strict=False))


def test_chunk_sizes_are_checked(spark):
    with pytest.raises(ValueError, match="lookback"):
        chunking.chunks(spark.createDataFrame([(1, "x")], "doc_id long, text string"), 10, 0, 11)


def test_float_bytes(spark):
    coded = F.base64(vectors.f32_bytes(F.lit([1.0, -2.5]).cast("array<float>")))
    assert one(spark, coded) == "P4AAAMAgAAA="
    assert one(spark, vectors.f32_values(F.unbase64(coded))) == [1.0, -2.5]


def test_q8(spark):
    v = np.zeros(256, np.float32)
    assert vectors.q8_encode(v)[:2] == b"\x00\x3c" and len(vectors.q8_encode(v)) == 272
    v[0] = 1
    assert vectors.q8_encode(v)[:3] == b"\x08\x20\x7f"
    v[:8] = [127, -2.5, 2.5, -0.5, 0.5, -126.6, np.float32(0.49999997), np.nan]
    want = [127, -2, 3, 0, 1, -127, 0, 0]
    assert np.frombuffer(vectors.q8_encode(v)[2:10], np.int8).tolist() == want
    rows = one(spark, vectors.blocks(F.lit([float(x) for x in v]).cast("array<float>")))
    assert rows[0]["q"][:8] == want and rows[1]["scale"] == 1
    for n in (0, 64, 100):
        with pytest.raises(ValueError, match="256"):
            vectors.q8_encode(np.zeros(n, np.float32))
    with pytest.raises(PySparkException, match="256"):
        one(spark, F.size(vectors.checked(F.array_repeat(F.lit(0.0), 64))))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.floats(-1000, 1000, width=32), min_size=256, max_size=256))
def test_q8_error_is_bounded(values):
    v = np.array(values, np.float32)
    top = np.abs(v.reshape(-1, 32)).max(1, keepdims=True)
    assert (np.abs(vectors.q8_decode(vectors.q8_encode(v)).reshape(-1, 32) - v.reshape(-1, 32)) <= top / 127 * 0.5 + top * 2**-10 + 127 * 2**-24).all()


def test_lines_and_back(spark):
    vec = [float(k) / 7 for k in range(256)]
    entries = spark.createDataFrame([('a;b"c', 1, 2, 3, 4, [(0, 5, vec), (4, 9, vec[::-1])]), ("none", 1, 2, 0, 0, [])], "key string, mod_ts long, size long, prompt_tokens int, total_tokens int, chunks array<struct<start:int,end:int,vec:array<float>>>")
    for q8 in (False, True):
        coded = store.to_lines(entries, q8)
        assert any(r["line"].startswith('"a;b""c";1;2;3;4;' + ("Q8_0" if q8 else "F32") + ";2;0;5;") for r in coded.collect())
        back = store.from_lines(coded.withColumn("ordinal", F.monotonically_increasing_id())).orderBy("key", "chunk_index").collect()
        assert [(r["key"], r["chunk_index"], r["start"], r["end"]) for r in back] == [('a;b"c', 0, 0, 5), ('a;b"c', 1, 4, 9), ("none", None, None, None)]
        assert np.allclose(back[0]["vec"], vec, atol=0.3 if q8 else 1e-6)


def test_malformed_lines(spark):
    b = "P4AAAMAgAAA="
    lines = [f"k;1;2;3;4;F32;1;0;9;{b}", "", "x;1;2;3;4;F32", f"y;no;2;3;4;F32;1;0;9;{b}", "j;1;2;3;4;F32;0", f"k;7;2;3;4;F32;1;5;9;{b}", "s;1;2;3;4;F32;2;0;9;" + b, "e;1;2;3;4;F32;1;0;9;***"]
    got = store.from_lines(spark.createDataFrame([*enumerate(lines)], "ordinal long, line string")).orderBy("ordinal").collect()
    assert [(r["key"], r["ordinal"], r["mod_ts"], r["start"], r["vec"]) for r in got] == [("k", 0, 7, 5, [1.0, -2.5]), ("j", 4, 1, None, None), ("e", 7, 1, 0, None)]


def test_search_ties_nan_and_empty(spark):
    nan = float("nan")
    rows = spark.createDataFrame([("a", 0, [0.5]), ("a", 1, [0.5]), ("b", 2, [nan]), ("b", 3, [0.1]), ("c", 4, [0.5])], "key string, n int, embedding array<float>")
    best = search.best_chunks(search.scored(rows, spark.createDataFrame([([1.0],)], "embedding array<float>")), "key", "n")
    entries = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2), ("d", 3)], "key string, ordinal int")
    got = search.top(search.with_empty(best.drop("ordinal"), entries, "key"), "ordinal").collect()
    assert [(r["key"], round(r["score"], 6), r["chunk_index"]) for r in got] == [("a", 0.5, 0), ("c", 0.5, 4), ("b", 0.1, 3), ("d", float("-inf"), -1)]


def test_report_and_markdown(spark):
    docs = spark.createDataFrame([(1, "a\nb\n")], "doc_id long, text string")
    best = spark.createDataFrame([(1, 0.5, 0, 2, 4), (9, 0.25, 0, 0, 0)], "doc_id long, score double, chunk_index int, start_offset int, end_offset int")
    rows = search.report(best, docs).orderBy("doc_id").collect()
    assert [(r["score"], r["start_line"], r["end_line"], r["excerpt"]) for r in rows] == [("0.5000", 2, 2, "b\n"), ("0.2500", None, None, "Not Found")] or rows[1]["excerpt"] == "Not Found"
    assert search.markdown(best, docs).first()[0].splitlines()[5:7] == ["| 1 | 0.5000 | 2..2 |", "| 9 | 0.2500 | Not Found |"]
    lines = [one(spark, text_.number_of_line(F.lit("a\nb\n"), F.lit(k))) for k in (0, 2, 4)]
    assert lines == [1, 2, 2]


def test_glob(spark):
    rows = spark.createDataFrame([("R.java", 1), ("a/S.java", 1), ("a/b/T.java", 1), ("c/x.txt", 1)], "path string, size long")
    find = lambda *a, **b: sorted(r["path"] for r in textfiles.find_by_glob(rows, *a, **b).collect())
    assert find("**/*.java") == ["a/S.java", "a/b/T.java"] and find("*.java") == ["R.java"]
    assert find(exclude="a") == ["c/x.txt"] and find(below="a") == ["a/S.java", "a/b/T.java"]
    assert find("**/*.*", limit=0) == find("**/*.*", limit=-1) == [] and find("**/*.*", limit=1) == ["a/S.java"]
    assert find("{a,c}/[!S]*") == ["c/x.txt"] and find("a/?.java") == ["a/S.java"]
    assert sorted(r["path"] for r in files.with_directories(rows).where("is_dir").collect()) == ["a", "a/b", "c"]


def test_keywords_and_paths(spark):
    rows = spark.createDataFrame([("My_Clip.mp4",), ("My_Clip.txt",)], "name string")
    hits = lambda *k: [r["name"] for r in textfiles.keyword_hits(rows, F.col("name"), [*k]).collect()]
    assert hits("my clip") == ["My_Clip.mp4"] and hits("my_clip") == [] == hits()
    assert one(spark, text_.normal_path(F.lit("a/./b//../../../c"))) == "../c"
    assert one(spark, text_.inside("base", F.lit("base/x/../../base2"))) is False and one(spark, text_.inside("base", F.lit("base/a/.."))) is True


def test_line_ranges(spark):
    docs = spark.createDataFrame([(1, "a\r\nb\rc")], "doc_id long, text string")
    r = textfiles.line_range(docs, 0).first()
    assert (r["header"], r["body"], r["truncated"], r["next_line"]) == ("Lines 1-3 of 3", "a\nb\nc", False, None)
    assert textfiles.line_range(docs, 2, 1).first()["header"] == "Lines 2-3 of 3"
    r = textfiles.line_range(docs, 1, 2, numbered=True).first()
    assert (r["body"], r["truncated"], r["next_line"]) == ("   1 | a\n   2 | b", True, 3)


def test_edits(spark):
    docs = spark.createDataFrame([(1, "aaaa"), (2, "xyz")], "doc_id long, text string")
    assert [tuple(r) for r in textfiles.replace_all(docs, "aa", "b").orderBy("doc_id").collect()] == [(1, 2, "bb"), (2, 0, "xyz")]
    assert [tuple(r) for r in textfiles.edited(textfiles.replace_first(docs, "aa", "b")).collect()] == [(1, 1, "baa")]
    with pytest.raises(ValueError, match="empty"):
        textfiles.replace_all(docs, "", "x")


@pytest.mark.parametrize(("text", "needle", "want"), [("abcabx", "abcd", (3, "d", "a")), ("abXabY", "abZ", (2, "Z", "Y")), ("ab", "abc", (0, "a", "b")), ("", "x", (None, None, None)), ("a.c", "a.d", (2, "d", "c"))])
def test_longest_prefix(spark, text, needle, want):
    r = textfiles.longest_prefix(spark.createDataFrame([(1, text)], "doc_id long, text string"), needle).first()
    assert (r["prefix_length"], r["expected"], r["actual"]) == want


def test_glossary(spark):
    md = spark.createDataFrame([(0, "intro\n# A b\nx\n# c\ny\n## not\n# a-b\nz\n# r\n-> c\n")], "file long, text string")
    words = spark.createDataFrame([(0, "A_B"), (1, '"a b"'), (2, "zz"), (3, "r")], "pos int, word string")
    plain, full = glossary.parse(md), glossary.parse(md, resolve_references=True)
    assert {(r["key"], r["term"], r["description"]) for r in plain.collect()} == {("ab", "A b", "x"), ("c", "c", "y\n## not")}
    assert [(r["pos"], r["term"]) for r in glossary.look_up(plain, words).collect()] == [(0, "A b")]
    assert sorted((r["pos"], r["term"]) for r in glossary.look_up(full, words).collect()) == [(0, "A b"), (3, "c")]
    assert glossary.answer(glossary.look_up(full, words)).first()[0] == "# A b\nx\n\n# c\ny\n## not"
    assert one(spark, text_.word_list(F.lit("a , b,, c d ,,"))) == ["a", "b", "", "c d"] and one(spark, text_.word_list(F.lit(None).cast("string"))) == []
    asked = glossary.asked(spark.createDataFrame([("zz, a_b ,r",)], "words string"))
    assert sorted((r["pos"], r["term"]) for r in glossary.look_up(full, asked).collect()) == [(1, "A b"), (2, "c")]


def test_artifacts(spark):
    c = one(spark, artifacts.coordinates(F.lit("org/slf4j/slf4j-api/2.0/slf4j-api-2.0-sources.jar")))
    assert tuple(c) == ("org.slf4j", "slf4j-api", "2.0")
    assert [one(spark, artifacts.version(F.lit(p))) for p in ("/x/foo-1.2.jar", "/x/foo.jar", "g/a/1/a-1.jar")] == ["1.2", "unknown", "1"]
    jars = spark.createDataFrame([("g/a/1/a-1.jar", 0), ("g/a/2/a-2.jar", 1)], "path string, ordinal int")
    assert [r["path"] for r in artifacts.classpath(jars).collect()] == ["g/a/2/a-2.jar"]
    assert one(spark, artifacts.entry_path(F.lit("a.b.C"))) == "a/b/C.class"


def test_archives_and_files(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("a/B.class", "xx")
    rows = spark.createDataFrame([("j.jar", bytearray(data.getvalue())), ("bad.jar", bytearray(b"no"))], "path string, content binary")
    assert [(r["archive"], r["name"], r["size"], r["method"]) for r in files.archive_entries(rows).collect()] == [("j.jar", "a/B.class", 2, "STORED")]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.txt").write_text("é\n")
    r = files.whole_texts(spark, str(tmp_path)).first()
    assert (r["text"], r["size"]) == ("é\n", 3) and files.listing(spark, str(tmp_path)).count() == 1
    gz = spark.createDataFrame([("a.js",), ("a.js.gz",), ("b.js",)], "path string")
    assert sorted(r["path"] for r in files.prefer_gzip(gz).collect()) == ["a.js.gz", "b.js"]
    assert sorted(one(spark, files.name_list(F.lit(" a, b,,a ")))) == ["a", "b"]


def test_usage(spark):
    schema = "prompt_tokens long, completion_tokens long, prompt_ms double, predicted_ms double, prompt_per_second double, predicted_per_second double, first_ms long, total_ms long"
    rows = [(100, 20, None, None, None, None, None, 1000), (100, 20, None, None, None, None, 500, 900), (1, 2, 10.5, 3.4, 7.0, None, 5, 9), (100, 0, None, None, None, None, None, 1000)]
    got = [tuple(r)[-4:] for r in usage.rates(spark.createDataFrame(rows, schema)).collect()]
    assert got == [(500, 500, 200.0, 40.0), (500, 400, 200.0, 50.0), (11, 3, 7.0, 0.0), (1000, 1000, 0.0, 0.0)]
    assert usage.totals(spark.createDataFrame([], "prompt_tokens long, completion_tokens long, total_tokens long")).first()["message"] == "none"
    p = one(spark, usage.from_payload(F.lit('{"usage":{"prompt_tokens":3,"prompt_tokens_details":{"cached_tokens":2}},"model":"m"}')))
    assert (p["prompt_tokens"], p["completion_tokens"], p["cached_tokens"], p["model"], p["prompt_ms"]) == (3, 0, 2, "m", None)


def test_log_is_appended(spark, tmp_path):
    calls = spark.createDataFrame([("t", 1, 2, "m", 3, 4, 7, 0, 1.5, None, '{"x":1}')], "ts_start string, millis_pp long, millis_tg long, model string, prompt_tokens long, completion_tokens long, total_tokens long, cached_tokens long, pp_tps double, tg_tps double, usage string")
    for _ in range(2):
        usage.append_log(calls, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).where("type = 'llm-request' AND millisPP = 1 AND usage.x = 1 AND tgTPS IS NULL AND totalTokens = 7").count() == 2


def test_streams_cut_anywhere(spark):
    text = 'data: {"x":"é"}\n\ndata: [DONE]\n'
    for k in range(1, len(text)):
        if k % 7 == 0:
            rows = spark.createDataFrame([(1, 0, text[:k]), (1, 1, text[k:])], "s int, seq int, piece string")
            assert [r["payload"] for r in events.payloads(rows, "s").collect()] == ['{"x":"é"}']


def test_throttle_tail_and_sessions(spark):
    rows = spark.createDataFrame([(1, t) for t in (0, 1900, 2000, 3900, 4100)], "k int, t long")
    assert sorted(r["at"] for r in events.throttled(rows, "k", "t", 2).collect()) == [0, 2000, 4100]
    assert one(spark, text_.tail(F.lit("x" * 79))) == "x" * 79 and one(spark, text_.tail(F.lit("x" * 81))) == "[...]" + "x" * 80
    turns = spark.createDataFrame([(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, "user", None)], "conv_id long, turn long, role string, text string")
    assert {r["conv_id"]: (r["n_turns"], r["history"], r["last_answer"]) for r in events.conversations(turns).collect()} == {1: (2, "user: a\nassistant: b", "b"), 2: (1, "user: ", None)}
    loop = spark.createDataFrame([(1, 0, True), (1, 1, False)] + [(2, k, True) for k in range(25)], "conv_id int, round int, has_call boolean")
    assert {r["conv_id"]: r["rounds"] for r in events.tool_loop(loop).collect()} == {1: 2, 2: 20}
    calls = spark.createDataFrame([(1, "function_call", "c1", "f()"), (1, "function_call_output", "c1", "3")], "conv_id int, type string, call_id string, text string")
    assert [(r["call"], r["output"]) for r in events.call_pairs(calls).collect()] == [("f()", "3")]


def test_small_functions(spark):
    assert one(spark, text_.json_escape(F.lit('a"\\\n\t'))) == 'a\\"\\\\\\n\\t' and one(spark, text_.json_escape(F.lit(None).cast("string"))) == ""
    assert one(spark, text_.content_type(F.lit("a/B.HTML"))) == "text/html" and one(spark, text_.content_type(F.lit("html"))) == "application/octet-stream"
    assert one(spark, text_.join_url(F.lit("http://h/"), F.lit("/p"))) == "http://h/p"
    assert one(spark, text_.basic_date(F.lit(1704063600000))) == "20240101"
    assert one(spark, text_.json_floats(F.lit('{"embedding":[1, -2.5]}'), "embedding")) == [1.0, -2.5]


def test_deltas_and_sinks(spark, tmp_path):
    lines = ['{"type":"response.output_text.delta","delta":"a"}', '{"type":"response.reasoning_text.delta","delta":"r"}', '{"type":"response.output_text.delta","delta":"b"}', '{"type":"response.completed","text":"zz"}']
    rows = spark.createDataFrame([(1, k, x) for k, x in enumerate(lines)] + [(2, 0, lines[3])], "s int, pos int, payload string")
    assert {r["s"]: tuple(r)[1:] for r in events.deltas(rows, "s").collect()} == {1: ("r", "ab", "ab"), 2: ("", "", "zz")}
    path = str(tmp_path / "new")
    sinks.create_files(spark.createDataFrame([("x",)], "value string"), path)
    with pytest.raises(PySparkException, match="exists"):
        sinks.create_files(spark.createDataFrame([("y",)], "value string"), path)
    sinks.create_files(spark.createDataFrame([("y",)], "value string"), path, overwrite=True)
    assert [r["value"] for r in spark.read.text(path).collect()] == ["y"]
    sinks.write_back(textfiles.replace_all(spark.createDataFrame([(1, "aa"), (2, "b")], "doc_id long, text string"), "a", "c"), str(tmp_path / "e"))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "e")).collect()] == [(1, 2, "cc")]
    assert one(spark, search.query_text(F.lit("abc"), 2)) == "ab"


def test_artifact_of_a_class(spark):
    wanted = spark.createDataFrame([("a.B",), ("a.C",), ("no class",)], "class_name string")
    entries = spark.createDataFrame([("a.B", 1, 0, "/lib/x-3.jar"), ("a.B", 0, 5, "g/h/x/2/x-2-sources.jar")], "class_name string, tier int, ordinal int, path string")
    got = artifacts.resolve(wanted, entries)
    assert {r["class_name"]: r["status"] for r in got.collect()} == {"a.B": "success", "a.C": "not_found", "no class": "error"}
    assert [tuple(r) for r in artifacts.artifact_of(got).collect()] == [("a.B", "g.h", "x", "2")]


def test_search_takes_several_queries(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0]), (4, None), (5, [float("nan"), 1.0])], "id long, embedding array<float>")
    two = spark.createDataFrame([("x", [1.0, 0.5]), ("y", [0.0, 2.0])], "q string, embedding array<float>")
    got = search.top_of_each(search.scored(rows, two, query_id="q"), "q", "id", k=1)
    assert sorted((r["q"], r["id"], r["score"], r["place"]) for r in got.collect()) == [("x", 1, 1.0, 1), ("y", 2, 2.0, 1)]
    for bad in (two, two.where("false")):
        with pytest.raises(ValueError, match="one vector"):
            search.scored(rows, bad)


def test_upsert_of_repeated_and_null_keys(spark):
    schema = "key string, mod_ts long, size long, v string"
    old = spark.createDataFrame([("a", 1, 1, "old"), ("b", 1, 1, "old"), (None, 1, 1, "old"), ("e", 1, 1, "old")], schema)
    new = spark.createDataFrame([("a", 1, 1, "same"), ("b", 2, 1, "new"), ("b", 1, 9, "earlier"), (None, 1, 2, "new"), ("d", 1, 1, "new"), ("d", 1, 1, "new")], schema)
    got = store.upsert(old, new)
    assert got.columns == [*old.columns, "status"]
    assert sorted((str(r["key"]), r["mod_ts"], r["v"], r["status"]) for r in got.collect()) == [("None", 1, "new", "updated"), ("a", 1, "old", "kept"), ("b", 2, "new", "updated"), ("d", 1, "new", "inserted"), ("e", 1, "old", "kept")]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1


def test_store_files_keep_their_order(spark, tmp_path):
    entries = spark.createDataFrame([(k, f"key{k}", 1, 2, 3, 4, [(0, 5, [1.0, 2.0])]) for k in range(50)], "ordinal long, key string, mod_ts long, size long, prompt_tokens int, total_tokens int, chunks array<struct<start:int,end:int,vec:array<float>>>")
    store.save(entries.repartition(5), str(tmp_path / "db"))
    back = store.load(spark, str(tmp_path / "db"))
    assert [r["key"] for r in back.orderBy("ordinal").collect()] == [f"key{k}" for k in range(50)]
    assert store.load(spark, str(tmp_path / "none"), back) is back


def test_embedder_of_ones_own(spark):
    docs = spark.createDataFrame([(1, "ab. cd"), (2, "")], "doc_id long, text string")
    got = chunking.embed_with(chunking.chunks(docs, 4, 0, 2), lambda texts: ([len(t) for t in texts], np.array([[len(t), 1] for t in texts])), batch_size=1)
    assert sorted((r["doc_id"], r["chunk_index"], r["n_tokens"], r["embedding"]) for r in got.collect()) == [(1, 0, 3, [3.0, 1.0]), (1, 1, 3, [3.0, 1.0])]


def test_streams_end_alike(spark):
    for text, want in (("x data: 1 \t\ndata: 2", ["1"]), ("data: a data: b\r\n: c\ndata:x\n", ["a data: b"]), ("data: [DONE] \n data:  \x01y\n", ["y"]), ("\n\n", [])):
        rows = spark.createDataFrame([(1, k, c) for k, c in enumerate(text)], "s int, seq int, piece string")
        assert [r["payload"] for r in events.payloads(rows, "s").orderBy("pos").collect()] == want
        assert [x for x in map(events.payload_of, text.split("\n")[:-1]) if x is not None] == want


def test_numbers_before_a_row_cross_blocks(spark):
    rows = spark.createDataFrame([(k % 2 or None, k * 3, k) for k in range(40)], "key int, at long, v long")
    got = events.before(rows, "key", "at", F.col("v"), "sum", block=7)
    assert got.columns == ["key", "at", "v", "sum"]
    assert all(r["sum"] == sum(k for k in range(r["v"]) if k % 2 == r["v"] % 2) for r in got.collect()) and got.count() == 40


def test_throttle_is_linear_and_holds_any_key(spark):
    rng = np.random.default_rng(0)
    rows = [(k, int(t)) for k in ("a", None, "b") for t in rng.integers(0, 400_000, 300)]
    want = []
    for k in ("a", None, "b"):
        last = None
        for t in sorted(t for q, t in rows if q == k):
            if last is None or (t - last) // 1000 >= 3:
                want.append((str(k), t))
                last = t
    got = events.throttled(spark.createDataFrame(rows, "k string, t long").repartition(3), "k", "t", 3)
    assert sorted((str(r["k"]), r["at"]) for r in got.collect()) == sorted(want)


def test_classes_from_archives(spark):
    def jar(**entries):
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            for name, body in entries.items():
                z.writestr(name.replace("__", "/").replace("_java", ".java").replace("_class", ".class"), body)
        return bytearray(data.getvalue())

    archives = spark.createDataFrame(
        [("r/a-sources.jar", jar(p__A_java="l1\nl2\nl3"), 0, False), ("cp/a.jar", jar(p__A_class="x", p__B_class="y"), 1, True), ("r/c.jar", jar(p__C_class="z", p__C_java="no"), 2, False), ("bad.jar", bytearray(b"no"), 3, True)],
        "path string, content binary, ordinal long, on_classpath boolean",
    )
    wanted = [("p.A", "read_source", 2, 9), ("p.A", "read_class_structure", None, None), ("p.A", "read_metadata", None, None), ("p.B", "read_source", None, None), ("p.C", "read_metadata", 1, 1), ("p.Z", "read_source", None, None), ("no class", "read_source", 1, 1), ("p.A", "run", 1, 1)]
    rows = artifacts.read_classes(spark.createDataFrame(wanted, "class_name string, command string, start_line int, end_line int"), archives).collect()
    got = {(r["class_name"], r["command"]): r for r in rows}
    assert len(rows) == len(wanted)
    a = got["p.A", "read_source"]
    assert (a["status"], a["text"], a["lines_read"], a["truncated"], a["message"]) == ("success", "--- File: p/A.java ---\nLines 2-3 of 3\n\n   2 | l2\n   3 | l3", 2, False, "File has 3 lines total.")
    assert [got[k]["status"] for k in (("p.A", "read_class_structure"), ("p.A", "read_metadata"), ("p.B", "read_source"), ("p.C", "read_metadata"), ("p.Z", "read_source"), ("no class", "read_source"), ("p.A", "run"))] == ["error", "success", "sources_not_available", "success", "not_found", "error", "error"]
    assert (got["p.A", "read_metadata"]["path"], got["p.C", "read_metadata"]["entry_name"], got["p.A", "run"]["error"]) == ("cp/a.jar", "p/C.class", "Unknown command: run")


def test_json_arguments(spark):
    rows = spark.createDataFrame([('{"a":[1,{"b":null}]}',), ('"{\\"a\\":2}"',), ("[1]",), ("no",), (None,), ('"x"',)], "t string")
    assert [r["j"] for r in rows.select(F.to_json(text_.json_arguments(F.col("t"))).alias("j")).collect()] == ['{"a":[1,{"b":null}]}', '{"a":2}', "{}", "{}", "{}", "{}"]


def test_names_are_not_cut(spark):
    long = "x" * 12_000
    rows = spark.createDataFrame([(long + "/f",)], "path string")
    assert textfiles.allowed(rows, "b", "x{12000}").first()["allowed"]
    md = spark.createDataFrame([(0, f"# r\n-> {long}\n")], "file long, text string")
    assert glossary.parse(md, resolve_references=True).first()["reference"] == long
