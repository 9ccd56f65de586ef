"""Streams give what the batch operators give."""

import random

import pytest
from pyspark.sql import functions as F

from tessel import plans, streaming
from tessel.operators import events
from tessel.streaming import log, pieces, sessions


def run(spark, source, build, mode, tmp_path, name):
    parts = source.repartition(3)
    path = str(tmp_path / "in")
    parts.write.parquet(path)
    stream = build(spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(path))
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_totals(spark, tmp_path):
    calls = spark.range(20).select(F.col("id").alias("prompt_tokens"), (F.col("id") * 2).alias("completion_tokens"), (F.col("id") * 3).alias("total_tokens"))
    got = run(spark, calls, streaming.running_totals, "complete", tmp_path, "totals").first()
    assert tuple(got) == (20, 190, 380, 570)


def test_payloads(spark, tmp_path):
    text = 'data: {"x":1}\n\ndata: {"y":"é"}\r\ndata: [DONE]\n'
    rows = spark.createDataFrame([(s, 0, text[: 5 + s]) for s in range(3)] , "stream_id long, seq long, piece string")
    more = spark.createDataFrame([(s, 1, text[5 + s :]) for s in range(3)], "stream_id long, seq long, piece string")
    path = str(tmp_path / "in")
    for part in (rows, more):
        part.coalesce(1).write.mode("append").parquet(path)
        q = streaming.payloads(spark.readStream.schema(rows.schema).parquet(path)).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = sorted((r["stream_id"], r["payload"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(s, p) for s in range(3) for p in ('{"x":1}', '{"y":"é"}')]


def test_pieces_that_come_early_wait(spark, tmp_path):
    text = "data: one\ndata: two\ndata: three\nrest"
    cut = [text[k : k + 4] for k in range(0, len(text), 4)]
    rows = [(1, k, x) for k, x in enumerate(cut)]
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = spark.createDataFrame(rows, "stream_id long, seq long, piece string").schema
    for part in (rows[1::2], rows[::2]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        q = streaming.payloads(spark.readStream.schema(schema).parquet(path)).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted(r["payload"] for r in spark.read.parquet(out).collect()) == ["one", "three", "two"]
    batch = events.payloads(spark.createDataFrame(rows, schema), "stream_id").orderBy("pos").collect()
    assert [r["payload"] for r in batch] == ["one", "two", "three"]


def test_throttle(spark, tmp_path):
    rows = spark.createDataFrame([(k, t) for k in (1, 2) for t in (0, 1900, 2000, 3900, 4100)], "key long, at long").coalesce(1)
    path = str(tmp_path / "one")
    rows.write.parquet(path)
    q = streaming.throttled(spark.readStream.schema(rows.schema).parquet(path), 2).writeStream.outputMode("append").format("memory").queryName("throttled").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("throttled").collect())) == sorted((r["key"], r["at"]) for r in events.throttled(rows, "key", "at", 2).collect())


def test_conversations(spark, tmp_path):
    turns = spark.createDataFrame([(c, t, "assistant" if t % 2 else "user", f"{c}-{t}") for c in range(5) for t in range(4)], "conv_id long, turn long, role string, text string")
    got = run(spark, turns, streaming.conversations, "complete", tmp_path, "convs").collect()
    assert sorted(map(tuple, got)) == [(c, 4, f"{c}-3") for c in range(5)]


def test_ingest_then_find(spark):
    files = spark.createDataFrame([("a", 1, 5, "red red blue."), ("b", 1, 4, "green things"), ("c", 1, 0, "")], "key string, mod_ts long, size long, text string")
    empty = spark.createDataFrame([], "key string, mod_ts long, size long, n_tokens long, embedding array<float>")
    first = plans.ingest(empty, files)
    assert {r["key"]: r["n_tokens"] for r in first.collect()} == {"a": 3, "b": 2, "c": 0}
    again = plans.ingest(first, spark.createDataFrame([("a", 2, 5, "red"), ("b", 1, 4, "not read")], files.schema))
    assert {r["key"]: r["n_tokens"] for r in again.collect()} == {"a": 1, "b": 2, "c": 0}
    assert plans.find(again, again.where("key = 'b'"), k=1).first()["key"] == "b"


@pytest.fixture
def data_only(spark):
    """No batches without data: a run that takes what there is would go on for ever, for timers to expire."""
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    yield
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def batches(spark, tmp_path, parts, schema, build, mode, name):
    """Feed parts one by one, each to a new run of the query on the same checkpoint; what each run gives."""
    source, out = tmp_path / f"{name}-in", tmp_path / f"{name}-out"
    got = []
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = build(spark.readStream.schema(schema).parquet(str(source)))
        write = lambda rows, batch, k=k: rows.write.mode("append").parquet(str(out / f"run={k}"))
        with streaming.rocksdb(spark):
            q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        got.append(spark.read.parquet(str(out / f"run={k}")).collect())
    return got


ITEMS = "conv_id long, turn long, role string, text string, type string, call_id string"


def test_sessions_over_restarts(spark, tmp_path):
    first = [(1, 0, "user", "hi", None, None), (1, 1, None, "f(1)", "function_call", "a"), (2, 0, "user", "x", "message", None)]
    second = [(1, 3, "assistant", "done", "message", None), (1, 2, None, "one", "function_call_output", "a"), (1, 4, None, "g()", "function_call", "b")]
    third = [(2, 1, "assistant", None, "message", None), (3, 5, None, "h()", "function_call", "c")]
    runs = batches(spark, tmp_path, [first, second, third], ITEMS, sessions.sessions, "update", "sessions")
    seen = []
    for part, run in zip((first, second, third), runs, strict=True):
        seen += part
        want = {r["conv_id"]: r for r in events.sessions(spark.createDataFrame(seen, ITEMS)).collect()}
        assert {r["conv_id"] for r in run} == {row[0] for row in part}
        assert all(r == want[r["conv_id"]] for r in run)
    assert want[1]["calls"][1]["output"] is None and want[3]["n_turns"] == 0


CHANGES = "name string, seq long, action string, active boolean"


def machine(rows):
    """Transitions by one state after the other."""
    out, state = [], {}
    for name, seq, action, active in sorted(rows, key=lambda r: r[1]):
        was = state.get(name)
        if action == "register":
            was, state[name] = False, bool(active)
        elif was is not None:
            state[name] = {"on": True, "off": False, "toggle": not was}[action]
        if bool(state.get(name)) != bool(was):
            out.append((name, seq, "activated" if state[name] else "deactivated"))
    return sorted(out)


def test_transitions_in_batch_and_stream(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice("abc"), k, rng.choices(["register", "on", "off", "toggle"], [1, 4, 4, 6])[0], rng.choice([True, False, None])) for k in range(300)]
    want = machine(rows)
    frame = spark.createDataFrame(rows, CHANGES)
    assert sorted(map(tuple, events.transitions(frame.repartition(5)).collect())) == want
    runs = batches(spark, tmp_path, [rows[:100][::-1], rows[50:220], rows[220:]], CHANGES, sessions.transitions, "append", "tools")
    assert sorted(tuple(r) for run in runs for r in run) == want


PIECES = "stream_id string, seq long, piece string"


def test_gaps_are_given_up(spark, tmp_path, data_only):
    text = "data: one\ndata: two\ndata: three\ndata: four\n"
    cut = [("s", k, text[4 * k : 4 * k + 4]) for k in range(11)]
    parts = [cut[:3] + cut[4:6], [("t", 0, "data: x\n")], cut[3:4] + cut[6:]]  # piece 3 comes after its time
    runs = batches(spark, tmp_path, parts, PIECES, lambda p: pieces.payloads(p, timeout_ms=1), "append", "gaps")
    got = [tuple(r) for run in runs for r in run if r["stream_id"] == "s"]
    assert got == [("s", "payload", "one", None), ("s", "gap", None, 1), ("s", "payload", "three", None), ("s", "payload", "four", None)]


def test_state_of_early_pieces_is_bounded(spark, tmp_path, data_only):
    late = [("s", k, f"data: {k}\n") for k in range(1, 8)]
    runs = batches(spark, tmp_path, [late[:3], late[3:]], PIECES, lambda p: pieces.payloads(p, timeout_ms=10**9, most=3), "append", "most")
    assert runs[0] == [] and [tuple(r)[1:] for r in runs[1]] == [("gap", None, 1), *[("payload", str(k), None) for k in range(2, 8)]]
    again = batches(spark, tmp_path, [[("s", 1, "data: 1\n"), ("s", 0, "data: 0\n")]], PIECES, lambda p: pieces.payloads(p, most=3), "append", "order")
    assert [r["payload"] for r in again[0]] == ["0", "1"]


def test_growing_files_cut_anywhere(spark, tmp_path, data_only):
    raw = 'data: {"é":"\U0001f600"}\ndata: ß\n'.encode()
    folder = tmp_path / "grow"
    folder.mkdir()
    got = []
    spark.dataSource.register(pieces.GrowingFiles)
    for cut in (0, *range(9, len(raw), 5), len(raw)):
        for name, data in (("a", raw[:cut]), ("b", raw[: len(raw) - cut])):
            old = (folder / name).stat().st_size if (folder / name).exists() else 0
            with (folder / name).open("ab") as f:
                f.write(data[old:])
        with streaming.rocksdb(spark):
            stream = pieces.payloads(pieces.growing_files(spark, str(folder), 8))
            q = stream.writeStream.foreachBatch(lambda rows, batch: got.extend(rows.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    want = ['{"é":"\U0001f600"}', "ß"]
    assert [r["payload"] for r in got if r["stream_id"] == "a"] == want and [r["payload"] for r in got if r["stream_id"] == "b"] == want


def test_growing_reader_at_every_byte(tmp_path):
    raw = "aé€\U0001f600z".encode() + b"\xff\xc3"
    for size in (8, 9, 64):
        for cut in range(len(raw) + 1):
            (tmp_path / "f").write_bytes(raw[:cut])
            reader = pieces.GrowingReader(str(tmp_path), size)
            first = reader.latestOffset()
            rows = [x for p in reader.partitions(reader.initialOffset(), first) for x in reader.read(p)]
            (tmp_path / "f").write_bytes(raw + "ü\n".encode())
            rows += [x for p in reader.partitions(first, reader.latestOffset()) for x in reader.read(p)]
            assert "".join(r[3] for r in rows) == (raw + "ü\n".encode()).decode("utf-8", "replace") or cut > len(raw) - 2
            assert "".join(r[3] for r in rows).startswith("aé€\U0001f600z") and [r[1] for r in rows][1:] == [r[2] for r in rows][:-1]


def test_log_batch_that_runs_twice(spark, tmp_path):
    folder, path = str(tmp_path / "log"), str(tmp_path / "in")
    calls = lambda a, b: spark.range(a, b).selectExpr("id AS prompt_tokens", "1L AS completion_tokens", "id + 1 AS total_tokens", "0L AS cached_tokens", "'t' AS ts_start", "1L AS millis_pp", "1L AS millis_tg", "'m' AS model", "0D AS pp_tps", "0D AS tg_tps", "'{}' AS usage")
    for a in (0, 4, 8):
        calls(a, a + 4).coalesce(1).write.mode("append").parquet(path)
        log.start_log(spark.readStream.schema(calls(0, 1).schema).parquet(path), folder, availableNow=True).awaitTermination()
    state = lambda: (sorted(r["value"] for r in log.read_log(spark, folder).collect()), tuple(log.log_totals(spark, folder).first()))
    before = state()
    assert len(before[0]) == 12 and before[1] == (12, 66, 12, 78)
    log.append_batch(calls(8, 12), 2, folder)  # the last batch, run again
    assert state() == before
