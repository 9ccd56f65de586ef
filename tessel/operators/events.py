"""Event streams as tables: payload lines, first and last events, throttling, sessions, the tool table."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


BLOCK = 4096  # rows of one key that are numbered in one task


def before(rows: DataFrame, key: str, order: str, value: Column, name: str, block: int = BLOCK, fold: Callable = F.sum, none: Column | int = 0) -> DataFrame:
    """Adds ``name``: the sum (or another ``fold``) of ``value`` over the rows of ``key`` with a smaller ``order`` (an integer); ``none`` for the first.

    Rows are summed in blocks of ``order`` first, then the blocks of a key, so that one key's rows
    don't meet in one task.
    """
    none = F.lit(none) if isinstance(none, int) else none
    marked = rows.withColumns({"_block": F.floor(F.col(order) / block), "_value": value})
    blocks = marked.groupBy(key, "_block").agg(fold("_value").alias("_sum"))
    earlier = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col(key).alias("_key"), F.col("_block").alias("_of"), F.coalesce(fold("_sum").over(earlier), none).alias("_before"))
    inside = Window.partitionBy(key, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    own = marked.withColumn("_own", F.coalesce(fold("_value").over(inside), none))
    both = own.join(blocks, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_block") == F.col("_of")))
    total = F.col("_before") + F.col("_own") if fold is F.sum else F.greatest("_before", "_own")
    return both.withColumn(name, total).drop("_block", "_value", "_sum", "_key", "_of", "_before", "_own")


def payload_of(line: str) -> str | None:
    """What follows the first ``data: `` of a whole line, without blanks and control characters around; None if there is nothing to keep."""
    at = line.find("data: ")
    found = line[at + 6 :].strip(_TRIM) if at >= 0 else ""
    return None if found in ("", "[DONE]") else found


_TRIM = "".join(map(chr, range(33)))


def payloads(pieces: DataFrame, key: str) -> DataFrame:
    """key, pos, payload of event streams cut into pieces (``seq``, ``piece``) anywhere; no marker is lost at a cut.

    A payload follows the first ``data: `` of a line, trimmed; ``[DONE]`` and empty ones go, and so
    does a last line without an end, as the streaming form would still wait for its rest. Lines are
    numbered over pieces and put together one by one, so a stream's size isn't bounded by memory.
    """
    whole = pieces.select(key, F.col("seq").cast("long").alias("seq"), F.split("piece", "\n", -1).alias("parts"))
    whole = before(whole, key, "seq", F.size("parts") - 1, "first")
    parts = whole.select(key, "seq", "first", F.size("parts").alias("n"), F.posexplode("parts").alias("k", "part"))
    part = F.struct("seq", "part")
    lines = parts.groupBy(key, (F.col("first") + F.col("k")).alias("line")).agg(F.array_sort(F.collect_list(part)).alias("t"), F.bool_or(F.col("k") < F.col("n") - 1).alias("ends")).where("ends")
    text = F.array_join(F.transform("t", lambda x: x["part"]), "")
    found = F.when(F.instr(text, "data: ") > 0, F.regexp_replace(F.substr(text, F.instr(text, "data: ") + 6), r"^[\x00-\x20]+|[\x00-\x20]+$", ""))
    kept = lines.select(key, "line", found.alias("payload")).where(F.col("payload").isNotNull() & ~F.col("payload").isin("", "[DONE]"))
    return before(kept, key, "line", F.lit(1), "pos").select(key, F.col("pos").cast("int").alias("pos"), "payload")


def deltas(rows: DataFrame, key: str) -> DataFrame:
    """key, reasoning, output, final: text of a stream's events (``pos``, ``payload``) by type, in order.

    The final text is the streamed output if there is any, else what the completed event has.
    """
    kind, part = F.get_json_object("payload", "$.type"), F.get_json_object("payload", "$.delta")

    def joined(name: str):
        own = F.collect_list(F.when(kind == name, F.struct("pos", part.alias("t"))))
        return F.array_join(F.transform(F.array_sort(own), lambda x: x["t"]), "")

    done = F.max(F.when(kind == "response.completed", F.struct("pos", F.get_json_object("payload", "$.text").alias("t")))).getField("t")
    out = rows.groupBy(key).agg(joined("response.reasoning_text.delta").alias("reasoning"), joined("response.output_text.delta").alias("output"), done.alias("done"))
    return out.select(key, "reasoning", "output", F.when(F.col("output") != "", F.col("output")).otherwise(F.coalesce("done", F.lit(""))).alias("final"))


def first_and_last(events: DataFrame, key: str, order: str, value: str, first: Column, last: Column) -> DataFrame:
    """key, first_at, last_value: when an event of one sort first came, and the last value of another."""
    return events.groupBy(key).agg(F.min(F.when(first, F.col(order))).alias("first_at"), F.max(F.when(last, F.struct(order, value))).getField(value).alias("last_value"))


def throttled(events: DataFrame, key: str, millis: str, gap: int) -> DataFrame:
    """key, at: events that come ``gap`` whole seconds or more after the last one let through; the first always is.

    Rows are sorted by key and time and pass by once; only the last time let through is held, and
    from it the next one is searched for in the batch. Equal times count once.
    """
    kind, step = events.schema[key].dataType.simpleString(), max(gap * 1000, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []  # key and last time
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, times = batch.column(0), batch.column(1).to_numpy()
            which = keys.dictionary_encode("encode").indices.to_numpy()
            bounds = np.append(np.flatnonzero(np.append(True, which[1:] != which[:-1])), len(times)).tolist()
            chosen: list[int] = []
            for begin, end in pairwise(bounds):
                own = keys[begin].as_py()
                at = begin
                if held and held[0] == own:
                    at = begin + int(np.searchsorted(times[begin:end], held[1] + step))
                while at < end:
                    chosen.append(at)
                    held = [own, int(times[at])]
                    at = begin + int(np.searchsorted(times[begin:end], held[1] + step))
            yield batch.take(pa.array(chosen, pa.int64())).rename_columns([key, "at"])

    rows = events.select(key, F.col(millis).cast("long").alias("at")).where("at is not null")
    return rows.repartition(key).sortWithinPartitions(key, "at").mapInArrow(run, f"{key} {kind}, at long")


def conversations(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """key, n_turns, history (role and text in order), last_answer."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    rows = turns.groupBy(key).agg(ordered.alias("h"), F.max(F.when(F.col("role") == "assistant", F.struct("turn", "text"))).getField("text").alias("last_answer"))
    return rows.select(key, F.size("h").alias("n_turns"), F.array_join(F.transform("h", lambda x: F.concat(x["role"], F.lit(": "), F.coalesce(x["text"], F.lit("")))), "\n").alias("history"), "last_answer")


def call_pairs(history: DataFrame, key: str = "conv_id") -> DataFrame:
    """Tool calls with their outputs, by call_id."""
    calls = history.where("type = 'function_call'").select(key, "call_id", F.col("text").alias("call"))
    return calls.join(history.where("type = 'function_call_output'").select(key, "call_id", F.col("text").alias("output")), [key, "call_id"], "left")


def sessions(items: DataFrame, key: str = "conv_id") -> DataFrame:
    """key, n_turns, history, last_answer, calls: conversations whose ``items`` (turn, role, text, type, call_id) hold tool calls too.

    ``history`` has the messages (type null or ``message``); ``calls`` is an array of call_id, call and
    output in the order of the calls, null where no output has come.
    """
    said = conversations(items.where(F.coalesce("type", F.lit("message")) == "message"), key)
    first = items.where("type = 'function_call'").groupBy(key, "call_id").agg(F.min("turn").alias("turn"))
    pair = F.struct("turn", "call_id", "call", "output")
    pairs = call_pairs(items.where("type <> 'message'"), key).join(first, [key, "call_id"]).groupBy(key).agg(F.array_sort(F.collect_list(pair)).alias("p"))
    calls = F.coalesce(F.transform("p", lambda x: F.struct(x["call_id"].alias("call_id"), x["call"].alias("call"), x["output"].alias("output"))), F.array())
    return said.join(pairs, key, "full").select(key, F.coalesce("n_turns", F.lit(0)).alias("n_turns"), F.coalesce("history", F.lit("")).alias("history"), "last_answer", calls.alias("calls"))


def tool_loop(calls: DataFrame, key: str = "conv_id", bound: int = 20) -> DataFrame:
    """Rounds up to the first without a call, ``bound`` at most: key, rounds."""
    ends = F.min(F.when(~F.col("has_call"), F.col("round")))
    return calls.groupBy(key).agg(F.least(F.coalesce(ends, F.max("round")) + 1, F.lit(bound)).alias("rounds"))


def tool_table(calls: DataFrame, toggles: DataFrame | None = None, active_only: bool = False) -> DataFrame:
    """name, call_count, calls_ok, is_active (by the last toggle; active without one), in order of names."""
    out = calls.groupBy("name").agg(F.count(F.lit(1)).alias("call_count"), F.count_if("ok").alias("calls_ok"))
    if toggles is not None:
        last = toggles.groupBy("name").agg(F.max_by("active", "ts").alias("is_active"))
        out = out.join(last, "name", "left")
    else:
        out = out.withColumn("is_active", F.lit(True))
    out = out.withColumn("is_active", F.coalesce("is_active", F.lit(True)))
    return (out.where("is_active") if active_only else out).orderBy("name")


#: What a change of the tool table may ask for: ``register`` makes a tool anew, switched off unless ``active`` is true.
ACTIONS = ("register", "on", "off", "toggle")


def transitions(changes: DataFrame) -> DataFrame:
    """name, seq, change: where a tool really goes on (``activated``) or off (``deactivated``).

    ``changes`` has name, seq (an integer, different for each change of a name), action (one of
    ``ACTIONS``) and active. Asking for a state that a tool has changes nothing, registering one
    anew resets it without a notice, and so do actions on names that were never registered. A state
    is what the last action but a toggle has set, turned round by each toggle since; both are
    found over blocks of ``seq``, so a name's changes needn't meet in one task.
    """
    toggles = F.when(F.col("action") == "toggle", 1).otherwise(0)
    rows = before(changes.where(F.col("action").isin(*ACTIONS)), "name", "seq", toggles, "flips")
    # A setting is kept as it would be without the toggles before it, so that all toggles up to a row apply.
    wanted = F.when(F.col("action") == "on", 1).when(F.col("action") == "off", 0).when(F.col("action") == "register", F.when(F.col("active"), 1).otherwise(0))
    rows = rows.withColumn("setting", F.when(wanted.isNotNull(), F.struct("seq", ((wanted + F.col("flips")) % 2).alias("on"))))
    rows = before(rows, "name", "seq", F.when(F.col("action") == "register", F.col("seq")), "known", fold=F.max, none=F.lit(None).cast("long"))
    rows = before(rows, "name", "seq", F.col("setting"), "last", fold=F.max, none=F.lit(None))
    was = F.coalesce((F.col("last.on") + F.col("flips")) % 2, F.lit(0)) == 1
    now = F.when(F.col("action") == "toggle", ~was).otherwise(wanted == 1)
    news = F.when(F.col("action") == "register", F.when(now, "activated")).when(F.col("known").isNull(), None).when(now & ~was, "activated").when(~now & was, "deactivated")
    return rows.select("name", "seq", news.alias("change")).where("change is not null")
