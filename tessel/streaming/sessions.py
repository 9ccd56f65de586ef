"""Conversations and tool states as streams with several states a key (start them inside ``rocksdb``)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

HISTORY = "conv_id long, n_turns int, history string, last_answer string, calls array<struct<call_id string, call string, output string>>"


class _Sessions(StatefulProcessor):
    """Messages in a list, calls and outputs in maps by call_id; appending reads nothing of what is there."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.said = handle.getListState("said", "turn long, role string, text string", self.ttl_ms)
        self.calls = handle.getMapState("calls", "call_id string", "turn long, text string", self.ttl_ms)
        self.outputs = handle.getMapState("outputs", "call_id string", "text string", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            batch = batch.astype(object).where(batch.notna(), None)
            said = []
            for turn, role, text, kind, call in batch[["turn", "role", "text", "type", "call_id"]].itertuples(index=False, name=None):
                if kind == "function_call":
                    if not self.calls.containsKey((call,)) or self.calls.getValue((call,))[0] > int(turn):
                        self.calls.updateValue((call,), (int(turn), text))
                elif kind == "function_call_output":
                    self.outputs.updateValue((call,), (text,))
                elif kind in (None, "message"):
                    said.append((int(turn), role, text))
            if said:
                self.said.appendList(said)
        messages = sorted(self.said.get(), key=lambda m: m[0]) if self.said.exists() else []
        calls = sorted((turn, call[0], text) for call, (turn, text) in self.calls.iterator()) if self.calls.exists() else []
        outputs = {call[0]: text[0] for call, text in self.outputs.iterator()} if calls and self.outputs.exists() else {}
        answers = [text for _, role, text in messages if role == "assistant"]
        history = "\n".join(f"{role}: {text or ''}" for _, role, text in messages)
        pairs = [{"call_id": call, "call": text, "output": outputs.get(call)} for _, call, text in calls]
        yield pd.DataFrame({"conv_id": [key[0]], "n_turns": [len(messages)], "history": [history], "last_answer": [answers[-1] if answers else None], "calls": [pairs]})

    def close(self) -> None:
        pass


def sessions(items: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """For each conversation that a micro-batch touches what ``events.sessions`` gives of all its items so far (output mode update).

    ``items`` has conv_id, turn, role, text, type, call_id. State grows with the conversation and
    lasts, unless ``ttl_ms`` lets what is older than that go. A call_id is expected once a
    conversation; of repeated calls the first turn counts, of repeated outputs the last that comes.
    """
    mode = "none" if ttl_ms is None else "ProcessingTime"
    return items.groupBy("conv_id").transformWithStateInPandas(_Sessions(ttl_ms), HISTORY, "Update", mode)


class _Tools(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("tool", "seq long, active boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen, active = self.state.get() if self.state.exists() else (None, None)  # None: never registered
        changes = pd.concat(list(rows)).sort_values("seq")
        out = []
        for seq, action, wanted in changes[["seq", "action", "active"]].itertuples(index=False, name=None):
            if seen is not None and seq <= seen:
                continue
            seen, was = int(seq), active
            if action == "register":
                was, active = False, bool(wanted is True or wanted == 1)
            elif active is not None:
                active = {"on": True, "off": False, "toggle": not active}.get(action, active)
            if active is not None and bool(active) != bool(was):
                out.append((seen, "activated" if active else "deactivated"))
        if seen is not None:
            self.state.update((seen, active))
        yield pd.DataFrame({"name": [key[0]] * len(out), "seq": pd.Series([s for s, _ in out], dtype="int64"), "change": pd.Series([c for _, c in out], dtype=object)})

    def close(self) -> None:
        pass


def transitions(changes: DataFrame) -> DataFrame:
    """name, seq, change as ``events.transitions`` gives them, from changes that come in order of seq (in a batch in any order).

    A tool's state is its last seq and whether it is on; a change that comes again, or too late, is passed over.
    """
    return changes.groupBy("name").transformWithStateInPandas(_Tools(), "name string, seq long, change string", "Append", "none")
