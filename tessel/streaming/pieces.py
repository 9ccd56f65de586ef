"""Event streams from growing files: a source of pieces, and payload lines with bounded state."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessel.operators.events import payload_of


@dataclass
class Range(InputPartition):
    """Bytes ``begin`` to ``end`` of a file."""

    path: str
    begin: int
    end: int


class GrowingFiles(DataSource):
    """Stream source ``growing_files``: stream_id (file name), seq, next, piece of files that are appended to; a piece is what lies from byte seq to byte next.

    Options: ``path``, a folder that driver and executors reach (a path, or a URI that pyarrow's
    file systems know), and ``piece_bytes`` (65,536). Offsets are bytes a file, so a restart reads nothing twice. An offset never lies within a UTF-8 character: its first bytes wait until the rest
    is there. Bytes that are no UTF-8 are replaced. Files are expected to grow only.
    """

    @classmethod
    def name(cls) -> str:
        return "growing_files"

    def schema(self) -> str:
        return "stream_id string, seq long, next long, piece string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return GrowingReader(self.options["path"], int(self.options.get("piece_bytes", 65_536)))


def file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def whole(tail: bytes) -> int:
    """How many bytes at the end of ``tail`` (the last four of a text) begin a UTF-8 character that isn't whole."""
    for k in range(1, min(4, len(tail)) + 1):
        byte = tail[-k]
        if byte & 0xC0 != 0x80:  # the first byte of a character, which tells its length
            return k if byte >= 0xC0 and k < (2 if byte < 0xE0 else 3 if byte < 0xF0 else 4) else 0
    return 0


class GrowingReader(DataSourceStreamReader):
    def __init__(self, path: str, size: int):
        if size < 8:
            raise ValueError("a piece needs 8 bytes at least")
        self.path, self.size = path, size

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        from pyarrow import fs

        system, root = file_system(self.path)
        ends = {}
        for info in system.get_file_info(fs.FileSelector(root)):
            if info.type == fs.FileType.File and info.size:
                with system.open_input_file(info.path) as f:
                    ends[info.base_name] = info.size - whole(f.read_at(min(4, info.size), max(0, info.size - 4)))
        return {"files": json.dumps(ends, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        before, after = json.loads(start["files"]), json.loads(end["files"])
        return [Range(name, before.get(name, 0), stop) for name, stop in sorted(after.items()) if stop > before.get(name, 0)]

    def read(self, part: Range) -> Iterator[tuple]:
        """Pieces of whole characters: each begins where the last one ended."""
        system, root = file_system(self.path)
        with system.open_input_file(f"{root.rstrip('/')}/{part.path}") as f:
            at = part.begin
            while at < part.end:
                data = f.read_at(min(self.size, part.end - at), at)
                if not data:
                    return  # the file has become shorter
                if at + len(data) < part.end:
                    data = data[: len(data) - whole(data[-4:])]
                yield part.path, at, at + len(data), data.decode("utf-8", "replace")
                at += len(data)

    def commit(self, end: dict) -> None:
        pass


def growing_files(spark: SparkSession, path: str, piece_bytes: int = 65_536) -> DataFrame:
    """stream_id, seq, next, piece of the files in a folder as a stream; see ``GrowingFiles``."""
    spark.dataSource.register(GrowingFiles)
    return spark.readStream.format("growing_files").option("path", path).option("piece_bytes", str(piece_bytes)).load()


class _Lines(StatefulProcessor):
    """What a stream waits for: the place of its next piece, a cut line, and pieces that came early."""

    def __init__(self, timeout_ms: int, most: int):
        self.timeout_ms, self.most = timeout_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "following long, held string, cut boolean, waits long")
        self.early = handle.getMapState("early", "seq long", "next long, piece string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        following, held, cut, waits = self.place.get() if self.place.exists() else (0, "", False, 0)
        new = {s: (n, p or "") for batch in rows for s, n, p in zip(*(batch[c].tolist() for c in ("seq", "next", "piece")), strict=True) if s >= following}
        for (seq,), early in self.early.iterator() if waits else ():
            new.setdefault(int(seq), early)
        yield self.go_on(key, following, held, cut, waits, new, timerValues)

    def go_on(self, key, following: int, held: str, cut: bool, waits: int, new: dict[int, tuple], timerValues, give_up: bool = False) -> pd.DataFrame:
        out: list[tuple] = []
        while new:
            if following in new:
                following, piece = new.pop(following)
                if cut:  # the rest of a line whose beginning is lost
                    _, end, piece = piece.partition("\n")
                    cut = not end
                *done, held = (held + piece).split("\n")
                out += [("payload", x, None) for x in map(payload_of, done) if x is not None]
            elif give_up or len(new) > self.most:
                after = min(new)
                out.append(("gap", None, after - following))
                following, held, cut, give_up = after, "", True, False
            else:
                break
        for (seq,), _ in list(self.early.iterator()) if waits else ():
            if int(seq) not in new:
                self.early.removeKey((seq,))
        for seq, early in new.items():
            self.early.updateValue((seq,), early)
        if new and not waits:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms)
        self.place.update((following, held, cut, len(new)))
        kinds, payloads, missing = zip(*out, strict=True) if out else ((), (), ())
        return pd.DataFrame({"stream_id": pd.Series([key[0]] * len(out), dtype=object), "kind": pd.Series(kinds, dtype=object), "payload": pd.Series(payloads, dtype=object), "missing": pd.Series(missing, dtype="Int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        following, held, cut, waits = self.place.get() if self.place.exists() else (0, "", False, 0)
        if waits:
            new = {int(seq): tuple(early) for (seq,), early in self.early.iterator()}
            left = self.go_on(key, following, held, cut, waits, new, timerValues, give_up=True)
            if self.place.get()[3]:  # another gap follows: it has its own time
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms)
            yield left

    def close(self) -> None:
        pass


def payloads(pieces: DataFrame, timeout_ms: int = 60_000, most: int = 1000) -> DataFrame:
    """stream_id, kind, payload, missing of pieces (stream_id, seq from 0 on, piece); start it inside ``rocksdb``.

    As ``streaming.payloads``, but with bounded state: a stream waits for a piece that hasn't come
    until ``timeout_ms`` after it first had to, or until more than ``most`` later ones are there.
    Time passes in batches: a run of ``availableNow`` ends only with ``spark.sql.streaming.noDataMicroBatches.enabled`` off.
    Then a row of kind ``gap`` says how many are ``missing``, the line that was cut is lost, and lines
    go on behind the next line end. Pieces that come after that, or again, are passed over.
    A column ``next`` tells which seq follows a piece, as in ``growing_files``; without it that is seq + 1.
    """
    rows = pieces.selectExpr("cast(stream_id as string) AS stream_id", "seq", "next" if "next" in pieces.columns else "seq + 1 AS next", "piece")
    return rows.groupBy("stream_id").transformWithStateInPandas(_Lines(timeout_ms, most), "stream_id string, kind string, payload string, missing long", "Append", "ProcessingTime")
