"""Byte-level BPE as recursive DuckDB queries inside each partition (operator 10).

Texts are split by the vocabulary's pattern. The different words of a portion of documents that
this worker has not met yet become rows (place, token) of a DuckDB table; a recursive query
joins neighbouring tokens with the merge table, contracts in every word its leftmost pair of
minimum rank, and ends when no word has a pair that merges. One contraction a round would take a
word of over ``LONG`` bytes as many rounds as it has bytes. So such words fall into parts wherever
no merge can ever cross, each of which contracts its own pair of minimum rank, and in the same round
all pairs that nothing can forestall (see ``ENCODE_LONG``); the ids are the same. Decoding joins the
ids of whole documents with the vocabulary and puts the bytes together with an ordered aggregate.

Each Python worker has a DuckDB of its own with one thread and a memory limit; nothing is
shuffled. Should a query spill, it does so in a folder of the executor's, which goes with it.

Defined cases: a null text counts as empty and has no ids; a word of any length is one more word
to the query; equal texts have equal ids; an empty table gives no rows; columns other than doc_id
and text are ignored; repeated rows stay.
"""

from __future__ import annotations

import atexit
import base64
import os
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessel.llm.common import portions, texts

BYTES_A_QUERY, WORDS_KEPT, LONG = 1 << 20, 250_000, 64

#: place is 128 times the word's number plus where the token begins, so places only thin out and
#: one order serves all words. A word takes part while a pair of it merges.
ENCODE = """
WITH RECURSIVE step AS (
    SELECT place, token, true AS live FROM start
  UNION ALL
    SELECT place, token, live FROM (
        WITH pair AS (
            SELECT place, token, lead(place) OVER w AS after, lead(token) OVER w AS other, lag(place) OVER w AS before
            FROM step WHERE live WINDOW w AS (ORDER BY place)
        ), ranked AS (
            SELECT place, token, before, rank FROM pair LEFT JOIN merges ON a = token AND b = other AND after >> 7 = place >> 7
        ), chosen AS (
            SELECT place >> 7 AS word, min(rank::BIGINT * 128 + (place & 127)) AS best FROM ranked WHERE rank IS NOT NULL GROUP BY 1
        )
        SELECT place, CASE WHEN place & 127 = best & 127 THEN (best >> 7)::INTEGER ELSE token END AS token, best IS NOT NULL AS live
        FROM ranked LEFT JOIN chosen ON word = place >> 7
        WHERE best IS NULL OR before IS NULL OR before <> ((place >> 7) << 7 | (best & 127))
    )
)
SELECT place >> 7 AS word, token FROM step WHERE NOT live ORDER BY place
"""

#: Neighbours of a token only grow, and go on to begin or end with what now touches it. So where no
#: merge has a left side that ends with one token and a right side that begins with the next
#: (``meets``), a part ends for good. A pair whose rank is below all merges that could ever take
#: one of its tokens away, or take the new token up, from the left (``lefts``) or right (``rights``)
#: contracts as it is whenever its turn comes: it may do so now. Of the part's minimum rank all places
#: contract where the new token has no earlier merge; where they overlap, every second one of a run.
#: part is the place where it begins.
ENCODE_LONG = """
WITH RECURSIVE step AS (
    SELECT place, token, place >> 32 << 32 AS part, true AS live FROM start
  UNION ALL
    SELECT place, token, part, live FROM (
        WITH near AS (
            SELECT place, token, part, row_number() OVER w AS n, lag(part) OVER w AS p0, lag(token) OVER w AS t0,
                lead(part) OVER w AS p2, lead(place) OVER w AS after, lead(token) OVER w AS t2, lead(part, 2) OVER w AS p3, lead(token, 2) OVER w AS t3
            FROM step WHERE live WINDOW w AS (ORDER BY place)
        ), cut AS (
            SELECT near.*, max(CASE WHEN a IS NULL THEN place END) OVER (ORDER BY place ROWS UNBOUNDED PRECEDING) AS own
            FROM near LEFT JOIN meets ON a = t0 AND b = token AND p0 = part
        ), pair AS (
            SELECT place, own, n, token, t2, after, rank, hazard, CASE WHEN p0 = part THEN t0 END AS t0, CASE WHEN p3 = part THEN t3 END AS t3
            FROM cut JOIN merges ON a = token AND b = t2 AND p2 = part
        ), best AS (
            SELECT own, min(rank::BIGINT << 32 | (place & 4294967295)) AS best FROM pair GROUP BY own
        ), fit AS (
            SELECT place, n, n - row_number() OVER (ORDER BY n) AS run
            FROM pair JOIN best USING (own) WHERE rank = best >> 32 AND (NOT hazard OR place & 4294967295 = best & 4294967295)
        ), chosen AS (
            SELECT place FROM (SELECT place, row_number() OVER (PARTITION BY run ORDER BY n) AS nth FROM fit) WHERE nth % 2 = 1
          UNION
            SELECT place FROM pair LEFT JOIN lefts l ON l.a = t0 AND l.b = token LEFT JOIN lefts m ON m.a = t0 AND m.b = rank
                LEFT JOIN rights r ON r.a = t2 AND r.b = t3 LEFT JOIN rights s ON s.a = rank AND s.b = t3
            WHERE rank < coalesce(least(l.least, m.least, r.least, s.least), 2147483647)
        ), joined AS (
            SELECT place, rank, after FROM pair SEMI JOIN chosen USING (place)
        )
        SELECT cut.place, coalesce(rank, token) AS token, own AS part, best IS NOT NULL AS live
        FROM cut LEFT JOIN best USING (own) LEFT JOIN joined ON joined.place = cut.place ANTI JOIN (SELECT after FROM joined) gone ON gone.after = cut.place
    )
)
SELECT place >> 32 AS word, token FROM step WHERE NOT live ORDER BY place
"""

#: What a merge's left side may end with, and its right side begin with; the least rank by either.
REACH = """
CREATE TABLE tail AS SELECT v.token AS whole, s.token AS part FROM (SELECT token, hex, unnest(range(2, length(hex) + 1, 2)) AS k FROM vocabulary) v JOIN vocabulary s ON s.hex = right(v.hex, k);
CREATE TABLE head AS SELECT v.token AS whole, s.token AS part FROM (SELECT token, hex, unnest(range(2, length(hex) + 1, 2)) AS k FROM vocabulary) v JOIN vocabulary s ON s.hex = left(v.hex, k);
CREATE TABLE lefts AS SELECT part AS a, b, min(rank) AS least FROM merges JOIN tail ON whole = a GROUP BY ALL;
CREATE TABLE rights AS SELECT a, part AS b, min(rank) AS least FROM merges JOIN head ON whole = b GROUP BY ALL;
CREATE TABLE meets AS SELECT DISTINCT lefts.a, head.part AS b FROM (SELECT DISTINCT tail.part AS a, b FROM merges JOIN tail ON whole = a) lefts JOIN head ON head.whole = lefts.b;
DROP TABLE tail;
DROP TABLE head
"""

#: Bytes are hexadecimal text inside, as DuckDB aggregates text in order but not blobs.
DECODE = """
SELECT doc, unhex(string_agg(hex, '' ORDER BY pos)) AS bytes FROM ids JOIN vocabulary USING (token) GROUP BY doc
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file (base64 and number a line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class ByteBpe:
    """DuckDB with the merge table and the vocabulary, and a memo of words already contracted."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        ranks = read_ranks(path)
        self.known: dict[str, bytes] = {}
        self.find = regex.compile(pattern).findall
        self.old: dict[str, bytes] = {}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(ranks[k[:i]], ranks[k[i:]], r) for k, r in ranks.items() for i in range(1, len(k)) if k[:i] in ranks and k[i:] in ranks]
        own = os.environ.get("SPARK_LOCAL_DIRS", tempfile.gettempdir()).split(",")[0]  # Spark removes it with the executor
        spill = os.path.join(own, f"bpe-{os.getpid()}-{id(self)}")
        atexit.register(shutil.rmtree, spill, ignore_errors=True)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "250MB", "temp_directory": spill})
        a, b, rank = np.array(pairs, np.int32).T
        hazard = np.zeros(rank.max() + 1, bool)
        hazard[a[rank < a]] = hazard[b[rank < b]] = True  # with a neighbour, such a token makes an earlier one
        self.fill("merges", {"a": a, "b": b, "rank": rank, "hazard": hazard[rank]})
        self.fill("vocabulary", {"token": np.array([*ranks.values()], np.int32), "hex": [k.hex() for k in ranks]})
        for name in ("merges", "vocabulary"):
            self.db.sql(f"CREATE TABLE {name}_ AS SELECT * FROM {name}")
            self.db.unregister(name)
            self.db.sql(f"ALTER TABLE {name}_ RENAME TO {name}")
        self.ready = False

    def fill(self, name: str, columns: dict) -> None:
        self.db.register(name, pa.table(columns))

    def contract(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word, by one recursive query."""
        size = np.array([*map(len, words)])
        word = np.repeat(np.arange(len(words)), size)
        pos = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
        long = size.max() > LONG
        if long and not self.ready:
            self.db.execute(REACH)
            self.ready = True
        self.fill("start", {"place": word << (32 if long else 7) | pos, "token": self.single[np.frombuffer(b"".join(words), np.uint8)]})
        got = self.db.sql(ENCODE_LONG if long else ENCODE).fetchnumpy()
        return np.split(got["token"].astype("<u4"), np.flatnonzero(np.diff(got["word"])) + 1)

    def encode(self, batch: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        split = [self.find(x) for x in batch]
        if len(self.known) > WORDS_KEPT:  # the younger generation becomes the older
            self.known, self.old = {}, self.known
        todo = set().union(*split).difference(self.known)
        met = self.old.keys() & todo
        self.known.update(zip(met, map(self.old.__getitem__, met), strict=True))
        todo = [w.encode() for w in todo - met]
        short = sum(len(w) <= LONG for w in todo)
        todo.sort(key=len)
        for part in [*_portions(todo[:short]), *_portions(todo[short:])]:
            for word, ids in zip(part, self.contract(part), strict=True):
                self.known[word.decode()] = ids.tobytes()
        return [b"".join(map(self.known.__getitem__, words)) for words in split]

    def decode(self, batch: list[bytes]) -> list[bytes]:
        """The bytes that ids stand for, by one ordered aggregation."""
        size = np.array([len(x) // 4 for x in batch])
        self.fill("ids", {"doc": np.repeat(np.arange(len(batch)), size), "pos": np.arange(size.sum()), "token": np.frombuffer(b"".join(batch), "<i4")})
        got = dict(self.db.sql(DECODE).fetchall())
        return [got.get(k, b"") for k in range(len(batch))]


def _portions(words: list[bytes]) -> Iterator[list[bytes]]:
    part, held = [], 0
    for word in words:
        part.append(word)
        held += len(word)
        if held >= BYTES_A_QUERY:
            yield part
            part, held = [], 0
    if part:
        yield part


_coders: dict[tuple[str, str], ByteBpe] = {}


def coder(path: str, pattern: str) -> ByteBpe:
    """The coder of this Python worker; it lives as long as the worker does."""
    if (path, pattern) not in _coders:
        _coders[path, pattern] = ByteBpe(path, pattern)
    return _coders[path, pattern]


def encode_bytes(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (binary, little-endian unsigned 32-bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for batch in batches:
            for part in portions(batch, 2 << 20):
                ids = bpe.encode(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return texts(docs).mapInArrow(run, "doc_id long, ids binary")


def decode_bytes(ids: DataFrame, path: str, pattern: str) -> DataFrame:
    """Adds ``decoded`` (binary) to doc_id and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for batch in batches:
            for part in portions(batch.rename_columns(["doc_id", "text"]), 2 << 20):
                own = part.column("text")
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), own, pa.array(bpe.decode(own.to_pylist()), pa.binary())], ["doc_id", "ids", "decoded"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")
