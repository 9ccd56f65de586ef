"""Token-ID output: frequency-ranked ids in byte-aligned variable-length coding (operator 9).

Ids are replaced by their rank of frequency in the corpus, so that frequent ones take one byte. A
rank takes 1 to 4 little-endian bytes; the four 2-bit lengths of four ranks make one control byte,
and control bytes lie in a column of their own, apart from the data bytes. Readers look lengths
up in a 256-row table and gather whole blocks with numpy.

Files: ``<path>/ids`` is Parquet, in ascending doc_id order from part to part and row to row. A
row is a block of whole documents: shard, shard_start (ids before it in its shard), n_ids, doc_ids
and lengths (arrays, one item a document), control, data. ``<path>/ranks`` has the id of each rank.

Defined cases: a null text counts as empty and holds the end id only; a document of any length
stays whole within its block; equal texts have equal ids; an empty table gives files without rows;
columns other than doc_id and text are ignored; rows that share a doc_id all stay, in any order
among them; a null doc_id comes first.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessel.llm.common import portions, settle, texts, word_memo

BLOCK_IDS = 1 << 16  # a block closes when it has this many ids
BLOCK = "shard long, shard_start long, n_ids long, doc_ids array<long>, lengths array<long>, control binary, data binary"
_BYTES = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)
_KEEP = np.array([0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values."""
    values = np.ascontiguousarray(values, "<u4")
    length = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    quads = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    quads[: len(values)] = length - 1
    control = (quads.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    used = np.arange(4, dtype=np.uint8) < length[:, None]
    return control.tobytes(), values.view(np.uint8).reshape(-1, 4)[used].tobytes()


def unpack(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The ``count`` values that ``pack`` wrote."""
    length = _BYTES[np.frombuffer(control, np.uint8)].ravel()[:count]
    at = np.cumsum(length, dtype=np.int64) - length
    raw = np.zeros(len(data) + 4, np.uint8)
    raw[: len(data)] = np.frombuffer(data, np.uint8)
    out = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(length > k)
        if not len(more):
            break
        out[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def encode_ids(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id and ids (binary, little-endian; 16 bits each where all ids fit, else 32)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = word_memo(tokenizer)
        kind = id_type(memo.tokenizer.get_vocab_size(), end_id)
        for batch in batches:
            for part in portions(batch):
                ids, ends = memo.encode(part.column("text"))
                raw = np.insert(ids.astype(kind), ends, end_id).tobytes()
                at = np.append(0, (ends + np.arange(1, len(ends) + 1)) * np.dtype(kind).itemsize).tolist()
                ids = [raw[a:b] for a, b in pairwise(at)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return texts(docs).mapInArrow(run, "doc_id long, ids binary")


def id_type(vocabulary: int, end_id: int) -> str:
    return "<u2" if max(vocabulary, end_id + 1) <= 1 << 16 else "<u4"


def rank_table(ids: DataFrame, kind: str, room: int) -> list[int]:
    """All ids below ``room`` by falling frequency, then id. ``room`` (the vocabulary) bounds it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(room, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                ids = b"".join(batch.column("ids").slice(at, 1000).to_pylist())
                seen += np.bincount(np.frombuffer(ids, kind), minlength=room)
        there = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(seen[there])], ["id", "n"])

    counts = ids.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    found = [r["id"] for r in counts.orderBy(F.desc("n"), "id").collect()]
    return found + sorted(set(range(room)) - set(found))


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Encode ``docs`` and write the two tables described above under ``path``."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    room = max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1)
    kind = id_type(room, end_id)
    ids = settle(encode_ids(docs, tokenizer, end_id), "op9-ids")
    ranks = np.array(rank_table(ids, kind, room), np.int64)
    spark.createDataFrame(pa.table({"rank": np.arange(room), "id": ranks})).coalesce(1).write.parquet(f"{path}/ranks")
    rank_of = np.empty(room, np.uint32)
    rank_of[ranks] = np.arange(room, dtype=np.uint32)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, start = TaskContext.get().partitionId(), 0
        many = pa.list_(pa.int64())
        names = ["shard", "shard_start", "n_ids", "doc_ids", "lengths", "control", "data"]
        kinds = pa.schema([*zip(names, [pa.int64()] * 3 + [many] * 2 + [pa.binary()] * 2, strict=True)])
        doc_ids: list[int] = []
        parts: list[np.ndarray] = []
        held = 0

        def close() -> pa.RecordBatch:
            values = rank_of[np.concatenate(parts)]
            control, data = pack(values)
            row = [shard, start, held, doc_ids, [*map(len, parts)], control, data]
            return pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True))], kinds)

        for batch in batches:
            for doc_id, x in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                doc_ids.append(doc_id)
                parts.append(np.frombuffer(x.as_buffer(), kind))
                held += len(parts[-1])
                if held >= BLOCK_IDS:
                    yield close()
                    start, doc_ids, parts, held = start + held, [], [], 0
        if parts:
            yield close()

    dealt = ids.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id").sortWithinPartitions("doc_id")
    dealt.mapInArrow(blocks, BLOCK).write.option("compression", "zstd").parquet(f"{path}/ids")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids (binary, 32 bits each) from the files."""
    ids_of = spark.read.parquet(f"{path}/ranks").orderBy("rank").toPandas()["id"].to_numpy("<u4")  # the vocabulary bounds it

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths = np.array(row["lengths"], np.int64)
                ends = np.cumsum(lengths)
                ids = ids_of[unpack(row["control"], row["data"], row["n_ids"])]
                out = [ids[e - n : e].tobytes() for e, n in zip(ends, lengths, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(np.full(len(ends), row["shard"])), pa.array(ends - lengths + row["shard_start"]), pa.array(out, pa.binary())],
                    ["doc_id", "shard", "within", "ids"],
                )

    files = spark.read.schema(BLOCK).parquet(f"{path}/ids")
    # A row per shard: as many as the writer had partitions, so a window over all of them is small.
    size = files.groupBy("shard").agg(F.max(F.col("shard_start") + F.col("n_ids")).alias("n"))
    before = size.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    rows = files.mapInArrow(decode, "doc_id long, shard long, within long, ids binary")
    return rows.join(F.broadcast(before), "shard").select("doc_id", (F.col("before") + F.col("within")).alias("start"), "ids")
