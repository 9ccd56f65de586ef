"""Best-fit packing of documents into sequences by a grouping genetic algorithm (operator 8).

A chromosome is a grouping: which pieces share a sequence. Crossover takes well-filled sequences
whole from one parent, injects them into the other, drops that one's sequences which hold a piece
twice, and best-fits the displaced pieces. Pieces are dealt by a hash into shards of bounded size;
each shard evolves on several islands, and after each epoch an island's elite moves to the next
island of its shard. Sequences that stay badly filled in their shards are pooled, dealt anew into
as many shards as they need and packed again, until one shard holds what is left or a round saves no
sequence.

Nothing but shards and elites (bounded by ``SHARD_PIECES``) is ever in one task, and the driver
holds counts only.

Defined cases: a null or empty text is one piece that holds the end id only; only documents of
more than ``capacity`` ids are cut, and their full pieces are sequences of their own; ties in fit
go to the fuller sequence; repeated rows are packed each for itself; an empty table gives no
pieces; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import portions, settle, texts, word_memo

SHARD_PIECES = 8192  # pieces that one island holds
ISLANDS, POPULATION, EPOCHS, GENERATIONS = 2, 4, 2, 60
WELL_FILLED = 0.995  # emptier sequences are pooled over all shards
_PIECE = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """Documents as ids plus ``end_id``, cut where longer than ``capacity``; ``row`` is unique once written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        memo, end = word_memo(tokenizer), np.array([end_id], "<u4").tobytes()
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in portions(batch):
                ids, ends = memo.encode(part.column("text"))
                raw, rows = ids.astype("<u4").tobytes(), []
                for doc_id, a, b in zip(part.column("doc_id").to_pylist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                    ids = raw[4 * a : 4 * b] + end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        rows.append((row, doc_id, k, at // 4, len(own) // 4, zlib.crc32(own)))
                        row += 1
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["row", "doc_id", "piece", "start", "length", "ids_crc32"])

    return texts(docs).mapInArrow(run, _PIECE)


class Bins:
    """Sequences under construction, found by free room: bit r of ``rooms`` says that some bin has r ids free."""

    def __init__(self, capacity: int, free: list[int]):
        self.free, self.capacity, self.rooms = free, capacity, 0
        self.by_room: dict[int, list[int]] = {}
        for bin_, room in enumerate(free):
            self.put(bin_, room)

    def put(self, bin_: int, room: int) -> None:
        self.by_room.setdefault(room, []).append(bin_)
        self.rooms |= 1 << room

    def fit(self, length: int) -> int:
        """The bin that ``length`` fits best; a new one if none has the room."""
        larger = self.rooms >> length
        if larger:
            room = length + (larger & -larger).bit_length() - 1
            have = self.by_room[room]
            bin_ = have.pop()
            if not have:
                self.rooms ^= 1 << room
        else:
            room, bin_ = self.capacity, len(self.free)
            self.free.append(room)
        self.free[bin_] = room - length
        self.put(bin_, room - length)
        return bin_


def fitness(length: np.ndarray, group: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer sequences first, then the mean square of their filling."""
    fill = np.bincount(group, length)
    return -len(fill), float(np.mean((fill / capacity) ** 2))


def crossover(length: np.ndarray, giver: np.ndarray, taker: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Inject most of the giver's fuller sequences into the taker; displaced pieces are fitted in a blurred order."""
    fill = np.bincount(giver, length)
    full = np.flatnonzero(fill >= np.quantile(fill, rng.uniform(0.3, 0.8)))
    chosen = np.zeros(len(fill), bool)
    chosen[rng.choice(full, max(1, int(len(full) * rng.uniform(0.5, 1))), replace=False)] = True
    inside = chosen[giver]
    broken = np.zeros(int(taker.max()) + 1, bool)
    broken[taker[inside]] = True
    broken |= np.bincount(taker, length) < capacity * rng.uniform(0.95, 1)  # mutation: poorly filled ones are dealt anew too
    keeps = ~inside & ~broken[taker]
    child = np.full(len(length), -1)
    child[inside] = np.unique(giver[inside], return_inverse=True)[1]
    child[keeps] = np.unique(taker[keeps], return_inverse=True)[1] + int(chosen.sum())
    placed = child >= 0
    bins = Bins(capacity, (capacity - np.bincount(child[placed], length[placed])).astype(int).tolist())
    todo = np.flatnonzero(~placed)
    blurred = length[todo] * rng.uniform(1 - rng.choice([0, 0.1, 0.3, 0.6]), 1, len(todo))
    for i in todo[np.argsort(-blurred, kind="stable")].tolist():
        child[i] = bins.fit(int(length[i]))
    return child


def evolve(length: np.ndarray, groups: list[np.ndarray], capacity: int, seed: int) -> list[np.ndarray]:
    """Some generations over ``groups``; the best ones come first."""
    rng = np.random.default_rng(seed)
    rated = sorted(((fitness(length, g, capacity), k, g) for k, g in enumerate(groups)), reverse=True)[:POPULATION]
    bound = -(-int(length.sum()) // capacity)
    for _ in range(GENERATIONS):
        if -rated[0][0][0] <= bound:
            break  # no packing has fewer sequences
        a, b = rng.permutation(len(rated))[:2] if len(rated) > 1 else (0, 0)
        child = crossover(length, rated[a][2], rated[b][2], capacity, rng)
        rated = sorted([*rated, (fitness(length, child, capacity), rng.integers(1 << 40), child)], key=lambda x: x[:2], reverse=True)[:POPULATION]
    return [g for *_, g in rated]


def first_groups(length: np.ndarray, capacity: int, seed: int) -> list[np.ndarray]:
    """Best fit by falling length, and the same with lengths blurred at random."""
    rng = np.random.default_rng(seed)
    out = []
    for k in range(POPULATION):
        blurred = length * rng.uniform(1 - 0.1 * k, 1, len(length)) if k else length
        bins, group = Bins(capacity, []), np.empty(len(length), np.int64)
        for i in np.argsort(-blurred, kind="stable").tolist():
            group[i] = bins.fit(int(length[i]))
        out.append(group)
        if k == 0 and int(group.max()) + 1 == -(-int(length.sum()) // capacity):
            break
    return out


_STATE = "shard long, island int, rows binary, lengths binary, groups array<binary>, n_bins long"


def _state(shard: int, island: int, rows: bytes, length: np.ndarray, groups: list[np.ndarray]) -> dict:
    return {"shard": shard, "island": island, "rows": rows, "lengths": length.astype("<i4").tobytes(), "groups": [g.astype("<i4").tobytes() for g in groups], "n_bins": int(groups[0].max()) + 1}


def _ints(x: bytes, kind: str = "<i4") -> np.ndarray:
    return np.frombuffer(x, kind).astype(np.int64)


def pack_level(items: DataFrame, shards: int, capacity: int, level: int = 0) -> DataFrame:
    """One round of evolution with migration over ``items`` (row, length): adds sequence_id (its first piece's row), offset, fill."""

    def begin(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "row"], ascending=[False, True])
        length, shard, island = pdf["length"].to_numpy(), int(pdf["shard"].iloc[0]), int(pdf["island"].iloc[0])
        seed = shard * ISLANDS + island
        groups = evolve(length, first_groups(length, capacity, seed), capacity, seed)
        return pd.DataFrame([_state(shard, island, pdf["row"].to_numpy("<i8").tobytes(), length, groups)])

    def migrate(epoch: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for x in pdf.itertuples():
                    length = _ints(x.lengths)
                    groups = evolve(length, [_ints(g) for g in [*x.groups, x.elite]], capacity, (epoch << 32) + x.shard * ISLANDS + x.island)
                    yield pd.DataFrame([_state(x.shard, x.island, x.rows, length, groups)])

        return run

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for x in pdf.itertuples():
                length, group = _ints(x.lengths), _ints(x.best)
                order = np.argsort(group, kind="stable")
                length, row, group = length[order], _ints(x.rows, "<i8")[order], group[order]
                at = np.cumsum(length) - length
                begins = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
                sizes = np.diff(np.r_[begins, len(group)])
                fill = np.add.reduceat(length, begins)
                yield pd.DataFrame({"row": row, "length": length, "sequence_id": np.repeat(row[begins], sizes), "offset": at - np.repeat(at[begins], sizes), "fill": np.repeat(fill, sizes)})

    dealt = items.select("row", "length", F.pmod(F.xxhash64("row", F.lit(level)), F.lit(shards)).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"))
    state = settle(dealt.groupBy("shard", "island").applyInPandas(begin, _STATE), "op8-islands")
    for epoch in range(1, EPOCHS):
        elite = state.select("shard", ((F.col("island") + 1) % ISLANDS).alias("island"), F.col("groups")[0].alias("elite"))
        state = settle(state.join(elite, ["shard", "island"]).mapInPandas(migrate(epoch), _STATE), "op8-islands")
    best = state.groupBy("shard").agg(F.min_by(F.struct("rows", "lengths", F.col("groups")[0].alias("best")), F.struct("n_bins", "island")).alias("b"))
    return best.select("shard", "b.*").mapInPandas(places, "row long, length long, sequence_id long, offset long, fill long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 4096) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every piece and its place."""
    cut = settle(pieces(docs, tokenizer, end_id, capacity), "op8-pieces")
    whole = cut.where(F.col("length") == capacity).select("row", (-F.col("row") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    left, places, level = cut.where(F.col("length") < capacity).select("row", "length"), [whole], 0
    n, held, least = left.count(), None, 0
    while n:
        shards = -(-n // SHARD_PIECES)
        packed = settle(pack_level(left, shards, capacity, level), "op8-level")
        poor, first = F.col("fill") < WELL_FILLED * capacity, F.col("offset") == 0
        made, n, worse = packed.agg(F.count_if(first), F.count_if(poor), F.count_if(poor & first)).first()
        if held is not None and made >= least:  # nothing saved: what is left stays as it was
            places.append(held.select("row", "sequence_id", "offset"))
            break
        places.append((packed if shards == 1 else packed.where(~poor)).select("row", "sequence_id", "offset"))
        if shards == 1:
            break
        held, least, level = packed.where(poor), worse, level + 1
        left = held.select("row", "length")
    out = places[0]
    for x in places[1:]:
        out = out.unionByName(x)
    return cut.join(out, "row").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
