"""Ranked lexical search by inverted treaps (operator 13).

``build`` writes the index: a row for each block of documents, with the block's terms, told byte
for byte, and for each of them the documents (in order of doc_id) and how often it stands there.
``search`` sums N, L and the document frequencies of the items' terms over all blocks. Then each
task goes through its blocks. For each term of an item the block's documents form a treap: a
search tree by document and a heap by impact, made of all lists at once by pointer jumping. One
traversal takes all treaps of an item together. It holds ranges of documents, each with the
topmost node of every term's treap inside the range; their impacts bound the score of any document
in it. A range whose bound is below the item's k-th score so far goes. Of the others, the document
under the heaviest node is scored, and the range falls into those before and after it. Ranges of
many items are handled together in numpy, those with the largest bounds first, and k-th scores
pass on from block to block. Each task keeps k documents an item; Spark cuts again before the
last few meet per item.

Items go to tasks in parts of about ``ITEM_TERMS`` terms, so any number of items works; each part
reads the index again. Scores are whole numbers, as the weights and impacts are.

Defined cases: a null or empty text has no terms; a document without terms counts for nothing and
an item without known terms has no rows; documents without a doc_id count and come last among
equal scores; every row is a document of its own, repeated ones too, and every row of the items is
an item of its own; empty tables give no rows; other columns are ignored. A text is never split
between blocks, so a block has at least one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessel.llm.common import portions, scratch, settle, strings, texts
from tessel.llm.shingles import SMALL, WORD, spans, texts_of

K, BLOCK_BYTES, PIECE_BYTES, BATCH_BYTES = 50, 8 << 20, 1 << 20, 4 << 20
ITEM_TERMS = 50_000  # terms of the items that one pass over the index serves, about
CELLS = 1 << 18  # treap nodes under work at once, about
_LAST = np.iinfo(np.int64).max


def terms_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """All terms of a column of texts: which of the different ones, the bounds of each text, the different ones."""
    raw, offsets = texts_of(column)
    small = SMALL[raw]
    begins, ends = spans(WORD[small], offsets)
    coded = strings(small, begins, ends).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), np.searchsorted(begins, offsets), coded.dictionary


_BLOCK = "n_docs long, n_terms long, terms array<binary>, df array<int>, docs binary, tf binary, ids array<long>, sizes array<int>"


def _block(ids: pa.Array, column: pa.Array) -> pa.RecordBatch:
    """One row: the inverted lists of a block, documents in order of doc_id (null last); lists of numbers are compressed.

    Texts are taken apart in pieces, as the places of all words take many times the memory of the lists.
    """
    named = ids.fill_null(_LAST).to_numpy(zero_copy_only=False)
    order = np.lexsort((named, ids.is_null().to_numpy(zero_copy_only=False)))
    place = np.empty(len(column), np.int64)
    place[order] = np.arange(len(column))
    size, known, number, doc, tf = [], [], [], [], []
    for part in portions(pa.RecordBatch.from_arrays([column], ["text"]), PIECE_BYTES):
        which, bounds, terms = terms_of(part.column("text"))
        own = place[sum(map(len, size)) :][: len(part)]
        cell, count = np.unique(which * len(part) + np.repeat(np.arange(len(part)), np.diff(bounds)), return_counts=True)
        number.append((cell // len(part) + sum(map(len, known))).astype(np.int32))
        doc.append(own[cell % len(part)].astype(np.int32))
        tf.append(count.astype(np.int32))
        size.append(np.diff(bounds))
        known.append(terms)
    coded, size, doc = pa.concat_arrays(known).dictionary_encode(), np.concatenate(size), np.concatenate(doc)
    terms, which, tf = coded.dictionary, coded.indices.to_numpy()[np.concatenate(number)], np.concatenate(tf)
    del number
    by_cell = np.argsort(which.astype(np.int64) * len(column) + doc)
    df = np.bincount(which, minlength=len(terms))
    lists = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
    docs, counts = (pa.array([pa.compress(x[by_cell].tobytes(), "zstd", asbytes=True)], pa.binary()) for x in (doc, tf))
    columns = [pa.array([int((size > 0).sum())]), pa.array([int(size.sum())]), lists(terms), lists(pa.array(df.astype(np.int32))), docs, counts, lists(ids.take(pa.array(order))), lists(pa.array(size[order].astype(np.int32)))]
    return pa.RecordBatch.from_arrays(columns, ["n_docs", "n_terms", "terms", "df", "docs", "tf", "ids", "sizes"])


def _numbers(block: pa.RecordBatch, name: str, n: int) -> np.ndarray:
    """The ``n`` numbers of a compressed list of a block."""
    return np.frombuffer(pa.decompress(block.column(name)[0].as_buffer(), 4 * n, "zstd"), np.int32)


def build(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The index, a row a block of about ``block_bytes`` bytes of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in portions(batch, max(1, block_bytes // 8)):  # so a block has little more than asked for
                held.append(part)
                size += pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
                if size >= block_bytes or sum(map(len, held)) >= 1 << 15:
                    yield joined(held)
                    held, size = [], 0
        if held:
            yield joined(held)

    def joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks()
        return _block(whole.column("doc_id").chunk(0), whole.column("text").chunk(0))

    return texts(docs).mapInArrow(run, _BLOCK)


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs inside sends rows to Python in batches of about ``BATCH_BYTES``, as the JVM and Python each hold a whole one."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    try:
        spark.conf.set(name, BATCH_BYTES)
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class Treaps:
    """Treaps of several lists: node arrays ``doc``, ``impact``, ``left``, ``right`` (-1: none) and the ``root`` of each list."""

    def __init__(self, starts: np.ndarray, doc: np.ndarray, impact: np.ndarray):
        self.doc, self.impact, self.starts, n = doc, impact, starts, len(doc)
        # Heap keys are different within a list: the impact, then a hash of the document, so that equal impacts make no chains.
        key = impact << 24 | (doc * 0x9E3779 + 0x7F4A7C) & 0xFFFFFF
        list_of = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        before = self._greater(key, list_of, -1)
        after = self._greater(key, list_of, 1)
        up = np.where((before >= 0) & ((after < 0) | (key[before] < key[after])), before, after)
        self.left, self.right = np.full(n, -1), np.full(n, -1)
        at = np.arange(n)
        self.right[up[(up >= 0) & (up < at)]] = at[(up >= 0) & (up < at)]
        self.left[up[up > at]] = at[up > at]
        self.root = np.full(len(starts) - 1, -1)
        self.root[list_of[up < 0]] = at[up < 0]

    @staticmethod
    def _greater(key: np.ndarray, list_of: np.ndarray, step: int) -> np.ndarray:
        """The nearest place with a greater key in the same list, in steps of -1 or 1; -1 if there is none.

        What lies between a place and where its pointer leads is smaller, so a pointer may always jump to where that place's own one leads.
        """
        n = len(key)
        to = np.arange(n) + step
        to[(to < 0) | (to >= n)] = -1
        to[(to >= 0) & (list_of[to] != list_of)] = -1
        live = np.flatnonzero(to >= 0)
        while True:
            live = live[key[to[live]] < key[live]]
            if not len(live):
                return to
            to[live] = to[to[live]]
            live = live[to[live] >= 0]

    def within(self, node: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Topmost node below (and with) ``node`` whose document lies from ``low`` to ``high``; -1 if there is none."""
        node, live = node.copy(), np.arange(len(node))
        while True:
            doc = self.doc[node[live]]
            early, late = doc < low[live], doc > high[live]
            off = early | late
            live, early = live[off], early[off]
            if not len(live):
                return node
            node[live] = np.where(early, self.right[node[live]], self.left[node[live]])
            live = live[node[live] >= 0]


class Best:
    """The k best (score, doc) of each item so far, and the score that another one has to reach."""

    def __init__(self, items: int, k: int):
        self.items, self.k, self.least = items, k, np.ones(items, np.int64)
        self.item, self.score, self.unnamed, self.doc = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    def add(self, item: np.ndarray, score: np.ndarray, unnamed: np.ndarray, doc: np.ndarray) -> None:
        some = score >= self.least[item]
        if not some.any():
            return
        item, score = np.append(self.item, item[some]), np.append(self.score, score[some])
        unnamed, doc = np.append(self.unnamed, unnamed[some]), np.append(self.doc, doc[some])
        order = np.lexsort((doc, unnamed, -score, item))
        starts = np.searchsorted(item[order], np.arange(self.items))
        rank = np.arange(len(order)) - starts[item[order]]
        kept = order[rank < self.k]
        last = order[rank == self.k - 1]
        self.least[item[last]] = score[last]
        self.item, self.score, self.unnamed, self.doc = item[kept], score[kept], unnamed[kept], doc[kept]


def _firsts(group: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)


def traverse(treaps: Treaps, item: np.ndarray, slot: np.ndarray, weight: np.ndarray, best: Best, found, keys: np.ndarray, n_docs: int, cells: int = CELLS) -> int:
    """Walk through the treaps of all items: cells (item, slot of a treap, weight), by item.

    ``found(item, score, doc)`` takes scored documents. ``keys`` (slot * n_docs + doc, rising) finds
    a document in a list. Returns how many documents were scored.
    """
    node, low = treaps.root[slot], np.zeros(len(slot), np.int64)
    stack, scored = [(item, item, slot, weight, node, low, low + n_docs - 1)], 0  # number of a range, item, slot, weight, node, the range's ends
    while stack:
        group, item, slot, weight, node, low, high = stack.pop()
        impact = weight * treaps.impact[node]
        first = _firsts(group)
        bound, size = np.add.reduceat(impact, first), np.diff(np.append(first, len(group)))
        good = bound >= best.least[item[first]]
        if not good.all():
            inside = np.repeat(good, size)
            group, item, slot, weight, node, low, high, impact = (x[inside] for x in (group, item, slot, weight, node, low, high, impact))
            first, bound, size = _firsts(group), bound[good], size[good]
        if not len(first):
            continue
        if len(group) > cells and len(first) > 1:  # those with the largest bounds come first
            large = np.zeros(len(first), bool)
            large[np.argsort(-bound, kind="stable")[: len(first) // 2]] = True
            large = np.repeat(large, size)
            for part in (~large, large):
                stack.append(tuple(x[part] for x in (group, item, slot, weight, node, low, high)))
            continue
        heaviest = np.maximum.reduceat(impact, first)
        where = np.flatnonzero(impact == np.repeat(heaviest, size))
        where = where[_firsts(group[where])]
        pivot = treaps.doc[node[where]]
        doc = np.repeat(pivot, size)
        at = np.searchsorted(keys, slot * n_docs + doc)
        at[at == len(keys)] = 0
        there = keys[at] == slot * n_docs + doc
        score = np.add.reduceat(np.where(there, weight * treaps.impact[at], 0), first)
        found(item[first], score, pivot)
        scored += len(first)
        number = np.repeat(np.arange(len(first)), size)
        low, high = np.append(low, doc + 1), np.append(doc - 1, high)
        child = treaps.within(np.tile(node, 2), low, high)
        some = np.flatnonzero(child >= 0)
        if len(some):
            stack.append((np.append(number, number + len(first))[some], *[np.tile(x, 2)[some] for x in (item, slot, weight)], child[some], low[some], high[some]))
    return scored


def _factors(tf: np.ndarray, size: np.ndarray, n: int, total: int) -> np.ndarray:
    """How much an occurrence count weighs in a document of so many terms, among ``n`` documents with ``total`` terms."""
    longest = int(size.max()) if len(size) else 0
    m = 50 + (50 * size * n // total if 50 * longest * n < 1 << 62 else np.array([50 * int(s) * n // total for s in size], np.int64))
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def _numbered(items: DataFrame) -> DataFrame:
    """item (number of the row), item_id, term: the different terms of each item, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch):
                which, bounds, terms = terms_of(part.column("text"))
                of = np.repeat(np.arange(len(part)), np.diff(bounds))
                cell = np.unique(of * max(len(terms), 1) + which)
                rows = pa.array(cell // max(len(terms), 1))
                yield pa.RecordBatch.from_arrays([part.column("item").take(rows), part.column("item_id").take(rows), terms.take(pa.array(cell % max(len(terms), 1)))], ["item", "item_id", "term"])

    rows = items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    return settle(settle(rows, "op13-items").mapInArrow(run, "item long, item_id long, term binary"), "op13-terms")


def frequencies(index: DataFrame, terms: list[bytes]) -> list[int]:
    """In how many documents each of ``terms`` stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, total = pa.array(terms, pa.binary()), np.zeros(len(terms), np.int64)
        for batch in batches:
            at = pc.index_in(batch.column("terms").flatten(), value_set=wanted)
            some = at.is_valid().to_numpy(zero_copy_only=False)
            np.add.at(total, at.drop_null().to_numpy(), batch.column("df").flatten().to_numpy()[some])
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["slot", "df"])

    out = [0] * len(terms)
    for row in index.select("terms", "df").mapInArrow(run, "slot long, df long").groupBy("slot").agg(F.sum("df").alias("df")).collect():  # a row a term of this part
        out[row["slot"]] = row["df"]
    return out


def _searched(index: DataFrame, part: list, n: int, total: int, k: int) -> DataFrame:
    """item, item_id, doc_id, score: the best ``k`` documents of each task for one part of the items (item, item_id, term)."""
    terms = sorted({bytes(r["term"]) for r in part})
    slots = {t: s for s, t in enumerate(terms)}
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * f + 1))) for f in frequencies(index, terms)], np.int64)
    rows = sorted({r["item"] for r in part})
    number = {x: i for i, x in enumerate(rows)}
    names = dict.fromkeys(rows)
    names.update({r["item"]: r["item_id"] for r in part})
    cells = np.array(sorted((number[r["item"]], slots[bytes(r["term"])]) for r in part), np.int64).reshape(-1, 2)
    cells = cells[weights[cells[:, 1]] > 0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, best = pa.array(terms, pa.binary()), Best(len(rows), k)
        for batch in batches:
            for row in range(len(batch)):
                _search_block(batch.slice(row, 1), wanted, cells, weights, n, total, best)
        ids = pa.array(np.array(rows, np.int64)[best.item])
        own = pa.array([names[rows[i]] for i in best.item.tolist()], pa.int64())
        yield pa.RecordBatch.from_arrays([ids, own, pa.array(best.doc, mask=best.unnamed), pa.array(best.score)], ["item", "item_id", "doc_id", "score"])

    return index.select("terms", "df", "docs", "tf", "ids", "sizes").mapInArrow(run, "item long, item_id long, doc_id long, score long")


def _search_block(block: pa.RecordBatch, wanted: pa.Array, cells: np.ndarray, weights: np.ndarray, n: int, total: int, best: Best, limit: int = CELLS) -> int:
    """Search one block of the index for all cells (item, slot) of a part; returns how many documents were scored."""
    at = pc.index_in(block.column("terms").flatten(), value_set=wanted)
    here = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
    if not len(here):
        return 0
    slot_of = at.drop_null().to_numpy().astype(np.int64)
    by_slot = np.argsort(slot_of)
    here, slot_of = here[by_slot], slot_of[by_slot]
    df = block.column("df").flatten().to_numpy().astype(np.int64)
    starts, size = np.cumsum(df) - df, df[here]
    ends = np.cumsum(size)
    pick = np.repeat(starts[here] - (ends - size), size) + np.arange(ends[-1])
    doc, tf = (_numbers(block, name, int(df.sum()))[pick].astype(np.int64) for name in ("docs", "tf"))
    ids, sizes = block.column("ids").flatten(), block.column("sizes").flatten().to_numpy().astype(np.int64)
    unnamed, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(_LAST).to_numpy()
    treaps = Treaps(np.append(0, ends), doc, _factors(tf, sizes[doc], n, total))
    local = np.full(len(wanted), -1)
    local[slot_of] = np.arange(len(slot_of))
    known = local[cells[:, 1]] >= 0
    item, slot = cells[known, 0], local[cells[known, 1]]
    keys = np.repeat(np.arange(len(size)), size) * len(sizes) + doc

    def found(of: np.ndarray, score: np.ndarray, place: np.ndarray) -> None:
        best.add(of, score, unnamed[place], ids[place])

    return traverse(treaps, item, slot, weights[cells[known, 1]], best, found, keys, len(sizes), limit) if len(item) else 0


def search(index: DataFrame, items: DataFrame, k: int = K, item_terms: int = ITEM_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of a written ``index`` for each row of ``items`` (item_id, text)."""
    spark = index.sparkSession
    n, total = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    terms = _numbered(items)
    parts = math.ceil(terms.count() / item_terms) if n else 0
    found = spark.createDataFrame([], "item long, item_id long, doc_id long, score long")
    for p in range(parts):  # parts of the items by a hash, so each is a bounded list
        part = terms.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == p).collect()
        if part:
            with _small_batches(spark):
                found = found.unionByName(settle(_searched(index, part, n, total, k), "op13-found"))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def write_index(docs: DataFrame, path: str, block_bytes: int = BLOCK_BYTES) -> None:
    """``build`` into files at ``path``, each block a row group of its own.

    A block has millions of bytes, and Parquet's writer looks at sizes only after 100 rows. Without
    the bound a task holds all its blocks when it writes, and again when it reads.
    """
    with _small_batches(docs.sparkSession):
        build(docs, block_bytes).write.option("compression", "zstd").option("parquet.block.row.count.limit", 1).parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_BLOCK).parquet(path)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """``search`` over an index of ``docs`` in the shared folder."""
    path = scratch(docs.sparkSession, "op13-index")
    write_index(docs, path)
    return search(read_index(docs.sparkSession, path), items, k)
