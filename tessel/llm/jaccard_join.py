"""Self-join of documents by the Jaccard of word n-grams, filtered under several global orders (operator 11).

A document is the set of its different shingles of three blank-separated words. Two sets whose
Jaccard is 90 % or more differ so little that, under any order of all shingles, they share one
among the first tenth (and one more) of each: their prefixes. That holds under every order, so a
candidate has to share a prefix shingle under all of ``ORDERS`` different ones before its sets
are compared. The orders put shingles of crowded slots last (``crowding`` counts all shingles of
all documents in ``SLOTS`` slots) and others by hashes, a different one for each order; so common
lines and passages stand in no prefix unless a text consists of them.

Texts with the same words are one row first. Candidates come from the first order; the prefixes
under the others, cut to 16 bits a shingle, sift them, and so do tallies: how many shingles of a set
fall in each of ``TALLY`` classes. Two sets differ in at least as many shingles as their tallies do,
so tallies that differ too much rule a link out. What passes is compared on the sets themselves
(64-bit names), in whole numbers; so few sets are made and move. To lose no link and yet never to
make all pairs of a large group, this goes in three steps:

1. Each text with one leader for each of its prefix shingles.
2. Each text with the hub of each of its prefix shingles, which has most links so far.
3. Any two texts that are still in different components and share a prefix shingle early enough
   for the rest to suffice. Per shingle only rows outside its commonest component start pairs.

After step 3 every two linked texts are in one component. Prefix shingles meet by their 64-bit names,
as shorter ones would meet by chance in numbers that grow with the square of the corpus.

Defined cases: texts of one or two words have one shingle of them all; a text without words (or a
null) has none and is alone; equal texts of words are linked; repeated rows are documents of their
own, and so are different texts under one doc_id; rows without a doc_id are linked as others are,
and a component of such rows only has no id; an empty table gives no rows; columns other than
doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import discard, likely, made, portions, settle, spread_join, texts, without
from tessel.llm.near_dedup import components, hub_pairs
from tessel.llm.shingles import SOLID, digests, mix, shingles, words

WIDTH, PERCENT, ORDERS, TALLY = 3, 90, 3, 128
SLOTS, CHUNKS = 1 << 22, 256


def _sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Different shingles of a column of texts: number of the text, 64-bit name; by text, then name."""
    return shingles(*words(column, SOLID), width)[:2]


def crowding(docs: DataFrame, width: int = WIDTH) -> np.ndarray:
    """For each slot of shingle names how crowded it is: 0 up to what chance brings together, then a number that grows with the bits of the excess.

    Most shingles are rare, so a slot's count without common ones is nearly the median, within
    some roots of it. Tasks send the counts of all slots, packed, in ``CHUNKS`` parts that are summed one
    by one; the driver gets the sums and keeps a byte a slot.
    """
    size = SLOTS // CHUNKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for part in portions(batch):
                np.add.at(total, _slot(_sets(part.column("text"), width)[1]), 1)
        if total.any():
            yield pa.RecordBatch.from_pydict({"chunk": range(CHUNKS), "counts": [zlib.compress(total[k * size : (k + 1) * size].tobytes(), 1) for k in range(CHUNKS)]})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column("chunk").to_pylist(), batch.column("counts"), strict=True):
                sums[chunk] = sums.get(chunk, 0) + np.frombuffer(zlib.decompress(counts.as_buffer()), np.int64)
        if sums:
            yield pa.RecordBatch.from_pydict({"chunk": list(sums), "counts": [zlib.compress(x.tobytes(), 1) for x in sums.values()]})

    summed = texts(docs).mapInArrow(count, "chunk long, counts binary").repartition(CHUNKS, "chunk").mapInArrow(merge, "chunk long, counts binary")
    total = np.zeros(SLOTS, np.int64)
    for row in summed.toLocalIterator():  # CHUNKS rows of bounded size
        total[row["chunk"] * size : (row["chunk"] + 1) * size] = np.frombuffer(zlib.decompress(row["counts"]), np.int64)
    usual = float(np.median(total))
    spread = usual**0.5 + 1
    return np.frexp(np.maximum(total - usual - 3 * spread, 0) / spread)[1].clip(0).astype(np.uint8)


def _slot(item: np.ndarray) -> np.ndarray:
    return (item >> np.uint64(32)).astype(np.int64) % SLOTS


def prefixes(text: np.ndarray, item: np.ndarray, n_texts: int, crowded: np.ndarray, orders: int = ORDERS, percent: int = PERCENT) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order the names in the prefix of each text, in order; and how many each text has."""
    n = np.bincount(text, minlength=n_texts)
    length = np.where(n > 0, n - (n * percent + 99) // 100 + 1, 0)
    early = np.arange(len(item)) - (np.cumsum(n) - n)[text] < length[text]
    slot, short, out = crowded[_slot(item)].astype(np.uint64) << np.uint64(56), text.astype(np.uint16), []
    for k in range(orders):
        order = np.argsort(slot | mix(item + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(8))
        out.append(item[order[np.argsort(short[order], kind="stable")][early]])
    return out, length


def tallies(text: np.ndarray, item: np.ndarray, n_texts: int) -> np.ndarray:
    """How many shingles of each text fall in each of ``TALLY`` classes, ``TALLY`` numbers a text; 127 stands for more as well."""
    counts = np.bincount(text * TALLY + (item >> np.uint64(20)).astype(np.int64) % TALLY, minlength=n_texts * TALLY)
    return np.minimum(counts, 127).astype(np.int8)


def _lists(sizes: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), values)


def signed(docs: DataFrame, crowded: np.ndarray, width: int = WIDTH, percent: int = PERCENT, orders: int = ORDERS) -> DataFrame:
    """doc_id, digest (of the words), n (different shingles), first (prefix under the first order), others (under the rest, 16 bits each), tally."""
    others = [f"p{k}" for k in range(1, orders)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch):
                column = part.column("text")
                text, item = _sets(column, width)
                (first, *rest), sizes = prefixes(text, item, len(part), crowded, orders, percent)
                lists = [_lists(sizes, pa.array(first.view(np.int64))), *[_lists(sizes, pa.array((x >> np.uint64(48)).astype(np.uint16).view(np.int16))) for x in rest]]
                lists.append(_lists(np.full(len(part), TALLY), pa.array(tallies(text, item, len(part)))))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(digests(column, SOLID), pa.binary()), pa.array(np.bincount(text, minlength=len(part))), *lists], ["doc_id", "digest", "n", "first", *others, "tally"])

    return texts(docs).mapInArrow(run, "doc_id long, digest binary, n long, first array<long>" + "".join(f", {x} array<short>" for x in others) + ", tally array<tinyint>")


def shingle_sets(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """digest (of the words) and items (the different shingles as 64-bit names)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch):
                text, item = _sets(part.column("text"), width)
                items = _lists(np.bincount(text, minlength=len(part)), pa.array(item.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(digests(part.column("text"), SOLID), pa.binary()), items], ["digest", "items"])

    return texts(docs).mapInArrow(run, "digest binary, items array<long>")


def reaches(common: Column, total: Column, percent: int) -> Column:
    """Whether two sets with so many shingles in ``common``, and so many in the ``total`` of their sizes, have that Jaccard."""
    return (100 + percent) * common >= percent * total


def _with_both(pairs: DataFrame, rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """Pairs (a, b) of a written table with ``columns`` of the rows whose ``key`` each end has."""
    count = {end: pairs.groupBy(end).agg(F.count(F.lit(1)).alias("n")) for end in "ab"}
    side = {end: rows.select(F.col(key).alias(end), *[F.col(c).alias(f"{c}_{end}") for c in columns]) for end in "ab"}
    return spread_join(spread_join(pairs, side["b"], "b", "a", count["b"]), side["a"], "a", "b", count["a"])


def _ends(pairs: DataFrame, name: str) -> DataFrame:
    return pairs.select(F.col("a").alias(name)).unionByName(pairs.select(F.col("b").alias(name))).distinct()


def sifted(pairs: DataFrame, once: DataFrame, others: list[str], percent: int = PERCENT) -> DataFrame:
    """Those pairs (a, b) of a written table that share prefix shingles under all the other orders, and whose tallies allow for ``percent``."""
    columns = ["n", *others, "tally"]
    both = _with_both(pairs, likely(once.select("id", *columns), _ends(pairs, "id"), "id"), "id", *columns)
    for c in others:
        both = both.where(F.arrays_overlap(f"{c}_a", f"{c}_b"))
    apart = F.aggregate(F.zip_with("tally_a", "tally_b", lambda x, y: F.abs(x.cast("int") - y)), F.lit(0), lambda x, y: x + y)
    total = F.col("n_a") + F.col("n_b")
    return both.where(reaches(total - apart, 2 * total, percent)).select("a", "b")


def verified(pairs: DataFrame, once: DataFrame, docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Those pairs (a, b) of a written table whose sets have a Jaccard of ``percent`` or more.

    Sets are made of the texts in pairs only, and stay where they are made; of a text that stands
    there more than once one would do, so the pairs found are made distinct.
    """
    members = settle(_ends(pairs, "id").join(once.select("id", "digest", F.col("doc_id")), "id"), "op11-members")
    sets = settle(shingle_sets(likely(texts(docs), members, "doc_id"), width), "op11-sets")
    named = settle(_with_both(pairs, members, "id", "digest").select(F.col("digest_a").alias("a"), F.col("digest_b").alias("b"), F.col("a").alias("id_a"), F.col("b").alias("id_b")), "op11-named")
    whole = _with_both(named, likely(sets, members.select("digest"), "digest"), "digest", "items")
    common = F.size(F.array_intersect("items_a", "items_b"))
    return whole.where(reaches(common, F.size("items_a") + F.size("items_b"), percent)).select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()


def bucketed(entries: DataFrame) -> DataFrame:
    """The rows (key, id, n, at) of prefix shingles that more than one text has, with the first text of each (leader)."""
    leaders = settle(entries.groupBy("key").agg(F.min("id").alias("leader"), F.count(F.lit(1)).alias("rows")).where("rows > 1"), "op11-leaders")
    return spread_join(entries, leaders.drop("rows"), "key", "id", leaders.select("key", F.col("rows").alias("n")))


def cross_pairs(entries: DataFrame, label: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) from different components that share a prefix shingle (key, id, n, at) early enough to reach ``percent``."""
    rows = settle(entries.join(label, "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("component"), (F.col("n") - F.col("at")).alias("rest")), "op11-entries")
    share = rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("k"))
    major = share.groupBy("key").agg(F.max(F.struct("k", "component")).alias("m"), F.count(F.lit(1)).alias("many")).where("many > 1").select("key", F.col("m.component").alias("major"))
    mixed = settle(rows.join(major, "key"), "op11-mixed")
    a = mixed.where("component <> major").select("key", F.col("id").alias("a"), F.col("component").alias("ca"), F.col("n").alias("na"), F.col("rest").alias("ra"))
    b = mixed.select("key", F.col("id").alias("b"), F.col("component").alias("cb"), F.col("n").alias("nb"), F.col("rest").alias("rb"))
    close = (F.col("ca") != F.col("cb")) & reaches(F.least("ra", "rb"), F.col("na") + F.col("nb"), percent) & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return a.join(b, "key").where(close).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def jaccard_join(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, orders: int = ORDERS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), a row a document."""
    spark, threshold = docs.sparkSession, percent / 100
    rows = settle(signed(docs, crowding(docs, width), width, percent, orders).withColumn("id", F.monotonically_increasing_id()), "op11-signed")
    others = [c for c in rows.columns if c not in ("id", "doc_id", "digest", "n", "first", "tally")]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "id")).alias("s")
    reps = rows.where("n > 0").groupBy("digest").agg(first, F.count(F.lit(1)).alias("copies"))
    reps = settle(reps.select("digest", F.col("s.id").alias("id"), F.col("s.doc_id").alias("rep_id"), "copies"), "op11-reps")
    gone = settle(rows.where("n > 0").select("id").join(reps.select("id"), "id", "left_anti"), "op11-gone")
    once = without(rows.where("n > 0"), gone, "id")  # one row of texts with the same words; rows that stay don't move
    begin = made()
    sifts = lambda pairs: settle(sifted(settle(pairs, "op11-pairs"), once, others, percent), "op11-sifted")

    def check(pairs: DataFrame) -> DataFrame:
        mark = made()
        out = settle(verified(pairs, once, docs, width, percent), "op11-linked")
        discard(spark, mark, keep=1)  # the sets have served
        return out

    buckets = settle(bucketed(once.select("id", "n", F.posexplode("first").alias("at", "key"))), "op11-buckets")
    sizes = once.select(F.col("id").alias("a"), F.col("n").alias("na"))
    led = buckets.where("leader <> id").select(F.col("leader").alias("a"), F.col("id").alias("b"), "n").distinct()
    led = sifts(led.join(sizes, "a").where(100 * F.least("n", "na") >= percent * F.greatest("n", "na")).select("a", "b"))
    links = check(led)
    links = links.unionByName(check(sifts(hub_pairs(buckets, links, threshold).join(led, ["a", "b"], "left_anti"))))
    label = components(links.unionByName(check(sifts(cross_pairs(buckets, components(links), percent)))))
    discard(spark, begin, keep=1)
    least = F.min(F.struct(F.col("rep_id").isNull(), "rep_id")).getField("rep_id").alias("component_id")
    classes = label.join(reps.select("id", "rep_id"), "id").groupBy("component").agg(least)
    of = reps.join(spread_join(label, classes, "component", "id"), "id", "left").select("digest", F.coalesce("component_id", "rep_id").alias("component_id"))
    found = spread_join(rows.where("n > 0").select("doc_id", "digest", "n"), of, "digest", "doc_id", reps.select("digest", F.col("copies").alias("n")))
    alone = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(alone)
