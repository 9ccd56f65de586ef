"""Near-duplicate groups by ProbMinHash (operator 6).

A text is its different shingles of five words, weighted by 1 + ln(count). Each shingle sends
exponential arrivals at a rate of its weight to the registers, in an order of its own without
repeats, and stops as soon as its next arrival is later than all that the text's registers hold;
a register keeps the first arrival. Two texts agree in a register with the probability Jaccard of
their weights. Bands of registers give buckets. Where repeats differ, that may lie far below the
Jaccard of the sets, which links ask for: so a text with repeats also has the bands that its set
gives, at the weight 1 for each different shingle. For others both are the same.

Texts with the same words (BLAKE2b, 256 bits) are one row first, under a number of its own. Links
are found in three steps, all checked on the shingle sets themselves (64-bit names; Jaccard of
``THRESHOLD`` or more), after sets whose sizes rule it out:

1. Every text is compared with one leader of each of its buckets, so pairs grow with the rows.
2. Every text is compared with the hub of each of its buckets, which has most links so far: the
   original of a group of edited copies, say.
3. Among all texts that share buckets, links between different components that the first steps
   could not see are found exactly by prefix filtering: two sets of at least 0.8 share a shingle
   among the rarest fifth of each, early enough for the rest to suffice. Per shingle only rows
   outside its commonest component start pairs.

Buckets, leaders, hubs and words that many rows share are dealt over tasks (``spread_join``).
Components come from label propagation with pointer jumping over tables in the shared folder; no
link, label or fingerprint goes to the driver, which sees counts only. Tables that no later step
reads are removed.

``estimated`` gives what the registers of two texts estimate, the probability Jaccard of their
weights.

Defined cases: texts of one to four words have one shingle of them all; a text without words is
like equal texts only; a null text counts as empty; class_id is the smallest doc_id of a class;
repeated rows are in one class, and different texts under one doc_id are texts of their own; rows
without a doc_id belong to classes as others do, and a class of such rows only has none; an empty
table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import discard, likely, made, named, portions, settle, spare, spread_join, texts, without
from tessel.llm.shingles import digests, mix, shingles, words

WIDTH, THRESHOLD = 5, 0.8
REGISTERS, BANDS, ROWS = 163, 32, 5  # a prime, so that each shingle's steps visit every register


def prob_minhash(text: np.ndarray, item: np.ndarray, weight: np.ndarray, n_texts: int) -> np.ndarray:
    """Registers (n_texts, REGISTERS): the name of the shingle that arrives first; 0 where none does.

    The k-th gap of a shingle is exponential at the rate weight * (REGISTERS - k) / REGISTERS, as
    between sorted arrivals at registers that each have the rate weight / REGISTERS.
    """
    m = REGISTERS
    least, owner = np.full(n_texts * m, np.inf), np.zeros(n_texts * m, np.uint32)
    seed = mix(item)
    name = (mix(seed) >> np.uint64(32)).astype(np.uint32)
    at, step = (seed % np.uint64(m)).astype(np.int64), 1 + (seed >> np.uint64(20)).astype(np.int64) % (m - 1)
    time, live = np.zeros(len(item)), np.arange(len(item))
    for k in range(m):
        if not len(live):
            break
        draw = mix(seed[live] + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64))
        gap = -np.log1p(-((draw >> np.uint64(11)).astype(np.float64) / (1 << 53)))
        time = time + gap * m / ((m - k) * weight[live])
        place = text[live] * m + at[live]
        sooner = np.flatnonzero(time < least[place])
        spot, when = place[sooner], time[sooner]
        np.minimum.at(least, spot, when)
        wins = least[spot] == when
        owner[spot[wins]] = name[live[sooner[wins]]]
        at[live] = (at[live] + step[live]) % m
        stays = time < least.reshape(n_texts, m).max(1)[text[live]]
        live, time = live[stays], time[stays]
    return owner.reshape(n_texts, m)


def bands(registers: np.ndarray) -> np.ndarray:
    """Bucket keys (n, BANDS); a band's number is part of its key."""
    key = np.zeros((len(registers), BANDS), np.uint64) + np.arange(1, BANDS + 1).astype(np.uint64)
    for r in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + registers[:, r : BANDS * ROWS : ROWS])
    return key


def band_keys(text: np.ndarray, item: np.ndarray, count: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Different bucket keys of all texts in order, and how many each has: weighted bands, then those of the bare set."""
    keys = bands(prob_minhash(text, item, 1 + np.log(count), n_texts))
    uneven = np.zeros(n_texts, bool)
    uneven[text[count > 1]] = True
    inside, bare, differs = uneven[text], np.zeros_like(keys), np.zeros(keys.shape, bool)
    bare[uneven] = bands(prob_minhash((np.cumsum(uneven) - 1)[text[inside]], item[inside], np.ones(int(inside.sum())), int(uneven.sum())))
    differs[uneven] = bare[uneven] != keys[uneven]
    some = np.broadcast_to((np.bincount(text, minlength=n_texts) > 0)[:, None], keys.shape)
    chosen = np.concatenate([some, differs], 1)
    return np.concatenate([keys, bare], 1)[chosen], chosen.sum(1)


def _shingled(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return shingles(*words(column), width)


def _lists(sizes: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), values)


def signatures(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, digest (of the words), n (different shingles), keys (buckets; none without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch):
                column = part.column("text")
                text, item, count = _shingled(column, width)
                keys, sizes = band_keys(text, item, count, len(part))
                n = np.bincount(text, minlength=len(part))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(digests(column), pa.binary()), pa.array(n), _lists(sizes, pa.array(keys.view(np.int64)))], ["doc_id", "digest", "n", "keys"])

    return texts(docs).mapInArrow(run, "doc_id long, digest binary, n long, keys array<long>")


def shingle_sets(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """digest (of the words) and items: the different shingles as 64-bit names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch):
                text, item, _ = _shingled(part.column("text"), width)
                items = _lists(np.bincount(text, minlength=len(part)), pa.array(item.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(digests(part.column("text")), pa.binary()), items], ["digest", "items"])

    return texts(docs).mapInArrow(run, "digest binary, items array<long>")


def estimated(docs: DataFrame, pairs: DataFrame, width: int = WIDTH) -> DataFrame:
    """a, b (doc_ids of ``docs``), estimate: the share of registers in which two texts agree, their probability Jaccard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch):
                text, item, count = _shingled(part.column("text"), width)
                got = prob_minhash(text, item, 1 + np.log(count), len(part))
                lists = _lists(np.full(len(part), REGISTERS), pa.array(got.astype(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], ["doc_id", "r"])

    signed = texts(docs).mapInArrow(run, "doc_id long, r array<long>")
    both = pairs.join(signed.select(F.col("doc_id").alias("a"), F.col("r").alias("ra")), "a").join(signed.select(F.col("doc_id").alias("b"), F.col("r").alias("rb")), "b")
    same = F.size(F.filter(F.zip_with("ra", "rb", lambda x, y: (x == y) & (x != 0)), lambda x: x))
    return both.select("a", "b", (same / F.lit(REGISTERS)).alias("estimate"))


def linked(pairs: DataFrame, sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Those pairs (a, b) of a written table whose shingle sets (id, items) have a Jaccard of ``threshold`` or more."""
    count = {end: pairs.groupBy(end).agg(F.count(F.lit(1)).alias("n")) for end in "ab"}
    with_b = spread_join(pairs.select("a", "b"), sets.select(F.col("id").alias("b"), F.col("items").alias("items_b")), "b", "a", count["b"])
    both = spread_join(with_b, sets.select(F.col("id").alias("a"), F.col("items").alias("items_a")), "a", "b", count["a"])
    common, total = F.size(F.array_intersect("items_a", "items_b")), F.size("items_a") + F.size("items_b")
    return both.where(common >= F.lit(threshold) * (total - common)).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """id, component (its smallest id) of every end of a link (a, b)."""
    spark, begin = links.sparkSession, made()
    both = settle(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "op6-links")
    labels = settle(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("component")), "op6-labels")
    while True:
        heard = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("heard"))
        near = labels.join(heard, labels["id"] == heard["a"]).select("id", "component", F.least("component", "heard").alias("next"))
        far = labels.select(F.col("id").alias("next"), F.col("component").alias("jump"))
        after = settle(near.join(far, "next").select("id", F.least("next", "jump").alias("component"), (F.least("next", "jump") != F.col("component")).alias("moved")), "op6-labels")
        labels = after.select("id", "component")
        if after.where("moved").isEmpty():
            discard(spark, begin, keep=1)
            return labels
        discard(spark, begin + 1, keep=1)


def _close(n: str, m: str, threshold: float) -> F.Column:
    """Whether the sizes of two sets allow for a Jaccard of ``threshold``."""
    return F.least(n, m) >= F.lit(threshold) * F.greatest(n, m) - F.lit(1e-9)


def bucketed(keyed: DataFrame) -> DataFrame:
    """The rows (key, id, n) of buckets with more than one, with the leader of each bucket and its n (leader, leader_n)."""
    first = F.min(F.struct(F.xxhash64("id"), "id", "n")).alias("first")
    leaders = settle(keyed.groupBy("key").agg(first, F.count(F.lit(1)).alias("rows")).where("rows > 1").select("key", F.col("first.id").alias("leader"), F.col("first.n").alias("leader_n"), "rows"), "op6-leaders")
    return spread_join(keyed, leaders.drop("rows"), "key", "id", leaders.select("key", F.col("rows").alias("n")))


def hub_pairs(buckets: DataFrame, links: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (a, b) of each row with the most linked row of its bucket."""
    ends = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id")))
    degree = ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    hubs = buckets.join(degree, "id").groupBy("key").agg(F.max(F.struct("degree", "id", "n")).alias("h")).select("key", F.col("h.id").alias("a"), F.col("h.n").alias("hub_n"))
    return spread_join(buckets.select("key", "id", "n"), hubs, "key", "id").where("a <> id").where(_close("n", "hub_n", threshold)).select("a", F.col("id").alias("b")).distinct()


def prefix_pairs(sets: DataFrame, label: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """All pairs (a, b) from different components that could reach ``threshold``.

    Shingles stand in order of rarity. The first one that two sets share lies in both prefixes, and
    what follows it in either must be long enough for the overlap that the threshold asks for.
    """
    rows = sets.join(label, "id", "left").select("id", F.coalesce("component", "id").alias("component"), F.size("items").alias("n"), F.explode("items").alias("item"))
    often = rows.groupBy("item").agg(F.count(F.lit(1)).alias("often"))
    ranked = rows.join(often, "item").groupBy("id", "component", "n").agg(F.array_sort(F.collect_list(F.struct("often", "item"))).alias("items"))
    length = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - F.lit(1e-9)) + 1
    prefix = ranked.select("id", "component", "n", F.posexplode(F.slice("items", F.lit(1), length.cast("int"))).alias("at", "p")).where("p.often > 1")
    prefix = settle(prefix.select("id", "component", "n", (F.col("n") - F.col("at")).alias("rest"), "p.item"), "op6-prefix")
    share = prefix.groupBy("item", "component").agg(F.count(F.lit(1)).alias("k"))
    major = share.groupBy("item").agg(F.max(F.struct("k", "component")).alias("m"), F.count(F.lit(1)).alias("many")).where("many > 1").select("item", F.col("m.component").alias("major"))
    mixed = settle(prefix.join(major, "item"), "op6-mixed")
    a = mixed.where("component <> major").select("item", F.col("id").alias("a"), F.col("component").alias("ca"), F.col("n").alias("na"), F.col("rest").alias("ra"))
    b = mixed.select("item", F.col("id").alias("b"), F.col("component").alias("cb"), F.col("n").alias("nb"), F.col("rest").alias("rb"))
    close = (F.col("ca") != F.col("cb")) & (F.least("ra", "rb") >= F.lit(threshold / (1 + threshold)) * (F.col("na") + F.col("nb")) - 1e-9)
    return a.join(b, "item").where(close).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, rep_id (smallest doc_id with the same words), class_id, a row a document."""
    signed = settle(signatures(docs, width), "op6-signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "n", "keys")).alias("s")
    once = signed.groupBy("digest").agg(first, F.count(F.lit(1)).alias("copies"))
    once = settle(once.select("digest", F.monotonically_increasing_id().alias("id"), F.col("s.doc_id").alias("rep_id"), "s.n", "s.keys", "copies"), "op6-once")
    begin = made()
    buckets = settle(bucketed(once.select("id", "n", F.explode("keys").alias("key"))), "op6-buckets")
    members = settle(once.join(buckets.select("id").distinct(), "id", "left_semi").select("id", "digest", F.col("rep_id").alias("doc_id")), "op6-members")
    some = shingle_sets(likely(texts(docs), members, "doc_id"), width).groupBy("digest").agg(F.first("items").alias("items"))
    sets = settle(some.join(members.select("digest", "id"), "digest").select("id", "items"), "op6-sets")
    led = settle(buckets.where("leader <> id").where(_close("n", "leader_n", threshold)).select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct(), "op6-pairs")
    links = settle(linked(led, sets, threshold), "op6-linked")
    hubs = settle(hub_pairs(buckets, links, threshold).join(led, ["a", "b"], "left_anti"), "op6-pairs")
    links = links.unionByName(settle(linked(hubs, sets, threshold), "op6-linked"))
    label = components(links)
    more = linked(settle(prefix_pairs(sets, label, threshold), "op6-pairs"), sets, threshold)
    label = components(links.unionByName(more))
    discard(docs.sparkSession, begin, keep=1)
    least = F.min(F.struct(F.col("rep_id").isNull(), "rep_id")).getField("rep_id").alias("class_id")
    classes = label.join(once.select("id", "rep_id"), "id").groupBy("component").agg(least)
    of = once.join(spread_join(label, classes, "component", "id"), "id", "left").select("digest", "rep_id", F.coalesce("class_id", "rep_id").alias("class_id"))
    return spread_join(signed.select("doc_id", "digest"), of, "digest", "doc_id", once.select("digest", F.col("copies").alias("n"))).select("doc_id", "rep_id", "class_id")


def deduplicate(docs: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each class: the smallest doc_id's (none comes last), then the first written; all columns as they are."""
    row = spare(docs.columns, "_row")
    numbered = settle(docs.withColumn(row, F.monotonically_increasing_id()), "op6-docs")
    classes = near_duplicates(numbered.select(F.col(row).alias("doc_id"), "text"), width, threshold).select(F.col("doc_id").alias(row), "class_id")
    ids = numbered.select(row, F.col("doc_id").alias("own"))
    known = settle(classes.join(ids, row), "op6-classes")
    first = F.min(F.struct(F.col("own").isNull().alias("unnamed"), "own", F.col(row).alias("row"))).alias("first")
    stays = known.groupBy("class_id").agg(first).select(F.col("first.row").alias(row))
    goes = settle(known.select(row).join(stays, row, "left_anti"), "op6-goes")
    return without(numbered, goes, row).select(*named(docs.columns))
