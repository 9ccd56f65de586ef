"""Exact deduplication as a stream with disk-backed state (operator 5).

Texts are equal when they are after deleting blanks. A stream of documents keeps, in RocksDB and
without expiry, one state row for each SHA-256 of such a text: the stable identifier of the row
that stays, a locator of its content (its file), and how many rows have come. Spark sums in each
task before rows move, so a digest that a third of all rows share costs no more than others. Each
micro-batch appends the state rows that it changed to a table in the shared folder, under its
number, so that a batch which runs twice leaves the same files.

A digest that has come more than once is a hit: before any row is dropped, the full text of each of
its new rows is compared with the one that the state's locator and identifier lead to. Hits with a large share of all rows (1,000 at most, as each has a thousandth of the rows)
go to every task, which sums equal bytes before they move; others are joined by digest, and rows
in no slot of a hit don't take part. Should different texts share a digest, each text is a group of its own.

With a ``work`` folder of the caller's all this lasts: checkpoint, state (one snapshot; older ones
and the batches in it are removed) and a ledger of rows (doc_id, size, digests, file, and the text of likely
hits). A later run, over the same folder or another one, streams and reads the files that are new
to the ledger, and of earlier files only those that hold the located text of a new hit whose text
the ledger hasn't kept. Groups are over all rows ever seen, rows of the report those at ``path``.
Where a located file is gone, its text can't be compared any more, and SHA-256 alone decides.

Defined cases: a null text counts as empty, and so equals a text of blanks only; of equal texts
the one with most code points stays, then the smallest doc_id; rows with the doc_id that stays and
an equal text are all marked as kept in the report, and ``deduplicate`` leaves one of them, with
most code points, then as first written (so do rows without a doc_id, if one of them stays); an empty table gives no rows; columns other than doc_id and text are ignored by the report.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm.common import SLOTS, likely, named, scratch, settle, spare, spread_join, without

BLANKS = "[\\x20\\x09-\\x0D]+"
HOT_SHARE = 1000  # a digest is hot with one in so many rows; so there are no more hot ones than that

_STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each partition's store reserves megabytes
}


def digests(docs: DataFrame, bits: int = 256, *more: F.Column) -> DataFrame:
    """doc_id, digest, n_points, content (without blanks) and what ``more`` adds. Fewer ``bits`` are for tests."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(text).cast("long").alias("n_points"), F.regexp_replace(text, BLANKS, "").alias("content"), *more)
    return rows.withColumn("digest", F.left(F.sha2("content", 256), F.lit(bits // 4)))


def groups(rows: DataFrame, *by: str) -> DataFrame:
    """For each group its size and the row that stays."""
    best = F.max(F.struct("n_points", F.bitwise_not("doc_id").alias("first"), "locator")).alias("best")
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("group_size"), best)


def _named(found: DataFrame, *by: str) -> DataFrame:
    return found.select(*by, "group_size", F.bitwise_not("best.first").alias("keep_id"), F.col("best.locator").alias("locator"))


def watch(spark: SparkSession, path: str, table: str, checkpoint: str, bits: int = 256, files_a_batch: int = 1000) -> None:
    """Run the stream over the Parquet files at ``path`` that are new to ``checkpoint``; append to ``table``."""
    path = path.rstrip("/")
    pattern = f"{path[:-1]}[{path[-1]}]"  # a stream takes a single file only as a match of a pattern
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_a_batch).parquet(pattern)
    seen = groups(digests(stream, bits, stream.metadataColumn("_metadata").getField("file_path").alias("locator")), "digest")

    def append(changed: DataFrame, batch: int) -> None:
        _named(changed, "digest").write.mode("overwrite").option("compression", "zstd").parquet(f"{table}/batch={batch}")

    before = {k: spark.conf.get(k, None) for k in _STATE_CONF}
    try:
        for k, v in _STATE_CONF.items():
            spark.conf.set(k, v)
        query = seen.writeStream.outputMode("update").foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()


_STATE = "digest string, group_size long, keep_id long, locator string"
_LEDGER = "doc_id long, n_points long, digest string, text_sha256 string, locator string"


def _numbers(spark: SparkSession, path: str, name: str) -> list[int]:
    """The numbers of whole tables ``<name>=<number>`` below a path."""
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = top.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in system.listStatus(top)] if system.exists(top) else []
    whole = [n for n in names if n.startswith(f"{name}=") and system.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return sorted(int(n.partition("=")[2]) for n in whole)


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def state(spark: SparkSession, table: str, snapshots: str | None = None) -> DataFrame:
    """The newest state row of each digest (digest, group_size, keep_id, locator) in a snapshot and the batches after it."""
    last = _numbers(spark, snapshots, "upto")[-1:] if snapshots else []
    batches = [n for n in _numbers(spark, table, "batch") if not last or n > last[0]]
    rows = [spark.read.schema(_STATE).parquet(f"{snapshots}/upto={n}").withColumn("batch", F.lit(n)) for n in last]
    if batches:
        paths = [f"{table}/batch={n}" for n in batches]
        rows.append(spark.read.schema(f"{_STATE}, batch int").option("basePath", table).parquet(*paths))
    if not rows:
        return spark.createDataFrame([], _STATE)
    if not batches:
        return rows[0].drop("batch")
    newest = reduce(DataFrame.unionByName, rows).groupBy("digest").agg(F.max_by(F.struct("group_size", "keep_id", "locator"), "batch").alias("s"))
    return newest.select("digest", "s.*")


def compacted(spark: SparkSession, table: str, snapshots: str) -> DataFrame:
    """``state`` as one snapshot; what went into it is removed once it is whole."""
    batches, before = _numbers(spark, table, "batch"), _numbers(spark, snapshots, "upto")
    upto = max([*batches, *before], default=-1)
    if upto not in before:
        path = f"{snapshots}/upto={max(upto, 0)}"
        state(spark, table, snapshots).write.mode("overwrite").option("compression", "zstd").parquet(path)
    for n in before:
        if n < upto:
            _remove(spark, f"{snapshots}/upto={n}")
    for n in batches:
        _remove(spark, f"{table}/batch={n}")
    return spark.read.schema(_STATE).parquet(f"{snapshots}/upto={max(upto, 0)}")


def read_rows(docs: DataFrame, hits: DataFrame, path: str, bits: int = 256, *keep: str) -> DataFrame:
    """One pass over new texts, written to ``path``: doc_id, n_points, digest, text_sha256, locator, ``keep``, and the content of likely hits only.

    ``SLOTS`` bounds the list of slots that goes to every task.
    """
    slot = F.pmod(F.xxhash64("digest"), F.lit(SLOTS)).alias("_slot")
    few = F.broadcast(hits.select(slot).distinct().withColumn("_hit", F.lit(True)))
    file = docs.metadataColumn("_metadata").getField("file_path").alias("locator")
    rows = digests(docs, bits, file, *named(keep)).withColumn("text_sha256", F.sha2("content", 256)).withColumn("_slot", slot).join(few, "_slot", "left")
    rows = rows.select("doc_id", "n_points", "digest", "text_sha256", "locator", *keep, F.when(F.col("_hit"), F.col("content")).alias("content"))
    rows.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


def originals(spark: SparkSession, places: DataFrame, rows: DataFrame | None, bits: int = 256) -> DataFrame:
    """digest, original: the texts of earlier runs that the state locates for hits (digest, id, place), each once.

    They stand in ``rows`` (digest, doc_id, locator, content), which none but the located ones leave, or are read from
    their files, as far as those are there still. The list of these files is as long as they are many.
    """
    key, found = lambda *columns: F.xxhash64(*columns).alias("_key"), []
    wanted = places.withColumn("_key", key("digest", "id", "place"))

    def located(texts: DataFrame, wanted: DataFrame) -> DataFrame:
        few = likely(texts.where("content is not null").withColumn("_key", key("digest", "doc_id", "locator")), wanted, "_key").drop("_key")
        same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("locator") == F.col("place"))
        return few.join(wanted.drop("_key"), "digest").where(same).groupBy("digest").agg(F.first("content").alias("original"))

    if rows is not None:
        found.append(settle(located(rows.select("digest", "doc_id", "locator", "content"), wanted), "op5-held"))
        wanted = wanted.join(found[0], "digest", "left_anti")
    files = [f for f in (r["place"] for r in wanted.select("place").distinct().collect()) if _exists(spark, f)]
    if files:
        docs = spark.read.parquet(*files)
        old = digests(docs, bits, docs.metadataColumn("_metadata").getField("file_path").alias("locator"))
        found.append(located(old, wanted))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "digest string, original string")


def collisions(rows: DataFrame, seen: DataFrame, earlier: DataFrame | None, bits: int = 256) -> DataFrame:
    """Digests that stand for different texts: full texts of (new) ``rows`` on hits are compared with those that the state locates.

    ``earlier`` has the rows of earlier runs, if there were any.
    """
    spark = rows.sparkSession
    hits = seen.where("group_size > 1")
    total = seen.agg(F.sum("group_size")).first()[0] or 0
    least = max(2, -(-total // HOT_SHARE))
    hot = F.broadcast(hits.where(F.col("group_size") >= least).select("digest"))
    new = rows.where("content is not null")
    # Hot rows meet nobody but the small list before they are summed; the others come to their digest.
    often = groups(new.join(hot, "digest", "left_semi"), "digest", "content")
    others = hits.where(F.col("group_size") < least).select("digest").hint("merge")
    seldom = groups(new.join(hot, "digest", "left_anti").join(others, "digest", "left_semi"), "digest", "content")
    texts = settle(_named(often.unionByName(seldom), "digest", "content"), "op5-hits")
    places = hits.join(texts.select("digest").distinct(), "digest").select("digest", F.col("keep_id").alias("id"), F.col("locator").alias("place"))
    own = texts.join(places, "digest").where(F.col("keep_id").eqNullSafe(F.col("id")) & (F.col("locator") == F.col("place"))).select("digest", F.col("content").alias("original"))
    if earlier is None:  # whatever is located came in this run
        known = own
    else:
        away = settle(places.join(own.select("digest"), "digest", "left_anti"), "op5-away")
        known = settle(own.unionByName(originals(spark, away, earlier, bits)), "op5-originals")
    compared = texts.join(known, "digest")
    if not compared.where((F.col("content") != F.col("original")) & (F.sha2("content", 256) == F.sha2("original", 256))).isEmpty():
        raise ValueError("two different texts have one SHA-256")
    unlike = compared.where(F.col("content") != F.col("original")).select("digest")
    if earlier is None:
        return unlike.distinct()
    # With no located text at hand SHA-256 tells texts apart.
    lost = places.join(known, "digest", "left_anti").select("digest")
    both = rows.select("digest", "text_sha256").unionByName(earlier.select("digest", "text_sha256"))
    mixed = both.join(lost, "digest", "left_semi").groupBy("digest").agg(F.min("text_sha256").alias("a"), F.max("text_sha256").alias("b")).where("a <> b").select("digest")
    return unlike.unionByName(mixed).distinct()


def report(spark: SparkSession, path: str, bits: int = 256, files_a_batch: int = 1000, keep: tuple[str, ...] = (), work: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each document at ``path``; with ``keep`` also n_points and those columns.

    ``work`` is a folder that lasts, with the stream's checkpoint, its state and the ledger; without it they start anew.
    ``keep`` is for tables that are read once.
    """
    lasting, work = work is not None, work or scratch(spark, "op5")
    if lasting and keep:
        raise ValueError("a ledger that lasts keeps no columns of the caller's")
    watch(spark, path, f"{work}/changed", f"{work}/checkpoint", bits, files_a_batch)
    seen = compacted(spark, f"{work}/changed", f"{work}/state")
    docs = spark.read.parquet(path)
    runs = _numbers(spark, f"{work}/rows", "run")
    fresh = docs
    if lasting:
        now = docs.select(docs.metadataColumn("_metadata").getField("file_path").alias("locator")).distinct()  # reads no column
        if runs:
            now = now.join(spark.read.schema("locator string").parquet(*[f"{work}/rows/run={n}" for n in runs]).distinct(), "locator", "left_anti")
        files = [r["locator"] for r in now.collect()]  # as many as there are new files
        fresh = spark.read.schema(docs.schema).parquet(*files) if files else None
    rows = None
    if fresh is not None and not fresh.isEmpty():
        earlier = spark.read.schema(f"{_LEDGER}, content string").parquet(*[f"{work}/rows/run={n}" for n in runs]) if runs else None
        runs = [*runs, len(runs)]
        rows = read_rows(fresh, seen.where("group_size > 1"), f"{work}/rows/run={runs[-1]}", bits, *keep)
    if not runs:
        return docs.select(F.col("doc_id").cast("long"), F.lit(None).cast("long").alias("keep_id"), F.lit(0).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.lit("").alias("text_sha256"), *([F.lit(0).cast("long").alias("n_points"), *keep] if keep else [])).where("false")
    ledger = rows if runs == [0] and rows is not None else spark.read.schema(f"{_LEDGER}, content string").parquet(*[f"{work}/rows/run={n}" for n in runs])
    if rows is not None:
        collisions(rows, seen, earlier, bits).write.mode("overwrite").parquet(f"{work}/split/run={runs[-1]}")
    split = spark.read.schema("digest string").parquet(*[f"{work}/split/run={n}" for n in runs]).distinct()
    slim, sizes = ledger.drop("content"), seen.select("digest", F.col("group_size").alias("n"))
    if lasting:
        slim = slim.join(docs.select(docs.metadataColumn("_metadata").getField("file_path").alias("locator")).distinct(), "locator", "left_semi")
    if split.isEmpty():
        found = spread_join(slim, seen.drop("locator"), "digest", "doc_id", sizes)
    else:
        apart = _named(groups(ledger.join(split, "digest", "left_semi"), "digest", "text_sha256"), "digest", "text_sha256").drop("locator")
        found = slim.join(split, "digest", "left_anti").join(seen.drop("locator"), "digest").unionByName(slim.join(apart, ["digest", "text_sha256"]), allowMissingColumns=True)
    return found.select("doc_id", "keep_id", "group_size", F.equal_null("doc_id", "keep_id").alias("kept"), "text_sha256", *(["n_points", *keep] if keep else []))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group of equal texts, all columns as they are."""
    spark, row = docs.sparkSession, spare([*docs.columns, "content", "locator", "digest", "text_sha256", "n_points", "keep_id", "group_size", "kept"], "row")
    path, numbered = scratch(spark, "op5-docs"), docs.withColumn(row, F.monotonically_increasing_id())
    numbered.write.option("compression", "zstd").parquet(path)
    numbered = spark.read.schema(numbered.schema).parquet(path)
    judged = settle(report(spark, path, keep=(row,)).select("doc_id", "text_sha256", "kept", "n_points", row), "op5-judged")
    best = F.max(F.struct("n_points", F.bitwise_not(row).alias("first")))
    stays = judged.where("kept").groupBy("doc_id", "text_sha256").agg(best.alias("best")).select(F.bitwise_not("best.first").alias(row))
    goes = settle(judged.select(row).join(stays, row, "left_anti"), "op5-goes")
    return without(numbered, goes, row).select(*named(docs.columns))
