"""Structured Streaming forms of the event operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessel.operators.events import payload_of


#: What operators with several states of a key need: state in RocksDB, its changes written to the checkpoint.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB; the session's settings are as before afterwards."""
    before = {k: spark.conf.get(k, None) for k in STATE}
    try:
        for k, v in STATE.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def drained(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """All that a stream gives until its input is used up, with the number of its ``batch``; a later call goes on from there.

    Each batch is written below ``folder`` under its number, beside the checkpoint, so one that runs twice leaves the same rows.
    """
    spark, schema = stream.sparkSession, stream.schema
    write = lambda rows, batch: rows.write.mode("overwrite").parquet(f"{folder}/out/batch={batch}")
    with rocksdb(spark):
        query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.IntegerType())])).option("basePath", f"{folder}/out").parquet(f"{folder}/out")


def running_totals(calls: DataFrame) -> DataFrame:
    """Totals over a stream of calls (for output mode complete); summed in each task first."""
    return calls.groupBy().agg(F.count(F.lit(1)).alias("n_calls"), *[F.sum(c).alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")])


def payloads(pieces: DataFrame) -> DataFrame:
    """stream_id, payload of a stream of pieces (stream_id, seq from 0 on, piece), as the batch form gives them.

    A cut line waits in state for its rest, and a piece that comes early for those before it.
    """

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, following, seqs, parts = state.get if state.exists else ("", 0, [], [])
        waiting = dict(zip(seqs, parts, strict=True))
        for rows in batches:
            waiting.update(zip(rows["seq"].tolist(), rows["piece"].tolist(), strict=True))
        ready = []
        while following in waiting:
            ready.append(waiting.pop(following) or "")
            following += 1
        *done, held = (held + "".join(ready)).split("\n")
        state.update((held, following, [*waiting], [*waiting.values()]))
        yield pd.DataFrame({"stream_id": key[0], "payload": [x for x in map(payload_of, done) if x is not None]})

    return pieces.groupBy("stream_id").applyInPandasWithState(run, "stream_id long, payload string", "held string, following long, seqs array<long>, parts array<string>", "append", GroupStateTimeout.NoTimeout)


def throttled(events: DataFrame, gap: int) -> DataFrame:
    """key, at (epoch milliseconds) of events that are ``gap`` whole seconds after the last one let through."""

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, out = state.get[0] if state.exists else None, []
        for at in sorted(pd.concat(list(batches))["at"].tolist()):
            if last is None or (at - last) // 1000 >= gap:
                last = at
                out.append(at)
        if last is not None:
            state.update((int(last),))
        yield pd.DataFrame({"key": key[0], "at": pd.Series(out, dtype="int64")})

    return events.groupBy("key").applyInPandasWithState(run, "key long, at long", "last long", "append", GroupStateTimeout.NoTimeout)


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, last_answer after each batch of turns (conv_id, turn, role, text), for output mode update."""
    last = F.max(F.when(F.col("role") == "assistant", F.struct("turn", "text"))).getField("text")
    return turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), last.alias("last_answer"))
