"""The usage log as a stream's sink, whose output a batch that runs twice leaves as it was."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessel.operators.usage import as_json

TOTALS = ("n_calls", "prompt_tokens", "completion_tokens", "total_tokens")
_TOTALS = "n_calls long, prompt_tokens long, completion_tokens long, total_tokens long"


def append_batch(calls: DataFrame, batch: int, folder: str) -> None:
    """Write one micro-batch: its lines, and the totals after it, which go on from those after the batch before.

    Both are overwritten under the batch's number. Lines come first, so totals never count lines that aren't there.
    """
    spark = calls.sparkSession
    as_json(calls).write.mode("overwrite").text(f"{folder}/lines/batch={batch}")
    own = calls.agg(F.count(F.lit(1)).alias("n_calls"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in TOTALS[1:]])
    if batch:
        own = own.unionByName(spark.read.schema(_TOTALS).parquet(f"{folder}/totals/batch={batch - 1}")).agg(*[F.sum(c).alias(c) for c in TOTALS])
    own.coalesce(1).write.mode("overwrite").parquet(f"{folder}/totals/batch={batch}")


def start_log(calls: DataFrame, folder: str, **trigger) -> StreamingQuery:
    """Start a stream of calls (columns as ``usage.rates`` leaves them) into a log below ``folder``.

    Its checkpoint lies there too: batch numbers belong to the log, so both last or go together.
    """
    writer = calls.writeStream.foreachBatch(lambda rows, batch: append_batch(rows, batch, folder)).option("checkpointLocation", f"{folder}/checkpoint")
    return (writer.trigger(**trigger) if trigger else writer).start()


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    """batch, value: the lines of a log."""
    return spark.read.schema("value string, batch int").option("basePath", f"{folder}/lines").text(f"{folder}/lines")


def log_totals(spark: SparkSession, folder: str) -> DataFrame:
    """The newest totals, a row; none before the first batch has ended."""
    rows = spark.read.schema(f"{_TOTALS}, batch int").option("basePath", f"{folder}/totals").parquet(f"{folder}/totals")
    return rows.orderBy(F.desc("batch")).limit(1).select(*TOTALS)
