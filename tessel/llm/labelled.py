"""A bounded sample of labelled documents for classifiers, and the fold that they never see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import texts

SAMPLE = 20_000  # labelled documents that a classifier learns from, at most


def held_out(doc_id: Column) -> Column:
    """Whether a document is for tests only: the CRC of its id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, name: str, bound: int = SAMPLE) -> DataFrame:
    """text and label of at most ``bound`` documents (a third of them for calibration: ``tuning``).

    Labels in question are those with value 0 or 1 outside the held-out fold; documents with the
    smallest hashes of their ids are taken, the same ones in every run.
    """
    usable = labels.where(~held_out(F.col("doc_id")) & F.col(name).isin(0, 1)).groupBy("doc_id").agg(F.max(name).alias("label"))
    order = F.xxhash64("doc_id", F.lit(11))
    few = usable.select("doc_id", "label", order.alias("h")).orderBy("h", "doc_id").limit(bound)  # so it may go to every task
    return texts(docs).join(F.broadcast(few), "doc_id").select("doc_id", "text", "label", (F.pmod("h", F.lit(3)) == 0).alias("tuning"))
