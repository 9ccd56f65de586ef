"""Markdown glossaries: parse, look up, resolve references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.functions.text import word_list


def key_of(term: Column) -> Column:
    """Lower case, without blanks, underscores, hyphens and one pair of quotes around; null gives ''."""
    plain = F.regexp_replace(F.lower(term), "[ _-]", "")
    return F.coalesce(F.regexp_replace(plain, '(?s)^"(.*)"$', "$1"), F.lit(""))


def parse(files: DataFrame, resolve_references: bool = False) -> DataFrame:
    """key, term, description, reference of files (``file``, ``text``); of equal keys the first in file order stays.

    A line that starts with exactly ``# `` opens a term; what follows up to the next is its
    description. An entry that is ``-> other`` refers to another one: it is dropped, or kept with
    its ``reference`` where references are to be resolved.
    """
    parts = F.split(F.concat(F.lit("\n"), F.regexp_replace("text", "\r\n|\r", "\n")), "\n# ")
    entries = files.select("file", F.posexplode(parts).alias("n", "e")).where("n > 0")
    term, rest = F.trim(F.substring_index("e", "\n", 1)), F.regexp_replace(F.when(F.instr("e", "\n") > 0, F.expr("substring(e, instr(e, '\n') + 1)")).otherwise(""), r"^\s+|\s+$", "")
    rows = entries.select("file", "n", term.alias("term"), rest.alias("description")).withColumn("key", key_of(F.col("term")))
    refers = F.col("description").startswith("-> ")
    rows = rows.withColumn("reference", F.when(refers, key_of(F.trim(F.substr("description", F.lit(4))))))
    if not resolve_references:
        rows = rows.where(~refers)
    first = rows.groupBy("key").agg(F.min_by(F.struct("term", "description", "reference"), F.struct("file", "n")).alias("e"))
    return first.select("key", "e.*")


def look_up(glossary: DataFrame, words: DataFrame) -> DataFrame:
    """pos, key, term, description of the words (``pos``, ``word``) that are found, each key at its first place."""
    asked = words.where("word is not null").select("pos", key_of(F.col("word")).alias("asked"))
    refers = glossary.where("reference is not null").select(F.col("key").alias("asked"), "reference")
    asked = asked.join(refers, "asked", "left").select("pos", F.coalesce("reference", "asked").alias("key"))
    once = asked.groupBy("key").agg(F.min("pos").alias("pos"))
    return once.join(glossary.where("reference is null").drop("reference"), "key").select("pos", "key", "term", "description")


def answer(found: DataFrame) -> DataFrame:
    """One row: the entries in the order asked for, as Markdown. They are no more than the words asked."""
    entry = F.struct("pos", F.concat(F.lit("# "), "term", F.lit("\n"), "description").alias("t"))
    return found.agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["t"]), "\n\n").alias("text"))


def asked(rows: DataFrame, text: str = "words") -> DataFrame:
    """pos, word of each word in lists as text, for ``look_up``."""
    return rows.select(F.posexplode(word_list(F.col(text))).alias("pos", "word"))
