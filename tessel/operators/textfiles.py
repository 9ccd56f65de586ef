"""Operations on files as rows: finding by glob, keyword search, line ranges, edits."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.functions.text import glob_regex, normal_path
from tessel.sources.files import lines


def find_by_glob(files: DataFrame, pattern: str = "**/*.*", exclude: str | None = None, below: str | None = None, limit: int | None = None) -> DataFrame:
    """path and size of relative paths that match. An excluded directory takes all below it along.

    ``limit`` takes the first paths in order; 0 or less gives none.
    """
    found = files.select("path", "size").where(F.col("path").rlike(glob_regex(pattern)))
    if below:
        found = found.where(F.col("path").startswith(below.rstrip("/") + "/"))
    if exclude is not None:
        parts = F.split("path", "/")
        above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
        found = found.where(~F.exists(above, lambda p: p.rlike(f"^(?:{exclude})$")))
    return found if limit is None else found.orderBy("path", "size").limit(max(0, limit))


def allowed(paths: DataFrame, base: str, project: str) -> DataFrame:
    """Adds ``normal`` and ``allowed``: the path below ``base`` stays there, and its project's name matches."""
    clean = normal_path(F.concat(F.lit(base + "/"), F.col("path")))
    name = F.split(F.substr(clean, F.lit(len(base) + 2)), "/")[0]
    return paths.withColumns({"normal": clean, "allowed": clean.startswith(base + "/") & name.rlike(f"^(?:{project})$")})


def keyword_hits(files: DataFrame, name: str, keywords: list[str], extensions: tuple[str, ...] = (".mp4", ".webm")) -> DataFrame:
    """Rows whose name, without blanks and underscores, has one of the keywords (without blanks) and an extension."""
    plain = F.translate(F.lower(name), "_ ", "")
    keys = [k.replace(" ", "").lower() for k in keywords]
    hit = F.exists(F.array(*map(F.lit, keys)), lambda k: F.contains(plain, k)) if keys else F.lit(False)
    return files.where(hit & F.exists(F.array(*map(F.lit, extensions)), lambda e: F.endswith(plain, e)))


SPAN = 999


def line_range(docs: DataFrame, first: int = 1, last: int | None = None, key: str = "doc_id", numbered: bool = False) -> DataFrame:
    """key, header, body, lines_read, total_lines, truncated, next_line of the lines ``first`` to ``last``.

    A first line below 1 is 1; a last line before the first, or none, is 999 lines on.
    """
    first = max(1, first)
    last = first + SPAN if last is None or last < first else last
    rows = docs.select(key, lines(F.coalesce("text", F.lit(""))).alias("l")).withColumn("total", F.size("l"))
    end = F.least(F.lit(last), F.col("total"))
    part = F.slice("l", F.lit(first), F.greatest(end - first + 1, F.lit(0)))
    if numbered:
        part = F.transform(part, lambda x, k: F.concat(F.lpad((k + first).cast("string"), 4, " "), F.lit(" | "), x))
    return rows.select(
        key, F.concat(F.lit(f"Lines {first}-"), end.cast("string"), F.lit(" of "), F.col("total").cast("string")).alias("header"), F.array_join(part, "\n").alias("body"),
        F.size(part).alias("lines_read"), F.col("total").alias("total_lines"), (F.col("total") > last).alias("truncated"), F.when(F.col("total") > last, last + 1).alias("next_line"),
    )


def _needle(text: str) -> None:
    if not text:
        raise ValueError("the text to look for is empty")


def replace_all(docs: DataFrame, old: str, new: str, key: str = "doc_id") -> DataFrame:
    """key, replacements, text: all places of a literal text, from the left, without overlap."""
    _needle(old)
    count = (F.length("text") - F.length(F.replace("text", F.lit(old), F.lit("")))) / len(old)
    return docs.select(key, count.cast("int").alias("replacements"), F.replace("text", F.lit(old), F.lit(new)).alias("text"))


def replace_first(docs: DataFrame, old: str, new: str, key: str = "doc_id") -> DataFrame:
    """key, replacements, text: the first place only."""
    _needle(old)
    at = F.instr("text", old)
    changed = F.concat(F.left("text", at - 1), F.lit(new), F.substring(F.col("text"), at + len(old), F.length("text")))
    return docs.select(key, (at > 0).cast("int").alias("replacements"), F.when(at > 0, changed).otherwise(F.col("text")).alias("text"))


def edited(rows: DataFrame) -> DataFrame:
    """What an edit writes back: rows with a replacement."""
    return rows.where("replacements > 0")


TRIES = 32  # searches of a text before every place is looked at


def common_prefixes(text: str, needle: str) -> list[int]:
    """For each place of ``text`` how much of the beginning of ``needle`` stands there (the Z-function of both), in linear time."""
    whole, n = needle + text, len(needle)
    z, left, right = [0] * len(whole), 0, 0
    for i in range(1, len(whole)):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < len(whole) and k < n and whole[k] == whole[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z[n:]


def farthest(text: str, needle: str) -> tuple[int, int] | None:
    """(length, place) of the longest prefix of ``needle`` that another character follows, at its last place; None without one.

    A few searches settle most texts: halving finds the longest prefix there is, and its last
    places are looked at from the end, in the reversed text. Where ``TRIES`` don't do, as in
    periodic texts, one linear pass over all places does.
    """
    if not text:
        return None
    low, high = 0, len(needle) - 1
    while low < high:  # a prefix occurs where a longer one does
        middle = (low + high + 1) // 2
        low, high = (middle, high) if text.find(needle[:middle]) >= 0 else (low, middle - 1)
    back, tries = text[::-1], 0
    for n in range(low, -1, -1):
        part, at = needle[:n][::-1], 0
        while tries < TRIES:
            tries += 1
            at = back.find(part, at + 1)  # at least one character follows
            if at < 0:
                break
            if back[at - 1] != needle[n]:
                return n, len(text) - at - n
        if tries == TRIES:
            break
    z, size = common_prefixes(text, needle), len(text)
    places = [(n, i) for i, n in enumerate(z) if n < len(needle) and i + n < size]
    return max(places) if places else None


def longest_prefix(docs: DataFrame, needle: str, key: str = "doc_id") -> DataFrame:
    """key, prefix_length, position, expected, actual, actual_code: how far a text that isn't there matches.

    The longest prefix that is followed by another character counts, at its last place; one that
    the text's end cuts off doesn't. The time grows as the text, whatever it repeats.
    """
    _needle(needle)
    names = [key, "prefix_length", "position", "expected", "actual", "actual_code"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                n, at = farthest(text or "", needle) or (None, None)
                rows.append((n, at, needle[n], text[at + n], f"U+{ord(text[at + n]):04X}") if n is not None else (None,) * 5)
            columns = [*zip(*rows, strict=True)] or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names)

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(run, f"{key} {kind}, prefix_length int, position int, expected string, actual string, actual_code string")


def occurrences(text: Column, literal: str) -> Column:
    """How often a literal occurs without overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(literal), F.lit("")))) / len(literal)).cast("int")
