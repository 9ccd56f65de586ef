"""Artifacts in a repository of archives: coordinates, versions, and resolution by priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.sources.files import archive_entries, entry_texts, lines

#: How a repository lays its archives out (group, artifact, version), and versions in plain file names.
COORDINATES = r"^(.+)/([^/]+)/([^/]+)/\2-\3(?:-sources)?\.jar$"
FILE_VERSION = r"([^/]+)-([0-9][^-/]*)(?:-sources)?\.jar$"


def coordinates(path: Column, repository: str | None = None) -> Column:
    """group_id, artifact_id, version of a path, without that of the ``repository`` it lies in; nulls where it is none."""
    if repository:
        base = repository.rstrip("/") + "/"
        path = F.when(F.startswith(path, F.lit(base)), F.substr(path, F.lit(len(base) + 1))).otherwise(path)
    part = [F.nullif(F.regexp_extract(path, COORDINATES, k), F.lit("")) for k in (1, 2, 3)]
    return F.struct(F.replace(part[0], F.lit("/"), F.lit(".")).alias("group_id"), part[1].alias("artifact_id"), part[2].alias("version"))


def version(path: Column) -> Column:
    """From the path, else from the file's name, else ``unknown``."""
    return F.coalesce(F.nullif(F.regexp_extract(path, COORDINATES, 3), F.lit("")), F.nullif(F.regexp_extract(path, FILE_VERSION, 2), F.lit("")), F.lit("unknown"))


def entry_path(name: Column, suffix: str = ".class") -> Column:
    return F.concat(F.replace(name, F.lit("."), F.lit("/")), F.lit(suffix))


def classpath(jars: DataFrame, repository: str | None = None) -> DataFrame:
    """One path (``path``) for each group and artifact: the later one (``ordinal``) wins."""
    named = jars.select("path", "ordinal", coordinates(F.col("path"), repository).alias("c")).where("c.artifact_id is not null")
    return named.groupBy("c.group_id", "c.artifact_id").agg(F.max_by("path", "ordinal").alias("path"))


def resolve(wanted: DataFrame, entries: DataFrame) -> DataFrame:
    """class_name, status, path, tier: the first archive (by tier, then ordinal) that has the class.

    ``entries`` has class_name, tier, ordinal, path. Every class has a row; one that fails doesn't
    touch the others.
    """
    best = entries.groupBy("class_name").agg(F.min(F.struct("tier", "ordinal", "path")).alias("b"))
    status = F.when(F.col("class_name").rlike(r"^[\w$]+(\.[\w$]+)*$"), F.when(F.col("b").isNotNull(), "success").otherwise("not_found")).otherwise("error")
    return wanted.join(best, "class_name", "left").select("class_name", status.alias("status"), "b.path", "b.tier")


def artifact_of(resolved: DataFrame, repository: str | None = None) -> DataFrame:
    """class_name, group_id, artifact_id, version of resolved classes; a path outside a repository has its version only."""
    c = coordinates(F.col("path"), repository)
    return resolved.where("status = 'success'").select("class_name", c["group_id"].alias("group_id"), c["artifact_id"].alias("artifact_id"), version(F.col("path")).alias("version"))


COMMANDS = ("read_metadata", "read_class_structure", "read_source")
LINES = 1000


def candidates(entries: DataFrame, archives: DataFrame) -> DataFrame:
    """class_name, tier, ordinal, path, entry fields of the classes in ``archive_entries``, for ``resolve``.

    ``archives`` has path, ordinal, on_classpath. Sources in source archives are tier 0, anything in
    archives of the class path tier 1, classes in other archives tier 2.
    """
    found = entries.withColumn("class_name", F.regexp_replace(F.regexp_extract("name", r"^(.+)\.(?:java|class)$", 1), "/", ".")).where("class_name <> ''")
    rows = found.join(archives.select(F.col("path").alias("archive"), "ordinal", "on_classpath"), "archive")
    sources, is_source = F.endswith("archive", F.lit("-sources.jar")), F.endswith("name", F.lit(".java"))
    tier = F.when(sources & is_source, 0).when(F.col("on_classpath"), 1).when(~sources & ~is_source, 2)
    return rows.withColumn("tier", tier).where("tier is not null").withColumnRenamed("archive", "path")


def read_classes(wanted: DataFrame, archives: DataFrame) -> DataFrame:
    """What the first archive with each class says about it: one row for each of ``wanted`` (class_name, command, start_line, end_line).

    ``archives`` has path, content (bytes), ordinal, on_classpath. Sources are asked for in source
    archives first, metadata and structures elsewhere first. Lines without a number are the first
    1,000; a last line before the first is 999 on. Classes that aren't there, unknown commands and
    names that are none have a row with their status, and so have classes without sources.
    Listings are joined first; only archives that were chosen are opened for their texts.
    """
    entries = candidates(archive_entries(archives), archives)
    good = F.col("class_name").rlike(r"^[\w$]+(\.[\w$]+)*$") & F.col("command").isin(*COMMANDS)
    fields = F.struct("tier", "ordinal", "path", "name", "size", "compressed_size", "modified", "method")
    ranked = wanted.select("class_name", "command").distinct().where(good).join(entries, "class_name").where((F.col("command") == "read_source") | (F.col("tier") > 0))
    best = ranked.groupBy("class_name", "command").agg(F.min(fields).alias("b"))
    chosen = best.where(F.endswith("b.name", F.lit(".java")) & (F.col("command") != "read_metadata")).select(F.col("b.path").alias("path"), F.col("b.name").alias("name")).distinct()
    texts = entry_texts(archives.join(chosen.groupBy("path").agg(F.collect_set("name").alias("names")), "path"))
    rows = wanted.join(best, ["class_name", "command"], "left").join(texts.withColumnRenamed("path", "p").withColumnRenamed("name", "n"), (F.col("b.path") == F.col("p")) & (F.col("b.name") == F.col("n")), "left")
    first = F.greatest(F.coalesce("start_line", F.lit(1)), F.lit(1))
    last = F.when(F.coalesce("end_line", F.lit(0)) < first, first + LINES - 1).otherwise(F.col("end_line"))
    rows = rows.withColumns({"first": first, "l": lines(F.col("text"))}).withColumns({"last": last, "total": F.size("l")})
    until = F.least("last", "total")
    part = F.slice("l", F.col("first"), F.greatest(until - F.col("first") + 1, F.lit(0)))
    numbered = F.transform(part, lambda x, k: F.concat(F.lpad((k + F.col("first")).cast("string"), 4, " "), F.lit(" | "), x))
    head = F.concat(F.lit("--- File: "), F.col("n"), F.lit(" ---\nLines "), F.col("first").cast("string"), F.lit("-"), until.cast("string"), F.lit(" of "), F.col("total").cast("string"), F.lit("\n\n"))
    has, read = F.col("text").isNotNull(), F.col("command") == "read_source"
    status = (
        F.when(~F.coalesce(good, F.lit(False)), "error").when(F.col("b").isNull(), "not_found").when(read & ~has, "sources_not_available").when(~has & (F.col("command") == "read_class_structure"), "error").otherwise("success")
    )
    error = (
        F.when(~F.coalesce(F.col("command").isin(*COMMANDS), F.lit(False)), F.concat(F.lit("Unknown command: "), F.coalesce("command", F.lit("")))).when(status == "not_found", "Class not found in any archive").when(status == "error", F.when(F.col("b").isNull(), "not a class name").otherwise("no sources to read the structure from"))
    )
    message = F.when(F.col("total") > F.col("last"), F.format_string("Showing lines %d-%d of %d total. Use start_line=%d to continue.", "first", "last", "total", F.col("last") + 1)).otherwise(F.format_string("File has %d lines total.", "total"))
    shown = {"lines_read": F.size(part), "total_lines": F.col("total"), "first_line": F.col("first"), "last_line": until, "truncated": F.col("total") > F.col("last"), "message": message}
    return rows.select(
        "class_name", "command", status.alias("status"), error.alias("error"), F.col("b.path").alias("path"), (F.col("b.tier") == 0).alias("is_sources"), F.col("b.name").alias("entry_name"), "b.size", "b.compressed_size", "b.modified", "b.method",
        F.when(has, F.concat(head, F.array_join(F.when(read, numbered).otherwise(part), "\n"))).alias("text"), *[F.when(has, c).alias(k) for k, c in shown.items()],
    )
