"""File sources: whole texts, lines, metadata, archives, embedding CSV lines."""

from __future__ import annotations

import contextlib
import gzip
import io
import os
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessel.session import checkpointed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, mod_ts (epoch milliseconds), size (as stored), text of all files below ``path``; UTF-8, that of ``.gz`` files unpacked."""
    files = unpacked(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))
    return files.select("path", F.unix_millis("modificationTime").alias("mod_ts"), F.col("length").alias("size"), F.decode("content", "UTF-8").alias("text"))


@F.pandas_udf(T.BinaryType())
def gunzip(content: pd.Series) -> pd.Series:
    """Unpacked bytes; null for what is no whole gzip file."""

    def one(data: bytes | None) -> bytes | None:
        with contextlib.suppress(OSError, EOFError, zlib.error):
            return gzip.decompress(data) if data is not None else None
        return None

    return content.map(one)


def unpacked(files: DataFrame) -> DataFrame:
    """``files`` (path, content and more) with the contents of ``.gz`` paths unpacked; others pass by Python."""
    packed = F.endswith("path", F.lit(".gz"))
    return files.where(~packed).unionByName(files.where(packed).withColumn("content", gunzip("content")))


def resources(files: DataFrame) -> DataFrame:
    """resource, path, is_gzipped, content: each resource of ``files`` (path, content) once, unpacked from its ``.gz`` form where there is one.

    A plain file only goes if its ``.gz`` form is there, so no content moves but by the paths of those.
    """
    twins = files.where(F.endswith("path", F.lit(".gz"))).select(F.regexp_replace("path", r"\.gz$", "").alias("path")).distinct()
    rows = unpacked(files.select("path", "content").join(twins, "path", "left_anti"))
    return rows.select(F.regexp_replace("path", r"\.gz$", "").alias("resource"), "path", F.endswith("path", F.lit(".gz")).alias("is_gzipped"), "content")


def listing(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """path and size of files below ``path``; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.select("path", F.col("length").alias("size"))


def with_directories(files: DataFrame) -> DataFrame:
    """Adds a row (size 0, is_dir) for every directory above a relative path."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    dirs = files.where(F.size(parts) > 1).select(F.explode(above).alias("path")).distinct()
    return files.select("path", "size", F.lit(False).alias("is_dir")).unionByName(dirs.select("path", F.lit(0).cast("long").alias("size"), F.lit(True).alias("is_dir")))


def lines(text: F.Column) -> F.Column:
    """Lines of a text; all three terminators count and the last one opens no line."""
    parts = F.split(text, "\r\n|\r|\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def prefer_gzip(files: DataFrame) -> DataFrame:
    """One row a resource: its ``.gz`` form where there is one."""
    plain = F.regexp_replace("path", r"\.gz$", "")
    return files.groupBy(plain.alias("resource")).agg(F.max_by("path", F.col("path").endswith(".gz").cast("int")).alias("path"))


#: What reading an archive raises that is damaged, encrypted, or of a version that isn't known.
DAMAGED = (zipfile.BadZipFile, NotImplementedError, RuntimeError, EOFError, zlib.error, ValueError, OSError, struct.error)
ENTRY = "archive string, name string, size long, compressed_size long, modified string, method string"


def archive_entries(archives: DataFrame) -> DataFrame:
    """Entries of ZIP and JAR files given as ``path`` and ``content``; a damaged archive has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    infos = zipfile.ZipFile(io.BytesIO(content or b"")).infolist()
                except DAMAGED:
                    continue
                for x in infos:
                    y, mo, d, h, mi, s = x.date_time
                    method = "STORED" if x.compress_type == zipfile.ZIP_STORED else "DEFLATED"
                    rows.append({"archive": path, "name": x.filename, "size": x.file_size, "compressed_size": x.compress_size, "modified": f"{y:04}-{mo:02}-{d:02}T{h:02}:{mi:02}:{s:02}Z", "method": method})
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([(f.split()[0], t) for f, t in zip(ENTRY.split(", "), kinds, strict=True)]))

    return archives.select("path", "content").mapInArrow(run, ENTRY)


def entry_texts(archives: DataFrame) -> DataFrame:
    """path, name, text (UTF-8) of the entries ``names`` of archives given as ``path`` and ``content``; those that can't be read have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content, names in zip(*(batch.column(c).to_pylist() for c in ("path", "content", "names")), strict=True):
                rows = []
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content or b""))
                    for name in names:
                        with contextlib.suppress(KeyError, *DAMAGED):
                            rows.append({"path": path, "name": name, "text": archive.read(name).decode("utf-8", "replace")})
                except DAMAGED:
                    continue
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("name", pa.string()), ("text", pa.string())]))

    return archives.select("path", "content", "names").mapInArrow(run, "path string, name string, text string")


def name_list(value: F.Column) -> F.Column:
    """The different names of a comma-separated setting."""
    return F.array_distinct(F.filter(F.transform(F.split(value, ","), lambda x: F.trim(x)), lambda x: x != ""))


def setting(spark: SparkSession, *keys: str, default: str | None = None) -> str | None:
    """A setting by the first of its names that is known: to the environment, else to the session, else the default."""
    for source in (os.environ.get, lambda key: spark.conf.get(key, None)):
        for key in keys:
            if (value := source(key)) is not None:
                return value
    return default


def resolved_settings(wanted: DataFrame, settings: DataFrame) -> DataFrame:
    """name, value, source of settings in tables: ``wanted`` has name, keys (array, the preferred one first) and fallback.

    ``settings`` has source (the smallest number comes first), key, value; null values count as
    unknown. A source that knows any of the keys comes before the next one, whatever keys that knows; without one the fallback
    counts and source is null.
    """
    asked = wanted.select("name", F.posexplode("keys").alias("place", "key"))
    found = asked.join(settings.where("value is not null"), "key").groupBy("name").agg(F.min(F.struct("source", "place", "value")).alias("s"))
    return wanted.join(found, "name", "left").select("name", F.coalesce("s.value", "fallback").alias("value"), F.col("s.source").alias("source"))


def walk(spark: SparkSession, root: str, exclude: str | None = None, opened: Accumulator | None = None) -> DataFrame:
    """path (relative), size, is_dir of all below ``root``, whose excluded directories are never opened.

    Directories are listed level by level, each level as a Spark job over those of the one before, so
    no list goes through the driver. A path that matches ``exclude`` whole goes, and with it all below;
    one that can't be read has size -1 and nothing below. ``root`` is a folder that all executors
    reach: a path, or a URI that pyarrow's file systems know. ``opened`` counts directories listed.
    """
    schema = "path string, size long, is_dir boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, top = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root.rstrip("/"))
        out = re.compile(exclude) if exclude is not None else None
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                rows = []
                with contextlib.suppress(OSError):
                    if opened is not None:
                        opened.add(1)
                    for info in system.get_file_info(fs.FileSelector(f"{top}/{folder}" if folder else top)):
                        path = f"{folder}/{info.base_name}" if folder else info.base_name
                        if out is None or not out.fullmatch(path):
                            is_dir = info.type == fs.FileType.Directory
                            rows.append((path, 0 if is_dir else -1 if info.size is None else info.size, is_dir))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.bool_()))], ["path", "size", "is_dir"])

    level = checkpointed(spark.createDataFrame([("",)], "path string").mapInArrow(run, schema))
    found = level
    while not (below := level.where("is_dir")).isEmpty():
        # A folder may hold most of the files: its subfolders are dealt anew.
        level = checkpointed(below.select("path").repartition("path").mapInArrow(run, schema))
        found = found.unionByName(level)
    return found
