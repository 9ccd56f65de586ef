"""The embedding store: incremental upsert, and the line format that other tools read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.functions.vectors import checked, f32_bytes, f32_values, q8_bytes, q8_values


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old`` with the rows of ``new`` that changed in (key, mod_ts, size), as a merge with ``status``: one join by key.

    Of rows with one key (null is one) the last by mod_ts, then size, counts.
    """

    def once(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("key").agg(F.max_by(F.struct(*old.columns), F.struct("mod_ts", "size")).alias(name)).withColumnRenamed("key", f"{name}_key")

    both = once(old, "o").join(once(new, "n"), F.col("o_key").eqNullSafe(F.col("n_key")), "full")
    o, n = F.col("o"), F.col("n")
    same = o["mod_ts"].eqNullSafe(n["mod_ts"]) & o["size"].eqNullSafe(n["size"])
    status = F.when(n.isNull(), "kept").when(o.isNull(), "inserted").when(same, "kept").otherwise("updated")
    rows = both.select(status.alias("status"), F.when(status == "kept", o).otherwise(n).alias("r"))
    return rows.select("r.*", "status")


def load(spark: SparkSession, path: str, held: DataFrame | None = None) -> DataFrame | None:
    """The entries of a store file as ``from_lines`` gives them, in file order; without a file, ``held`` as it is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return held
    lines_ = spark.read.text(path)
    at = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("n"))
    return from_lines(lines_.select(at.alias("ordinal"), F.col("value").alias("line")))


def save(entries: DataFrame, path: str, q8: bool = False) -> None:
    """Write entries as lines in the order of their ``ordinal``."""
    to_lines(entries, q8).orderBy("ordinal").select("line").write.mode("overwrite").text(path)


def escaped(field: Column) -> Column:
    """Quoted where a separator, quote or line end occurs, with quotes doubled."""
    return F.when(field.rlike('[;"\n]'), F.concat(F.lit('"'), F.replace(field, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(field)


def fields(line: Column) -> Column:
    """Fields of a line: quotes toggle, a doubled quote inside is one."""
    marked = F.regexp_extract_all(line, F.lit('((?:[^;"]|"(?:[^"]|"")*")*)(?:;|$)'), F.lit(1))
    whole = F.slice(marked, F.lit(1), F.when(F.endswith(line, F.lit(";")), F.size(marked)).otherwise(F.greatest(F.size(marked) - 1, F.lit(1))))
    return F.transform(whole, lambda x: F.when(x.startswith('"'), F.replace(F.regexp_replace(x, '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(x))


def to_lines(entries: DataFrame, q8: bool = False) -> DataFrame:
    """``line`` for each entry (key, mod_ts, size, prompt_tokens, total_tokens, chunks of start, end, vec), one format for all; an ``ordinal`` stays."""
    pieces = entries.select("*", F.posexplode_outer("chunks").alias("n", "c"))
    vec = F.col("c.vec")
    coded = pieces.withColumn("b", F.base64(q8_bytes(checked(vec)) if q8 else f32_bytes(vec)))
    piece = F.when(F.col("c").isNotNull(), F.struct("n", F.concat_ws(";", "c.start", "c.end", "b").alias("t")))
    keys = ["key", "mod_ts", "size", "prompt_tokens", "total_tokens"]
    ordinal = ["ordinal"] if "ordinal" in entries.columns else []
    whole = coded.groupBy(*keys, *ordinal).agg(F.array_sort(F.collect_list(piece)).alias("p"))
    head = [escaped(F.col("key")), *[F.col(k).cast("string") for k in keys[1:]], F.lit("Q8_0" if q8 else "F32"), F.size("p").cast("string")]
    return whole.select(*ordinal, F.concat_ws(";", *head, F.when(F.size("p") > 0, F.array_join(F.transform("p", lambda x: x["t"]), ";"))).alias("line"))


def from_lines(lines: DataFrame) -> DataFrame:
    """Chunks of stored lines (``ordinal``, ``line``): key, ordinal, counts, chunk_index, start, end, vec.

    Blank and malformed lines are skipped. Of lines with one key the last has the values and the
    first gives the place (``ordinal``). An entry without chunks has one row with nulls.
    """
    row = lines.select("ordinal", fields(F.trim("line")).alias("f")).where(F.size("f") >= 7)
    names = ["mod_ts", "size", "prompt_tokens", "total_tokens"]
    kinds = ["long", "long", "int", "int"]
    row = row.select("ordinal", "f", F.get("f", 0).alias("key"), *[F.get("f", k + 1).try_cast(t).alias(n) for k, (n, t) in enumerate(zip(names, kinds, strict=True))], F.get("f", 6).try_cast("int").alias("n"))
    good = row.where(F.col("n").isNotNull() & (F.size("f") >= 7 + 3 * F.col("n")))
    for n in names:
        good = good.where(F.col(n).isNotNull())
    places = good.groupBy("key").agg(F.min("ordinal").alias("place"), F.max("ordinal").alias("last"))
    last = good.join(places.withColumnRenamed("last", "ordinal"), ["key", "ordinal"])
    each = F.when(F.col("n") > 0, F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.struct(k.alias("chunk_index"), F.get("f", 7 + 3 * k).try_cast("int").alias("start"), F.get("f", 8 + 3 * k).try_cast("int").alias("end"), F.get("f", 9 + 3 * k).alias("b64"))))
    out = last.select("key", F.col("place").alias("ordinal"), *names, (F.get("f", 5) == "Q8_0").alias("q8"), F.explode_outer(each).alias("c"))
    raw = F.try_to_binary("c.b64", F.lit("base64"))
    return out.select("key", "ordinal", *names, "c.chunk_index", "c.start", "c.end", F.when(F.col("q8"), q8_values(F.when(F.col("q8"), raw))).otherwise(f32_values(F.when(~F.col("q8"), raw))).alias("vec"))
