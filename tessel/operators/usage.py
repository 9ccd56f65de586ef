"""Model usage: rates by case, totals, and the append-only log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def _rate(tokens: Column, millis: Column) -> Column:
    return F.when((millis > 0) & (tokens > 0), tokens * 1000.0 / millis).otherwise(0.0)


def rates(calls: DataFrame) -> DataFrame:
    """Adds millis_pp, millis_tg, pp_tps, tg_tps to calls.

    Columns: prompt_tokens, completion_tokens; prompt_ms, predicted_ms, prompt_per_second,
    predicted_per_second (the server's timings, or nulls); first_ms (start to the first content,
    or null) and total_ms (start to end). Server timings come first, then streams, whose first
    content is known, then buffered answers, where reading a prompt counts as five times as fast.
    """
    prompt, completion = F.col("prompt_tokens"), F.col("completion_tokens")
    server, stream = F.col("prompt_ms").isNotNull(), F.col("first_ms").isNotNull()
    rest, total = F.col("total_ms") - F.col("first_ms"), F.col("total_ms")
    whole = F.when((total > 0) & (completion > 0), 1000.0 * (prompt / 5.0 + completion) / total).otherwise(0.0)

    def spent(tokens: Column, rate: Column) -> Column:
        return F.when((rate > 0) & (tokens > 0), F.floor(tokens * 1000.0 / rate + 0.5)).otherwise(total).cast("long")

    def case(a: Column, b: Column, c: Column) -> Column:
        return F.when(server, a).when(stream, b).otherwise(c)

    return calls.withColumns({
        "millis_pp": case(F.floor(F.col("prompt_ms") + 0.5).cast("long"), F.col("first_ms"), spent(prompt, 5 * whole)),
        "millis_tg": case(F.floor(F.col("predicted_ms") + 0.5).cast("long"), rest, spent(completion, whole)),
        "pp_tps": case(_or_zero(F.col("prompt_per_second")), _rate(prompt, F.col("first_ms")), 5 * whole),
        "tg_tps": case(_or_zero(F.col("predicted_per_second")), _rate(completion, rest), whole),
    })


def totals(calls: DataFrame) -> DataFrame:
    """One row: calls, prompt, completion and total tokens, and a message."""
    out = calls.agg(F.count(F.lit(1)).alias("n_calls"), *[_or_zero(F.sum(c)).cast("long").alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")])
    return out.withColumn("message", F.when(F.col("n_calls") == 0, "none").otherwise(F.concat(F.col("n_calls").cast("string"), F.lit(" calls"))))


#: The fields of a log record and the columns that they come from.
RECORD = {
    "tsStart": "ts_start", "millisPP": "millis_pp", "millisTG": "millis_tg", "model": "model", "promptTokens": "prompt_tokens", "completionTokens": "completion_tokens",
    "totalTokens": "total_tokens", "cachedTokens": "cached_tokens", "ppTPS": "pp_tps", "tgTPS": "tg_tps",
}


def as_json(calls: DataFrame) -> DataFrame:
    """``value``: one JSON object a call, for the append-only log: its type, the columns of ``RECORD``, and ``usage`` (JSON text) as it came.

    ts_start is ISO 8601 text; rates are 32-bit floats; fields without a value are null.
    """
    kinds = {"pp_tps": "float", "tg_tps": "float"}
    fields = [F.col(c).cast(kinds[c]).alias(n) if c in kinds else F.col(c).alias(n) for n, c in RECORD.items()]
    record = F.struct(F.lit("llm-request").alias("type"), *fields, F.try_parse_json("usage").alias("usage"))
    return calls.select(F.to_json(record, {"ignoreNullFields": "false"}).alias("value"))


def append_log(calls: DataFrame, path: str) -> None:
    """Append calls to a folder of JSON lines."""
    as_json(calls).write.mode("append").text(path)


def from_payload(payload: Column) -> Column:
    """Token counts and timings of a final stream payload; missing counts are 0."""
    usage = {n: _or_zero(F.get_json_object(payload, f"$.usage.{n}").try_cast("long")).alias(n) for n in ("prompt_tokens", "completion_tokens", "total_tokens")}
    cached = _or_zero(F.get_json_object(payload, "$.usage.prompt_tokens_details.cached_tokens").try_cast("long")).alias("cached_tokens")
    timing = [F.get_json_object(payload, f"$.timings.{n}").try_cast("double").alias(n) for n in ("prompt_ms", "predicted_ms", "prompt_per_second", "predicted_per_second")]
    return F.struct(*usage.values(), cached, *timing, F.get_json_object(payload, "$.model").alias("model"))
