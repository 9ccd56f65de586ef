"""Text functions as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_escape(text: Column) -> Column:
    """Backslash escapes for a JSON string; null gives the empty string."""
    for raw, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\b", "\\b"), ("\f", "\\f"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    return F.coalesce(text, F.lit(""))


#: Content types by extension.
CONTENT_TYPES = {"html": "text/html", "css": "text/css", "js": "application/javascript", "json": "application/json", "png": "image/png", "jpg": "image/jpeg", "svg": "image/svg+xml", "ico": "image/x-icon"}


def content_type(path: Column) -> Column:
    """By what follows the last dot, in lower case."""
    extension = F.when(F.instr(path, ".") > 0, F.lower(F.substring_index(path, ".", -1)))
    out = F.lit("application/octet-stream")
    for name, kind in CONTENT_TYPES.items():
        out = F.when(extension == name, kind).otherwise(out)
    return out


def join_url(base: Column, path: Column) -> Column:
    """One slash between the two."""
    return F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), F.regexp_replace(path, "^/+", ""))


def responses_url(base: Column) -> Column:
    """``base`` with one ``/responses`` at its end."""
    return F.when(F.endswith(base, F.lit("/responses")), base).otherwise(F.concat(F.regexp_replace(base, "/$", ""), F.lit("/responses")))


def word_list(text: Column) -> Column:
    """Words of a list: commas, with blanks around them; nothing after the last comma is no word. Null gives none."""
    return F.coalesce(F.split(F.regexp_replace(text, "( *, *)+$", ""), " *, *", -1), F.array().cast("array<string>"))


def json_arguments(text: Column) -> Column:
    """A JSON object as a nested value (variant); a string that holds one is read once more, anything else is an empty object."""
    outer = F.try_parse_json(text)
    inner = F.when(F.schema_of_variant(outer) == "STRING", F.try_parse_json(F.try_variant_get(outer, "$", "string"))).otherwise(outer)
    return F.when(F.coalesce(F.schema_of_variant(inner).startswith("OBJECT"), F.lit(False)), inner).otherwise(F.parse_json(F.lit("{}")))


def glob_regex(pattern: str) -> str:
    """A regular expression for a path glob: ``*`` and ``?`` stay within a component, ``**`` does not."""
    out, depth, k = "", 0, 0
    while k < len(pattern):
        c = pattern[k]
        if c == "*":
            if pattern[k : k + 2] == "**":
                out, k = out + ".*", k + 1
            else:
                out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[":
            end = pattern.index("]", k + 2)
            inner = pattern[k + 1 : end]
            negated = inner[0] == "!"
            out += "(?!/)[" + "^" * negated + inner[negated:].replace("\\", "\\\\") + "]"  # not even a range has a separator in it
            k = end
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        elif c == "\\":
            k += 1
            out += re.escape(pattern[k])
        else:
            out += re.escape(c) if not c.isalnum() and c not in "/_" else c
        k += 1
    if depth:
        raise ValueError("a group is not closed")
    return f"^{out}$"


def normal_path(path: Column) -> Column:
    """Without empty and ``.`` components; ``..`` takes its predecessor away, and stays where there is none."""

    def step(acc: Column, x: Column) -> Column:
        up = (x == "..") & (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("..")) != "..")
        return F.when((x == "") | (x == "."), acc).when(up, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(F.concat(acc, F.array(x)))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def inside(base: str, path: Column) -> Column:
    """Whether a path, normalised, is ``base`` or lies below it, component by component."""
    clean = normal_path(path)
    return (clean == base) | clean.startswith(base + "/")


def number_of_line(text: Column, offset: Column) -> Column:
    """Line (from 1) of a code point offset, which is clamped to the text."""
    at = F.when(offset >= F.length(text), F.length(text) - 1).otherwise(offset)
    return F.when(offset <= 0, 1).otherwise(1 + F.regexp_count(F.left(text, at), F.lit("\n")))


def excerpt(text: Column, start: Column, end: Column) -> Column:
    """The text between two offsets; the whole of it if neither is positive."""
    return F.when((start <= 0) & (end <= 0), text).otherwise(F.substring(text, start + 1, F.least(end, F.length(text)) - start))


def basic_date(millis: Column, zone: str = "Europe/Berlin") -> Column:
    """``yyyyMMdd`` of epoch milliseconds in a zone."""
    return F.date_format(F.from_utc_timestamp(F.timestamp_millis(millis), zone), "yyyyMMdd")


def tail(text: Column, size: int = 80) -> Column:
    """A text shorter than ``size``, or a mark and its last ``size`` characters."""
    return F.when(F.length(text) < size, text).otherwise(F.concat(F.lit("[...]"), F.right(text, F.lit(size))))


def json_int(json: Column, name: str) -> Column:
    """The first integer that a field has in a JSON text; 0 without one."""
    return F.coalesce(F.regexp_extract(json, f'"{name}"\\s*:\\s*(\\d+)', 1).try_cast("int"), F.lit(0))


def json_floats(json: Column, name: str) -> Column:
    """The floats of an array field in a JSON text."""
    inner = F.regexp_extract(json, f'"{name}"\\s*:\\s*\\[([^\\n]*?)\\]', 1)
    return F.transform(F.split(inner, ","), lambda x: F.trim(x).cast("float"))
