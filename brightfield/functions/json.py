"""JSON out of model text and event properties."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def object_text(text: Column) -> Column:
    """The JSON object in a reply: without code fences; whole, or from the first brace to the last. Null if neither parses."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"(?i)^```(?:json)?\s*", ""), r"\s*```$", ""))
    inner = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    valid = lambda t: F.when(t.startswith("{") & F.try_parse_json(t).isNotNull(), t)
    return F.coalesce(valid(bare), valid(inner))


def authored(content: Column, reasoning: Column) -> Column:
    return F.coalesce(object_text(content), object_text(reasoning))


def path_value(js: Column, path: str) -> Column:
    """Value at a dotted path; null where a level is missing or no object."""
    return F.get_json_object(js, "$." + path)


def classification(text: Column) -> Column:
    """``topic, confidence, reasoning`` of a reply, with defaults."""
    js = object_text(text)
    return F.struct(
        F.coalesce(path_value(js, "topic"), F.lit("unknown")).alias("topic"),
        F.coalesce(path_value(js, "confidence").try_cast("double"), F.lit(0.0)).alias("confidence"),
        F.coalesce(path_value(js, "reasoning"), F.lit("")).alias("reasoning"),
    )


def safe_number(value: Column) -> Column:
    """A number that JSON can hold: null for NaN and the infinities."""
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def timestamp(text: Column) -> Column:
    """An ISO time, with Z or an offset (UTC without); null where the text is none."""
    zoned = F.regexp_replace(F.trim(text), r"[zZ]$", "+00:00")
    return F.when(zoned.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?([+-]\d{2}:?\d{2})?)?$"), F.try_to_timestamp(zoned))
