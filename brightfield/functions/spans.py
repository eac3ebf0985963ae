"""Character spans: resolving quotes, substitutions, stable pseudonyms."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SPAN = T.StructType([T.StructField("status", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def find_span(text: str, start: str, end: str) -> tuple[str, int, int]:
    """Where a span given by its first and last words stands.

    The first place of the opening quote that a closing quote follows counts; if there is none, the same with white
    space left out (``OK-NORM``). Paraphrases stay unresolved. An opening quote has a closing quote after it exactly if
    the text's last closing quote begins late enough, so the first opening quote decides.
    """
    start, end = (start or "").strip(), (end or "").strip()
    if start and end:
        a = text.find(start)
        b = text.find(end, a + len(start)) if a >= 0 else -1
        if b >= 0:
            return "OK", a, b + len(end)
        places = [i for i, c in enumerate(text) if not c.isspace()]
        bare, s, e = "".join(text.split()), "".join(start.split()), "".join(end.split())
        a = bare.find(s)
        b = bare.find(e, a + len(s)) if a >= 0 else -1
        if b >= 0:
            return "OK-NORM", places[a], places[b + len(e) - 1] + 1
    return "UNRESOLVED", -1, -1


@F.pandas_udf(_SPAN)
def resolve_span(text: pd.Series, start: pd.Series, end: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([find_span(t or "", a, b) for t, a, b in zip(text, start, end, strict=True)], columns=["status", "start", "end"])


def substitute(text: Column, spans: Column) -> Column:
    """``text`` with each span of an array of ``start, end, replacement`` replaced; null if two spans overlap or one leaves the text."""
    ordered = F.sort_array(spans)
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"), F.lit(True).alias("ok"))

    def step(acc: Column, s: Column) -> Column:
        ok = acc["ok"] & (s["start"] >= acc["at"]) & (s["end"] >= s["start"]) & (s["end"] <= F.length(text))
        return F.struct(s["end"].cast("int").alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, (s["start"] - acc["at"]).cast("int")), s["replacement"]).alias("out"), ok.alias("ok"))

    return F.aggregate(ordered, zero, step, lambda a: F.when(a["ok"], F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text)))))


@F.pandas_udf(T.StringType())
def same_shape(source: pd.Series) -> pd.Series:
    """Letters and digits replaced by others of their kind, chosen by the hash of the whole; other characters stay."""

    def one(s: str) -> str:
        picks = hashlib.sha256(f"shape\x00{s}".encode()).digest()
        kinds = {"d": "0123456789", "u": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "l": "abcdefghijklmnopqrstuvwxyz"}
        out, k = [], 0
        for c in s:
            kind = "d" if c.isdigit() else "u" if c.isalpha() and c.isupper() else "l" if c.isalpha() else ""
            if kind:
                out.append(kinds[kind][picks[k % 32] % len(kinds[kind])])
                k += 1
            else:
                out.append(c)
        made = "".join(out)
        return made if made != s or not s else made[:-1] + ("1" if made[-1] != "1" else "2")

    return source.map(one, na_action="ignore")


def pseudonym(category: Column, source: Column) -> Column:
    """A stable stand-in: a mail address, a name from a list, or a text of the same shape."""
    pick = (F.conv(F.substring(F.sha2(F.concat(category, F.lit("\x00"), source), 256), 1, 8), 16, 10).cast("long") % 10_000).cast("int")
    names = F.array(*map(F.lit, ("Alex Reed", "Jordan Lane", "Sam Brook", "Casey Hill", "Robin Vale", "Morgan Field", "Jamie Stone", "Taylor Marsh")))
    return F.when(category == "EMAIL", F.format_string("customer%04d@example.com", pick)).when(category == "PERSON_NAME", F.element_at(names, pick % 8 + 1)).otherwise(same_shape(source))
