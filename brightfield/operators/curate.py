"""Text curation: ordered rejection reasons, duplicates, frequency caps."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from .ordered import fold


def first_reason(*rules: tuple[str | Column, Column]) -> Column:
    """Reason of the first rule that holds, or null. Null conditions do not hold."""
    out = None
    for name, hit in rules:
        value = name if isinstance(name, Column) else F.lit(name)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def text_reason(text: Column, least: int = 8, most: int = 63) -> Column:
    """Why a text is rejected: wrapper text, a personal-data class, or its length in words; null if it is accepted."""
    pii = X.personal_data_class(text)
    words = F.greatest(F.lit(1), F.size(X.split_words(text)))
    return first_reason(
        ("empty", F.trim(F.coalesce(text, F.lit(""))) == ""),
        ("bad_text", text.rlike(P.WRAPPER_TEXT)),
        (pii, pii.isNotNull()),
        ("length", ~words.between(least, most)),
    )


def candidate_reason(messages: Column, target: Column, least: Column, most: Column, names: list[str] = ()) -> Column:
    """Ordered checks of a conversation candidate: ``messages`` is an array of ``role, text`` that a target must answer."""
    size = F.size(messages)
    clean = F.transform(messages, lambda m: F.trim(F.regexp_replace(F.coalesce(m["text"], F.lit("")), r"\s+", " ")))
    # customer and owner take turns, and nobody says nothing
    spoken = F.transform(messages, lambda m, i: (X.normalise(F.coalesce(m["role"], F.lit(""))) == F.when(i % 2 == 0, "customer").otherwise("owner")) & (F.trim(F.coalesce(m["text"], F.lit(""))) != ""))
    wrong = F.exists(spoken, lambda ok: ~ok)
    bare = F.trim(F.regexp_replace(F.trim(F.regexp_replace(target, r"\s+", " ")), P.SPEAKER_PREFIX, ""))
    combined = F.concat_ws(" ", F.array_join(clean, " "), bare)
    pii = X.personal_data_class(combined)
    words = F.greatest(F.lit(1), F.size(X.split_words(bare)))
    return first_reason(
        ("schema", messages.isNull() | target.isNull()),
        ("turn_count", ~size.isin(3, 5, 7)),
        ("role_order", wrong),
        ("bad_text", (bare == "") | bare.rlike(P.WRAPPER_TEXT) | F.exists(clean, lambda t: t.rlike(P.WRAPPER_TEXT))),
        (pii, pii.isNotNull()),
        ("real_customer_name_overlap", X.let(X.normalise(combined), lambda t: F.exists(F.array(*map(F.lit, names)).cast("array<string>"), lambda n: t.contains(n)))),
        ("length", ~words.between(least, most)),
    )


def exact_first(df: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """``df`` with ``duplicate_of_first``: whether an earlier row has the same key (by partial minimum, so any group size will do)."""
    keyed = df.withColumn("dup_key", F.sha2(key, 256))
    first = keyed.groupBy("dup_key").agg(F.min(F.struct(*order)).alias("dup_first"))
    joined = keyed.join(first, "dup_key")
    return joined.withColumn("duplicate_of_first", F.struct(*order) > F.col("dup_first")).drop("dup_key", "dup_first")


def near_duplicate_fold(df: DataFrame, cap: int = 8, limit: float = 0.90, size: int = 5) -> DataFrame:
    """``id, reason`` of rows ``id, target, combined`` in order of id: a cap on equal targets, then near duplicates.

    A row is capped once ``cap`` equal targets were accepted, and is a near duplicate if its character n-grams reach
    the Jaccard limit with an accepted row of its bucket (size of its set by 20, first 12 characters of the target).
    Both depend on what was accepted before. Rows that can meet share the target's first characters, so the fold runs
    in parallel over these; an accepted row is found by the first of its n-grams, so a row meets those that can be near.
    A task holds the accepted rows of one such head: that is the bound, and heads that a large part of all rows share
    (an empty target among them) are its limit.
    """
    rows = df.select("id", X.normalise(F.col("target")).alias("target_key"), X.normalise(F.col("combined")).alias("combined"))
    rows = rows.withColumn("head", F.substring("target_key", 1, 12))

    def step(state: dict, r: dict) -> dict:
        text = r["combined"]
        sketch = frozenset(text[i : i + size] for i in range(len(text) - size + 1))
        bucket = len(sketch) // 20
        # near sets share one of the first n - limit n + 1 n-grams of either, in one order of all
        first = sorted(sketch)[: len(sketch) - math.ceil(limit * len(sketch)) + 1] or [""]
        reason = None
        if state["targets"].get(r["target_key"], 0) >= cap:
            reason = "target_frequency_cap"
        else:
            met = {i for g in first for i in state["places"].get((bucket, g), ())}
            for i in met:
                other = state["sets"][i]
                a, b = len(sketch), len(other)
                if min(a, b) >= limit * max(a, b) and (a + b == 0 or (x := len(sketch & other)) >= limit * (a + b - x)):
                    reason = "near_duplicate"
                    break
        if reason is None:
            for g in first:
                state["places"].setdefault((bucket, g), []).append(len(state["sets"]))
            state["sets"].append(sketch)
            state["targets"][r["target_key"]] = state["targets"].get(r["target_key"], 0) + 1
        return {"id": r["id"], "reason": reason}

    return fold(rows, ["head"], ["id"], lambda: {"targets": {}, "places": {}, "sets": []}, step, "id long, reason string")


def frequency_cap(df: DataFrame, key: Column, order: list[Column], cap: int) -> DataFrame:
    """The first ``cap`` rows of each key in order."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("cap_no", F.row_number().over(w)).filter(F.col("cap_no") <= cap).drop("cap_no")
