"""Annotations and reviews: vocabularies, one-to-one coverage, spans that do not overlap, consistent stand-ins, grounded candidates."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from .curate import first_reason

#: Length bands of grounded targets, in words.
BANDS = {"short": (2, 32), "standard": (6, 65), "detailed": (25, 120)}


def invalid_labels(df: DataFrame, key: str, vocabularies: dict[str, list[str]]) -> DataFrame:
    """``key, column, bad`` where an array column holds labels outside its vocabulary, or is missing."""
    parts = []
    for column, names in vocabularies.items():
        bad = F.array_except(column, F.array(*map(F.lit, names)))
        parts.append(df.filter(F.col(column).isNull() | (F.size(bad) > 0)).select(key, F.lit(column).alias("column"), F.coalesce(bad, F.array().cast("array<string>")).alias("bad")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def without_witness(attributes: Column, witnesses: list[str]) -> Column:
    """A label with no attribute that bears it out."""
    return ~F.arrays_overlap(attributes, F.array(*map(F.lit, witnesses)))


def mixture_priority(labels: Column, weights: dict[str, float]) -> Column:
    """Sum of the labels' weights; an unknown label weighs nothing."""
    table = F.create_map(*(x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))))
    return F.aggregate(F.transform(labels, lambda x: F.coalesce(F.try_element_at(table, x), F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)


def coverage_gaps(messages: DataFrame, reviews: DataFrame, keys: list[str]) -> DataFrame:
    """Messages without a review, reviews without a message, and messages reviewed twice: ``keys, problem``."""
    named = lambda df, problem: df.select(*keys).distinct().withColumn("problem", F.lit(problem))
    twice = reviews.groupBy(*keys).count().filter("count > 1")
    return named(messages.join(reviews, keys, "left_anti"), "no review").unionByName(named(reviews.join(messages, keys, "left_anti"), "no message")).unionByName(named(twice, "reviewed twice"))


def overlapping_spans(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Spans that begin before an earlier one of their text has ended."""
    w = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("busy_to", F.max("end").over(w)).filter("start < busy_to").drop("busy_to")


def excluded_sessions(reviews: DataFrame, session: str, action: str = "action") -> DataFrame:
    """Reviews with exclusion carried over: one excluded message excludes its session."""
    w = Window.partitionBy(session)
    return reviews.withColumn("session_excluded", F.max((F.col(action) == "exclude").cast("int")).over(w) == 1)


def review_counters(reviews: DataFrame, by: str, flags: list[str], usage: list[str]) -> DataFrame:
    """``by, n``, how many rows each flag holds in, and the sums of the usage columns (whole numbers; null counts as 0)."""
    return reviews.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), *(F.count_if(f).alias(f) for f in flags), *(F.sum(F.coalesce(F.col(u).cast("long"), F.lit(0))).alias(u) for u in usage)
    )


def inconsistent_tokens(df: DataFrame, token: str, replacement: str) -> DataFrame:
    """Placeholders that stand for more than one replacement: must be empty."""
    return df.groupBy(token).agg(F.count_distinct(replacement).alias("replacements")).filter("replacements > 1")


def machine_fields(answer: Column, names: list[str]) -> Column:
    """Map of labelled fields ``name: value`` of an answer, lower case; unlabelled answers give fields by place."""
    labelled = [F.regexp_extract(F.lower(answer), rf"\b{n.lower()}\s*[:=]\s*([^\s,;]+)", 1) for n in names]
    parts = F.split(F.lower(F.trim(answer)), r"\s*[,;]\s*")
    any_label = F.greatest(*(F.length(c) for c in labelled), F.lit(0)) > 0
    values = [F.when(any_label, F.nullif(c, F.lit(""))).otherwise(F.get(parts, F.lit(i))) for i, c in enumerate(labelled)]
    return F.create_map(*(x for n, v in zip(names, values, strict=True) for x in (F.lit(n), v)))


def same_fields(answer: Column, gold: Column, names: list[str]) -> Column:
    """Whether every field is there and equal: the checker of assignments, grids and machine states."""
    a, b = machine_fields(answer, names), machine_fields(gold, names)
    out = F.lit(True)
    for n in names:
        out = out & F.coalesce(F.element_at(a, n) == F.element_at(b, n), F.lit(False))
    return out


def same_items(answer: Column, gold: Column) -> Column:
    """Whether two comma lists hold the same items, whatever their order."""
    items = lambda t: F.array_sort(F.array_distinct(F.filter(F.transform(F.split(F.lower(t), ","), lambda x: F.trim(x)), lambda x: x != "")))
    return F.coalesce((F.size(items(answer)) > 0) & (items(answer) == items(gold)), F.lit(False))


def valid_colouring(colours: Column, nodes: Column, edges: Column, palette: list[str]) -> Column:
    """Every node has a colour of the palette, and no edge joins equal ones (``colours`` is a map, ``edges`` an array of ``a, b``)."""
    of = lambda n: F.try_element_at(colours, n)
    complete = F.forall(nodes, lambda n: F.coalesce(of(n).isin(*palette), F.lit(False)))
    return complete & F.forall(edges, lambda e: F.coalesce(of(e["a"]) != of(e["b"]), F.lit(False)))


def grounded_reason(messages: Column, target: Column, mode: Column, band: Column, state: dict[str, Column]) -> Column:
    """Ordered checks of a grounded candidate: shape, wrapper text, personal data, unsupported claims, length band."""
    clean = F.transform(messages, lambda m: F.trim(F.regexp_replace(F.coalesce(m["text"], F.lit("")), r"\s+", " ")))
    spoken = F.transform(messages, lambda m, i: (m["role"] == F.when(i % 2 == 0, "customer").otherwise("owner")) & (F.trim(F.coalesce(m["text"], F.lit(""))) != ""))
    bare = X.clean_target(target)
    combined = F.concat_ws(" ", F.array_join(clean, " "), bare)
    pii, size, words = X.personal_data_class(combined), F.size(messages), F.size(X.split_words(X.normalise(bare)))
    flag = lambda k: F.coalesce(state.get(k, F.lit(False)), F.lit(False))
    broken = X.response_violation(bare, mode, flag("calendar"), flag("messaging"), flag("invoice"), flag("amount"))
    least, most = (F.coalesce(_of(band, i), F.lit(BANDS["standard"][i])) for i in (0, 1))
    return first_reason(
        ("schema", messages.isNull() | (bare == "")), ("turn_count", ~size.between(3, 9) | (size % 2 == 0)), ("role_order", F.exists(spoken, lambda ok: ~F.coalesce(ok, F.lit(False)))),
        ("meta_or_bad_text", combined.rlike(P.WRAPPER_TEXT)), (F.concat(F.lit("privacy_"), pii), pii.isNotNull()), (F.concat(F.lit("grounding_"), broken), broken.isNotNull()),
        (F.concat(F.lit("length_"), band), ~words.between(least, most)),
    )


def _of(band: Column, which: int) -> Column:
    out = F.lit(None).cast("int")
    for name, limits in BANDS.items():
        out = F.when(band == name, limits[which]).otherwise(out)
    return out


def grounded_fold(df: DataFrame, target_cap: int = 16, context_cap: int = 2, limit: float = 0.94, size: int = 5) -> DataFrame:
    """``id, reason`` of accepted-so-far candidates ``id, family, target_key, context_key``: caps that count over all
    families and near duplicates inside one.

    Every verdict depends on all accepted rows before it, so one task reads the rows in order of id: it streams them
    and holds the accepted sketches (hashes of character n-grams), not the rows.
    """
    rows = df.select("id", "family", "target_key", "context_key").coalesce(1).sortWithinPartitions("id")

    def run(batches):
        targets, contexts, sketches = {}, {}, {}
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                text = r.target_key or ""
                sketch = frozenset(hash_of(text[i : i + size]) for i in range(len(text) - size + 1))
                reason = None
                if targets.get(r.target_key, 0) >= target_cap:
                    reason = "target_frequency_cap"
                elif contexts.get(r.context_key, 0) >= context_cap:
                    reason = "context_frequency_cap"
                else:
                    for other in sketches.get(r.family, ()):
                        a, b = len(sketch), len(other)
                        if min(a, b) >= limit * max(a, b) and (a + b == 0 or (x := len(sketch & other)) >= limit * (a + b - x)):
                            reason = "near_duplicate_target"
                            break
                if reason is None:
                    sketches.setdefault(r.family, []).append(sketch)
                    targets[r.target_key] = targets.get(r.target_key, 0) + 1
                    contexts[r.context_key] = contexts.get(r.context_key, 0) + 1
                out.append((r.id, reason))
            yield pd.DataFrame(out, columns=["id", "reason"])

    return rows.mapInPandas(run, "id long, reason string")


def hash_of(s: str) -> int:
    return int.from_bytes(hashlib.blake2b(s.encode(), digest_size=8).digest(), "big")


def advantage_series(df: DataFrame, by: list[str], order: str, reward: str, value: str, gamma: float = 0.99, lam: float = 0.95) -> DataFrame:
    """Generalised advantages of each series as ``by, steps`` (array of ``order, advantage``), walking the series backwards."""
    w = Window.partitionBy(*by).orderBy(order)
    rows = df.withColumn("delta_v", F.col(reward) + gamma * F.coalesce(F.lead(value).over(w), F.lit(0.0)) - F.col(value))
    series = rows.groupBy(*by).agg(F.reverse(F.sort_array(F.collect_list(F.struct(F.col(order).alias("order"), F.col("delta_v").cast("double").alias("d"))))).alias("s"))
    zero = F.struct(F.lit(0.0).alias("next"), F.array().cast(f"array<struct<order:{dict(df.dtypes)[order]},advantage:double>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        a = x["d"] + gamma * lam * acc["next"]
        return F.struct(a.alias("next"), F.concat(acc["out"], F.array(F.struct(x["order"].alias("order"), a.alias("advantage")))).alias("out"))

    return series.select(*by, F.aggregate("s", zero, step, lambda a: F.reverse(a["out"])).alias("steps"))
