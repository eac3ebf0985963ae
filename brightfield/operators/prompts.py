"""Prompt fields and replies: length requests, punctuation compliance, audits, refusals, repeats, capture positions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.hashing import sample_order
from .curate import first_reason

# Fields of a prompt, details that a customer may give, refusals that these make irrelevant, stock openings.
LENGTH_FIELD = r"Length: approximately (\d+) tokens"
GIVEN_DETAIL = (
    r"(?i)\b(?:january|february|march|april|may|june|july|august|september|october|november|december|monday|tuesday|wednesday|thursday|friday|saturday|sunday|"
    r"\d{1,2}(?:st|nd|rd|th)?|window(?:s)?|morning|afternoon|evening)\b"
)
REFUSAL = r"(?i)\b(?:pricing|inventory|cost)\b|tools? to (?:verify|confirm)"
STOCK_OPENINGS = ("i can help with that", "i understand", "that sounds good")
STOCK_FIRST_SENTENCES = ("i have noted", "i cannot verify", "i do not have", "i don't have")


def requested_tokens(prompt: Column) -> Column:
    return F.regexp_extract(prompt, LENGTH_FIELD, 1).try_cast("int")


def use_case(prompt: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(F.regexp_extract(prompt, r"Use case: ([^\n]+)", 1)), F.lit("")), F.lit("unknown"))


def with_target_length(df: DataFrame, prompt: str, target: int, least: int, most: int) -> DataFrame:
    """Rows whose requested length lies between the bounds, the request replaced by ``target``; raises under two rows."""
    rows = df.withColumn("original_target_tokens", requested_tokens(F.col(prompt))).filter(F.col("original_target_tokens").between(least, most))
    if len(rows.take(2)) < 2:
        raise ValueError("the length bounds must keep at least two rows")
    return rows.withColumn(prompt, F.regexp_replace(prompt, LENGTH_FIELD, f"Length: approximately {target} tokens")).withColumn("use_case", use_case(F.col(prompt)))


def dash_violations(df: DataFrame, prompt: str, reply: str) -> DataFrame:
    """Share of replies with a long dash among prompts that do not allow it; 0 if none asks."""
    asks = df.filter(F.col(prompt).rlike("(?i)Emdash: not allowed"))
    return asks.agg(F.coalesce(F.avg(F.col(reply).contains("—").cast("double")), F.lit(0.0)).alias("rate"))


def assemble(prompt: Column, use: Column, style: Column, length: Column, dash_allowed: Column, outline: Column, key: Column) -> Column:
    """A prompt under its flags; three quarters of the outlines, by hash of the key, are kept."""
    keep = (F.coalesce(outline, F.lit("")) != "") & (sample_order(key, "outline") < "c")
    return F.concat_ws(
        "\n\n", F.concat(F.lit("Use case: "), use), F.concat(F.lit("Style: "), style), F.concat(F.lit("Length: approximately "), length.cast("string"), F.lit(" tokens")),
        F.concat(F.lit("Emdash: "), F.when(dash_allowed, "allowed").otherwise("not allowed")), F.when(keep, F.concat(F.lit("Outline:\n"), outline)), F.concat(F.lit("Prompt:\n"), prompt),
    )


def audit_reason(target_tokens: Column, prompt_tokens: Column, decoded: Column, answer: Column, most_target: int = 128, most: int = 1024) -> Column:
    """Why a task does not fit its token budgets, or null."""
    total = prompt_tokens + target_tokens
    return first_reason(
        (F.concat(F.lit("target budget "), target_tokens.cast("string"), F.lit(f">{most_target}")), target_tokens > most_target),
        (F.concat(F.lit("context budget "), total.cast("string"), F.lit(f">{most}")), total > most),
        ("decoded target lost terminal answer", ~F.endswith(F.trim(decoded), F.concat(F.lit("FINAL: "), answer))),
    )


def token_count(text: Column) -> Column:
    """Words, at least one: the count where no tokenizer is given."""
    return F.greatest(F.lit(1), F.size(X.split_words(text)))


def refuses_given_detail(reply: Column, asked: Column) -> Column:
    """A refusal about prices or tools although the customer gave a date or a detail, and asked for no price."""
    return asked.rlike(GIVEN_DETAIL) & reply.rlike(REFUSAL) & ~asked.rlike(r"(?i)\b(?:price|cost)\b")


def repeats_recent(reply: Column, recent: Column, least: int = 24) -> Column:
    """Whether a reply equals one of the recent ones, opens with the same stock phrase, or repeats a stock first sentence."""
    starts = lambda t, options: F.greatest(*(t.startswith(o) for o in options))
    opening = lambda a, b: F.greatest(*(a.startswith(o) & b.startswith(o) for o in STOCK_OPENINGS))
    first = lambda t: F.substring_index(t, ". ", 1)

    def hit(t: Column) -> Column:
        stock = (F.length(first(t)) >= least) & starts(first(t), STOCK_FIRST_SENTENCES)
        return F.exists(F.transform(recent, X.normalise), lambda p: (p == t) | opening(t, p) | (stock & (first(t) == first(p))))

    return X.let(X.normalise(F.coalesce(reply, F.lit(""))), lambda t: (F.length(t) >= least) & hit(t))


def recent_rate(rows: DataFrame, by: list[str], order: str, amount: str, seconds: str, last: int = 8) -> DataFrame:
    """Mean of amount a second over the last rows; rows without a duration are passed over."""
    w = Window.partitionBy(*by).orderBy(F.desc(order))
    kept = rows.withColumn("age_no", F.row_number().over(w)).filter((F.col("age_no") <= last) & (F.coalesce(F.col(seconds), F.lit(0.0)) > 0))
    return kept.groupBy(*by).agg(F.avg(F.col(amount) / F.col(seconds)).alias("rate"))


def capture_positions(spans: DataFrame, totals: DataFrame, key: str, lookbacks: tuple[int, ...] = (4, 16, 64), controls: int = 4, seed: int = 0) -> DataFrame:
    """``key, span_no, kind, token, decile``: places around each token span, places before it, and controls of like depth.

    ``spans`` are ``key, no, first, last`` in tokens, ``totals`` give ``key, n_tokens``. Each span has its places before,
    at the start, in the middle and at the end; lookbacks outside all spans and not yet used; and in every decile that
    its start and lookbacks fall in, ``controls`` unused places outside all spans, drawn by hash. Keys are worked on apart.
    """
    rows = spans.join(totals, key).select(F.col(key).cast("string").alias("grp"), "no", "first", "last", "n_tokens")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import hashlib

        pdf = pdf.sort_values("no")
        n, group = int(pdf["n_tokens"].iloc[0]), pdf["grp"].iloc[0]
        busy = set().union(*(range(a, b + 1) for a, b in zip(pdf["first"], pdf["last"], strict=True)))
        depth = lambda t: min(t * 10 // max(n, 1), 9)
        out, used, around = [], set(), {}
        for r in pdf.itertuples():
            for kind, t in (("pre_onset", r.first - 1), ("onset", r.first), ("mid", (r.first + r.last) // 2), ("end", r.last)):
                if 0 <= t < n:
                    out.append((group, r.no, kind, t, depth(t)))
                    used.add(t)
            around[r.no] = {depth(r.first)}
        for r in pdf.itertuples():
            for k in lookbacks:
                t = r.first - k
                if 0 <= t < n and t not in busy and t not in used:
                    out.append((group, r.no, f"lb_{k}", t, depth(t)))
                    used.add(t)
                    around[r.no].add(depth(t))
        for r in pdf.itertuples():
            for d in sorted(around[r.no]):
                free = [t for t in range(max(d * n // 10, 1), (d + 1) * n // 10) if t not in busy and t not in used]
                free.sort(key=lambda t: hashlib.sha256(f"{seed}:{group}:{r.no}:{t}".encode()).digest())
                for t in free[:controls]:
                    out.append((group, r.no, "control", t, d))
                    used.add(t)
        return pd.DataFrame(out, columns=["grp", "span_no", "kind", "token", "decile"])

    return rows.groupBy("grp").applyInPandas(run, "grp string, span_no long, kind string, token long, decile int")
