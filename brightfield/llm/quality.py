"""Quality rules per document and per host, in DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, words_of

SYMBOLS = "#*$%&|<>"
#: Rules whose failures are aggregated by host: name and the condition on a document's counts.
HOST_RULES = {
    "base": "base_failed",
    "symbols": "n_words > 0 AND 10 * n_symbols > 3 * n_words",
    "lines": "n_lines > 0 AND 10 * n_dup_lines > 3 * n_lines",
    "word_length": "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words)",
}


def document_counts(docs: DataFrame, min_words: int = 50, max_repeat_percent: int = 50, host: str = "source") -> DataFrame:
    """Counts of each document and its base verdict; one row per input row, null text as no words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(x, F.lit(" \t\x0b\x0c\r"))) > 0)
    df = docs.select(
        F.col("doc_id"),
        F.col(host).cast("string").alias("host"),
        words_of(F.col("text")).alias("w"),
        lines.alias("l"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    df = df.withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    windows = F.when(
        F.size("h") >= 3, F.transform(F.sequence(F.lit(0), F.size("h") - 3), lambda i: F.xxhash64(F.get("h", i), F.get("h", i + 1), F.get("h", i + 2)))
    ).otherwise(F.array().cast("array<long>"))
    df = df.select(
        "doc_id", "host", "n_symbols", "w",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.size("l").cast("long").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        windows.alias("g"),
    )
    # equal 3-word windows have equal hashes; those that share a hash are compared as strings (words hold no space, so the
    # joined words are unambiguous). Either meets its likes by sorting; texts without a repeat skip both sorts.
    hashed = F.transform("g", lambda t, i: F.struct(t.alias("t"), i.alias("i")))
    df = df.withColumn("s", F.when(F.size(F.array_distinct("g")) < F.size("g"), F.sort_array(hashed)))
    same = lambda x, y: F.coalesce(x["t"] == y["t"], F.lit(False))  # noqa: E731  past either end there is no row
    again = lambda c: F.filter(c, lambda x, j: same(x, F.get(c, j - 1)) | same(x, F.get(c, j + 1)))
    words = lambda x: F.concat_ws(" ", F.get("w", x["i"]), F.get("w", x["i"] + 1), F.get("w", x["i"] + 2))
    df = df.withColumn("p", F.sort_array(F.transform(again("s"), lambda x: F.struct(words(x).alias("t"), x["i"].alias("i")))))
    covered = F.array_distinct(F.flatten(F.transform(again("p"), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    df = df.withColumn("n_repeat_words", F.when(F.col("p").isNull(), F.lit(0)).otherwise(F.size(covered)).cast("long"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return df.select("doc_id", "host", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"))


def host_verdicts(counts: DataFrame, max_rate: float = 0.5, min_strength: float = 1.0, max_strength: float = 1e6) -> DataFrame:
    """One row per host: documents, failures and shrunk rate of each rule, and whether the host is rejected.

    The prior of a rule is Beta(m k, (1 - m) k): m is the rate over all documents, and k (its strength) comes from the
    variance of the hosts' rates beyond what their sizes explain. A host falls if any posterior mean is above ``max_rate``.
    """
    per_host = counts.groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), *(F.sum(F.expr(f"CAST({rule} AS BIGINT)")).alias(f"f_{k}") for k, rule in HOST_RULES.items())
    ).withColumn("one", F.lit(1))
    totals = per_host.groupBy("one").agg(
        F.avg(1 / F.col("n")).alias("inv_n"),
        *(x for k in HOST_RULES for x in (
            (F.sum(f"f_{k}") / F.sum("n")).alias(f"m_{k}"),
            F.var_pop(F.col(f"f_{k}") / F.col("n")).alias(f"v_{k}"),
        )),
    )
    both = per_host.join(totals, "one")  # totals is one row

    def rate(k: str) -> Column:
        m, spread = F.col(f"m_{k}"), F.col(f"m_{k}") * (1 - F.col(f"m_{k}"))
        between = F.col(f"v_{k}") - spread * F.col("inv_n")
        strength = F.when(between <= 0, F.lit(max_strength)).otherwise(F.least(F.greatest(spread / between - 1, F.lit(min_strength)), F.lit(max_strength)))
        return (F.col(f"f_{k}") + m * strength) / (F.col("n") + strength)

    rates = both.select("host", "n", *(f"f_{k}" for k in HOST_RULES), *(rate(k).alias(f"rate_{k}") for k in HOST_RULES))
    return rates.withColumn("host_rejected", F.expr(" OR ".join(f"rate_{k} > {max_rate}" for k in HOST_RULES)))


def quality_rules(docs: DataFrame, host: str = "source", min_words: int = 50, max_repeat_percent: int = 50, max_rate: float = 0.5) -> DataFrame:
    """Counts, base verdict, host verdict and ``kept`` of every document.

    Null text counts as empty (fails the word minimum); a null host is a host of its own; repeated rows are judged each;
    an empty table gives an empty result; other columns of ``docs`` are ignored, whatever their names.
    The counts are written once (without texts) and then read both for the host rates and for the result.
    """
    counts = cut(document_counts(docs, min_words, max_repeat_percent, host), "quality", few=True)
    hosts = host_verdicts(counts, max_rate).select(F.col("host").alias("h"), "host_rejected", *(f"rate_{k}" for k in HOST_RULES))
    joined = counts.join(hosts, F.col("host").eqNullSafe(F.col("h")), "left").drop("h")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(F.col("host_rejected"), F.lit(False)))
