"""Findings over conversations, their summary, and the release gate.

Turns are rows ``session_id, turn, role, text``. Findings are rows ``source, criterion_id, message, severity, scope,
session_id, turn_indices, evidence``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


@dataclass(frozen=True)
class Rule:
    """A finding for each assistant turn that a regular expression matches."""

    pattern: str
    message: str
    severity: str = "major"
    criterion_id: str = "grounding"


def _finding(criterion: str | Column, message: Column, severity: str, scope: str, session: Column, turns: Column, evidence: Column) -> list[Column]:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return [
        F.lit("deterministic").alias("source"), lit(criterion).alias("criterion_id"), message.alias("message"), lit(severity).alias("severity"),
        F.lit(scope).alias("scope"), session.cast("string").alias("session_id"), turns.cast("array<long>").alias("turn_indices"), evidence.alias("evidence"),
    ]


def trajectory_findings(turns: DataFrame, rules: tuple[Rule, ...] = ()) -> DataFrame:
    """No assistant turn; empty turns; exact repeats of an earlier turn; rule hits. Empty turns have no other finding."""
    none, session, turn = F.array().cast("array<long>"), F.col("session_id"), F.col("turn")
    silent = turns.groupBy("session_id").agg(F.max((F.col("role") == "assistant").cast("int")).alias("spoke")).filter("coalesce(spoke, 0) = 0")
    silent = silent.select(*_finding("response_validity", F.lit("The subject produced no assistant response."), "critical", "session", session, none, F.lit(None).cast("string")))
    said = turns.filter("role = 'assistant'").select("session_id", "turn", F.coalesce("text", F.lit("")).alias("text"), X.normalise(F.coalesce("text", F.lit(""))).alias("norm"))
    first = F.min("turn").over(Window.partitionBy("session_id", "norm"))
    said = said.withColumn("first", first)
    empty = said.filter("norm = ''").select(*_finding("response_validity", F.lit("The subject produced an empty response."), "critical", "session", session, F.array(turn), F.lit(None).cast("string")))
    spoken = said.filter("norm <> ''")
    repeat = spoken.filter("turn > first").select(
        *_finding("conversation_coherence", F.lit("The subject repeated an earlier assistant response exactly."), "major", "session", session, F.array("first", "turn"), F.col("text"))
    )
    out = silent.unionByName(empty).unionByName(repeat)
    for rule in rules:
        hit = spoken.filter(F.col("text").rlike(rule.pattern))
        out = out.unionByName(hit.select(*_finding(rule.criterion_id, F.lit(rule.message), rule.severity, "session", session, F.array(turn), F.col("text"))))
    return out


def phrase_reuse(turns: DataFrame, size: int = 4, least: int = 3) -> DataFrame:
    """Phrases of ``size`` words that the assistant says in ``least`` sessions or more: ``phrase, sessions, example``.

    The example is the first turn that holds the phrase in the session with the smallest id.
    """
    said = turns.filter("role = 'assistant' AND text IS NOT NULL").select("session_id", "turn", "text")
    grams = said.select("session_id", "turn", F.explode(F.array_distinct(X.ngrams(X.tokens(X.normalise(F.col("text"))), size))).alias("phrase"))
    # one row a phrase and session before sessions are counted
    by_session = grams.groupBy("phrase", "session_id").agg(F.min("turn").alias("turn"))
    shared = by_session.groupBy("phrase").agg(F.count(F.lit(1)).alias("sessions"), F.min(F.struct("session_id", "turn")).alias("at")).filter(F.col("sessions") >= least)
    named = shared.select("phrase", "sessions", F.col("at.session_id").alias("session_id"), F.col("at.turn").alias("turn"))
    texts = said.groupBy("session_id", "turn").agg(F.min("text").alias("example"))
    return named.join(texts, ["session_id", "turn"], "left").select("phrase", "sessions", "example")


def batch_findings(turns: DataFrame, size: int = 4, least: int = 3) -> DataFrame:
    reused = phrase_reuse(turns, size, least)
    message = F.concat(F.lit("A phrase recurs across "), F.col("sessions").cast("string"), F.lit(" distinct sessions."))
    return reused.select(*_finding("cross_session_reuse", message, "minor", "batch", F.lit(None), F.array().cast("array<long>"), F.col("example")))


def findings(turns: DataFrame, rules: tuple[Rule, ...] = (), size: int = 4, least: int = 3) -> DataFrame:
    return trajectory_findings(turns, rules).unionByName(batch_findings(turns, size, least))


def counts(found: DataFrame) -> DataFrame:
    """``kind, name, n``: findings in total, by criterion and by severity, and the sessions that have any."""
    total = found.agg(F.count(F.lit(1)).alias("n")).select(F.lit("total").alias("kind"), F.lit("").alias("name"), "n")
    sessions = found.agg(F.count_distinct("session_id").alias("n")).select(F.lit("sessions_with_findings").alias("kind"), F.lit("").alias("name"), "n")
    by = lambda c, kind: found.groupBy(c).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), F.col(c).alias("name"), "n")
    return total.unionByName(sessions).unionByName(by("criterion_id", "by_criterion")).unionByName(by("severity", "by_severity"))


def report(turns: DataFrame, found: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """One row: conversations, judged sessions, mean score, pass rate, critical findings, sessions with findings and their rate.

    ``verdicts`` are rows ``session_id, score, passed`` of an outside judge; without them mean and rate are null. The
    rate of sessions with findings is 0 where there are no sessions.
    """
    sessions = turns.select(F.col("session_id").cast("string").alias("session_id")).distinct()
    hit = found.filter("session_id IS NOT NULL").select("session_id").distinct().join(sessions, "session_id", "left_semi")
    one = sessions.agg(F.count(F.lit(1)).alias("trajectory_count")).withColumn("k", F.lit(1))
    bad = found.agg(F.count_if(F.col("severity") == "critical").alias("critical_failure_count")).withColumn("k", F.lit(1))
    with_findings = hit.agg(F.count(F.lit(1)).alias("sessions_with_findings")).withColumn("k", F.lit(1))
    out = one.join(bad, "k").join(with_findings, "k")
    if verdicts is None:
        out = out.withColumns({"judged_session_count": F.lit(0).cast("long"), "mean_session_score": F.lit(None).cast("double"), "session_pass_rate": F.lit(None).cast("double")})
    else:
        judged = verdicts.agg(F.count(F.lit(1)).alias("judged_session_count"), F.avg("score").alias("mean_session_score"), F.avg(F.col("passed").cast("double")).alias("session_pass_rate"))
        out = out.join(judged.withColumn("k", F.lit(1)), "k")
    rate = F.when(F.col("trajectory_count") > 0, F.col("sessions_with_findings") / F.col("trajectory_count")).otherwise(0.0)
    return out.withColumn("first_failure_rate", rate).drop("k")


def gate(summary: DataFrame, max_critical: int = 0, min_mean: float = 3.0, min_pass: float = 0.8, max_first_failure: float | None = None, overseer: str | None = None) -> DataFrame:
    """``summary`` with ``gate_passed``; a null measure or a null limit skips its check, no conversation fails."""
    ok = (F.col("trajectory_count") > 0) & (F.col("critical_failure_count") <= max_critical)
    ok &= F.coalesce(F.col("mean_session_score") >= min_mean, F.lit(True)) & F.coalesce(F.col("session_pass_rate") >= min_pass, F.lit(True))
    if max_first_failure is not None:
        ok &= F.col("first_failure_rate") <= max_first_failure
    return summary.withColumn("gate_passed", ok & F.lit(overseer not in ("guard", "fail", "unknown")))


def baseline_delta(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Differences of the four compared measures; null where either side is."""
    keys = ["mean_session_score", "session_pass_rate", "first_failure_rate", "critical_failure_count"]
    old = baseline.select(F.lit(1).alias("k"), *(F.col(c).alias(f"old_{c}") for c in keys))
    return current.withColumn("k", F.lit(1)).join(old, "k").select(*((F.col(c) - F.col(f"old_{c}")).alias(c) for c in keys))
