"""Judge verdicts: blind labels, ranks, votes, batch assessments, progress and promise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hex_number

# Label orders that the hash of a case picks from.
LABEL_ORDERS = [["A", "B", "C"], ["A", "C", "B"], ["B", "A", "C"], ["B", "C", "A"], ["C", "A", "B"], ["C", "B", "A"]]
SEVERITIES, SCOPES = ("info", "minor", "major", "critical"), ("turn", "session", "batch", "corpus")


def blind_labels(case: Column, seed: Column) -> Column:
    """Three label orders for a case: a permutation by hash, and its two rotations, so each arm has each label once."""
    pick = (hex_number(F.substring(F.sha2(F.concat_ws(":", case, seed.cast("string")), 256), 1, 8)) % 6).cast("int")
    base = F.element_at(F.array(*(F.array(*map(F.lit, order)) for order in LABEL_ORDERS)), pick + 1)
    return F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda r: F.concat(F.slice(base, r + 1, 3 - r), F.slice(base, 1, r)))


def group_ranks(ranking: Column) -> Column:
    """Map of label to place (from 0) in a ranking of groups; the labels of a group share the mean of their places."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<label:string,rank:double>>").alias("out"))

    def step(acc: Column, g: Column) -> Column:
        mean = acc["at"] + (F.size(g) - 1) / 2
        return F.struct((acc["at"] + F.size(g)).alias("at"), F.concat(acc["out"], F.transform(g, lambda x: F.struct(x.alias("label"), mean.cast("double").alias("rank")))).alias("out"))

    return F.map_from_entries(F.aggregate(ranking, zero, step, lambda a: a["out"]))


def arm_ranks(passes: DataFrame, case: list[str], arm: str, rank: str) -> DataFrame:
    """Mean rank of each arm of a case over its passes, and whether it is (or shares) the best."""
    means = passes.groupBy(*case, arm).agg(F.avg(rank).alias("mean_rank"))
    return means.withColumn("best", F.col("mean_rank") == F.min("mean_rank").over(Window.partitionBy(*case)))


def pair_verdict(a: Column, b: Column, name_a: str, name_b: str) -> Column:
    return F.when(a.isNull() | b.isNull(), "missing").when(a < b, name_a).when(b < a, name_b).otherwise("tie")


def preference(wins: Column, ties: Column, total: Column) -> Column:
    return 2 * (wins + ties / 2) / F.greatest(total, F.lit(1))


def majority(votes: DataFrame, case: list[str], choice: str, order: str) -> DataFrame:
    """The commonest choice of each case, ties to the one seen first."""
    counted = votes.groupBy(*case, choice).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("seen"))
    return counted.groupBy(*case).agg(F.max_by(choice, F.struct(F.col("n"), -F.col("seen"))).alias(choice))


def clean_finding(severity: Column, scope: Column, default_scope: str = "session") -> tuple[Column, Column]:
    known = lambda c, names, other: F.when(c.isin(*names), c).otherwise(other)
    return known(severity, SEVERITIES, "major"), known(scope, SCOPES, default_scope)


def assess(sessions: DataFrame, scores: DataFrame, criteria: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """One row a session: ``scored, missing, overall, passed, error`` from a judge's scores ``session_id, criterion_id, score``.

    Scores are clamped to 0..4 and pass at their criterion's ``min_score``; unknown criteria and sessions do not count.
    A session without a score for each criterion has a critical finding and fails, and so does one that the judge left
    out. ``findings`` are the judge's own, by ``session_id, severity``.
    """
    known = scores.join(sessions.select("session_id").distinct(), "session_id", "left_semi").join(criteria.select("criterion_id", "min_score"), "criterion_id")
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(4.0), F.coalesce("score", F.lit(0.0))))
    by = known.withColumn("s", clamped).groupBy("session_id").agg(
        F.count_distinct("criterion_id").alias("scored"), F.avg("s").alias("overall"), F.bool_and(F.col("s") >= F.col("min_score")).alias("ok")
    )
    wanted = criteria.agg(F.count_distinct("criterion_id").alias("wanted")).withColumn("k", F.lit(1))
    out = sessions.select("session_id").distinct().join(by, "session_id", "left").withColumn("k", F.lit(1)).join(wanted, "k")
    if findings is not None:
        critical = findings.groupBy("session_id").agg(F.bool_or(F.col("severity") == "critical").alias("critical"))
        out = out.join(critical, "session_id", "left")
    else:
        out = out.withColumn("critical", F.lit(False))
    missing = F.col("wanted") - F.coalesce("scored", F.lit(0))
    passed = F.coalesce("ok", F.lit(False)) & (missing == 0) & ~F.coalesce("critical", F.lit(False))
    return out.select("session_id", F.coalesce("scored", F.lit(0)).alias("scored"), missing.alias("missing"), F.coalesce("overall", F.lit(0.0)).alias("overall"), passed.alias("passed"),
                      F.when(F.col("scored").isNull(), "judge omitted this session").alias("error"))


def progress(rows: DataFrame, dimension: DataFrame, by: str, correct: Column, capped: Column, seed: str) -> DataFrame:
    """Rows, seeds, accuracy and cap rate of every value of a dimension, those without rows included."""
    sums = rows.groupBy(by).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(seed).alias("seeds"), F.count_if(correct).alias("correct"), F.count_if(capped).alias("capped"))
    out = dimension.select(by).distinct().join(sums, by, "left").fillna(0, ["rows", "seeds", "correct", "capped"])
    rate = lambda c: F.when(F.col("rows") > 0, F.round(100 * F.col(c) / F.col("rows"), 1)).otherwise(0.0)
    return out.select(by, "rows", "seeds", "correct", rate("correct").alias("accuracy"), rate("capped").alias("cap_rate"))


def promise(accuracy: Column, cap_rate: Column, arm_delta: Column, recent: Column, earlier: Column) -> Column:
    """Score of 0 to 100 from four signals around 50; a null signal adds nothing."""
    points = lambda *cases: F.coalesce(_cases(cases), F.lit(0))
    total = (
        F.lit(50)
        + points((accuracy >= 75, 15), (accuracy >= 50, 5), (accuracy < 30, -15))
        + points((cap_rate <= 20, 10), (cap_rate >= 50, -10))
        + points((arm_delta > 5, 25), (arm_delta > 0, 10), (arm_delta < -10, -15))
        + points((recent > earlier + 5, 10), (recent < earlier - 10, -10))
    )
    return F.greatest(F.lit(0), F.least(F.lit(100), total))


def _cases(cases: tuple) -> Column:
    out = F.when(F.lit(False), 0)
    for hit, value in cases:
        out = out.when(hit, value)
    return out


def promise_label(score: Column) -> Column:
    return F.when(score >= 70, "Promising").when(score >= 40, "Steady").otherwise("Watch")
