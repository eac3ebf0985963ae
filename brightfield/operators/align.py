"""Pairing and alignment: rank pairs, complete groups, contrast pairs, spans."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import running

#: Which outcome classes are paired first.
CONTRASTS = [("correct", "cap"), ("correct", "wrong"), ("cap", "wrong"), ("correct", "correct"), ("cap", "cap"), ("wrong", "wrong")]
MATCH = 0.5


def outcome(correct: Column, truncated: Column) -> Column:
    return F.when(correct, "correct").when(truncated, "cap").otherwise("wrong")


def rank_pairs(df: DataFrame, by: list[str], win: Column, length: str, id_: str) -> DataFrame:
    """The k-th shortest row that wins with the k-th shortest that loses, in each group; what has no partner is left out."""
    rows = df.select(*by, win.alias("win"), F.col(length).alias("len"), F.col(id_).alias("id")).filter("win IS NOT NULL")
    ranked = rows.withColumn("k", F.row_number().over(Window.partitionBy(*by, "win").orderBy("len", "id")))
    side = lambda flag, name: ranked.filter(F.col("win") == flag).select(*by, "k", F.col("id").alias(f"{name}_id"), F.col("len").alias(f"{name}_len"))
    return side(True, "win").join(side(False, "lose"), [*by, "k"])


def complete_groups(df: DataFrame, key: list[str], arm: str, arms: list, order: list[Column], value: str) -> DataFrame:
    """Keys that have every arm, the last value of each arm side by side."""
    last = df.filter(F.col(arm).isin(arms)).groupBy(*key, arm).agg(F.max_by(value, F.struct(*order)).alias("v"))
    wide = last.groupBy(*key).pivot(arm, arms).agg(F.first("v"))
    return wide.filter(" AND ".join(f"`{a}` IS NOT NULL" for a in arms))


def contrast_pairs(df: DataFrame, by: list[str], class_: str, id_: str) -> DataFrame:
    """Pairs inside each group, unlike classes before like ones; a row without a partner comes with a null.

    The number of rows of each class decides how many pairs of a kind there are, so places in the classes pair up
    without walking the rows.
    """
    ranked = df.select(*by, F.col(class_).alias("c"), F.col(id_).alias("id")).withColumn("k", F.row_number().over(Window.partitionBy(*by, "c").orderBy("id")))
    sizes = ranked.groupBy(*by).pivot("c", ["correct", "cap", "wrong"]).count().fillna(0)
    used = {c: F.lit(0).cast("long") for c in ("correct", "cap", "wrong")}
    plans = []
    for no, (a, b) in enumerate(CONTRASTS):
        left_a, left_b = F.col(a) - used[a], F.col(b) - used[b]
        pairs = F.least(left_a, left_b) if a != b else F.floor(left_a / 2)
        plans.append(F.struct(F.lit(no).alias("kind"), F.lit(a).alias("a"), F.lit(b).alias("b"), used[a].alias("from_a"), used[b].alias("from_b"), pairs.alias("pairs")))
        used[a] = used[a] + (pairs if a != b else 2 * pairs)
        if a != b:
            used[b] = used[b] + pairs
    plan = sizes.select(*by, F.explode(F.array(*plans)).alias("plan_row")).select(*by, "plan_row.*").filter("pairs > 0")
    plan = plan.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pairs") - 1)))
    same = F.col("a") == F.col("b")
    plan = plan.select(*by, "kind", "i", "a", "b", F.when(same, F.col("from_a") + 2 * F.col("i") + 1).otherwise(F.col("from_a") + F.col("i") + 1).alias("ka"),
                       F.when(same, F.col("from_a") + 2 * F.col("i") + 2).otherwise(F.col("from_b") + F.col("i") + 1).alias("kb"))
    left = ranked.select(*by, F.col("c").alias("a"), F.col("k").cast("long").alias("ka"), F.col("id").alias("left_id"))
    right = ranked.select(*by, F.col("c").alias("b"), F.col("k").cast("long").alias("kb"), F.col("id").alias("right_id"))
    return plan.join(left, [*by, "a", "ka"]).join(right, [*by, "b", "kb"]).select(*by, "kind", F.col("a").alias("left_class"), F.col("b").alias("right_class"), "left_id", "right_id")


def hull_overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Common length over the length of the hull of two spans."""
    hull = F.greatest(a1, b1) - F.least(a0, b0)
    return F.when(hull > 0, F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0)) / hull).otherwise(0.0)


def span_candidates(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Pairs of spans ``start, end, class`` of one key that overlap or contain one another, with their score."""
    a = left.select(*key, *(F.col(c).alias(f"l_{c}") for c in ("no", "start", "end", "class")))
    b = right.select(*key, *(F.col(c).alias(f"r_{c}") for c in ("no", "start", "end", "class")))
    inside = ((F.col("l_start") <= F.col("r_start")) & (F.col("r_end") <= F.col("l_end"))) | ((F.col("r_start") <= F.col("l_start")) & (F.col("l_end") <= F.col("r_end")))
    score = hull_overlap(F.col("l_start"), F.col("l_end"), F.col("r_start"), F.col("r_end"))
    return a.join(b, key).withColumn("inside", inside).withColumn("score", F.when(inside, F.greatest(score, F.lit(MATCH))).otherwise(score)).filter(F.col("score") >= MATCH)


def match_spans(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Greedy one-to-one matching in order of the left spans: ``kind`` is matched, class_conf, a_only or b_only.

    A left span takes the best free right span of its class; failing that, the first free one of another class in its
    place. Only pairs that can match reach the fold, which runs for each key by itself.
    """
    found = span_candidates(left, right, key).select(*key, F.col("l_no").alias("no"), F.struct("r_no", F.col("score"), (F.col("l_class") == F.col("r_class")).alias("same")).alias("c"))
    options = found.groupBy(*key, "no").agg(F.sort_array(F.collect_list("c")).alias("options"))
    rows = left.select(*key, "no").join(options, [*key, "no"], "left").withColumn("side", F.lit("a"))
    both = rows.unionByName(right.select(*key, "no").withColumn("side", F.lit("b")), allowMissingColumns=True)
    names = [*key, "kind", "left_no", "right_no", "score"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        head = [pdf[k].iloc[0] for k in key]
        free, out = set(pdf.loc[pdf["side"] == "b", "no"]), []
        for r in pdf[pdf["side"] == "a"].sort_values("no").itertuples():
            options = [c for c in (r.options if r.options is not None else []) if c["r_no"] in free]
            like = [c for c in options if c["same"]]
            best = max(like, key=lambda c: (c["score"], -c["r_no"])) if like else None
            other = options[0] if options and not like else None
            if best or other:
                free.discard((best or other)["r_no"])
            kind = "matched" if best else "class_conf" if other else "a_only"
            out.append((*head, kind, r.no, (best or other or {"r_no": None})["r_no"], (best or other or {"score": None})["score"]))
        out += [(*head, "b_only", None, n, None) for n in sorted(free)]
        return pd.DataFrame(out, columns=names).astype({"left_no": "Int64", "right_no": "Int64"})

    types = dict(left.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in key) + ", kind string, left_no long, right_no long, score double"
    return both.groupBy(*key).applyInPandas(run, schema)


def agreement(left: DataFrame, right: DataFrame, key: list[str], value: str) -> DataFrame:
    """One row: keys in both, share of equal values, and flips either way (booleans)."""
    joined = left.select(*key, F.col(value).alias("x")).join(right.select(*key, F.col(value).alias("y")), key)
    return joined.agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("x") == F.col("y")).cast("double")).alias("agreement"),
        F.count_if(F.col("x") & ~F.col("y")).alias("lost"), F.count_if(~F.col("x") & F.col("y")).alias("gained"),
    )


def span_agreement(matched: DataFrame, left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """One row: pairs of each kind, the share of matched spans among matched and one-sided ones, and boundary drift.

    Pairs that disagree in class are left out of the share. Drift quantiles are elements of the sorted drifts.
    """
    kinds = matched.agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("matched", "class_conf", "a_only", "b_only"))).withColumn("k", F.lit(1))
    a = left.select(*key, F.col("no").alias("left_no"), F.col("start").alias("s0"), F.col("end").alias("e0"))
    b = right.select(*key, F.col("no").alias("right_no"), F.col("start").alias("s1"), F.col("end").alias("e1"))
    pairs = matched.filter("kind = 'matched'").join(a, [*key, "left_no"]).join(b, [*key, "right_no"])
    drift = pairs.select(F.explode(F.array(F.abs(F.col("s0") - F.col("s1")), F.abs(F.col("e0") - F.col("e1")))).alias("d"))
    # counted values with the number below each: an element of the sorted drifts without sorting them all in one place
    counted = running(drift.groupBy("d").agg(F.count(F.lit(1)).alias("m")), [F.col("d")], {"below": "m"}, "drifts")
    counted = counted.withColumn("k", F.lit(1)).join(drift.agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.lit(1)), "k")
    place = lambda q: F.least(F.col("n") - 1, F.floor(F.col("n") * q))
    at = lambda q: F.max(F.when((F.col("below") <= place(q)) & (place(q) < F.col("below") + F.col("m")), F.col("d")))
    drifts = counted.agg(at(0.5).alias("drift_median"), at(0.9).alias("drift_p90")).withColumn("k", F.lit(1))
    share = F.col("matched") / F.nullif(F.col("matched") + F.col("a_only") + F.col("b_only"), F.lit(0))
    return kinds.join(drifts, "k").withColumn("agreement", share).drop("k")


def preference_pairs(chosen: DataFrame, rejected: DataFrame, place: str, text: str) -> DataFrame:
    """Rows at the same place side by side, both with a text and not the same one but for case and white space."""
    from ..functions.text import normalise

    both = chosen.select(place, F.col(text).alias("chosen")).join(rejected.select(place, F.col(text).alias("rejected")), place)
    some = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    return both.filter(some("chosen") & some("rejected") & (normalise(F.col("chosen")) != normalise(F.col("rejected"))))


def pointer(source: Column, **columns: Column) -> Column:
    """What names a row elsewhere: its source and the columns that find it there."""
    return F.struct(source.alias("source"), *(c.alias(k) for k, c in columns.items()))


def first_onsets(positions: DataFrame, trace: list[str], prompt: list[str], at: str) -> DataFrame:
    """The earliest position of each trace, then the first trace of each prompt."""
    first = positions.groupBy(*trace).agg(F.min(at).alias(at))
    return first.groupBy(*prompt).agg(F.min(F.struct(*[c for c in trace if c not in prompt], F.col(at))).alias("first"))
