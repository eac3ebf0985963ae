"""Prompt fields, compliance, audits, refusals, repeats and capture positions."""

import pytest
from brightfield.operators import prompts as P
from pyspark.sql import functions as F


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()[0]


def test_prompt_fields(spark):
    rows = [(i, f"Use case: mail {i}\n\nLength: approximately {n} tokens\n\nEmdash: not allowed", "a — b" if i else "a") for i, n in enumerate((50, 100, 400))] + [(9, "free", "—")]
    df = spark.createDataFrame(rows, "i int, prompt string, reply string")
    got = P.with_target_length(df, "prompt", 80, 50, 100).orderBy("i").collect()
    assert [(r.original_target_tokens, r.use_case, "approximately 80 tokens" in r.prompt) for r in got] == [(50, "mail 0", True), (100, "mail 1", True)]
    with pytest.raises(ValueError):
        P.with_target_length(df, "prompt", 80, 400, 400)
    assert P.dash_violations(df, "prompt", "reply").first().rate == pytest.approx(2 / 3)
    assert P.dash_violations(df.filter("i = 9"), "prompt", "reply").first().rate == 0.0
    kept = spark.range(400).select(P.assemble(F.lit("p"), F.lit("u"), F.lit("s"), F.lit(5), F.lit(False), F.lit("o"), F.col("id")).contains("Outline:").cast("int").alias("k")).agg(F.avg("k")).first()[0]
    assert 0.68 < kept < 0.82


def test_audit_and_counts(spark):
    df = spark.createDataFrame([(10, 10, "x FINAL: YES", "YES"), (200, 10, "", "YES"), (100, 1000, "", "NO"), (5, 5, "FINAL: NO", "YES")], "t int, p int, d string, a string")
    got = [r.x for r in df.select(P.audit_reason(F.col("t"), F.col("p"), F.col("d"), F.col("a")).alias("x")).collect()]
    assert got == [None, "target budget 200>128", "context budget 1100>1024", "decoded target lost terminal answer"]
    assert one(spark, P.token_count(F.col("t")), t=" ") == 1


def test_refusals_and_repeats(spark):
    refuse = lambda reply, asked: one(spark, P.refuses_given_detail(F.col("r"), F.col("a")), r=reply, a=asked)
    assert refuse("I have no pricing", "Friday works") and not refuse("I have no pricing", "what is the price on Friday") and not refuse("ok", "Friday")
    again = lambda reply, *recent: one(spark, P.repeats_recent(F.col("r"), F.array(*map(F.lit, recent))), r=reply)
    assert again("We will look at the window soon.", "x", "we will  look at the window soon.")
    assert again("I understand, it is about the door then", "i understand that you wait")
    assert again("I have noted the date you gave. Thanks", "I have noted the date you gave. See you")
    assert not again("short", "short") and not again("Something that is quite different here", "I understand that you wait")


def test_recent_rate(spark):
    rows = [("a", i, 10.0 * i, None if i == 9 else 2.0) for i in range(10)]
    assert P.recent_rate(spark.createDataFrame(rows, "g string, i int, n double, s double"), ["g"], "i", "n", "s", 3).first().rate == pytest.approx((80 + 70) / 2 / 2)


def test_capture_positions(spark):
    spans = spark.createDataFrame([("k", 0, 50, 60), ("k", 1, 120, 130)], "k string, no long, first long, last long")
    totals = spark.createDataFrame([("k", 400)], "k string, n_tokens long")
    got = P.capture_positions(spans, totals, "k").collect()
    tokens = [r.token for r in got if r.kind == "control"]
    assert len(tokens) == len(set(tokens)) and not {*range(50, 61), *range(120, 131)} & set(tokens)
    assert all(r.decile == r.token * 10 // 400 for r in got)
    assert {(r.kind, r.token) for r in got if r.span_no == 0 and r.kind != "control"} == {("pre_onset", 49), ("onset", 50), ("mid", 55), ("end", 60), ("lb_4", 46), ("lb_16", 34)}
    by = [(r.span_no, r.decile) for r in got if r.kind == "control"]
    assert all(by.count(x) == 4 for x in by)
    assert sorted(map(tuple, P.capture_positions(spans, totals, "k").collect())) == sorted(map(tuple, got))
