"""Smaller functions: classification by terms, templates, flags, summaries, surfaces, paired draws, span agreement."""

import numpy as np
import pytest
from brightfield.functions import text as X
from brightfield.operators import align, catalog, stats
from pyspark.sql import functions as F


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()[0]


def test_terms_and_templates(spark):
    terms = {"plumbing": ["leak", "pipe"], "garden": ["lawn", "tree"]}
    assert one(spark, X.classify_terms(F.col("t"), terms), t="The pipe by the lawn, LEAKING tree tree") == "garden"
    assert one(spark, X.classify_terms(F.col("t"), terms), t="pipe and lawn") == "plumbing"
    assert one(spark, X.classify_terms(F.col("t"), terms), t="nothing") == "general_business"
    assert one(spark, X.render("{a} and {b}", {"a": F.col("t"), "b": F.lit(2)}), t="x") == "x and 2"
    with pytest.raises(ValueError):
        X.render("{a}", {"b": F.lit(1)})
    assert one(spark, X.prompt_of(F.col("p"), F.col("q"), "Go."), p="Sum 2 and 3. How many?", q="How many?") == "Sum 2 and 3. How many?\n\nGo."
    turns = F.array(F.struct(F.lit("user").alias("role"), F.lit("hi").alias("text")), F.struct(F.lit("x").alias("role"), F.lit("yo").alias("text")))
    assert one(spark, X.spoken_history(turns, {"user": "Customer"}), t="") == "Customer: hi\nx: yo"


def test_flags_and_tokens(spark):
    text = 'intro ⟦LOOP | trace: 2 | start: "again and" | end: "again"⟧ more ⟦NONE⟧'
    got = [tuple(f) for f in one(spark, X.flag_blocks(F.col("t")), t=text)]
    assert got == [("LOOP", "2", "again and", "again"), ("NONE", None, None, None)]
    offsets = F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((0, 3), (3, 6), (7, 9))))
    assert tuple(one(spark, X.token_range(offsets, F.lit(2), F.lit(8)), t="")) == (0, 2)
    assert one(spark, X.token_range(offsets, F.lit(6), F.lit(7)), t="") is None


def test_summaries(spark):
    df = spark.createDataFrame([(v,) for v in (5, 1, 4, 2)], "v int")
    r = stats.coordinate_summary(df, "v").first()
    assert (r.n, r["mean"], r.upper_median) == (4, 3.0, 4)
    log = spark.createDataFrame([("r", 1, 2.0), ("r", 2, 4.0), ("r", 3, 3.0)], "run string, step int, loss double")
    s = catalog.log_summary(log, ["run"], "step", ["loss"]).first()
    assert (s.first_step, s.last_step, s.loss_first, s.loss_last, s.loss_max) == (1, 3, 2.0, 3.0, 4.0) and s.loss_std == pytest.approx(np.std([2, 4, 3]))
    assert catalog.over_budget(log, "loss", "step", 0.9).count() == 2
    assert catalog.fallback_series(log, log.withColumn("run", F.lit("q")).union(log), ["run"]).count() == 6
    assert one(spark, catalog.run_id(F.lit("eval"), F.to_timestamp(F.col("t"))), t="2024-01-02 03:04:05") == "20240102T030405-eval"


def test_surface_and_transfer(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 2))
    y = rng.random(300) < 1 / (1 + np.exp(-(x[:, 0] - 0.5 * x[:, 1] + x[:, 0] * x[:, 1])))
    df = spark.createDataFrame([(float(a), float(b), bool(c)) for (a, b), c in zip(x, y)], "a double, b double, y boolean")
    model = stats.fit_surface(df, ["a", "b"], [("a", "b")], "y", ridge=0.1)
    want = stats.fit_logistic(np.column_stack([np.ones(300), x, x[:, 0] * x[:, 1]]), y.astype(float), ridge=0.1)
    assert [model.intercept, *model.coefficients] == pytest.approx(list(want), abs=1e-4)
    rows = spark.createDataFrame([(i, i % 2, bool(c), [float(v) for v in r]) for i, (r, c) in enumerate(zip(x + np.outer(y, [2, 2]), y))], "id long, half int, p boolean, v array<double>")
    assert stats.transfer(rows, F.col("half") == 0, F.col("half") == 1, "id", "v", F.col("p")).first().auroc > 0.85


def test_paired_bootstrap(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(d), bool(rng.random() < 1 / (1 + np.exp(d - 3))), bool(rng.random() < 1 / (1 + np.exp(d - 5)))) for i, d in enumerate(np.repeat(np.arange(1, 9), 40))]
    df = spark.createDataFrame(rows, "id long, depth int, a boolean, b boolean")
    got = stats.paired_bootstrap(df.select("id", "depth", F.col("a").alias("hit")), df.select("id", F.col("b").alias("hit")), "id", "depth", "hit", 40)
    assert got.count() == 40 and 1 < got.agg(F.percentile("delta", F.lit(0.5))).first()[0] < 3


def test_span_agreement_and_pairs(spark):
    left = spark.createDataFrame([("t", 0, 0, 10, "a"), ("t", 1, 20, 30, "a"), ("t", 2, 50, 60, "b")], "t string, no long, start long, end long, class string")
    right = spark.createDataFrame([("t", 0, 1, 11, "a"), ("t", 1, 22, 28, "b"), ("t", 2, 90, 95, "b")], "t string, no long, start long, end long, class string")
    matched = align.match_spans(left, right, ["t"])
    r = align.span_agreement(matched, left, right, ["t"]).first()
    assert (r.matched, r.class_conf, r.a_only, r.b_only, r.agreement, r.drift_median) == (1, 1, 1, 1, pytest.approx(1 / 3), 1)
    a = spark.createDataFrame([(1, "Yes "), (2, "x"), (3, ""), (4, "p")], "n int, t string")
    b = spark.createDataFrame([(1, "yes"), (2, "y"), (3, "q"), (5, "p")], "n int, t string")
    assert [tuple(r) for r in align.preference_pairs(a, b, "n", "t").collect()] == [(2, "x", "y")]
    onsets = spark.createDataFrame([("p", "t1", 9), ("p", "t0", 7), ("p", "t0", 5), ("q", "t2", 1)], "p string, t string, at int")
    assert {r.p: tuple(r["first"]) for r in align.first_onsets(onsets, ["p", "t"], ["p"], "at").collect()} == {"p": ("t0", 5), "q": ("t2", 1)}
