"""Spans, reviews, checkers and the grounded fold."""

import json
import random

import numpy as np
import pytest
from brightfield.functions import json as J
from brightfield.functions import spans as S
from brightfield.operators import criteria
from brightfield.operators import review as R
from brightfield.sources import specs, tables
from pyspark.sql import functions as F


def test_span_resolution(spark):
    cases = [("a b c a d e", "a", "e", ("OK", 0, 11)), ("end start x end", "start", "end", ("OK", 4, 15)), ("the  quick\nbrown fox", "the quick", "brown fox", ("OK-NORM", 0, 20)), ("abc", "x", "c", ("UNRESOLVED", -1, -1)), ("abc", "", "c", ("UNRESOLVED", -1, -1)), (None, "a", "b", ("UNRESOLVED", -1, -1))]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, t string, a string, b string").select("i", S.resolve_span("t", "a", "b").alias("s"))
    assert {r.i: tuple(r.s) for r in df.collect()} == {i: c[3] for i, c in enumerate(cases)}


def test_substitution_and_pseudonyms(spark):
    span = "array<struct<start:int,end:int,replacement:string>>"
    df = spark.createDataFrame([("hello big world", [(10, 15, "[W]"), (0, 5, "[H]")]), ("abc", [(0, 2, "x"), (1, 3, "y")]), ("abc", []), ("abc", [(2, 9, "z")])], f"t string, s {span}")
    assert [r.x for r in df.select(S.substitute(F.col("t"), F.col("s")).alias("x")).collect()] == ["[H] big [W]", None, "abc", None]
    rows = spark.createDataFrame([("EMAIL", "a@b.c"), ("PERSON_NAME", "Jo Do"), ("ID", "AB-12 x"), ("ID", "AB-12 x")], "c string, s string").select("s", S.pseudonym(F.col("c"), F.col("s")).alias("p")).collect()
    assert rows[0].p.endswith("@example.com") and rows[2].p == rows[3].p != "AB-12 x" and rows[2].p[2] == "-" and rows[2].p[3:5].isdigit()


def test_review_checks(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "z"]), (3, None)], "k int, labels array<string>")
    assert sorted((r.k, tuple(r.bad)) for r in R.invalid_labels(df, "k", {"labels": ["a", "b"]}).collect()) == [(2, ("z",)), (3, ())]
    assert [r.x for r in df.filter("k < 3").select(R.mixture_priority(F.col("labels"), {"a": 2, "b": 0.5}).alias("x")).collect()] == [2.5, 2.0]
    messages = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "s int, m int")
    reviews = spark.createDataFrame([(1, 1, "keep"), (1, 1, "exclude"), (2, 1, "keep"), (3, 3, "keep")], "s int, m int, action string")
    assert sorted(tuple(r) for r in R.coverage_gaps(messages, reviews, ["s", "m"]).collect()) == [(1, 1, "reviewed twice"), (1, 2, "no review"), (3, 3, "no message")]
    assert {r.s: r.session_excluded for r in R.excluded_sessions(reviews, "s").collect()} == {1: True, 2: False, 3: False}
    spans = spark.createDataFrame([(1, 0, 10), (1, 2, 3), (1, 5, 6), (1, 10, 12), (2, 0, 1)], "k int, start int, end int")
    assert sorted((r.start, r.end) for r in R.overlapping_spans(spans, ["k"]).collect()) == [(2, 3), (5, 6)]
    tokens = spark.createDataFrame([("t", "a"), ("t", "a"), ("u", "a"), ("u", "b")], "t string, r string")
    assert [r.t for r in R.inconsistent_tokens(tokens, "t", "r").collect()] == ["u"]


def test_checkers(spark):
    cases = [("x: 3, y=4", "x=3; y=4", True), ("3, 4", "x: 3, y: 4", True), ("x: 3", "x: 3, y: 4", False), ("y=4, x=3", "3; 4", True)]
    df = spark.createDataFrame(cases, "a string, g string, want boolean").withColumn("got", R.same_fields(F.col("a"), F.col("g"), ["x", "y"]))
    assert all(r.got == r.want for r in df.collect())
    items = spark.createDataFrame([("b, a", "A,b", True), ("a", "a,b", False), ("", "", False)], "a string, g string, want boolean").withColumn("got", R.same_items(F.col("a"), F.col("g")))
    assert all(r.got == r.want for r in items.collect())
    graph = spark.createDataFrame([({"p": "red", "q": "blue"}, True), ({"p": "red", "q": "red"}, False), ({"p": "red"}, False), ({"p": "pink", "q": "red"}, False)], "c map<string,string>, want boolean")
    ok = R.valid_colouring(F.col("c"), F.array(F.lit("p"), F.lit("q")), F.array(F.struct(F.lit("p").alias("a"), F.lit("q").alias("b"))), ["red", "blue"])
    assert all(r.got == r.want for r in graph.withColumn("got", ok).collect())


def test_grounded_reasons(spark):
    m = [("customer", "can you help"), ("owner", "sure"), ("customer", "when")]
    fine = "we can take a look at it and then tell you what it needs"
    cases = [(m, fine, "standard", None), (m[:2], fine, "standard", "turn_count"), ([m[1], m[0], m[2]], fine, "standard", "role_order"), (m, "ok then", "standard", "length_standard"), (m, "ok then", "short", None), (m, fine + " a@b.com", "standard", "privacy_email"), (m, "your visit is booked for you right now", "standard", "grounding_unsupported_action"), (m, "<think>x</think>", "short", "schema")]
    df = spark.createDataFrame(cases, "m array<struct<role:string,text:string>>, t string, b string, want string")
    got = df.withColumn("got", R.grounded_reason(F.col("m"), F.col("t"), F.lit("business_reply"), F.col("b"), {})).collect()
    assert [(r.t, r.got) for r in got if r.got != r.want] == []


def test_grounded_fold(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcd ") for _ in range(80)) for _ in range(10)]
    rows = []
    for i in range(150):
        t = list(rng.choice(texts))
        if rng.random() < 0.6:
            t[rng.randrange(80)] = rng.choice("xyz")
        rows.append((i, f"f{i % 2}", "".join(t), f"c{rng.randrange(30)}"))
    got = {r.id: r.reason for r in R.grounded_fold(spark.createDataFrame(rows, "id long, family string, target_key string, context_key string").repartition(4), 3, 4).collect()}
    targets, contexts, sketches = {}, {}, {}
    for i, f, t, c in rows:
        s = {t[k : k + 5] for k in range(len(t) - 4)}
        if targets.get(t, 0) >= 3:
            want = "target_frequency_cap"
        elif contexts.get(c, 0) >= 4:
            want = "context_frequency_cap"
        elif any(len(s & o) / len(s | o) >= 0.94 for o in sketches.get(f, [])):
            want = "near_duplicate_target"
        else:
            want = None
            sketches.setdefault(f, []).append(s)
            targets[t], contexts[c] = targets.get(t, 0) + 1, contexts.get(c, 0) + 1
        assert got[i] == want


def test_advantages(spark):
    rows = [("a", i, float(r), float(v)) for i, (r, v) in enumerate([(0, 0.5), (0, 0.6), (1, 0.4)])]
    got = R.advantage_series(spark.createDataFrame(rows, "g string, t int, r double, v double"), ["g"], "t", "r", "v", 0.9, 0.8).first().steps
    nxt, want = 0.0, []
    for i in (2, 1, 0):
        v2 = rows[i + 1][3] if i < 2 else 0.0
        nxt = rows[i][2] + 0.9 * v2 - rows[i][3] + 0.9 * 0.8 * nxt
        want.append(nxt)
    assert [s.order for s in got] == [0, 1, 2] and [s.advantage for s in got] == pytest.approx(want[::-1])


def test_criteria_prompt_and_errors():
    made = criteria.criteria_set({"name": "n", "description": "d", "min_mean_score": 2, "criteria": [{"id": "a", "description": "x", "rubric": {"1": "y"}}]})
    assert made.prompt() == 'Criteria set: n\nd\n{"description": "x", "evidence_required": true, "id": "a", "rubric": {"1": "y"}, "scope": "session", "severity": "major"}'
    assert made.thresholds == {"max_critical_failures": 0, "min_mean_score": 2.0, "min_session_pass_rate": 1.0, "max_first_failure_rate": None}
    for bad in ([{"id": "a"}], [{"id": "a", "description": "x"}] * 2):
        with pytest.raises(ValueError):
            criteria.criteria_set(bad)


def test_read_matrices_and_specs(spark, tmp_path):
    for k in range(3):
        listed = json.dumps([{"token_abs": i, "class": "c"} for i in range(4)])
        np.savez(tmp_path / f"{k}.npz", X=np.arange(8.0).reshape(4, 2) + k, positions=listed if k < 2 else "[]")
    (tmp_path / "bad.npz").write_bytes(b"PK no archive")
    got = tables.read_matrices(spark, str(tmp_path / "*.npz")).collect()
    assert len(got) == 8 and sorted((r.no, r.token_abs, tuple(r.vector)) for r in got if r.file.endswith("1.npz"))[1] == (1, 1, (3.0, 4.0))
    (tmp_path / "s.yaml").write_text("stage: x\nlist: [1, 2]\n")
    (tmp_path / "s.json").write_text('{"no": "stage"}')
    assert specs.read_spec(spark, str(tmp_path / "s.yaml")) == {"stage": "x", "list": [1, 2]}
    for bad in ("s.json", "0.npz"):
        with pytest.raises(Exception):  # noqa: B017
            specs.read_spec(spark, str(tmp_path / bad))


def test_safe_numbers_and_times(spark):
    df = spark.createDataFrame([(1.5, "2024-01-02T03:04:05Z"), (float("nan"), "2024-01-02T03:04:05+02:00"), (float("inf"), "2024-01-02"), (None, "soon")], "v double, t string")
    got = df.select(J.safe_number(F.col("v")).alias("v"), J.timestamp(F.col("t")).cast("string").alias("t")).collect()
    assert [r.v for r in got] == [1.5, None, None, None]
    assert [r.t for r in got] == ["2024-01-02 03:04:05", "2024-01-02 01:04:05", "2024-01-02 00:00:00", None]
