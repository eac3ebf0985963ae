"""Operators against hand-written cases and brute force."""

import json
import math
import random

import numpy as np
import pytest
from brightfield.functions import hashing as H
from brightfield.functions import json as J
from brightfield.functions import numeric as N
from brightfield.functions import text as X
from brightfield.operators import align, catalog, curate, ordered, probes, select, stats, validate
from brightfield.sources import sinks, tables
from pyspark.sql import functions as F


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()[0]


@pytest.mark.parametrize("many", [False, True])
def test_running_sums(spark, many):
    rng = random.Random(1)
    rows = [(i, rng.randrange(100)) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, v long").repartition(7)
    got = {r.k: r.before for r in ordered.running(df, [F.col("k")], {"before": "v"}, small=10 if many else 10_000).collect()}
    total = 0
    for k, v in rows:
        assert got[k] == total
        total += v


def test_text_functions(spark):
    assert one(spark, X.normalise(F.col("t")), t="  A  b\n\tC ") == "a b c"
    assert one(spark, X.ngrams(X.tokens(F.col("t")), 2), t="a b'c d") == ["a b'c", "b'c d"]
    assert one(spark, X.ngrams(X.split_words(F.col("t")), 4), t="a b c") == []
    assert one(spark, X.char_ngrams(F.col("t"), 3), t="éabéab") == ["éab", "abé", "béa"]
    assert one(spark, X.chunks(F.col("t"), 10), t="One two. Three four five. Six.") == ["One two.", "Three four five.", "Six."]
    assert one(spark, X.locate_occurrence(F.col("t"), F.lit("aa"), F.lit(2)), t="aaaa") == 2
    assert one(spark, X.locate_occurrence(F.col("t"), F.lit("aa"), F.lit(3)), t="aaaa") == -1
    assert one(spark, X.count_occurrences(F.col("t"), F.lit("aa")), t="aaaaa") == 2
    assert one(spark, X.strip_reasoning(F.col("t")), t="<think>x</think> y") == "y"
    assert one(spark, X.strip_reasoning(F.col("t")), t="z <think>x") == "z"
    assert one(spark, X.strip_reasoning(F.col("t"), True), t="<think>x") == "x"
    assert one(spark, X.answer_text(F.col("t")), t="<think>Answer: 3</think>so\nAnswer: 5\nAnswer: 7.00") == "7.00"
    assert one(spark, X.numbers_equal(F.col("t"), F.lit("7.0")), t="7.00") is True
    assert one(spark, X.numbers_equal(F.col("t"), F.lit("113")), t="114") is False
    assert one(spark, X.parse_money(F.col("t")), t="-$1,234.5") == -123450
    assert one(spark, X.truncate_to_last_sentence(F.col("t"), 5), t="One two. Three") == "One two."
    assert one(spark, X.truncate_to_last_sentence(F.col("t"), 50), t="One two. Three") is None
    assert one(spark, X.excerpt(F.col("t"), 8), t="one two three") == "one two"
    assert one(spark, X.has_triple_word(F.col("t")), t="a b b B c") is True
    assert one(spark, X.repeats_openings(F.col("t")), t="We go. We see. We win.") is True
    assert one(spark, X.looped_tail(F.col("t")), t="x\n" * 7 + "y\nz") is True
    assert [tuple(h) for h in one(spark, X.headings(F.col("t")), t="# A\ntext\n### B c")] == [(1, "A"), (3, "B c")]
    assert one(spark, X.clean_target(F.col("t")), t="<think>a</think> Owner:  hi\nthere") == "hi there"
    assert one(spark, X.redact(F.col("t"), ["Ann", "Ann Lee"]), t="Ann Lee, a@b.com, 555-123-4567, www.x.y") == "[NAME], [EMAIL], [PHONE], [URL]"


def test_personal_data_classes(spark):
    cases = {"mail a@b.org now": "email", "see example.com": "url", "call 555-123-4567": "phone", "zip 90210": "zip", "my password": "payment_or_secret", "<NAME_1>": "unresolved_marker", "nothing here": None}
    for t, want in cases.items():
        assert one(spark, X.personal_data_class(F.col("t")), t=t) == want


def test_safety_rules(spark):
    no, yes = F.lit(False), F.lit(True)
    check = lambda t, mode="business_reply", calendar=no: one(spark, X.response_violation(F.col("t"), F.lit(mode), calendar, no, no, no), t=t)
    assert check("I am a real person") == "identity_claim"
    assert check("You are scheduled. Your visit is booked.") == "unsupported_action"
    assert check("Your visit is booked.", calendar=yes) is None
    assert check("I will email you") == "unsupported_external_action"
    assert check("Our calendar is nice", "casual_sms") == "service_leakage"
    assert check("The total is $ 5") == "invented_amount"
    mode = lambda latest, prior="": one(spark, X.infer_mode(F.col("a"), F.col("b")), a=latest, b=prior)
    assert mode("Why is the sky blue?") == "general_question"
    assert mode("Can you repair my window?") == "business_reply"
    assert mode("by the way my dog ate a shoe", "the invoice") == "casual_sms"


def test_json_functions(spark):
    assert one(spark, J.object_text(F.col("t")), t='```json\n{"a": 1}\n```') == '{"a": 1}'
    assert one(spark, J.path_value(J.object_text(F.col("t")), "a.b"), t='so: {"a": {"b": 2}} ok') == "2"
    assert one(spark, J.object_text(F.col("t")), t="{no") is None
    assert one(spark, J.classification(F.col("t")), t="x").topic == "unknown"


def test_hashes(spark):
    import hashlib

    for key in ("a", "x:1", "é"):
        d = hashlib.sha256(key.encode()).hexdigest()
        assert one(spark, H.in_modulus_split(F.col("k")), k=key) == (int(d[:8], 16) % 10 == 0)
        assert one(spark, H.choose(F.col("k"), ["p", "q", "r"]), k=key) == "pqr"[int(d[:16], 16) % 3]
        assert one(spark, H.base_seed(F.col("k")), k=key) == int(d, 16) % 2**31
        assert one(spark, H.unit_interval(F.col("k")), k=key) == pytest.approx(int(d[:16], 16) / 2**64, abs=1e-12)


def test_wilson(spark):
    low, high = N.wilson(F.col("k"), F.col("n"))
    assert one(spark, F.struct(low, high), k=0, n=0) == (0.0, 0.0)
    a, b = one(spark, F.struct(low, high), k=8, n=10)
    assert (a, b) == pytest.approx((0.490162, 0.943318), abs=1e-5)


CONVERSATIONS = [(1, 0, "user", "hi"), (1, 1, "assistant", "Same answer."), (1, 2, "user", "?"), (1, 3, "assistant", "same  ANSWER."), (2, 0, "user", "x"), (3, 0, "assistant", " "), (3, 1, "assistant", None)]


def test_findings_and_gate(spark):
    turns = spark.createDataFrame(CONVERSATIONS, "session_id long, turn long, role string, text string")
    found = validate.findings(turns)
    got = sorted((r.criterion_id, r.session_id, tuple(r.turn_indices)) for r in found.collect())
    assert got == [("conversation_coherence", "1", (1, 3)), ("response_validity", "2", ()), ("response_validity", "3", (0,)), ("response_validity", "3", (1,))]
    summary = validate.report(turns, found).first()
    assert (summary.trajectory_count, summary.critical_failure_count, summary.sessions_with_findings, summary.mean_session_score) == (3, 3, 3, None)
    assert not validate.gate(validate.report(turns, found)).first().gate_passed
    good = turns.filter("session_id = 9")
    assert not validate.gate(validate.report(good, validate.findings(good))).first().gate_passed  # no conversation
    fine = spark.createDataFrame([(1, 0, "assistant", "hello there")], "session_id long, turn long, role string, text string")
    verdicts = spark.createDataFrame([("1", 4.0, True)], "session_id string, score double, passed boolean")
    assert validate.gate(validate.report(fine, validate.findings(fine), verdicts)).first().gate_passed
    assert not validate.gate(validate.report(fine, validate.findings(fine), verdicts), overseer="guard").first().gate_passed


def test_phrase_reuse(spark):
    rows = [(s, 0, "assistant", f"well {s} the quick brown fox jumps") for s in range(3)] + [(9, 0, "user", "the quick brown fox jumps")]
    reused = validate.phrase_reuse(spark.createDataFrame(rows, "session_id long, turn long, role string, text string")).collect()
    assert sorted((r.phrase, r.sessions) for r in reused) == [("quick brown fox jumps", 3), ("the quick brown fox", 3)]
    assert all(r.example.startswith("well 0") for r in reused)


def test_candidate_reasons(spark):
    m = lambda *texts: [("customer" if i % 2 == 0 else "owner", t) for i, t in enumerate(texts)]
    ok = m("need help today", "sure", "thanks a lot")
    long = "we can look at that for you any time now"
    cases = [(ok, long, None), (None, long, "schema"), (m("a", "b"), long, "turn_count"), ([("owner", "a"), ("owner", "b"), ("customer", "c")], long, "role_order"), (ok, "As an AI I think so " + long, "bad_text"),
             (ok, long + " at a@b.com", "email"), (ok, long + " bob", "real_customer_name_overlap"), (ok, "too short", "length")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, m array<struct<role:string,text:string>>, t string, want string")
    reason = curate.candidate_reason(F.col("m"), F.col("t"), F.lit(8), F.lit(63), ["bob"])
    assert all(r.got == r.want for r in df.withColumn("got", reason).collect())


def test_near_duplicate_fold(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abc ") for _ in range(60)) for _ in range(12)]
    rows = []
    for i in range(120):
        t = list(rng.choice(texts))
        if rng.random() < 0.5:
            t[rng.randrange(60)] = "z"
        rows.append((i, "same target" if i % 3 else f"other {i % 5}", "".join(t)))
    got = {r.id: r.reason for r in curate.near_duplicate_fold(spark.createDataFrame(rows, "id long, target string, combined string"), cap=5).collect()}
    counts, buckets, norm = {}, {}, lambda t: " ".join(t.lower().split())
    for i, target, combined in rows:
        key, c = norm(target), norm(combined)
        sketch = {c[k : k + 5] for k in range(len(c) - 4)}
        bucket = buckets.setdefault((len(sketch) // 20, key[:12]), [])
        if counts.get(key, 0) >= 5:
            want = "target_frequency_cap"
        elif any(len(sketch & o) / len(sketch | o) >= 0.9 for o in bucket):
            want = "near_duplicate"
        else:
            want = None
            bucket.append(sketch)
            counts[key] = counts.get(key, 0) + 1
        assert got[i] == want
    assert len(set(got.values())) == 3


def test_selection(spark):
    rows = [(i, f"g{i % 3}" if i < 20 else "g9", (i * 37) % 101 / 10) for i in range(25)]
    df = spark.createDataFrame(rows, "id long, g string, s double")
    quotas = {r.g: r.quota for r in select.largest_remainder(df.groupBy("g").count(), "g", "count", 10).collect()}
    assert sum(quotas.values()) == 10 and quotas == {"g0": 3, "g1": 3, "g2": 2, "g9": 2}
    picked = select.quota_sample(df, "g", "id", [F.desc("s"), F.col("id")], 10)
    assert picked.count() == 10 and {r.g: r["count"] for r in picked.groupBy("g").count().collect()} == quotas
    robin = [r.g for r in select.round_robin(df, "g", [F.col("id")], 7, 2).collect()]
    assert robin == ["g0", "g1", "g2", "g9", "g0", "g1", "g2"]
    held = select.spaced_holdout(df, "g", [F.col("id")])
    for g in ("g0", "g1", "g2", "g9"):
        mine = [r.held_out for r in held.filter(F.col("g") == g).orderBy("id").collect()]
        n = len(mine)
        h = max(1, round(n / 3))
        assert mine == [k in {j * n // h for j in range(h)} for k in range(n)]
    matched = select.matched_sample(df, df.filter("id < 9"), "g", "id", 5)
    assert {r.g: r["count"] for r in matched.groupBy("g").count().collect()} == {"g0": 3, "g1": 3, "g2": 3}


def test_two_caps(spark):
    rng = random.Random(8)
    rows = [(i, f"c{rng.randrange(6)}", f"w{rng.randrange(2)}", rng.random()) for i in range(200)]
    got = [r.id for r in select.two_cap_selection(spark.createDataFrame(rows, "id long, c string, w string, s double"), 30, "c", "w", "s", "id").orderBy("pick_no").collect()]
    cap = world_cap = None
    cap = math.ceil(30 * 0.1)
    world_cap = max(cap, math.ceil(30 * 0.35))
    ordered_rows = sorted(rows, key=lambda r: (-r[3], r[0]))
    chosen, cells, worlds = [], {}, {}
    for second in (False, True):
        for i, c, w, _ in ordered_rows:
            if len(chosen) < 30 and i not in chosen and cells.get(c, 0) < cap and (second or worlds.get(w, 0) < world_cap):
                chosen.append(i)
                cells[c], worlds[w] = cells.get(c, 0) + 1, worlds.get(w, 0) + 1
    assert got == chosen


def test_packing_in_order(spark):
    rng = random.Random(4)
    sizes = [rng.choice([5, 9, 30, 400]) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(sizes)), "k long, n long").repartition(5)
    got = [r.batch_no for r in select.pack_in_order(df, ["k"], "n", 4, 100).orderBy("k").collect()]
    want, batch, items, total = [], 0, 0, 0
    for n in sizes:
        if items and (items >= 4 or total + n > 100):
            batch, items, total = batch + 1, 0, 0
        items, total = items + 1, total + n
        want.append(batch)
    assert got == want


def test_rank_statistics(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(10), rng.random() < 0.4, rng.choice("ab")) for _ in range(300)]
    df = spark.createDataFrame(rows, "s int, p boolean, g string")

    def brute(rows):
        pos, neg = [r[0] for r in rows if r[1]], [r[0] for r in rows if not r[1]]
        return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))

    assert stats.auroc(df, F.col("s"), F.col("p")).first().auroc == pytest.approx(brute(rows))
    assert stats.auroc(df, -F.col("s"), F.col("p")).first().auroc == pytest.approx(1 - brute(rows))
    for r in stats.auroc(df, F.col("s"), F.col("p"), ["g"]).collect():
        assert r.auroc == pytest.approx(brute([x for x in rows if x[2] == r.g]))
    assert stats.auroc(df.filter("p"), F.col("s"), F.col("p")).first().auroc is None
    ranks = stats.average_ranks(spark.createDataFrame([(1, 1), (1, 2), (1, 2), (1, 3)], "g int, v int"), "v", ["g"])
    assert sorted(r.avg_rank for r in ranks.collect()) == [1, 2.5, 2.5, 4]


def test_fits(spark):
    rows = [("a", x, n, k) for x, n, k in ((1, 10, 9), (2, 5, 3.5), (3, 5, 4), (4, 10, 2), (5, 30, 9))]
    df = spark.createDataFrame([(g, x, i < 2 * k) for g, x, n, k in rows for i in range(2 * n)], "g string, x int, hit boolean")
    fitted = [round(r.fitted, 6) for r in stats.isotonic_decreasing(df, "g", F.col("x"), F.col("hit")).orderBy("x").collect()]
    assert fitted == [0.9, 0.75, 0.75, 0.275, 0.275]
    curve = stats.depth_logistic(df, "g", F.col("x"), F.col("hit")).first()
    x, y = np.array([[1.0, r.x] for r in df.collect()]), np.array([float(r.hit) for r in df.collect()])
    b = stats.fit_logistic(x, y)
    assert (curve.beta0, curve.beta1) == pytest.approx(tuple(b), abs=1e-6) and curve.d50 == pytest.approx(-b[0] / b[1], abs=1e-6) and curve.n == len(y)
    boot = stats.bootstrap(df, F.col("x"), F.col("hit"), 60)
    summary = {r.measure: r for r in stats.bootstrap_summary(boot).collect()}
    assert summary["d50"].low <= curve.d50 <= summary["d50"].high and boot.count() == 60
    assert {tuple(r) for r in stats.bootstrap(df, F.col("x"), F.col("hit"), 5).collect()} == {tuple(r) for r in stats.bootstrap(df.repartition(3), F.col("x"), F.col("hit"), 5).collect()}


def test_kernel_distance(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(30, 4)), rng.normal(size=(25, 4)) + 1
    frame = lambda m, o: spark.createDataFrame([(o + i, v.tolist()) for i, v in enumerate(m)], "id long, v array<double>")
    k = lambda x, y: np.exp(-((x[:, None] - y[None]) ** 2).sum(2) / 2)
    off = lambda m: (m.sum() - np.trace(m)) / (len(m) * (len(m) - 1))
    want = off(k(a, a)) + off(k(b, b)) - 2 * k(a, b).mean()
    assert stats.mmd2(frame(a, 0), frame(b, 100), "id", "v", 1.0).first().mmd2 == pytest.approx(want)
    assert stats.mmd2(frame(a[:1], 0), frame(b, 100), "id", "v", 1.0).first().mmd2 is None
    sums = stats.kernel_sums(frame(a, 0), frame(a, 0), "id", "v", 1.0, rows=7).agg(F.sum("s"), F.sum("m")).first()
    assert sums[0] == pytest.approx(k(a, a).sum() - 30) and sums[1] == 30 * 29


def test_alignment(spark):
    rows = [(p, c, i) for p, cs in (("x", ["correct"] * 3 + ["cap"] * 2 + ["wrong"] * 3), ("y", ["wrong"] * 4), ("z", ["correct", "cap"])) for i, c in enumerate(cs)]
    got = align.contrast_pairs(spark.createDataFrame(rows, "p string, c string, i long"), ["p"], "c", "i").collect()
    pools = {}
    for p, c, i in rows:
        pools.setdefault(p, {"correct": [], "cap": [], "wrong": []})[c].append(i)
    want = []
    for p, by in pools.items():
        for no, (a, b) in enumerate(align.CONTRASTS):
            while len(by[a]) > (a == b) and by[b]:
                want.append((p, no, by[a].pop(0), by[b].pop(0)))
    assert sorted((r.p, r.kind, r.left_id, r.right_id) for r in got) == sorted(want)
    left = spark.createDataFrame([("t", 0, 0, 10, "a"), ("t", 1, 20, 30, "a"), ("t", 2, 50, 60, "b"), ("t", 3, 90, 95, "a")], "t string, no long, start long, end long, class string")
    right = spark.createDataFrame([("t", 0, 1, 11, "a"), ("t", 1, 0, 4, "a"), ("t", 2, 22, 28, "b"), ("t", 3, 48, 62, "b"), ("t", 4, 70, 80, "a")], "t string, no long, start long, end long, class string")
    kinds = sorted((r.kind, r.left_no, r.right_no) for r in align.match_spans(left, right, ["t"]).collect())
    assert sorted(kinds, key=str) == sorted([("matched", 0, 0), ("class_conf", 1, 2), ("matched", 2, 3), ("a_only", 3, None), ("b_only", None, 1), ("b_only", None, 4)], key=str)


def catalog_of(spark, runs, edges, metrics):
    return {
        "runs": spark.createDataFrame(runs, "run_id string, stage string, created_at string"), "lineage": spark.createDataFrame(edges, catalog.LINEAGE),
        "metrics": spark.createDataFrame(metrics, "run_id string, key string, value double"),
    }


def test_catalog_merge(spark):
    local = catalog_of(spark, [("a", "s", "1"), ("b", "s", "2")], [("a", "b", "input")], [("b", "k", 1.0)])
    remote = catalog_of(spark, [("c", "s", "3"), ("d", "s", "4")], [("c", "d", "input")], [("d", "k", 2.0)])
    assert catalog.merge(local, remote)["report"].first().asDict() == {"added": 2, "replaced": 0, "skipped": 0, "lineage": 1, "metrics": 1}
    same = catalog_of(spark, [("a", "remote", "9")], [], [("a", "k", 1.0), ("a", "k", 2.0)])
    kept = catalog.merge(local, same, "skip")
    assert kept["report"].first().skipped == 1 and {r.run_id: r.stage for r in kept["runs"].collect()} == {"a": "s", "b": "s"}
    swapped = catalog.merge(local, same, "replace")
    assert swapped["report"].first().asDict() == {"added": 0, "replaced": 1, "skipped": 0, "lineage": 0, "metrics": 2}
    assert {r.run_id: r.stage for r in swapped["runs"].collect()} == {"a": "remote", "b": "s"} and swapped["lineage"].count() == 0
    assert catalog.orphans(local["lineage"], local["runs"]).count() == 0


def test_catalog_updates(spark):
    runs = spark.createDataFrame([("a", "s", "running", "1", None), ("b", "s", "running", "2", None)], "run_id string, stage string, status string, created_at string, completed_at string")
    done = catalog.update_status(runs, "a", "completed", F.lit("now"))
    assert {r.run_id: (r.status, r.completed_at) for r in done.collect()} == {"a": ("completed", "now"), "b": ("running", None)}
    again = catalog.register(runs, spark.createDataFrame([("a", "t", "failed", "9", "9")], runs.schema))
    assert {r.run_id: (r.stage, r.created_at) for r in again.collect()} == {"a": ("t", "1"), "b": ("s", "2")}
    with pytest.raises(ValueError):
        catalog.find(runs, order="1; drop table runs")
    with pytest.raises(ValueError):
        catalog.update_status(runs, "a", "odd", F.lit(""))


def test_probes(spark, tmp_path):
    lines = ['{"key": "loss", "value": 3.0, "step": 1}', '{"step": 1, "loss": 3.0, "grad_norm": 2.0}', "not json", '{"key": "loss", "value": 2.0, "step": 2}', '{"step": 2, "loss": 2.0, "grad_norm": 1.5}', '{"event": "saved", "step": 2}', '{"a": {"b": 7}', '{"key": "loss", "value": "x", "step": 3}', ""]
    (tmp_path / "log.jsonl").write_text("\n".join(lines))
    log = tables.read_lines(spark, str(tmp_path / "log.jsonl"))
    points = catalog.last_writes(probes.metric_points(log), ["key", "step"], [F.col("line_no")])
    assert sorted(map(tuple, points.collect())) == [("grad_norm", 1, 2.0), ("grad_norm", 2, 1.5), ("loss", 1, 3.0), ("loss", 2, 2.0)]
    assert probes.matching_lines(log, "loss").first().n == 5
    assert probes.last_match(log, r'"step": (\d)').first().value == "3"
    assert probes.last_record(log, "step").first().value == "3"
    assert one(spark, probes.style(F.col("v"), danger_above=5, warn_above=3), v=4) == "yellow"
    assert probes.sparkline_steps(5, 64) == [0, 1, 2, 3, 4] and len(probes.sparkline_steps(1000, 64)) == 64
    bad = tables.read_jsonl(spark, str(tmp_path / "log.jsonl"), "key string, step long", "keep")
    assert bad.filter("bad_line IS NOT NULL").count() == 2 and tables.bad_line_count(spark, str(tmp_path / "log.jsonl")).first().n_bad == 2
    assert tables.read_jsonl(spark, str(tmp_path / "log.jsonl"), "key string, step long").count() == 6
    with pytest.raises(Exception, match="bad line"):
        tables.read_jsonl(spark, str(tmp_path / "log.jsonl"), "key string", "fail").collect()


def test_sinks(spark, tmp_path):
    df = spark.range(3).withColumn("label", F.lit("x"))
    path = str(tmp_path / "out.parquet")
    record = sinks.save(df, path, title="T", description="D", tags=["a"])
    meta = json.loads(spark.read.text(path + ".meta").first()[0])
    assert meta["title"] == "T" and record["format"] == "parquet" and spark.read.parquet(path).count() == 3
    with pytest.raises(ValueError):
        sinks.save(df, path, title=" ", description="D")
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.save(df, path, title="T", description="D")
    assert sinks.append_new(df.union(spark.range(2, 5).withColumn("label", F.lit("y"))), df, ["id"]).count() == 2
    assert sinks.metric_rows(spark.createDataFrame([(1, 2.0, 3.0)], "step int, a double, b double"), "step").count() == 2
    old = spark.createDataFrame([("p", "T", "D", None, None, None, "json", "1")], "path string, title string, description string, tags array<string>, caveats string, sensitivity string, format string, created_at string")
    new = spark.createDataFrame([("p", None, "E", None, None, None, None, "2")], old.schema)
    merged = catalog.upsert_artifacts(old, new).first()
    assert (merged.title, merged.description, merged.format, merged.created_at) == ("T", "E", "json", "1")


def test_session_gap_is_strict(spark):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-05 00:00:00"), (1, "2024-01-09 00:00:01")]
    df = spark.createDataFrame(rows, "u int, t string").withColumn("ts", F.to_timestamp("t"))
    assert [r.session_no for r in catalog.sessionise(df, ["u"], "ts", 96 * 3600).orderBy("ts").collect()] == [0, 0, 1]


def test_pack_in_order_over_parts(spark):
    rng = random.Random(11)
    sizes = [rng.choice([0, 1, 5, 20, 40, 90, 150]) for _ in range(300)]
    want, batch, items, held = [], 0, 0, 0
    for n in sizes:
        if items and (items >= 4 or held + n > 100):
            batch, items, held = batch + 1, 0, 0
        items, held = items + 1, held + n
        want.append(batch)
    df = spark.createDataFrame([(i, n, "x") for i, n in enumerate(sizes)], "k long, n long, note string").repartition(5)
    for part in (4, 7, 50, 1000):
        got = select.pack_in_order(df, ["k"], "n", 4, 100, part).orderBy("k").collect()
        assert [r.batch_no for r in got] == want and got[0].note == "x", part
    assert select.pack_in_order(df.limit(0), ["k"], "n").collect() == []


def test_chunks_of_long_texts(spark):
    rng = random.Random(12)
    sentences = ["w" * rng.randrange(1, 30) + "." for _ in range(1500)]
    want, held = [], ""
    for x in sentences:
        if held and len(held) + len(x) > 60:
            want.append(held)
            held = x
        else:
            held = f"{held} {x}" if held else x
    want.append(held)
    df = spark.createDataFrame([(" ".join(sentences),), ("",), (None,)], "t string")
    assert [r.c for r in df.select(X.chunks(F.col("t"), 60).alias("c")).collect()] == [want, [], None]


def test_isotonic_equals_its_definition(spark):
    rng = random.Random(13)
    rows = [("g", float(rng.randrange(40)), rng.random() < 0.5) for _ in range(400)]
    got = stats.isotonic_decreasing(spark.createDataFrame(rows, "g string, x double, hit boolean"), "g", F.col("x"), F.col("hit")).orderBy("x").collect()
    hits, n = [r.rate * r.n for r in got], [r.n for r in got]
    mean = lambda j, k: sum(hits[j : k + 1]) / sum(n[j : k + 1])
    for i, r in enumerate(got):
        assert r.fitted == pytest.approx(min(max(mean(j, k) for k in range(i, len(got))) for j in range(i + 1)))


def test_read_lines_of_several_files(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.log").write_text("".join(f"{name}{i}\n\n" if i % 3 else f"{name}{i}\r\n" for i in range(50)))
    want = [(i, x) for name in ("a", "b") for i, x in enumerate((tmp_path / f"{name}.log").read_bytes().decode().split("\n")) if x]
    assert sorted(map(tuple, tables.read_lines(spark, str(tmp_path / "*.log")).collect())) == sorted(want)


def test_split_manifest_counts_repeated_ids(spark):
    df = spark.createDataFrame([("train", "f", 1), ("train", "f", 1), ("train", "f", 2)], "side string, family string, id long")
    once, twice = sinks.split_manifest(df.distinct(), "side", "family", "id").first(), sinks.split_manifest(df, "side", "family", "id").first()
    assert (once.n, twice.n) == (2, 3) and once.id_digest != twice.id_digest


def test_round_exact(spark):
    from brightfield.functions.numeric import round_exact

    values = [i / n for n in (7, 8, 40, 64, 200) for i in range(0, 3 * n)] + [0.0, 2.675, 4.475, 4.525, 4.975, 0.125, 0.375, 1e6 + 0.005]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", round_exact(F.col("x"), 2).alias("two"), round_exact(F.col("x"), 4).alias("four")).collect()
    assert [(r.two, r.four) for r in rows] == [(round(r.x, 2), round(r.x, 4)) for r in rows]
