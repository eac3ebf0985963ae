"""Operators over documents against brute-force versions."""

import glob
import hashlib
import math
import os
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from brightfield.llm import exact, jaccard, mixing, packing, quality, suffixes
from brightfield.llm.common import Words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_exact_groups(docs, texts):
    got = by_id(exact.exact_dedup(docs, keys_per_bucket=7))
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in texts}
    groups = defaultdict(list)
    for i, t in norm.items():
        groups[t].append(i)
    assert len(got) == len(texts)
    for i, t in norm.items():
        r = got[i]
        assert (r.keep_id, r.group_size, r.kept) == (min(groups[t]), len(groups[t]), i == min(groups[t]))
        assert r.text_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_exact_odd_rows(odd, empty):
    assert exact.exact_dedup(empty).collect() == []
    rows = exact.exact_dedup(odd).collect()
    assert len(rows) == 6
    big = [r for r in rows if r.group_size == 4]
    assert len(big) == 4 and {r.keep_id for r in big} == {5} and sum(r.kept for r in big) == 1


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 50_000])
def test_binary_fuse_filter(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    filter_ = exact.build_filter(np.concatenate([keys, keys[: n // 2]]))
    assert exact.in_filter(keys, *filter_).all()
    others = rng.integers(1 << 63, (1 << 64) - 1, 20_000, dtype=np.uint64)
    assert exact.in_filter(others, *filter_).mean() < 0.02


def links(sets):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x = len(sets[a] & sets[b])
            if x and 100 * x >= 75 * (len(sets[a]) + len(sets[b]) - x):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def shingles(text):
    w = WORD.findall((text or "").translate(FOLD))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


@pytest.mark.parametrize("options", [{}, {"most": 1}, {"most": 1, "block": 3}, {"most": 2, "hot_from": 2}, {"most": 3, "heavy_kept": 0}])
def test_jaccard_components(docs, texts, options):
    sets = {i: shingles(t) for i, t in texts}
    want = links(sets)
    got = by_id(jaccard.jaccard_components(docs, **options))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(sets[i]), want[i]) for i in sets}
    assert len(set(want.values())) < len(want)


def test_jaccard_odd_rows(odd, empty):
    assert jaccard.jaccard_components(empty).collect() == []
    rows = jaccard.jaccard_components(odd).collect()
    assert Counter((r.doc_id, r.component_id) for r in rows) == Counter({(None, None): 2, (5, 5): 2, (6, 5): 2})


def test_jaccard_shared_ids(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    # 9 holds the texts of 1 and of 4; 7 has no words but shares its id with a copy of c; 8 stands alone
    rows = [(1, a), (9, a + " z"), (9, b), (4, b), (3, c), (7, c), (7, None), (8, d), (8, " "), (10, None)]
    got = Counter((r.doc_id, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter({(1, 1): 1, (9, 1): 2, (4, 1): 1, (3, 3): 1, (7, 3): 2, (8, 8): 2, (10, 10): 1})


def test_jaccard_equal_polynomials(spark):
    """Words of two letters in Thue-Morse order and its mirror: polynomials modulo a power of two cannot tell them apart."""
    bits = [0]
    while len(bits) < 2048:
        bits += [1 - x for x in bits]
    for n in (1024, 2048):
        left, right = ("".join("ab"[x ^ k] for x in bits[:n]) for k in (0, 1))
        rows = [(1, left), (2, right), (3, f"{left} {right}"), (4, f"{right} {left}"), (5, left)]
        got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}


def test_word_hashes_do_not_depend_on_place():
    rng = np.random.default_rng(6)
    long_word = bytes(rng.integers(97, 123, 700_000, dtype=np.uint8))
    texts = [b"one " + long_word + b" two", b"x " * 1000 + long_word + b" two", long_word[:-1] + b"A two"]
    hashes = [Words([t]).hash for t in texts]
    assert hashes[0][1] == hashes[1][1000] != hashes[2][0] and hashes[0][2] == hashes[1][1001] == hashes[2][1]
    assert (Words([b"", *texts]).hash == np.concatenate(hashes)).all()


def removed(texts, length=100):
    seen, out = set(), {}
    for i, t in sorted(texts):
        b = (t or "").encode()
        drop = bytearray(len(b))
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            if w in seen:
                drop[k : k + length] = b"\1" * length
            else:
                seen.add(w)
        kept = bytes(c for c, d in zip(b, drop, strict=True) if not d)
        out[i] = (len(b), sum(drop), len(re.findall(rb"\x01+", bytes(drop))), kept)
    return out


@pytest.mark.parametrize("options", [{}, {"shard_bytes": 5000}, {"hot_pieces": 1}, {"hot_pieces": 3, "shard_bytes": 20_000}])
def test_suffix_repeats(docs, texts, options):
    got = by_id(suffixes.remove_repeats(docs, **options))
    want = removed(texts)
    assert {i: (r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), bytes(r.kept)) for i, r in got.items()} == want
    assert sum(w[1] for w in want.values()) > 3000


def test_suffix_odd_rows(odd, empty):
    assert suffixes.remove_repeats(empty).collect() == []
    rows = suffixes.remove_repeats(odd).collect()
    assert len(rows) == 6
    assert all(r.n_bytes == len(r.kept) for r in rows if r.doc_id is None)


@pytest.mark.parametrize("parts", [1, 8])
@pytest.mark.parametrize("options", [{}, {"hot_pieces": 1}])
def test_suffix_repeated_rows(spark, parts, options):
    rng = np.random.default_rng(4)
    a, b = (" ".join(f"w{x}" for x in rng.integers(0, 10**6, 80)) for _ in range(2))
    twice = b[:200] + a[300:] + " - " + b
    texts = [(5, a), (6, a), (7, b), (8, twice), (9, a + b)]
    rows = [x for x in [*texts, *texts, texts[0]] for _ in range(2 if x[0] == 7 else 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = suffixes.remove_repeats(df, **options).collect()
    want = removed(texts)
    assert len(got) == len(rows)
    for r in got:
        assert bytes(r.kept) == want[r.doc_id][3]
    assert want[5][3] == a.encode() and want[6][3] == b""


@pytest.mark.parametrize("options", [{}, {"hot_pieces": 1}])
def test_suffix_shared_ids(spark, options):
    rng = np.random.default_rng(5)
    a, b, c = (" ".join(f"w{x}" for x in rng.integers(0, 10**6, 60)) for _ in range(3))
    rows = [(1, a), (2, b[:50] + a[:150] + b[50:]), (2, c[:20] + a[:220] + c[20:]), (2, c[:20] + a[:220] + c[20:]), (3, b + " " + c)]
    order = sorted(dict.fromkeys(rows), key=lambda x: (x[0], int.from_bytes(hashlib.sha256(x[1].encode()).digest()[:8], "big", signed=True)))
    want = removed([(k, t) for k, (_, t) in enumerate(order)])
    got = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), **options).collect()
    expected = {x: want[k][3] for k, x in enumerate(order)}
    assert sorted((r.doc_id, bytes(r.kept)) for r in got) == sorted((x[0], expected[x]) for x in rows)


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(1)
    for raw in (rng.integers(97, 99, 700, dtype=np.uint8), np.zeros(300, np.uint8), np.frombuffer(b"abracadabra" * 20, np.uint8), np.zeros(1, np.uint8)):
        text = raw.tobytes()
        sa = suffixes.suffix_array(raw)
        assert sa.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        lcp = suffixes.common_prefixes(raw, sa, 50)
        for k in range(1, len(sa)):
            a, b = text[sa[k - 1] :], text[sa[k] :]
            n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert lcp[k] == min(n, 50)


def test_packing(docs, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    cap = 256
    rows = packing.best_fit_packing(docs, cap).collect()
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append(r)
    total = 0
    for i, text in texts:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        at = 0
        for k, r in enumerate(sorted(pieces[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and r.length <= cap and (r.length == cap or k == 0)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for b in bins.values():
        at = 0
        for r in sorted(b, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= cap
    assert len(bins) <= math.ceil(total / cap) + 1
    sequences, bound = packing.certificate(packing.best_fit_packing(docs, cap), cap)
    assert sequences == len(bins) and math.ceil(total / cap) <= bound <= sequences <= bound + 1


def test_packing_added_tokens(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = [f"x{end}y", end, f"{end}{end}", f"one  {end}  two\n\n{end}\n", f"<|{end}|>", "<|endoftext |>", f" {end}é日本 \t{end[:-1]}", "plain text", (f"word {end} " * 300), "a" + " " * 1_000_000 + f"b {end}" + "\n \u3000" * 60_000]
    rows = packing.tokenised_pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 256, with_ids=True).orderBy("doc_id", "piece").collect()
    assert t.encode(texts[0], add_special_tokens=False).ids == [87, 50256, 88]
    for i, text in enumerate(texts):
        assert [x for r in rows if r.doc_id == i for x in r.ids] == [*t.encode(text, add_special_tokens=False).ids, 0]


def test_packing_levels(spark, docs, empty, odd):
    pieces = packing.tokenised_pieces(docs, 128).cache()
    one = packing.pack(pieces, 128)
    many = packing.pack(pieces, 128, per_part=20, fan_in=3, release=4)
    n, m = (x.select("sequence_id").distinct().count() for x in (one, many))
    assert many.count() == one.count() == pieces.count()
    assert n <= m <= n * 1.1 + 2
    fill = many.groupBy("sequence_id").sum("length").toDF("s", "n")
    assert fill.filter("n > 128").count() == 0
    assert packing.best_fit_packing(empty).collect() == []
    assert packing.best_fit_packing(odd).count() == 6


def test_lower_bound_is_a_bound():
    rng = np.random.default_rng(3)
    for _ in range(30):
        cap = int(rng.integers(10, 60))
        sizes = np.sort(rng.integers(1, cap + 1, int(rng.integers(1, 40))))[::-1].copy()
        bins = packing.best_fit(sizes, cap)
        fill = np.bincount(bins, weights=sizes)
        assert fill.max() <= cap
        assert packing.lower_bound(sizes, cap) <= len(fill) <= 1.25 * packing.lower_bound(sizes, cap) + 1
    assert packing.lower_bound(np.array([6] * 5), 10) == 5


def test_mixing(docs, texts):
    rows = by_id(mixing.mix_sources(docs, per_leaf=3, fan_in=2))
    size = {i: len(WORD.findall(t or "")) for i, t in texts}
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    total, by = sum(size.values()), Counter()
    for i, s in source.items():
        by[s] += size[i]
    names = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}
    target, open_ = {}, set(names)
    while True:
        left = total - sum(target.values())
        over = [s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 3 * by[s]]
        if not over:
            target |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
            break
        target |= {s: 3.0 * by[s] for s in over}
        open_ -= set(over)
    taken, largest = Counter(), Counter()
    for i, r in rows.items():
        assert r["size"] == size[i] and r.source_size == by[source[i]] and r.target == pytest.approx(target[source[i]])
        assert 0 <= r.taken <= 3 * size[i] and r.taken == r.copies * size[i]
        assert r.copies in (math.floor(r.target / r.source_size + 1e-9), math.ceil(r.target / r.source_size - 1e-9))
        taken[source[i]] += r.taken
        largest[source[i]] = max(largest[source[i]], size[i])
    for s in names:
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6
    again = by_id(mixing.mix_sources(docs.repartition(3), per_leaf=3, fan_in=2))
    assert {i: r.taken for i, r in rows.items()} == {i: r.taken for i, r in again.items()}


def test_pivotal_keeps_mass_and_expectation():
    size = np.array([5.0, 4, 3, 3, 2, 1, 1])
    runs = [mixing.pivotal_pool(size, 0.4, np.arange(7), seed) for seed in range(3000)]
    assert all(abs(m.sum() - 0.4 * size.sum()) < 1e-6 for m, _ in runs)
    assert np.abs(np.mean([m for m, _ in runs], 0) - 0.4 * size).max() < 0.12
    other = [mixing.pivotal(size, 0.4 * size, np.arange(7), seed)[0] for seed in range(3000)]
    assert np.abs(np.mean(other, 0) - 0.4 * size).max() < 0.12


def test_pivotal_units_follow_their_own_draws():
    """Joint inclusion: of equal units, no two are taken together more often than draws of their own allow (0.16; one draw for both: 0.4)."""
    n, f, runs = 25, 0.4, 4000
    taken = np.array([mixing.pivotal_pool(np.full(n, 5.0), f, np.arange(n), seed)[0] > 2.5 for seed in range(runs)])
    assert np.abs(taken.mean(0) - f).max() < 0.04
    both = taken.T.astype(float) @ taken / runs
    off = both[~np.eye(n, dtype=bool)]
    assert off.max() < 0.2 and off.mean() > 0.14


def test_mixing_hot_ids(spark):
    """Rows without an id and repeated rows are spread over the leaves, and reruns agree."""
    rng = np.random.default_rng(3)
    rows = [(None, "w " * int(n), "a") for n in rng.integers(1, 40, 500)] + [(7, "x y z", "b")] * 400 + [(i, "w " * int(n), "a") for i, n in enumerate(rng.integers(1, 40, 200))] + [(8, "q " * 50, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    units = mixing._units(df.selectExpr("doc_id", "source", "size(split(trim(text), ' ')) AS size"), chunk=7)
    assert units.count() == len(rows) == units.distinct().count()
    runs = [Counter(map(tuple, mixing.mix_sources(x, per_leaf=20, fan_in=4).collect())) for x in (df, df.repartition(5))]
    assert runs[0] == runs[1] and sum(runs[0].values()) == len(rows)
    for source in "abc":
        mine = {k: n for k, n in runs[0].items() if k[1] == source}
        target = next(iter(mine))[4]
        assert abs(sum(k[6] * n for k, n in mine.items()) - target) <= max(k[2] for k in mine) / 2 + 1e-6


def test_mixing_many_sources(spark):
    rng = np.random.default_rng(2)
    sizes = {f"s{i:03d}": int(x) for i, x in enumerate(rng.zipf(1.4, 200).clip(0, 10**6))} | {"empty": 0, None: 50}
    df = spark.createDataFrame([(s, 1, n) for s, n in sizes.items()], "source string, n long, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, left, open_, want = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}, sum(sizes.values()), set(names), {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if share * weight[s] > 3 * sizes[s]}
        want |= {s: 3.0 * sizes[s] for s in over} if over else {s: share * weight[s] for s in open_}
        left -= sum(want[s] for s in over)
        open_ = open_ - over if over else set()
    assert got == pytest.approx(want)


def test_mixing_odd_rows(odd, empty):
    assert mixing.mix_sources(empty).collect() == []
    assert mixing.mix_sources(odd).count() == 6


def test_quality(docs, texts):
    got = by_id(quality.quality_rules(docs))
    for i, t in texts:
        t = t or ""
        w = WORD.findall(t)
        seen = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {k + j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(covered))
        assert (r.n_symbols, r.n_dup_lines) == (sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r.base_failed and r.kept)


def test_quality_hosts(spark, empty, odd):
    good, bad = " ".join(f"word{i}" for i in range(80)), "spam spam spam " * 40
    rows = [(i, bad if i % 10 else good, "bad") for i in range(40)] + [(100 + i, good if i % 10 else bad, "good") for i in range(40)] + [(200, bad, "tiny")]
    got = by_id(quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")))
    assert not any(got[i].kept for i in range(40)) and got[10].host_rejected
    assert got[101].kept and not got[100].kept and not got[101].host_rejected
    assert quality.quality_rules(empty).collect() == []
    assert quality.quality_rules(odd).count() == 6


@pytest.mark.parametrize("options", [{"most": 8, "block": 40}, {"most": 8}, {}])
def test_jaccard_many_near_copies(spark, options):
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for k in rng.integers(0, 120, int(rng.integers(0, 8))):
            w[k] = f"x{rng.integers(0, 10**6)}"
        rows.append((i, " ".join(w)))
    sets = {i: shingles(t) for i, t in rows}
    got = by_id(jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), **options))
    assert {i: r.component_id for i, r in got.items()} == links(sets)


def test_jaccard_sets_sent(spark, monkeypatch):
    """Each of many near copies is multiplied a few times, not once for each column and block pair that it stands in."""
    rng, sent, whole = np.random.default_rng(3), spark.sparkContext.accumulator(0), jaccard._dense
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join([*base[: (k := int(rng.integers(0, 120)))], f"x{i}", *base[k + 1 :]])) for i in range(160)]

    def counting(percent):
        run = whole(percent)

        def counted(pdf):
            sent.add(len(pdf))
            return run(pdf)

        return counted

    monkeypatch.setattr(jaccard, "_dense", counting)
    got = by_id(jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), most=8, block=40))
    assert {i: r.component_id for i, r in got.items()} == links({i: shingles(t) for i, t in rows})
    assert len(rows) <= sent.value <= 4 * len(rows)


def test_cut_frees_shuffles(spark):
    from brightfield.llm import common

    folders = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    files = lambda: {x for d in folders for x in glob.glob(f"{d}/*/shuffle_*.data")}
    before, setting = files(), spark.conf.get(common.FREE_SHUFFLES, None)
    out = common.cut(spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count(), "freed")
    deadline = time.time() + 10  # they are deleted on the side
    while files() - before and time.time() < deadline:
        time.sleep(0.1)
    assert not files() - before
    assert out.count() == 7
    assert spark.conf.get(common.FREE_SHUFFLES, None) == setting


def test_components(spark):
    import random

    from brightfield.llm.common import components

    rng = random.Random(4)
    for edges in ([], [(1, 1)], [(i, i + 1) for i in range(40)], [(40 - i, 39 - i) for i in range(40)], [(rng.randrange(200), rng.randrange(200)) for _ in range(120)]):
        parent = {x: x for e in edges if e[0] != e[1] for x in e}

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            if a != b:
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
        got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {x: find(x) for x in parent}
