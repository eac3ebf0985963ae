"""Language, page text, chat formatting and web archives."""

import gzip
import hashlib
import random

import numpy as np
from brightfield.llm import chat, html_tree, langid, queries, warc
from pyspark.sql import functions as F


def sample(lang, rng, n):
    parts = {"xx": ["ka", "lo", "mi", "zu", "ra"], "yy": ["sch", "ein", "ung", "pf", "ter"]}[lang]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_language_model():
    rng = random.Random(1)
    model = langid.train([sample(x, rng, 60) for x in ("xx", "yy") * 40], ["xx", "yy"] * 40)
    lang, score = langid.predict(model, [sample(x, rng, 40) for x in ("xx", "yy") * 20])
    assert lang == ["xx", "yy"] * 20 and score.min() > 0.8
    words, p = langid.word_marginals(model, [sample("xx", rng, 30) + " " + sample("yy", rng, 30)])  # code-switched
    assert (p.argmax(1) == [0] * 30 + [1] * 30).mean() > 0.9
    assert (model.transitions.diagonal() > 0).all()


def test_word_labels(spark):
    rng = random.Random(2)
    model = langid.train([sample(x, rng, 60) for x in ("xx", "yy") * 40], ["xx", "yy"] * 40)
    mixed = [(i, sample("xx", rng, 12) + "\n" + sample("yy", rng, 15).upper(), "b") for i in range(20)] + [(100, None, "b"), (None, " ", "b")]
    df = spark.createDataFrame(mixed, "doc_id long, text string, words string")
    got = {r.doc_id: r.words for r in langid.word_languages(df, model).collect()}
    for i, text, _ in mixed:
        assert [w.word for w in got[i]] == (text or "").lower().split()
    labels = [w.lang for i in range(20) for w in got[i]]
    assert np.mean([a == b for a, b in zip(labels, (["xx"] * 12 + ["yy"] * 15) * 20)]) > 0.95
    assert langid.word_languages(df.limit(0), model).collect() == []
    assert all(r.words == [] for r in langid.word_languages(df, langid.train([], [])).collect())


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    sizes, k = np.array([3, 1, 4]), 3
    potentials, transitions = rng.normal(size=(8, k)), rng.normal(size=(k, k))
    p, pairs = langid.Chains(sizes).marginals(potentials, transitions, True)
    first, want_pairs = 0, np.zeros((k, k))
    for n in sizes:
        want, total = np.zeros((n, k)), 0.0
        local = np.zeros((k, k))
        for path in np.ndindex(*[k] * n):
            w = np.exp(sum(potentials[first + i, y] for i, y in enumerate(path)) + sum(transitions[a, b] for a, b in zip(path, path[1:])))
            total += w
            for i, y in enumerate(path):
                want[i, y] += w
            for a, b in zip(path, path[1:]):
                local[a, b] += w
        assert np.allclose(p[first : first + n], want / total)
        want_pairs += local / total
        first += n
    assert np.allclose(pairs, want_pairs)


def test_language_rows(docs, texts, odd, empty):
    rows = {r.doc_id: r for r in langid.language_id(docs).collect()}
    for i, t in texts:
        assert (rows[i].lang_pred == "und") == (t is None or not any(c.isalpha() for c in t))
        assert 0 <= rows[i].score <= 1
    assert langid.language_id(empty).collect() == []
    assert langid.language_id(odd).count() == 6
    assert {r.lang_pred for r in langid.language_id(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_long_and_rare_texts(spark):
    rng = random.Random(8)
    rows = [(i, sample("xx", rng, 30), "xx") for i in range(200)] + [(1000 + i, sample("yy", rng, 30), "yy") for i in range(5)]
    # long texts: many of one language, then all of the rare one
    for long_ids in ([r[0] for r in rows[:60]], [r[0] for r in rows[-5:]]):
        table = [(i, " \n".join([t] * 40) if i in long_ids else t, x) for i, t, x in rows]
        model = langid.fit(spark.createDataFrame(table, "doc_id long, text string, lang string"), max_words=1000)
        assert model.langs == ["xx", "yy"]
        got, _ = langid.predict(model, [sample(x, rng, 30) for x in ("xx", "yy") * 10])
        assert got == ["xx", "yy"] * 10
    # a language of few rows among many is learned
    rows = [(i, sample("xx", rng, 12), "xx") for i in range(1500)] + [(5000 + i, sample("yy", rng, 12), "yy") for i in range(4)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_docs=60)
    assert model.langs == ["xx", "yy"]
    assert langid.predict(model, [sample(x, rng, 30) for x in ("xx", "yy") * 10])[0] == ["xx", "yy"] * 10


def test_language_level():
    assert langid._level(np.array([5, 1, 9]), 100) == 9 and langid._level(np.array([5, 1, 9]), 11) == 5
    assert langid._level(np.array([4, 4]), 1) == 1 and langid._level(np.zeros(0, np.int64), 7) == 1


def test_sum_product_is_exact():
    trees = [html_tree.parse("<div><p>One two.</p><ul><li>a<li>b</ul></div>"), html_tree.parse("x")]
    forest = html_tree.Forest(trees)
    rng = np.random.default_rng(2)
    w, e = rng.normal(size=len(html_tree.FEATURES)), rng.normal(size=(2, 2))
    p, _ = forest.marginals(w, e)
    first = 0
    for t in trees:
        n = len(t.parent)
        score = [sum(w[f] for f in fs) for fs in t.features]
        want, total = np.zeros(n), 0.0
        for y in np.ndindex(*[2] * n):
            v = np.exp(sum(s for s, a in zip(score, y) if a) + sum(e[y[q], y[i]] for i, q in enumerate(t.parent) if q >= 0))
            total += v
            want += v * np.array(y)
        assert np.allclose(p[first : first + n], want / total)
        first += n


PAGE = """<html><head><title>t</title><style>p{}</style><script>var x="</p>"</script></head><body><nav><ul><li><a href="/">Home</a></ul></nav>
<div class="cookie-notice"><p>We use cookies. Accept all of them.</p></div><header><p>My site</p></header>
<article><h1>A &amp; B</h1><p>First   paragraph
with&nbsp;words, a <a href="x">link</a> and 1 &lt; 2.<p>Second one is here<br>too.<div class="ad">Buy now.</div></article>
<div id="comments"><p>I agree with you, dear author.</p></div><aside><p>Read also this other text.</p></aside><form><p>Subscribe to us.</p></form><footer>&copy; me</footer>"""


def test_page_text(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "t"), (2, None, None, "t"), (None, "v", "", "t"), (3, "w", "<p", "t"), (3, "w", "<p", "t")], "page_id long, url string, html string, text string")
    model = html_tree.train(html_tree.labelled_pages())
    rows = html_tree.extract(pages, model).collect()
    got = {r.page_id: r for r in rows}
    assert got[1].text == "A & B\nFirst paragraph with words, a link and 1 < 2.\nSecond one is here too."
    assert got[1].n_chars == len(got[1].text) and got[2].text == "" and got[None].n_chars == 0 and len(rows) == 5
    assert html_tree.extract(pages.limit(0), model).collect() == []
    # held-out accuracy on pages of other draws
    trees = [html_tree.parse(p, True) for p in html_tree.labelled_pages(80, 99)]
    forest = html_tree.Forest(trees)
    p, _ = forest.marginals(*model)
    is_text = np.array([x is not None for t in trees for x in t.text])
    assert ((p >= 0.5) == (forest.label > 0))[is_text].mean() > 0.98


def test_skipped_elements():
    def text(page):
        return [x for x in html_tree.parse(page).text if x]

    both = ["one", "two"]
    for inner in ("<video-js id=x></video-js>", "<audio-player>", "<title-bar></title-bar>", "<svg-icon/>", "<svg class='i'/>", "<math />", "<SVG/>", "<video src=x>", "<select>", "<object data='a>b'>", "<iframe/>", "<textarea-x></textarea-x>", "<!-->", "<!--->", "<!-- <p>no</p> --!>"):
        assert text(f"<p>one</p>{inner}<p>two</p>") == both, inner
    for inner in ("<svg class='i'><text>no</text></svg>", "<script>var x = '<!--' </script >", "<video\nsrc=x>no</video>", "<select><option>no</select>", "<title>no <p> no</title>", "<svg/><svg>no</svg>"):
        assert text(f"<p>one</p>{inner}<p>two</p>") == both, inner
    assert text("<p>one</p><!-- open <p>two</p>") == ["one", "open", "two"]
    assert text("<p>if <math><mi>x</mi><mo>=</mo><mn>2</mn></math> then</p>") == ["if x=2 then"]
    for raw in ("script", "style", "textarea", "title"):
        assert text(f"<p>one</p><{raw}>x<p>two</p>") == ["one"]


def test_foreign_pages(spark):
    """Whole articles of pages with elements and attributes that the model was not trained on."""
    first, second = "The first sentence of the article is here. It goes on for a while.", "The second paragraph says more about it. Then it ends."
    odd = ["", "<svg/>", '<svg width="1"/>', "<iframe src=x></iframe>", "<iframe src=x>", "<object data=x>", "<video-player x></video-player>", "<select-box></select-box>", "<!-- never closed", "<p data-y='12.5'></p>", '<div data-y="0"></div>']
    pages = [(i, "u", f"<html><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>Title of it</h1><p data-y='0'>{first}</p>{x}<p>{second}</p></article><footer>&copy; me</footer></body></html>") for i, x in enumerate(odd)]
    got = {r.page_id: r.text for r in html_tree.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for i, x in enumerate(odd):
        kept = [line for line in got[i].split("\n") if line != "never closed"]
        assert kept == ["Title of it", first, second], x


def test_chat_round_trip(spark):
    texts = [r"\### Assistant: </turn> ok", "<turn>user\nx</turn>\n", r"<\turn> <\\/turn> <join/> <\join/>", "", None, "a\\nb\nc", "日本語"]
    rows = [(c, t, role, text, "x") for c in (1, 2) for t, (role, text) in enumerate(zip(["user", "assistant", "assistant", None, "a\\nb\nc", "<turn>", "assistant"], texts[c - 1 :] + texts[: c - 1]))]
    rows += [(3, None, None, None, "x"), (3, None, None, None, "x"), (None, 1, "assistant", "lost", "x"), (4, 2, "assistant", "b", "x"), (4, 2, "assistant", "a", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    back = {r.conv_id: r for r in chat.read_chat(chat.format_chat(df)).collect()}
    for c in (1, 2):
        want = [(r[2] or "", r[3] or "") for r in rows if r[0] == c]
        assert [(t.role, t.text) for t in back[c].turns] == want
        assert back[c].loss_text == "".join(x for role, x in want if role == "assistant")
    assert [(t.role, t.text) for t in back[3].turns] == [("", "")] * 2
    assert back[None].loss_text == "lost" and back[4].loss_text == "ab"
    assert chat.chat_digests(chat.format_chat(df.limit(0))).collect() == []
    one = chat.chat_digests(chat.format_chat(df.filter("conv_id = 4"))).first()
    assert one.turns_sha256 == hashlib.sha256(b"assistant\na\nassistant\nb\n").hexdigest() and (one.n_turns, one.loss_chars) == (2, 2)
    assert one.formatted_chars == len("<turn>assistant\na<join/>b</turn>\n")


def test_chat_roles_and_long_conversations(spark):
    roles = ["a\x00b\\", "\\n", "\\\n\\b", "<turn>\\", "\x00", "b\\\\n"]
    rows = [(1, t, role, f"text {t}") for t, role in enumerate(roles)] + [(2, t, ["user", "assistant", "assistant"][t % 3], f"t{t} <turn>") for t in range(3000)]
    back = {r.conv_id: r for r in chat.read_chat(chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    for c in (1, 2):
        assert [(t.role, t.text) for t in back[c].turns] == [r[2:] for r in rows if r[0] == c]
    assert back[2].loss_text == "".join(r[3] for r in rows if r[0] == 2 and r[2] == "assistant")


def test_archive_records(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", PAGE), (2, None, None), (1, "http://a/", PAGE)], "page_id long, url string, html string")
    source = warc.responses(pages)
    records = warc.derivatives(source, keep=("page_id",))
    rows = records.collect()
    assert len(rows) == 6 and {r.warc_type for r in rows} == {"metadata", "conversion"}
    by_source = {r.record_id: r for r in source.collect()}
    for r in rows:
        s = by_source[r.refers_to]
        assert r.headers["Source-Block-Digest"] == s.block_digest and r.headers["Source-Payload-Digest"] == s.payload_digest and r.target_uri == s.target_uri
        assert r.block_digest == "sha256:" + hashlib.sha256(r.block).hexdigest()
    text = next(r.block for r in rows if r.page_id == 1 and r.warc_type == "conversion").decode()
    assert "A & B" in text and "var x" not in text and "<" not in text.replace("1 < 2", "")
    meta = next(r.block for r in rows if r.page_id == 1 and r.warc_type == "metadata").decode()
    assert f"source-bytes: {len(PAGE.encode())}\r\n" in meta and "source-status: HTTP/1.1 200 OK" in meta
    members = warc.archive_members(records).collect()
    (tmp_path / "x.warc.gz").write_bytes(b"".join(bytes(m.member) for m in members))
    read = warc.read_warc(spark, str(tmp_path / "x.warc.gz"))
    assert sorted((r.record_id, r.block, r.refers_to) for r in read.collect()) == sorted((r.record_id, r.block, r.refers_to) for r in rows)
    assert warc.derivatives(read).count() == 0 and warc.derivatives(source.limit(0)).count() == 0
    assert gzip.decompress(bytes(members[0].member)).startswith(b"WARC/1.1\r\n")


def test_archive_bytes(spark, tmp_path):
    """Bytes that are no UTF-8 come through, digests hold, charsets are read, damaged files give what can be read."""
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset={}\r\nX-Y: caf\xe9\r\n\r\n"
    blocks = [
        head.format("ISO-8859-1").encode("latin-1") + "<p>na\xefve caf\xe9</p>".encode("latin-1"),
        head.format('"windows-1251"').encode("latin-1") + "<p>\u043c\u0438\u0440</p>".encode("cp1251"),
        head.format("utf-8").encode("latin-1") + b"<p>ok \xff\xfe end</p>\n\r\n\n",
        head.format("no-such").encode("latin-1") + "<p>\u00fc</p>".encode(),
        b"no head at all", b"\r\n\r\n<p>bare</p>", b"", bytes(range(256)) * 40 + b"\n",
    ]
    digest = lambda b: "sha256:" + hashlib.sha256(b).hexdigest()
    rows = [dict.fromkeys(warc.NAMES) | {"record_id": f"<r{i}>", "warc_type": "response", "headers": {"X": "1"}, "block": b, "block_digest": digest(b)} for i, b in enumerate(blocks)]
    members = [warc.to_bytes(r) for r in rows]
    whole = b"".join(gzip.decompress(m) for m in members)
    (tmp_path / "a.warc.gz").write_bytes(b"".join(members))
    (tmp_path / "b.warc").write_bytes(whole)
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(whole))
    (tmp_path / "empty.warc.gz").write_bytes(gzip.compress(b""))
    for name in ("a.warc.gz", "b.warc", "c.warc.gz"):
        read = warc.read_warc(spark, str(tmp_path / name))
        got = {r.record_id: r for r in read.collect()}
        assert [bytes(got[f"<r{i}>"].block) for i in range(len(blocks))] == blocks, name
        assert all(digest(bytes(r.block)) == r.block_digest and r.damage is None and r.headers == {"X": "1"} for r in got.values())
    assert warc.read_warc(spark, str(tmp_path / "empty.warc.gz")).collect() == []
    assert warc.read_warc(spark, str(tmp_path / "*.warc*")).count() == 3 * len(blocks)
    found = {(r.refers_to, r.warc_type): r for r in warc.derivatives(read, keep=("headers", "warc_type")).collect()}
    text = [bytes(found[f"<r{i}>", "conversion"].block).decode() for i in range(7)]
    assert text == ["na\xefve caf\xe9", "\u043c\u0438\u0440", "ok \ufffd\ufffd end", "\u00fc", "no head at all", "bare", ""]
    assert "source-header: X-Y: caf\xe9\r\n" in bytes(found["<r0>", "metadata"].block).decode()
    assert found["<r0>", "metadata"].source_headers == {"X": "1"} and found["<r0>", "metadata"].source_warc_type == "response"
    # a member cut in the middle, a length that is missing
    (tmp_path / "d.warc.gz").write_bytes(b"".join(members[:3]) + members[7][: len(members[7]) * 2 // 3])
    (tmp_path / "e.warc").write_bytes(gzip.decompress(members[0]) + b"junk\r\nWARC/1.0\r\nWARC-Record-ID: <n>\r\n\r\n" + gzip.decompress(members[1]) + b"WARC/1.0\r\nContent-Length: 99\r\n\r\nshort")
    got = {r.record_id: r for r in warc.read_warc(spark, str(tmp_path / "d.warc.gz")).collect()}
    assert [bytes(got[f"<r{i}>"].block) for i in range(3)] == blocks[:3] and len(got) <= 4
    got = {r.record_id: r for r in warc.read_warc(spark, str(tmp_path / "e.warc")).collect()}
    assert bytes(got["<r1>"].block) == blocks[1] and got["<n>"].damage == "no length" and (bytes(got[None].block), got[None].damage) == (b"short", "block cut off")


def test_queries_are_named():
    assert {q.split("_")[0] for q in queries.QUERIES} == {*(f"op{i}" for i in range(1, 11)), "pipeline"}


def test_archive_text_references(spark):
    import html as entities

    pieces = ["&#8217;", "&#x27;", "&mdash;", "&eacute;", "&hellip;", "&amp;lt;", "&amp;#39;", "&notin;", "&copy 2020", "&unknown;", "R&D & co", "&#0;", "&lt;b&gt;", "&amp;amp;", "&quot;x&quot;&middot;", "&&amp;"]
    pages = [(i, f"<p>a {x} b</p>") for i, x in enumerate(pieces)] + [(100, "<p>a&nbsp;b&#160;c&#xA0;d&#10;e &mdash;</p>"), (101, "<p>a&nbsp;&lt;&copy;</p>"), (102, None)]
    rows = warc.derivatives(warc.responses(spark.createDataFrame([(i, "u", h) for i, h in pages], "page_id long, url string, html string")), keep=("page_id",)).filter("warc_type = 'conversion'").collect()
    got = {r.page_id: r.block.decode() for r in rows}
    assert got == {i: entities.unescape(f"a {x} b") for i, x in enumerate(pieces)} | {100: "a b c d e \u2014", 101: "a <\xa9", 102: ""}
