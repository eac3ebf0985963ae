"""Main text of web pages by a tree-structured graphical model over their DOM.

Every element and every run of text is a node with a hidden label (content or not). Node potentials come from tag, name,
text and ancestor features; parent-child potentials tie the labels of neighbours. Sum-product messages go up the tree
and down again, and runs of text whose content marginal is at least one half are the page's text. Weights are trained
from labelled pages (``data-y`` attributes); :func:`labelled_pages` writes such pages in many layouts.
"""

from __future__ import annotations

import functools
import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Elements whose content is never text of the page.
SKIPPED = "script|style|noscript|template|svg|iframe|object|select|textarea|canvas|audio|video|title"
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html label legend li link main menu meta nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag of the first kind ends an open element of the second.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words in class, id and role values, by what they speak for.
NAMES = {
    "ad": "ad ads advert adverts advertisement sponsor sponsored promo promotion banner adsense dfp outbrain taboola",
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc skip topbar",
    "foot": "footer foot copyright legal colophon imprint masthead header",
    "comment": "comment comments reply replies respond disqus discussion reader feedback",
    "notice": "cookie cookies consent notice notices popup modal newsletter subscribe alert overlay gdpr paywall signup toast message",
    "side": "sidebar side related widget share social recommended trending aside tags meta byline complementary",
    "main": "article content post entry main body story text page article-body prose",
}
_NAME_OF = {w: k for k, ws in NAMES.items() for w in ws.split()}
TAGS = "p h1 h2 h3 li div article main section nav aside header footer form table td blockquote pre ul ol body html figure button label dt dd #text".split()
BAD_TAGS = frozenset("nav aside footer header form menu button label fieldset dialog".split())
_NAMES = [*(f"tag:{t}" for t in TAGS), "tag:other", *(f"name:{k}" for k in NAMES), *(f"above:{k}" for k in NAMES), "above:bad_tag", "above:main_tag",
          "above:list", "above:table", "linked", "all_linked", "short", "long", "very_long", "sentence", "copyright", "bias"]
FEATURES = {n: i for i, n in enumerate(_NAMES)}
#: Those whose content is no markup: unclosed, they run to the end of the page. An unclosed one of the others is a tag like any.
RAW = frozenset("script style textarea title".split())
_TOKEN = re.compile(
    rf"""(?P<note><!--)|<(?P<skip>{SKIPPED})(?=[\s/>])(?:"[^"]*"|'[^']*'|[^'">])*>"""
    r"""|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:"[^"]*"|'[^']*'|[^'">])*)>|<[!?/][^>]*>""",
    re.S | re.I,
)
_CLOSING = {name: re.compile(rf"</{name}\s*>", re.I) for name in SKIPPED.split("|")} | {"!--": re.compile(r"--!?>")}
_ATTR = re.compile(r"""(?<![\w-])(class|id|role|data-y)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Tree:
    """Nodes of one page, parents before children: parent, feature numbers, label (-1: none) and text of text nodes."""

    parent: list
    features: list
    label: list
    text: list


def parse(page: str, labelled: bool = False) -> Tree:
    """DOM of a page, as far as blocks go: text between two block boundaries is one text node, inline tags add nothing but links.

    Labels are read from pages to learn from (``labelled``) only. A skipped element or comment that is never closed is
    no more than its tag, but for those whose content is no markup.
    """
    t = Tree([-1], [[FEATURES["tag:html"], FEATURES["bias"]]], [-1], [None])
    stack = [("#root", 0, frozenset(), -1)]  # tag, node, inherited features, label
    held: list[str] = []
    linked = total = 0
    in_link = 0

    def text(s: str) -> None:
        nonlocal linked, total
        held.append(s)
        n = len(s.strip())
        total += n
        linked += n if in_link else 0

    def flush() -> None:
        nonlocal linked, total
        if total:
            s = "".join(held)
            s = " ".join((entities.unescape(s) if "&" in s else s).split())
            if s:
                _, node, above, y = stack[-1]
                f = [FEATURES["tag:#text"], FEATURES["bias"], *above, FEATURES["short" if len(s) < 25 else "very_long" if len(s) > 300 else "long" if len(s) > 100 else "sentence"]]
                if s[-1] in ".!?…":
                    f.append(FEATURES["sentence"])
                if 2 * linked > total:
                    f.append(FEATURES["all_linked"])
                elif linked:
                    f.append(FEATURES["linked"])
                if "©" in s[:40]:
                    f.append(FEATURES["copyright"])
                t.parent.append(node)
                t.features.append(list(dict.fromkeys(f)))
                t.label.append(y)
                t.text.append(s)
        held.clear()
        linked = total = 0

    at = 0
    unclosed: set[str] = set()  # skipped elements that no later tag closes
    while m := _TOKEN.search(page, at):
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        if m.group("note") and page.startswith((">", "->"), at):  # an empty comment
            at = page.index(">", at) + 1
            continue
        if skip := "!--" if m.group("note") else (m.group("skip") or "").lower():
            if not (skip == "svg" and page[at - 2] == "/"):  # a slash closes it at once
                stop = None if skip in unclosed else _CLOSING[skip].search(page, at)
                if stop:
                    at = stop.end()
                else:
                    unclosed.add(skip)
                    at = len(page) if skip in RAW else at
            continue
        tag = m.group("tag")
        if not tag:
            continue
        tag = tag.lower()
        if tag not in BLOCKS:
            if tag == "br":
                held.append(" ")
            elif tag == "a":
                in_link = 0 if m.group("close") else 1
            continue
        flush()
        if m.group("close"):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        in_link = 0
        if stack[-1][0] == "p":
            stack.pop()
        if tag in ENDS:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in ENDS[tag]:
                    del stack[k:]
                    break
                if stack[k][0] in ("ul", "ol", "dl", "table", "menu"):
                    break
        _, node, above, y = stack[-1]
        own, kinds = {k.lower(): v.strip("\"'") for k, v in _ATTR.findall(m.group("attrs"))} if "=" in m.group("attrs") else {}, set()
        for k in ("class", "id", "role"):
            for w in _WORD.findall(own.get(k, "")):
                if w.lower() in _NAME_OF:
                    kinds.add(_NAME_OF[w.lower()])
        if labelled and "data-y" in own:
            y = int(own["data-y"])
        f = [FEATURES.get(f"tag:{tag}", FEATURES["tag:other"]), FEATURES["bias"], *above, *(FEATURES[f"name:{k}"] for k in sorted(kinds))]
        t.parent.append(node)
        t.features.append(f)
        t.label.append(y)
        t.text.append(None)
        if tag in VOID:
            continue
        more = {FEATURES[f"above:{k}"] for k in kinds}
        if tag in BAD_TAGS:
            more.add(FEATURES["above:bad_tag"])
        elif tag in ("article", "main"):
            more.add(FEATURES["above:main_tag"])
        elif tag in ("ul", "ol", "dl"):
            more.add(FEATURES["above:list"])
        elif tag == "table":
            more.add(FEATURES["above:table"])
        stack.append((tag, len(t.parent) - 1, above | more if more else above, y))
    if at < len(page):
        text(page[at:])
    flush()
    return t


class Forest:
    """Trees of many pages as arrays, with the nodes of each depth."""

    def __init__(self, trees: list[Tree]):
        sizes = [len(t.parent) for t in trees]
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        self.parent = np.concatenate([np.where(np.array(t.parent) < 0, -1, np.array(t.parent) + o) for t, o in zip(trees, self.first, strict=False)]).astype(np.int64)
        counts = [len(f) for t in trees for f in t.features]
        self.row = np.repeat(np.arange(len(counts)), counts)
        self.col = np.fromiter((i for t in trees for f in t.features for i in f), np.int64, sum(counts))
        self.label = np.array([y for t in trees for y in t.label])
        level = np.flatnonzero(self.parent < 0)
        children = np.argsort(self.parent, kind="stable")
        sorted_parents = self.parent[children]
        self.levels = []
        while len(level):
            self.levels.append(level)
            lo, hi = np.searchsorted(sorted_parents, level), np.searchsorted(sorted_parents, level, side="right")
            level = children[np.repeat(hi - np.cumsum(hi - lo), hi - lo) + np.arange((hi - lo).sum())] if (hi - lo).sum() else level[:0]

    def marginals(self, weights: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Content marginal of each node by sum-product, and the expected 2 x 2 counts of parent and child labels."""
        score = np.bincount(self.row, weights[self.col], len(self.parent))
        up = np.stack([np.zeros_like(score), score], 1)  # log potential with all that came from below
        to_parent = np.zeros_like(up)
        for level in self.levels[:0:-1]:
            m = np.logaddexp(up[level, None, 0] + edge[:, 0], up[level, None, 1] + edge[:, 1])
            m -= m.max(1, keepdims=True)
            to_parent[level] = m
            np.add.at(up, self.parent[level], m)
        belief, pairs = up.copy(), np.zeros((2, 2))
        for level in self.levels[1:]:
            rest = belief[self.parent[level]] - to_parent[level]  # the parent's belief without this child
            joint = rest[:, :, None] + edge[None] + up[level][:, None, :]
            joint = np.exp(joint - joint.max((1, 2), keepdims=True))
            joint /= joint.sum((1, 2), keepdims=True)
            pairs += joint.sum(0)
            down = np.logaddexp(rest[:, 0, None] + edge[0], rest[:, 1, None] + edge[1])
            belief[level] += down - down.max(1, keepdims=True)
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500))), pairs


def train(pages: list[str], rounds: int = 150, rate: float = 0.15, penalty: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights of node features and of parent-child pairs, from pages whose ``data-y`` labels cover every node (no label: 0)."""
    forest = Forest([parse(p, True) for p in pages])
    y = np.maximum(forest.label, 0)
    child = np.flatnonzero(forest.parent >= 0)
    seen_pairs = np.bincount(2 * y[forest.parent[child]] + y[child], minlength=4).reshape(2, 2)
    seen = np.bincount(forest.col, y[forest.row], len(FEATURES))
    params = np.zeros(len(FEATURES) + 4)
    m, v = np.zeros_like(params), np.zeros_like(params)
    n = len(y)
    for k in range(1, rounds + 1):
        p, pairs = forest.marginals(params[:-4], params[-4:].reshape(2, 2))
        grad = np.concatenate([seen - np.bincount(forest.col, p[forest.row], len(FEATURES)), (seen_pairs - pairs).ravel()]) / n - penalty * params
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        params += rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return params[:-4], params[-4:].reshape(2, 2)


def labelled_pages(n: int = 300, seed: int = 7) -> list[str]:
    """Pages of varied layout with ``data-y`` labels: articles among menus, notices, adverts, sidebars, forms and comments."""
    rng = np.random.default_rng(seed)
    letters = list("abcdefghijklmnoprstuvwyz")

    def words(a: int, b: int) -> str:
        return " ".join("".join(rng.choice(letters, rng.integers(2, 9))) for _ in range(rng.integers(a, b + 1)))

    def sentence(a: int = 4, b: int = 18) -> str:
        return words(a, b).capitalize() + ("." if rng.random() < 0.9 else "")

    def prose(k: int) -> str:
        return " ".join(sentence() for _ in range(k))

    def pick(*options: str) -> str:
        return options[rng.integers(len(options))]

    def maybe(p: float, s: str) -> str:
        return s if rng.random() < p else ""

    def links(k: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{words(1, 3)}</a></li>' for i in range(k)) + "</ul>"

    def named(tag: str, kind: str) -> str:
        return f'{tag} {pick("class", "id")}="{pick(*NAMES[kind].split())}"'

    def body() -> str:
        out = [f"<{pick('h1', 'h1', 'h2')}>{words(2, 9)}</h1>"]
        for _ in range(rng.integers(0, 14)):
            kind = rng.random()
            if kind < 0.7:
                out.append(f"<p>{prose(int(rng.integers(1, 6)))}" + maybe(0.8, "</p>"))
            elif kind < 0.76:
                out.append(f"<p><b>{sentence(2, 8)}<br><p>{prose(1)}</p>")
            elif kind < 0.82:
                out.append(f"<h2>{words(1, 6)}</h2>")
            elif kind < 0.86:
                out.append("<ul>" + "".join(f"<li>{sentence()}</li>" for _ in range(3)) + "</ul>")
            elif kind < 0.89:
                out.append(f"<blockquote>{prose(1)}</blockquote>")
            elif kind < 0.91:
                out.append(f"<table><tr><td>{words(1, 3)}</td><td>{words(1, 3)}</td></tr></table>")
            elif kind < 0.93:
                out.append(f"<p>{sentence()} <a href='/x'>{words(1, 3)}</a> {sentence()}</p>")
            elif kind < 0.95:
                out.append(f"<p>{words(1, 4)}</p>")
            elif kind < 0.98:
                out.append(f"<{named('div', 'ad')} data-y=0>{prose(1)}</div>")
            else:
                out.append(f"<{named('div', 'side')} data-y=0>{links(3)}</div>")
        return "".join(out)

    pages = []
    for _ in range(n):
        open_, close = {
            0: ("<article data-y=1>", "</article>"), 1: ("<main data-y=0><article data-y=1>", "</article></main>"),
            2: (f"<{named('div', 'main')} data-y=1>", "</div>"), 3: ("<main data-y=1>", "</main>"),
            4: ("<article data-y=1>", "</article>"), 5: (f"<section><{named('div', 'main')} data-y=1>", "</div></section>"),
        }[int(rng.integers(6))]
        before = [
            maybe(0.6, f"<nav>{links(int(rng.integers(2, 9)))}</nav>"),
            maybe(0.3, f"<header><h1>{words(1, 4)}</h1><p>{sentence()}</p></header>"),
            maybe(0.3, f"<{named('div', 'nav')}>{links(4)}</div>"),
            maybe(0.5, f"<{named('div', 'ad')}>{prose(int(rng.integers(1, 4)))}</div>"),
            maybe(0.3, f"<{named('div', 'notice')}><p>{prose(int(rng.integers(1, 4)))}</p><button>{words(1, 2)}</button></div>"),
            maybe(0.2, f"<form><label>{words(1, 3)}</label><p>{sentence()}</p></form>"),
            maybe(0.2, f"<{named('div', 'side')}><h3>{words(1, 3)}</h3>{links(4)}<p>{prose(1)}</p></div>"),
        ]
        after = [
            maybe(0.3, f"<aside><h3>{words(1, 3)}</h3><p>{prose(int(rng.integers(1, 4)))}</p></aside>"),
            maybe(0.4, f"<{named(pick('div', 'section', 'ol'), 'comment')}>" + "".join(f"<{pick('p', 'li', 'div')}>{prose(int(rng.integers(1, 4)))}" for _ in range(rng.integers(1, 5))) + "</section></div></ol>"),
            maybe(0.2, f"<form>{words(1, 4)}<p>{prose(1)}</p></form>"),
            maybe(0.3, f"<{named('div', 'ad')}><p>{prose(2)}</p></div>"),
            maybe(0.6, f"<footer>&copy; {words(1, 4)} &middot; {sentence()}</footer>"),
            maybe(0.3, f"<{named('div', 'foot')}><p>{sentence()}</p></div>"),
        ]
        inner = [*(before[int(i)] for i in rng.permutation(len(before))), open_ + body() + close, *(after[int(i)] for i in rng.permutation(len(after)))]
        wrap = pick("", "", "<div id='page'>", "<div class='container'><div>")
        pages.append(f"<!DOCTYPE html><html data-y=0><head><title>{words(1, 5)}</title></head><body>{wrap}{''.join(inner)}</body></html>")
    return pages


@functools.cache
def default_model() -> tuple[np.ndarray, np.ndarray]:
    """What :func:`train` learns from :func:`labelled_pages`: the same in every run."""
    return train(labelled_pages())


def extract_text(tree_list: list[Tree], weights: np.ndarray, edge: np.ndarray) -> list[str]:
    forest = Forest(tree_list)
    p, _ = forest.marginals(weights, edge)
    out = []
    for t, a in zip(tree_list, forest.first, strict=False):
        out.append("\n".join(s for s, q in zip(t.text, p[a : a + len(t.text)], strict=True) if s and q >= 0.5))
    return out


def extract(pages: DataFrame, model: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page (one row per input row).

    Null or empty html, and pages without content, give an empty text; a null page_id or url stays null; repeated rows
    are extracted each; an empty table gives no rows. Whole pages are read, whatever their length (a page's tree must fit a
    worker: about 1 KB a block). Other columns are
    ignored. ``model`` is what :func:`train` returns; without one it is trained from :func:`labelled_pages`.
    """
    small_batches(pages.sparkSession)
    weights, edge = model or default_model()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), 200):
                part = pdf.iloc[a : a + 200]
                texts = extract_text([parse(h or "") for h in part["html"]], weights, edge)
                yield pd.DataFrame({"page_id": part["page_id"].astype("Int64"), "url": part["url"], "text": texts, "n_chars": [len(x) for x in texts]})

    chosen = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return chosen.mapInPandas(run, "page_id long, url string, text string, n_chars long")
