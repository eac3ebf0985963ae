"""Language of each word and document by a linear-chain conditional random field.

A word's features are its byte n-grams of one to four bytes with its edges marked (so prefixes and suffixes are among
them), the whole word, and the languages whose learned lexicon holds it. Weights and transitions are learned together by
gradient ascent on the likelihood; forward-backward gives the marginals of each word, and a document's language is the
one with the largest mean marginal over its words.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_RUN, Words, cut, mix64, release_memory, small_batches

BITS = 17  # features are hashed to 2**BITS rows of weights
LENGTHS = (1, 2, 3, 4)


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # features x languages
    transitions: np.ndarray  # from x to
    lexicon: np.ndarray  # sorted word hashes
    lexicon_of: np.ndarray  # languages of each, as bits


def word_features(words: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of the chosen words, and the number (in ``which``) of the word that each belongs to."""
    mask = np.uint64((1 << BITS) - 1)
    size = words.end[which] - words.start[which]
    # the words' bytes in a row, each between two marks of its edges
    place = np.concatenate([[0], np.cumsum(size + 2)])
    own = np.repeat(np.arange(len(which)), size)
    within = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)
    text = np.zeros(place[-1], np.uint64)
    text[place[own] + 1 + within] = words.raw[words.start[which][own] + within]
    owner = np.repeat(np.arange(len(which), dtype=np.int32), size + 2)
    narrow = lambda x: x.astype(np.int32)  # noqa: E731  at once: together they are the largest arrays of a fit
    rows, owners = [narrow((words.hash[which] ^ np.uint64(0x5851F42D4C957F2D)) & mask)], [np.arange(len(which), dtype=np.int32)]
    gram = np.zeros(len(text), np.uint64)
    for n in LENGTHS:
        gram = gram[: len(text) - n + 1] * np.uint64(257) + text[n - 1 :] + np.uint64(1)
        inside = owner[: len(gram)] == owner[n - 1 :]
        if n == 1:
            inside &= text > 0
        rows.append(narrow(mix64(gram[inside] + np.uint64(n << 40)) & mask))
        owners.append(owner[: len(gram)][inside])
    return np.concatenate(rows), np.concatenate(owners)


def emissions(model: Model, words: Words, which: np.ndarray) -> np.ndarray:
    """Log potentials of the chosen words, one row each."""
    rows, owner = word_features(words, which)
    out = np.stack([np.bincount(owner, model.weights[rows, k], len(which)) for k in range(len(model.langs))], 1)
    return out / np.sqrt(np.bincount(owner, minlength=len(which)))[:, None] + _lexicon_scores(model, words.hash[which])


def _lexicon_scores(model: Model, hashes: np.ndarray) -> np.ndarray:
    if not len(model.lexicon):
        return np.zeros((len(hashes), len(model.langs)))
    at = np.minimum(np.searchsorted(model.lexicon, hashes), len(model.lexicon) - 1)
    bits = np.where(model.lexicon[at] == hashes, model.lexicon_of[at], 0)
    return ((bits[:, None] >> np.arange(len(model.langs))) & 1).astype(np.float64)


class Sums:
    """Sums of values by group, over and over for the same groups: values are put in order of group and added run by run."""

    def __init__(self, group: np.ndarray, taken: np.ndarray | None = None):
        self.order = np.argsort(group, kind="stable").astype(np.int32)
        ordered = group[self.order]
        self.first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        self.groups = ordered[self.first]
        if taken is not None:  # the values come from a table, at these places
            self.order = taken[self.order]  # in place of the order itself

    def __call__(self, table: np.ndarray) -> np.ndarray:
        """One row a group that occurs, in order; ``table`` has a column for each kind of value."""
        return np.stack([np.add.reduceat(np.ascontiguousarray(table[:, k])[self.order], self.first) for k in range(table.shape[1])], 1)


class Chains:
    """Words of several sequences laid out by place: all first words, then all second words, and so on."""

    def __init__(self, sizes: np.ndarray):
        order = np.argsort(-sizes, kind="stable")
        ordered = sizes[order]
        longest = int(ordered[0]) if len(ordered) else 0
        # how many sequences reach each place
        self.active = np.searchsorted(-ordered, -np.arange(longest), side="left")
        self.offset = np.concatenate([[0], np.cumsum(self.active)])
        lane = np.empty(len(sizes), np.int64)
        lane[order] = np.arange(len(sizes))
        first = np.cumsum(sizes) - sizes
        place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
        self.slot = self.offset[place] + np.repeat(lane, sizes)  # of each word in sequence order

    def marginals(self, potentials: np.ndarray, transitions: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Forward-backward: marginals in sequence order, and (if asked for) expected transition counts."""
        k = potentials.shape[1]
        e = np.empty_like(potentials)
        top = functools.reduce(np.maximum, potentials.T)[:, None]  # column by column: far faster than along short rows
        e[self.slot] = np.exp(potentials - top) + np.float32(1e-30)
        t = np.exp(transitions)
        ones = np.ones((k, 1), e.dtype)
        total = lambda x: x @ ones
        alpha, expected = np.empty_like(e), np.zeros((k, k))
        now = None
        for i, n in enumerate(self.active):
            here = e[self.offset[i] : self.offset[i] + n]
            now = here if now is None else (now[:n] @ t) * here
            now = now / total(now)
            alpha[self.offset[i] : self.offset[i] + n] = now
        beta = np.ones((0, k), e.dtype)
        for i in range(len(self.active) - 1, -1, -1):
            n, a = self.active[i], self.offset[i]
            if i + 1 < len(self.active):
                m = self.active[i + 1]
                ahead = e[self.offset[i + 1] : self.offset[i + 1] + m] * beta[:m]
                back = np.ones((n, k), e.dtype)
                back[:m] = ahead @ t.T
                if pairs:
                    left = alpha[a : a + m]
                    expected += (left / total(left * back[:m])).T @ ahead * t
                beta = back / total(back)
            else:
                beta = np.ones((n, k), e.dtype)
            e_slot = alpha[a : a + n] * beta
            alpha[a : a + n] = e_slot / total(e_slot)
        return alpha[self.slot], expected


def train(texts: list[str], langs: list[str], window: int = 64, rounds: int = 40, rate: float = 0.2, penalty: float = 2e-4, min_count: int = 3, share: float = 0.9) -> Model:
    """Weights, transitions and lexicon from labelled texts; chains of at most ``window`` words are trained on."""
    names = sorted(set(langs))
    words = Words([t.lower().encode() for t in texts])
    sizes = np.diff(words.first)
    y = np.repeat(np.array([names.index(x) for x in langs], np.int64), sizes)
    full, rest = sizes // window, sizes % window
    cuts = np.concatenate([[window] * f + ([r] if r else []) for f, r in zip(full, rest, strict=True)] or [[]]).astype(np.int64)
    unique, index, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
    seen = np.stack([np.bincount(inverse, y == k, len(unique)) for k in range(len(names))], 1) if len(names) else np.zeros((0, 0))
    total = seen.sum(1)
    member = (total >= min_count) & (seen.max(1, initial=0) >= share * total)
    model = Model(names, np.zeros((1 << BITS, len(names))), np.zeros((len(names), len(names))), unique[member], np.left_shift(1, seen[member].argmax(1)) if member.any() else np.zeros(0, np.int64))
    if not len(names) or not len(y):
        return model
    chains = Chains(cuts)
    rows, owner = word_features(words, index)
    scale = 1 / np.sqrt(np.bincount(owner, minlength=len(unique)))[:, None]
    of_word, of_row, of_place = Sums(owner, rows), Sums(rows, owner), Sums(inverse)  # each word has a feature and a place
    del rows, owner
    lex = _lexicon_scores(model, unique)
    begin = np.zeros(len(y), bool)
    begin[np.cumsum(cuts) - cuts] = True
    follow = np.flatnonzero(~begin)
    seen_pairs = np.zeros((len(names), len(names)))
    np.add.at(seen_pairs, (y[follow - 1], y[follow]), 1)
    state = [np.zeros_like(p) for p in (model.weights, model.weights, model.transitions, model.transitions)]
    n = len(y)
    for step in range(1, rounds + 1):
        score = of_word(model.weights.astype(np.float32)) * scale + lex
        p, pairs = chains.marginals(score.astype(np.float32)[inverse], model.transitions.astype(np.float32), True)
        up = np.zeros_like(model.weights)
        up[of_row.groups] = of_row(((seen - of_place(p.astype(np.float64))) * scale).astype(np.float32)) / n
        for param, grad, m, v in ((model.weights, up, state[0], state[1]), (model.transitions, (seen_pairs - pairs) / n, state[2], state[3])):
            grad = grad - penalty * param * (1 / 50 if param is model.weights else 1)
            m += 0.1 * (grad - m)
            v += 0.01 * (grad**2 - v)
            param += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    return model


def word_marginals(model: Model, texts: list[str]) -> tuple[Words, np.ndarray]:
    """The words of the texts, and the marginals of each."""
    words = Words([t.lower().encode() for t in texts])
    _, index, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
    p, _ = Chains(np.diff(words.first)).marginals(emissions(model, words, index).astype(np.float32)[inverse], model.transitions.astype(np.float32))
    return words, p


def _batches(texts: list[str], most: int) -> Iterator[np.ndarray]:
    """Numbers of texts, longest first, in groups of about ``most`` characters."""
    sizes = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(-sizes, kind="stable")
    group = np.cumsum(sizes[order]) // most
    yield from np.split(order, np.flatnonzero(np.diff(group)) + 1) if len(order) else ()


def predict(model: Model, texts: list[str], most: int = 2_000_000) -> tuple[list[str], np.ndarray]:
    """Language and score of each text (with a letter)."""
    best, score = np.zeros(len(texts), np.int64), np.zeros(len(texts))
    for part in _batches(texts, most):
        words, p = word_marginals(model, [texts[i] for i in part])
        total = np.concatenate([np.zeros((1, p.shape[1])), np.cumsum(p, 0, np.float64)])
        count = np.maximum(np.diff(words.first), 1)[:, None]
        mean = (total[words.first[1:]] - total[words.first[:-1]]) / count
        best[part], score[part] = mean.argmax(1), mean.max(1)
    return [model.langs[i] for i in best], np.clip(score, 0, 1)


def _level(sizes: np.ndarray, total: int) -> int:
    """Largest whole number, at least 1, such that the sizes cut to it sum to at most ``total``; the largest size if all fit."""
    low, high = 1, max(int(sizes.max(initial=1)), 1)
    while low < high:
        middle = (low + high + 1) // 2
        if int(np.minimum(sizes, middle).sum()) <= total:
            low = middle
        else:
            high = middle - 1
    return low


def fit(docs: DataFrame, max_docs: int = 1500, max_words: int = 1_500_000) -> Model:
    """Model from rows with a language whose ``crc32(doc_id) mod 5`` is not 0.

    Where there are over ``max_docs`` of them, every language has the same quota (a rarer one gives all its rows, any
    language one at least) and about that many are drawn by a hash of id and text. Where the drawn texts have over
    ``max_words`` words in all, the longest are learned from up to a common number of first words; no text is left out.
    That bounds what reaches the driver.
    """
    usable = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40))
    found = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).collect()
    sizes = np.array([r.n for r in found], np.int64)
    if sizes.sum() > max_docs:
        quota = _level(sizes, max_docs)
        upto = [(r.lang, max(quota * (1 << 40) // r.n, r.first + 1)) for r in found]
        limits = docs.sparkSession.createDataFrame(upto, "lang string, upto long")
        usable = usable.join(F.broadcast(limits), "lang").filter(place < F.col("upto")).drop("upto")
    flat = F.trim(F.regexp_replace("text", SPACE_RUN, " "))  # only words count
    gaps = F.length("flat") - F.length(F.replace("flat", F.lit(" "), F.lit("")))
    drawn = usable.select("lang", "doc_id", F.xxhash64("doc_id", "text").alias("place"), flat.alias("flat"))
    drawn = cut(drawn.withColumn("words", F.when(F.col("flat") == "", 0).otherwise(gaps + 1)), "learned", few=True)
    most = _level(np.array([r.words for r in drawn.select("words").collect()], np.int64), max_words)
    text = F.when(F.col("words") > most, F.substring_index("flat", " ", most)).otherwise(F.col("flat"))
    rows = drawn.orderBy("place", "doc_id", "flat", "lang").select(text.alias("text"), "lang").collect()
    model = train([r[0] for r in rows], [r[1] for r in rows])
    del rows
    release_memory()
    return model


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def language_id(docs: DataFrame, model: Model | None = None, max_docs: int = 1500) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document; prediction looks at the whole text alone.

    ``und`` with score 0 where the text is null or has no letter, and where no model could be learned (no labelled
    row). A null doc_id counts as not held out. Repeated rows are predicted each; an empty table gives no rows; other
    columns are ignored. ``model``: what :func:`fit` or :func:`train` returns; by default it is fitted on ``docs``.
    """
    small_batches(docs.sparkSession)
    model = model or fit(docs, max_docs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lang, score = np.full(len(pdf), "und", object), np.zeros(len(pdf))
            some = np.flatnonzero(pdf["letters"].to_numpy(bool)) if model.langs else []
            if len(some):
                texts = pdf["text"].to_numpy(object)
                lang[some], score[some] = predict(model, [texts[i] for i in some])
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "held_out": pdf["held_out"], "lang_pred": lang, "score": score})
        release_memory()

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"),
        F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"),
    )
    return rows.mapInPandas(run, "doc_id long, held_out boolean, lang_pred string, score double")


def word_languages(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``doc_id, words`` of every document: of each word (lower case, in order) its language and that label's marginal.

    Words are the runs without ASCII white space. Null, empty and blank texts, and all texts where no model could be
    learned, have no labelled words; repeated rows are labelled each; an empty table gives no rows; other columns are
    ignored. A text of any length is one chain, and its words one array.
    """
    small_batches(docs.sparkSession)
    model = model or fit(docs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [t or "" for t in pdf["text"]]
            out: list[list[dict]] = [[] for _ in texts]
            for part in _batches(texts, 2_000_000) if model.langs else ():
                words, p = word_marginals(model, [texts[i] for i in part])
                raw, best = words.raw.tobytes(), p.argmax(1)
                for i, a, b in zip(part.tolist(), words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
                    out[i] = [{"word": raw[words.start[k] : words.end[k]].decode(), "lang": model.langs[best[k]], "score": float(p[k, best[k]])} for k in range(a, b)]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "words": pd.Series(out, dtype=object)})
        release_memory()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(run, "doc_id long, words array<struct<word:string,lang:string,score:double>>")


def with_language(docs: DataFrame, model: Model, column: str = "language") -> DataFrame:
    """``docs`` with one more column ``column`` (struct of ``lang_pred, score``), by the rules of :func:`language_id`; the rest stays in the JVM."""

    small_batches(docs.sparkSession)

    @F.pandas_udf("lang_pred string, score double")
    def label(text: pd.Series, letters: pd.Series) -> pd.DataFrame:
        lang, score = np.full(len(text), "und", object), np.zeros(len(text))
        some = np.flatnonzero(letters.to_numpy(bool)) if model.langs else []
        if len(some):
            lang[some], score[some] = predict(model, [text.iloc[i] for i in some])
        release_memory()
        return pd.DataFrame({"lang_pred": lang, "score": score})

    return docs.withColumn(column, label(F.col("text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))))
