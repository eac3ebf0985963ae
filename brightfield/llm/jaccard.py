"""Documents whose word n-gram sets overlap: a blocked sparse product of the document by n-gram incidence.

Pairs at or above the threshold must share one of the first n - ceil(t n) + 1 n-grams of each document, in any one
order of all n-grams; here the rarest come first. The product runs over those columns only, in blocks of n-grams, and
accumulates overlap counts of pairs. A pair whose count cannot reach ceil(t / (1 + t) (n_a + n_b)) even if all that is
left overlaps is discarded; the rest have their whole sets intersected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, components, cut, cut_whole, discard, mix64, near_filter, release_memory, small_batches

STEP = np.uint64(0x9E3779B97F4A7C15)
CHUNK = 2_000_000  # characters whose n-grams are hashed at a time


def shingle_sets(texts: list[bytes], size: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of the word n-grams of each text; a text of fewer words has its whole sequence as one."""
    words = Words(texts)
    h = words.hash
    gram = np.zeros(max(len(h) - size + 1, 0), np.uint64)
    for k in range(size):
        gram = mix64(gram * STEP + h[k : k + len(gram)] + np.uint64(k + 1))
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(gram[a : b - size + 1]))
        else:
            x = np.zeros(min(b - a, 1), np.uint64)
            for k, w in enumerate(h[a:b]):
                x = mix64(x * STEP + w + np.uint64(1000 + k))
            out.append(x)
    return out


def _each(pdf: pd.DataFrame, size: int) -> Iterator[tuple[pd.DataFrame, list[np.ndarray]]]:
    """Slices of a batch and the n-gram sets of their texts."""
    texts = [(t or "").encode() for t in pdf["text"]]
    group = np.cumsum([len(t) + 1 for t in texts]) // CHUNK
    for part in np.split(np.arange(len(pdf)), np.flatnonzero(np.diff(group)) + 1):
        if len(part):
            yield pdf.iloc[part], shingle_sets([texts[i] for i in part], size)


def _class_key(s: np.ndarray) -> int:
    """64-bit name of a set of hashes."""
    return int(mix64(np.array([mix64(s).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def _second_key(s: np.ndarray) -> int:
    """Another 64-bit name, from the hashes as they are: a set is known by both."""
    return int(mix64(np.array([s.sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def signatures(docs: DataFrame, size: int = 5) -> DataFrame:
    """``doc_id, n, key, second`` of each document, and rows ``n = -1, key, count`` of n-grams
    that stand in several different sets among about five million n-grams of one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        met: set[int] = set()
        fresh: list[np.ndarray] = []
        held = 0

        def shared() -> pd.DataFrame:
            values = np.sort(np.concatenate([*fresh, np.zeros(0, np.uint64)]))
            first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
            counts = np.diff(np.append(first, len(values)))
            values, counts = values[first[counts > 1]], counts[counts > 1]
            return pd.DataFrame({"doc_id": pd.array([None] * len(values), "Int64"), "n": -1, "key": values.view(np.int64), "second": 0, "count": counts})

        for pdf in batches:
            for part, sets in _each(pdf, size):
                keys = [_class_key(s) if len(s) else 0 for s in sets]
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "n": [len(s) for s in sets], "key": keys, "second": [_second_key(s) if len(s) else 0 for s in sets], "count": 0})
                for s, k in zip(sets, keys, strict=True):
                    if k not in met:
                        met.add(k)
                        fresh.append(s)
                        held += len(s)
            if len(met) > 1_000_000:
                met.clear()
            if held > 5_000_000:
                yield shared()
                fresh.clear()
                held = 0
        yield shared()
        fresh.clear()
        release_memory()

    return _texts(docs).mapInPandas(run, "doc_id long, n long, key long, second long, count long")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def prefix_entries(docs: DataFrame, heavy: np.ndarray, counts: np.ndarray, percent: int, size: int, hot_from: int) -> DataFrame:
    """``g, key, n, pos, hot``: the prefix n-grams of each distinct set; a task emits a set once, however many copies it meets.

    ``heavy`` are the most frequent n-grams (sorted) with their ``counts``: they come last in the order of n-grams,
    which changes what is compared, never what is found.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        met: set[int] = set()
        for pdf in batches:
            for _, sets in _each(pdf, size):
                grams, keys, ns, hots = [], [], [], []
                for s in sets:
                    if not len(s) or (key := _class_key(s)) in met:
                        continue
                    if len(met) < 1_000_000:
                        met.add(key)
                    n = len(s)
                    p = n - -(-percent * n // 100) + 1
                    hot = np.zeros(p, bool)
                    if len(heavy):
                        at = np.minimum(np.searchsorted(heavy, s), len(heavy) - 1)
                        weight = np.where(heavy[at] == s, counts[at], 0)
                        if weight.any():
                            order = np.argsort(weight, kind="stable")
                            s, hot = s[order], weight[order][:p] >= hot_from
                    grams.append(s[:p])
                    hots.append(hot)
                    keys.append(key)
                    ns.append(n)
                if grams:
                    lengths = [len(x) for x in grams]
                    yield pd.DataFrame({"g": np.concatenate(grams).view(np.int64), "key": np.repeat(np.array(keys, np.int64), lengths), "n": np.repeat(np.array(ns, np.int32), lengths), "pos": np.concatenate([np.arange(x, dtype=np.int32) for x in lengths]), "hot": np.concatenate(hots)})
        release_memory()

    return _texts(docs).mapInPandas(run, "g long, key long, n int, pos int, hot boolean")


def _product(percent: int, most: int):
    """Over rows sorted by n-gram: pairs of sets that a short column holds; the rows of longer columns as they are."""

    def pairs_of(k: np.ndarray, n: np.ndarray, first: np.ndarray, length: np.ndarray) -> pd.DataFrame:
        out = []
        for m in np.unique(length):
            block = first[length == m][:, None] + np.arange(m)[None]  # columns of one length at a time
            for i in range(m - 1):
                a, b = np.repeat(block[:, i], m - 1 - i), block[:, i + 1 :].ravel()
                fits = (n[a] * 100 >= percent * n[b]) & (k[a] != k[b])  # sorted by size: n[a] <= n[b]
                out.append((a[fits], b[fits]))
        a, b = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2
        swap = k[a] > k[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        return pd.DataFrame({"a": k[a], "b": k[b], "na": n[a], "nb": n[b], "g": pd.array([None] * len(a), "Int64")})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def work(df: pd.DataFrame) -> Iterator[pd.DataFrame]:
            df = df.drop_duplicates(["g", "key"])
            g = df["g"].to_numpy()
            if not len(g):
                return
            first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            length = np.diff(np.append(first, len(g)))
            hot = df["hot"].to_numpy(bool)[first] | (length > most)
            short = (length > 1) & ~hot
            yield pairs_of(df["key"].to_numpy(), df["n"].to_numpy(), first[short], length[short])
            whole = np.repeat(hot, length)
            if whole.any():
                k, n, pos = (df[c].to_numpy()[whole] for c in ("key", "n", "pos"))
                yield pd.DataFrame({"a": k, "b": k, "na": n, "nb": pos, "g": pd.array(g[whole], "Int64")})

        for pdf in batches:  # a column may go on in the next batch
            g = pdf["g"].to_numpy()
            last = int(np.searchsorted(g, g[-1])) if len(g) else 0
            if last:
                yield from work(pd.concat([*held, pdf.iloc[:last]]))
                held = []
            held.append(pdf.iloc[last:])
            if sum(map(len, held)) > 500_000:  # one column alone: it is a long one, its rows pass on
                one = pd.concat(held).assign(hot=True)
                yield from work(one)
                held = [one.iloc[:1].assign(hot=True)]
        if held:
            yield from work(pd.concat(held))
        release_memory()

    return run


#: Columns of what _long_column returns.
LONG = "a long, b long, g long, i int, j int, block int, n int, pos int"


def _long_column(percent: int):
    """One block pair of a long column: pairs that their sizes and places allow, or all its rows as dense if those are many.

    An n-gram at place p of a set of n leaves n - p that can still be common; the first common n-gram of two sets that
    are similar enough leaves enough in either. Rows may bring a ``root``, 0 where it is not known: sets of one root are
    known to be connected and make no pair.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        k, n, pos = (pdf[c].to_numpy(np.int64) for c in ("key", "n", "pos"))
        g, i, j = (int(pdf[c].iloc[0]) for c in ("g", "i", "j"))
        rest, block = n - pos, pdf["block"].to_numpy()
        need = -(-percent * (n[:, None] + n) // (100 + percent))
        fits = (100 * np.minimum(n[:, None], n) >= percent * np.maximum(n[:, None], n)) & (np.minimum(rest[:, None], rest) >= need)
        fits &= (k[:, None] < k) if i == j else (block[:, None] == i) & (block == j)
        if "root" in pdf:
            root, known = pdf["root"].to_numpy(np.int64), pdf["known"].to_numpy(bool)
            fits &= ~((root[:, None] == root) & known[:, None] & known)
        if fits.sum() <= 16 * len(k):
            a, b = np.nonzero(fits)
            low, high = np.minimum(k[a], k[b]), np.maximum(k[a], k[b])
            return pd.DataFrame({"a": low, "b": high, "g": pd.array([None] * len(a), "Int64"), "i": i, "j": j, "block": 0, "n": 0, "pos": 0})
        some = fits.any(0) | fits.any(1)
        return pd.DataFrame({"a": k[some], "b": k[some], "g": pd.array([g] * int(some.sum()), "Int64"), "i": i, "j": j, "block": block[some], "n": n[some], "pos": pos[some]})

    return run


def _homes(dense: DataFrame, block: int, turn: int) -> DataFrame:
    """``g, i, j, block, key``: each set of the dense rows in one group of about ``block`` sets of one of its columns.

    The column is the one whose hash is the least of the set's columns, so near copies mostly choose the same.
    """
    chosen = dense.groupBy("key").agg(F.min_by("g", F.struct(F.xxhash64("g", F.lit(turn)), "g")).alias("g"))
    groups = chosen.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("groups"))
    placed = chosen.join(groups, "g").withColumn("i", F.pmod(F.xxhash64("key", F.lit(turn)), F.col("groups")).cast("int"))
    return placed.select("g", "i", F.col("i").alias("j"), F.col("i").alias("block"), "key")


def _dense(percent: int, width: int = 4096):
    """Links of one block pair of a dense column, from the product of its rows; of the links, those of a spanning forest."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep")  # in this order the same links come back from every column
        sets = [np.asarray(x, np.int64) for x in pdf["s"]]
        rep, n = pdf["rep"].to_numpy(np.int64), np.array([len(x) for x in sets])
        values = np.concatenate(sets)
        row = np.repeat(np.arange(len(sets)), n)
        _, column, count = np.unique(values, return_inverse=True, return_counts=True)
        number = np.cumsum(count > 1) - 1  # n-grams of one row alone overlap with nothing
        shared = count[column] > 1
        row, column = row[shared], number[column[shared]]
        overlap = np.zeros((len(sets), len(sets)), np.float32)
        for lo in range(0, int(number[-1]) + 1 if len(number) else 0, width):
            here = (column >= lo) & (column < lo + width)
            x = np.zeros((len(sets), width), np.float32)
            x[row[here], column[here] - lo] = 1
            overlap += x @ x.T
        linked = 100 * overlap >= percent * (n[:, None] + n - overlap)
        if pdf["i"].iloc[0] != pdf["j"].iloc[0]:
            block = pdf["block"].to_numpy()
            linked &= block[:, None] != block
        seen, out = np.zeros(len(sets), bool), []
        for first in range(len(sets)):
            todo = [] if seen[first] else [first]
            seen[first] = True
            while todo:
                at = todo.pop()
                new = np.flatnonzero(linked[at] & ~seen)
                seen[new] = True
                out += [(rep[at], rep[x]) for x in new]
                todo += new.tolist()
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return run


def sets_of(keys: DataFrame, classes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """``key, rep, s``: the set of each class in ``keys`` (read again from its first document) as an array of longs."""
    wanted = cut(classes.join(keys, "key", "left_semi").select("key", "second", "rep"), "wanted")
    texts = near_filter(_texts(docs).filter("doc_id IS NOT NULL"), "doc_id", wanted.select("rep")).join(wanted.withColumnRenamed("rep", "doc_id"), "doc_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part, sets in _each(pdf, size):
                names = zip(sets, part["key"], part["second"], strict=True)
                fits = [i for i, (s, k, x) in enumerate(names) if len(s) and _class_key(s) == k and _second_key(s) == x]  # not other rows of the same id
                if fits:
                    yield pd.DataFrame({**{c: part[c].to_numpy()[fits] for c in ("key", "second")}, "rep": part["doc_id"].to_numpy()[fits], "s": [sets[i].view(np.int64) for i in fits]})

    found = texts.select("key", "second", "doc_id", "text").mapInPandas(run, "key long, second long, rep long, s array<long>")
    out = cut(found.dropDuplicates(["key", "second"]).drop("second"), "sets")
    discard(wanted)
    return out


def jaccard_components(docs: DataFrame, percent: int = 75, size: int = 5, most: int = 64, heavy_kept: int = 100_000, hot_from: int = 20_000, block: int = 1024) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document.

    Two documents link when ``100 * intersection >= percent * union`` of their n-gram sets; ``component_id`` is the
    smallest doc_id that links reach. Equal sets are one class from the start, so copies cost nothing further; a class is
    known by 128 bits over its n-grams. Candidates are looked for by the first 64 of them, and every candidate pair has
    its sets intersected, so that two classes which share those 64 bits by chance are still told apart.

    Columns of the incidence of up to ``most`` classes give all their pairs (of fitting sizes) with counts. Longer
    columns are worked on in pairs of blocks of about ``block`` rows: sizes and places discard most pairs there, and
    where they do not (many near copies of one text) the rows are multiplied in memory, which gives back a spanning forest
    of their links, not all of them: it connects the same documents. Each class is multiplied twice in one of its columns
    first, in groups of about ``block``; block pairs are worked on as far as that leaves classes unconnected.

    A text without words (or null) has size 0 and its own id; a row without doc_id keeps its size and has no component;
    rows that share an id are one document with the links of all their texts, and get one component; an empty table gives
    no rows. Very long texts are hashed whole, a slice of texts at a time. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    rows = cut(signatures(docs, size), "signatures", few=True)
    top = rows.filter("n = -1").groupBy("key").agg(F.sum("count").alias("c")).orderBy(F.desc("c"), "key").limit(heavy_kept)
    kept = cut(top, "heavy")  # written first: else each task's best rows would go to the driver
    top = kept.toPandas()
    top = top.assign(u=top["key"].to_numpy(np.int64).view(np.uint64)).sort_values("u")
    heavy, counts = top["u"].to_numpy(np.uint64), top["c"].to_numpy(np.int64)
    sig = rows.filter("n >= 0").select("doc_id", "n", "key", "second")
    classes = cut(sig.filter("n > 0 AND doc_id IS NOT NULL").groupBy("key", "second").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n")), "classes")
    links = cut_whole(lambda: _links(docs, classes, heavy, counts, percent, size, most, hot_from, block), "links")
    # the texts of one id belong together
    named = sig.filter("doc_id IS NOT NULL")
    name = F.struct("key", "second")
    several = cut(named.groupBy("doc_id").agg(F.min(name).alias("low"), F.max(name).alias("high")).filter("low <> high").select("doc_id"), "several", few=True)
    if several.limit(1).count():
        own = near_filter(named.filter("n > 0"), "doc_id", several).join(several, "doc_id", "left_semi")
        links = links.union(own.join(classes, ["key", "second"]).select("doc_id", "rep").distinct())
    labels = components(links)

    of_class = classes.select("key", "second", "rep").join(labels, F.col("rep") == F.col("node"), "left").select("key", "second", F.coalesce("root", "rep").alias("root"))
    some = sig.filter("n > 0").join(of_class, ["key", "second"], "left").select("doc_id", "n", "root")
    none = sig.filter("n = 0").join(labels, F.col("doc_id") == F.col("node"), "left").select("doc_id", "n", F.coalesce("root", "doc_id").alias("root"))
    return some.union(none).select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("root")).alias("component_id"))


def _links(docs: DataFrame, classes: DataFrame, heavy: np.ndarray, counts: np.ndarray, percent: int, size: int, most: int, hot_from: int, block: int) -> DataFrame:
    """``a, b``: links between the first documents of classes, enough of them to connect all that are connected."""
    entries = prefix_entries(docs.filter("doc_id IS NOT NULL"), heavy, counts, percent, size, hot_from)
    dealt = entries.repartition("g", F.when(F.col("hot"), F.pmod("key", F.lit(64))).otherwise(0)).sortWithinPartitions("g", "n", "key")
    found = cut(dealt.mapInPandas(_product(percent, most), "a long, b long, na int, nb int, g long"), "product", few=True)
    columns = cut(found.filter("g IS NOT NULL").select("g", F.col("a").alias("key"), F.col("na").alias("n"), F.col("nb").alias("pos")).distinct(), "columns")

    # short columns: counts of pairs; prefix n-grams in long columns are not in the counts and may all be common
    missing = columns.groupBy("key").agg(F.count(F.lit(1)).alias("missing"))
    counted = found.filter("g IS NULL").groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("c"))
    need = F.ceil(F.lit(percent) * (F.col("na") + F.col("nb")) / F.lit(100 + percent))
    rest = lambda n: F.ceil(F.lit(percent) * F.col(n) / F.lit(100)) - 1  # noqa: E731  what the prefix leaves
    possible = F.col("c") + F.coalesce("missing", F.lit(0)) + F.greatest(rest("na"), rest("nb"))
    short = counted.join(missing.withColumnRenamed("key", "a"), "a", "left").filter(possible >= need).select("a", "b")

    blocks = columns.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    placed = columns.join(blocks, "g").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("g", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "key", "n", "pos")
    long_ = cut(placed.groupBy("g", "i", "j").applyInPandas(_long_column(percent), LONG), "long", few=True)
    pairs = cut(short.union(long_.filter("g IS NULL").select("a", "b")).distinct(), "pairs")
    discard(found, columns)
    dense = long_.filter("g IS NOT NULL").select("g", "i", "j", "block", F.col("a").alias("key"), "n", "pos")

    keys = pairs.select(F.explode(F.array("a", "b")).alias("key")).union(dense.select("key")).distinct()
    sets = sets_of(keys, classes, docs, size)
    multiplied = lambda rows: rows.join(sets, "key").groupBy("g", "i", "j").applyInPandas(_dense(percent), "a long, b long")

    # a group of near copies fills hundreds of columns: its sets are compared in one column at first, in groups, twice;
    # what that connects is left out of the other columns and block pairs, which would send a set for each of them
    near, rooted = None, None
    if dense.limit(1).count():
        near = cut(multiplied(_homes(dense, block, 1)).union(multiplied(_homes(dense, block, 2))), "near", few=True)
        single = sets.groupBy("key").agg(F.min("rep").alias("node")).join(sets.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m = 1"), "key").select("key", "node")
        rooted = cut(single.join(components(near), "node").select("key", "root"), "rooted", few=True)
        told = dense.join(rooted, "key", "left").withColumn("known", F.col("root").isNotNull()).withColumn("root", F.coalesce("root", F.lit(0)))
        mixed = told.groupBy("g", "i", "j").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.bool_and("known").alias("all")).filter("low <> high OR NOT all")
        left = cut(told.join(mixed.select("g", "i", "j"), ["g", "i", "j"], "left_semi").groupBy("g", "i", "j").applyInPandas(_long_column(percent), LONG), "dense", few=True)
        root = lambda c: rooted.toDF(c, f"root_{c}")
        more = pairs.union(left.filter("g IS NULL").select("a", "b")).distinct().join(root("a"), "a", "left").join(root("b"), "b", "left")
        pairs = cut(more.filter("NOT root_a <=> root_b OR root_a IS NULL").select("a", "b"), "pairs")
        dense = left.filter("g IS NOT NULL").select("g", "i", "j", "block", F.col("a").alias("key"))

    joined = pairs.join(sets.toDF("a", "ra", "sa"), "a").join(sets.toDF("b", "rb", "sb"), "b")
    joined = joined.select("ra", "rb", (F.size("sa") + F.size("sb")).alias("n"), F.size(F.array_intersect("sa", "sb")).alias("x"))
    exact = joined.filter(100 * F.col("x") >= percent * (F.col("n") - F.col("x"))).select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    return exact if near is None else exact.union(multiplied(dense)).union(near)
