"""Repeated byte strings across documents, by suffix arrays of shards.

Which shard a 100-byte window goes to depends on its bytes alone: on the smallest hash among its 32-byte strings (its
anchor). So equal windows always meet, and an anchor that occurs once needs no suffix array at all. Windows that share
an anchor occurrence are neighbours and travel as one piece of text; equal pieces are settled by their hash, and the
first of each kind of piece enters its shard's suffix array. An anchor of very many kinds is dealt over several shards;
their different windows are sorted over the cluster, and a binary search finds those that several shards hold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, cut, cut_whole, mix64, near_filter, release_memory, segment_hash, small_batches

GRAM = 32
BLOCK = 1 << 20  # bytes whose anchors are found at a time: places must fit in 20 bits


def _block_anchors(raw: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each start of a ``length``-byte window: the place of its anchor; and the hash of the string at each place."""
    h, step, width = raw.astype(np.uint64) + np.uint64(1), BASE, 1
    while width < GRAM:
        h = h[:-width] * np.uint64(step) + h[width:]
        step, width = step * step % (1 << 64), 2 * width
    h = mix64(h)
    key = (h & ~np.uint64(BLOCK - 1)) | np.arange(len(h), dtype=np.uint64)
    span, width = length - GRAM + 1, 1
    while 2 * width <= span:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if width < span:
        key = np.minimum(key[: len(key) - (span - width)], key[span - width :])
    return (key & np.uint64(BLOCK - 1)).astype(np.int64), h


def anchored_pieces(texts: list[bytes], length: int = 100) -> tuple[np.ndarray, ...]:
    """Pieces of the texts: text number, first window start, number of windows, anchor hash, hash of the piece.

    Every window of ``length`` bytes inside one text is in exactly one piece.
    """
    out: list[list[np.ndarray]] = []
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def work() -> None:
        nonlocal size
        if held:
            raw = np.frombuffer(b"".join(x[2] for x in held), np.uint8)
            sizes = np.array([len(x[2]) for x in held])
            begin = np.cumsum(sizes) - sizes
            place, h = _block_anchors(raw, length)
            step = np.zeros(len(raw) + 1, np.int64)  # 1 where windows of a text start, -1 where they stop
            np.add.at(step, begin, 1)
            np.add.at(step, begin + sizes - length + 1, -1)
            inside = np.cumsum(step[:-1])[: len(place)] > 0
            new = inside & np.concatenate([[True], place[1:] != place[:-1]])
            new[begin] = True
            first = np.flatnonzero(new & inside)
            # a piece ends where the next begins or its text's windows stop
            stop = np.minimum(np.append(first[1:], len(place)), (begin + sizes - length + 1)[np.searchsorted(begin, first, side="right") - 1])
            which = np.searchsorted(begin, first, side="right") - 1
            number, offset = np.array([x[0] for x in held])[which], np.array([x[1] for x in held])[which]
            at = place[first]
            whole = mix64(segment_hash(raw, first, stop + length - 1) + (at - first).astype(np.uint64))
            out.append([number, offset + first - begin[which], stop - first, h[at], whole])
        held.clear()
        size = 0

    for i, t in enumerate(texts):
        for a in range(0, max(len(t) - length + 1, 0), BLOCK // 2):
            part = t[a : a + BLOCK // 2 + length - 1]
            if size + len(part) >= BLOCK:
                work()
            held.append((i, a, part))
            size += len(part)
    work()
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def suffix_array(raw: np.ndarray) -> np.ndarray:
    """Suffixes in order, by Larsson-Sadakane refinement.

    Suffixes are sorted by 7 bytes; groups of equal ones are then sorted by the rank of the suffix that begins where
    their known prefix ends, which doubles the prefix. Suffixes alone in their group are not touched again.
    """
    n = len(raw)
    padded = np.concatenate([raw.astype(np.uint64) + np.uint64(1), np.zeros(7, np.uint64)])  # 0: the end, before all bytes
    key = np.zeros(n, np.uint64)
    for k in range(7):
        key = (key << np.uint64(9)) | padded[k : k + n]
    sa = np.argsort(key, kind="stable")
    sorted_key = key[sa]
    new = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]]) if n else np.zeros(0, bool)
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0)) if n else np.zeros(0, np.int64)
    rank[sa] = head
    h = 7
    # places in sa whose group has several members
    alone = new & np.concatenate([new[1:], [True]]) if n else new
    left = np.flatnonzero(~alone)
    while len(left):  # the order must be complete: Kasai's rule needs it
        suffix = sa[left]
        group = rank[suffix]
        key = group * (n + 1) + rank[np.minimum(suffix + h, n)] + 1
        order = np.argsort(key, kind="stable")
        key, suffix = key[order], suffix[order]
        sa[left] = suffix
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[suffix] = np.maximum.accumulate(np.where(new, left, 0))
        left = left[~(new & np.concatenate([new[1:], [True]]))]
        h *= 2
    return sa


def common_prefixes(raw: np.ndarray, sa: np.ndarray, cap: int, lane: int = 32) -> np.ndarray:
    """Length of the common prefix of each suffix with the one before it in ``sa``, up to ``cap``, by Kasai's rule.

    Going on by one byte in the text, a common prefix loses one byte at most. Text runs of ``lane`` bytes go in step, so
    each step is one vector operation over all runs.
    """
    n = len(sa)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    padded = np.concatenate([raw, np.zeros(1, np.uint8)])
    out = np.zeros(n, np.int64)
    have = np.zeros(-(-n // lane), np.int64)
    for k in range(lane):
        at = np.arange(k, n, lane)
        have = np.maximum(have[: len(at)] - 1, 0)
        other = before[at]
        have[other < 0] = 0
        go = np.flatnonzero((other >= 0) & (have < cap))
        while len(go):
            a, b = at[go] + have[go], other[go] + have[go]
            same = (np.maximum(a, b) < n) & (padded[np.minimum(a, n)] == padded[np.minimum(b, n)])
            go = go[same]
            have[go] += 1
            go = go[have[go] < cap]
        out[at] = have
    lcp = np.zeros(n, np.int64)
    lcp[np.arange(n)] = out[sa]
    return lcp


def shard_repeats(pieces: list[bytes], counts: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows that start earlier in the shard as well: piece number, first window, number of windows; and the
    places, as piece number and window, of the first of each kind of window.

    Pieces of one anchor stand in order of their place in the corpus.
    """
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    sizes = np.array([len(p) for p in pieces])
    begin = np.cumsum(sizes) - sizes
    sa = suffix_array(raw)
    lcp = common_prefixes(raw, sa, length)
    window = np.zeros(len(raw) + 1, np.int64)
    np.add.at(window, begin, 1)
    np.add.at(window, begin + counts, -1)
    window = np.cumsum(window[:-1]) > 0
    group = np.cumsum(lcp < length)  # in suffix order
    keep = window[sa]
    place, group = sa[keep], group[keep]
    order = np.lexsort((place, group))
    place, group = place[order], group[order]
    lead = np.concatenate([[True], group[1:] != group[:-1]]) if len(group) else np.zeros(0, bool)
    again = np.zeros(len(raw), bool)
    again[place[~lead]] = True
    piece = np.repeat(np.arange(len(pieces)), sizes)
    firsts = place[lead]
    hit = np.flatnonzero(again)
    first = np.concatenate([[True], (np.diff(hit) != 1) | (piece[hit[1:]] != piece[hit[:-1]])]) if len(hit) else np.zeros(0, bool)
    at = hit[first]
    return piece[at], at - begin[piece[at]], np.diff(np.append(np.flatnonzero(first), len(hit))), piece[firsts], firsts - begin[piece[firsts]]


_ROWS = "anchor long, whole long, doc long, kin long, start long, count long"
_NAMES = [x.split()[0] for x in _ROWS.split(", ")]


def _anchors(length: int):
    """Pieces of each document; a piece that its task has seen earlier in the corpus comes without an anchor: it is a repeat."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        met: dict[bytes, tuple[int, int]] = {}
        for pdf in batches:
            pdf = pdf.sort_values(["doc_id", "kin"], kind="stable")
            texts, ids, copies = [], [], []
            for doc, kin, text in zip(pdf["doc_id"].tolist(), pdf["kin"].tolist(), pdf["text"], strict=True):
                t = (text or "").encode()
                if len(t) < length:
                    continue
                key = hashlib.blake2b(t, digest_size=16).digest()
                first = met.get(key)
                if first == (doc, kin):  # the same row again
                    continue
                if first is not None and first < (doc, kin):
                    copies.append((None, 0, doc, kin, 0, len(t) - length + 1))
                    continue
                if len(met) < 500_000:
                    met[key] = (doc, kin)
                texts.append(t)
                ids.append((doc, kin))
            if copies:
                yield pd.DataFrame(copies, columns=_NAMES).astype({"anchor": "Int64"})
            number, start, count, anchor, whole = anchored_pieces(texts, length)
            if len(number):
                _, first, kind = np.unique(whole, return_index=True, return_inverse=True)
                head, (doc, kin) = first[kind], np.array(ids, np.int64)[number].T
                later = head != np.arange(len(whole))
                marks = pd.arrays.IntegerArray(anchor.view(np.int64), later)
                found = pd.DataFrame({"anchor": marks, "whole": whole.view(np.int64), "doc": doc, "kin": kin, "start": start, "count": count})
                yield found[~(later & (doc == doc[head]) & (kin == kin[head]) & (start == start[head]))]
        release_memory()

    return run


def _classes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Over rows in order of anchor, piece, place: repeats (no anchor) and, of anchors with several kinds of piece, the first of each kind."""
    empty = pd.DataFrame({x: np.zeros(0, np.int64) for x in _NAMES}).assign(given=np.zeros(0, bool))
    held = empty

    def out(df: pd.DataFrame, repeat: bool) -> pd.DataFrame:
        df = df[_NAMES]
        return df.assign(anchor=pd.array([None] * len(df), "Int64")) if repeat else df.assign(anchor=df["anchor"].astype("Int64"))

    for pdf in batches:
        missing = pdf["anchor"].isna().to_numpy()
        if missing.any():
            yield out(pdf[missing], True)
        df = pdf[~missing].astype({"anchor": np.int64}).assign(given=False) if missing.any() else pdf.assign(given=False)
        if not len(df):
            continue
        df = pd.concat([held, df], ignore_index=True) if len(held) else df.reset_index(drop=True)
        a, w = df["anchor"].to_numpy(), df["whole"].to_numpy()
        new_anchor = np.concatenate([[True], a[1:] != a[:-1]])
        new_kind = new_anchor | np.concatenate([[True], w[1:] != w[:-1]])
        if not new_kind.all():
            head = np.maximum.accumulate(np.where(new_kind, np.arange(len(df)), 0))
            place = df[["doc", "kin", "start"]].to_numpy()
            # a piece of a repeated row is the first one itself
            yield out(df[~new_kind & (place != place[head]).any(1)], True)
        df, new_anchor = df[new_kind], new_anchor[new_kind]
        group = np.cumsum(new_anchor) - 1
        several = (np.bincount(group) > 1)[group]  # a carried kind and a new one are several
        last = group == group[-1]
        now = several & ~df["given"].to_numpy()
        if now.any():
            yield out(df[now], False)
        # of the anchor that may go on: its last kind, and whether its kinds so far are given
        held = df[last].iloc[-1:].assign(given=bool(several[-1]) or bool(df["given"].to_numpy()[-1]))
    yield out(empty, False)


def _cut_pieces(length: int):
    """Texts with the pieces to take from them: rows of pieces with their bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, kin, text, pieces in zip(pdf["doc"], pdf["kin"], pdf["text"], pdf["pieces"], strict=True):
                t = text.encode()
                rows += [(p["anchor"], doc, kin, p["start"], p["count"], t[p["start"] : p["start"] + p["count"] + length - 1]) for p in pieces]
            yield pd.DataFrame(rows, columns=["anchor", "doc", "kin", "start", "count", "piece"])

    return run


_FOUND = "anchor long, window binary, doc long, kin long, start long, count long"


def _shards(length: int, shard_bytes: int):
    """Over pieces in order of anchor, deal and place: runs of repeated windows, shard by shard; of anchors dealt over several
    shards (deal > 0) also the first of each kind of window, with its bytes. A shard holds whole anchors or deals of one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0

        def work(df: pd.DataFrame) -> Iterator[pd.DataFrame]:
            if (df["deal"] > 0).any():  # several deals of an anchor in one shard: in order of place again
                df = df.sort_values(["anchor", "doc", "kin", "start"], kind="stable")
            pieces = df["piece"].tolist()
            doc, kin, start, deal, anchor = (df[c].to_numpy(np.int64) for c in ("doc", "kin", "start", "deal", "anchor"))
            piece, at, count, lead, lead_at = shard_repeats(pieces, df["count"].to_numpy(np.int64), length)
            none = pd.array([None] * len(piece), "Int64")
            yield pd.DataFrame({"anchor": none, "window": None, "doc": doc[piece], "kin": kin[piece], "start": start[piece] + at, "count": count})
            some = deal[lead] > 0
            lead, lead_at = lead[some], lead_at[some]
            for lo in range(0, len(lead), 50_000):
                k, w = lead[lo : lo + 50_000], lead_at[lo : lo + 50_000]
                bytes_ = [pieces[i][j : j + length] for i, j in zip(k.tolist(), w.tolist(), strict=True)]
                yield pd.DataFrame({"anchor": pd.array(anchor[k], "Int64"), "window": bytes_, "doc": doc[k], "kin": kin[k], "start": start[k] + w, "count": 1})

        for pdf in batches:
            lengths = np.cumsum([len(p) for p in pdf["piece"]])
            for part in np.split(np.arange(len(pdf)), np.flatnonzero(np.diff(lengths // shard_bytes)) + 1):
                if not len(part):
                    continue
                held.append(pdf.iloc[part])
                size += int(lengths[part[-1]] - (lengths[part[0] - 1] if part[0] else 0))
                if size >= shard_bytes:
                    whole = pd.concat(held)
                    names = whole[["anchor", "deal"]].to_numpy(np.int64)
                    # close the shard before its last anchor, which may go on
                    border = np.flatnonzero((names[1:] != names[:-1]).any(1))
                    if len(border):
                        yield from work(whole.iloc[: border[-1] + 1])
                        whole = whole.iloc[border[-1] + 1 :]
                    held, size = [whole], int(whole["piece"].str.len().sum())
        if held:
            yield from work(pd.concat(held))
        release_memory()

    return run


def _merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Over the shards' windows in order of anchor, bytes and place: those that are not the first of their kind."""
    last: tuple[int, bytes] | None = None
    for pdf in batches:
        anchor = pdf["anchor"].to_numpy(np.int64)
        text = np.array([w + b"\1" for w in pdf["window"]])  # the last byte keeps zeros at the end
        again = np.zeros(len(pdf), bool)
        edges = np.concatenate([[0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, [len(pdf)]])
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            again[a:b] = np.searchsorted(text[a:b], text[a:b]) != np.arange(b - a)
            if a == 0 and b and last is not None and last[0] == anchor[0]:
                again[: np.searchsorted(text[:b], last[1], side="right")] = True
        if len(pdf):
            last = (int(anchor[-1]), text[-1])
        yield pdf.loc[again, ["doc", "kin", "start", "count"]]


def _texts(docs: DataFrame) -> DataFrame:
    """``doc_id, kin, text``: ``kin`` tells the texts of one id apart (0 where an id has one row)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    several = cut(texts.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id"), "several", few=True)
    none = F.lit(0).cast("long").alias("kin")
    if not several.limit(1).count():
        return texts.select("doc_id", none, "text")
    kin = F.conv(F.substring(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256), 1, 16), 16, -10).cast("long").alias("kin")
    return near_filter(texts, "doc_id", several).select("doc_id", kin, "text").unionByName(near_filter(texts, "doc_id", several, others=True).select("doc_id", none, "text"))


def repeated_windows(texts: DataFrame, length: int = 100, shard_bytes: int = 2_000_000, hot_pieces: int = 1_000) -> DataFrame:
    """``doc, kin, start, count``: runs of window starts whose ``length`` bytes also start earlier; ``texts`` have ``doc_id, kin, text``.

    A shard holds up to about ``shard_bytes``, or the pieces of one anchor; anchors of over ``hot_pieces`` kinds of piece
    are dealt over shards of about that many.
    """
    small_batches(texts.sparkSession)
    texts = texts.filter("doc_id IS NOT NULL")
    rows = texts.mapInPandas(_anchors(length), _ROWS)
    spread = F.when(F.col("anchor").isNull(), F.col("doc")).otherwise(F.col("anchor"))
    lists = cut(rows.repartition(spread).sortWithinPartitions("anchor", "whole", "doc", "kin", "start").mapInPandas(_classes, _ROWS), "lists", few=True)
    settled = lists.filter("anchor IS NULL").select("doc", "kin", "start", "count")
    need = lists.filter("anchor IS NOT NULL").select("anchor", "doc", "kin", "start", "count")
    by_doc = need.groupBy("doc", "kin").agg(F.collect_list(F.struct("anchor", "start", "count")).alias("pieces"))
    near = near_filter(texts, "doc_id", need.select("doc")).withColumnRenamed("doc_id", "doc").dropDuplicates(["doc", "kin"])
    pieces = cut(near.join(by_doc, ["doc", "kin"]).mapInPandas(_cut_pieces(length), "anchor long, doc long, kin long, start long, count long, piece binary"), "pieces")
    # a table of its own: Spark knows its size, and broadcasts it only below its threshold
    hot = cut(pieces.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot_pieces), "hot", few=True)
    deal = F.when(F.col("n").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc", "kin", "start"), F.ceil(F.col("n") / hot_pieces)) + 1)
    dealt = pieces.join(hot, "anchor", "left").select("anchor", deal.cast("long").alias("deal"), "doc", "kin", "start", "count", "piece")
    found = dealt.repartition("anchor", "deal").sortWithinPartitions("anchor", "deal", "doc", "kin", "start").mapInPandas(_shards(length, shard_bytes), _FOUND)
    found = cut(found, "runs", few=True)
    runs = settled.union(found.filter("anchor IS NULL").select("doc", "kin", "start", "count"))
    several = found.filter("anchor IS NOT NULL")
    if several.limit(1).count():
        merge = several.repartitionByRange("anchor", "window").sortWithinPartitions("anchor", "window", "doc", "kin", "start")
        runs = runs.union(merge.mapInPandas(_merged, "doc long, kin long, start long, count long"))
    return runs


def _remove(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, text, runs in zip(pdf["doc_id"], pdf["text"], pdf["runs"], strict=True):
                t = (text or "").encode()
                spans: list[list[int]] = []
                for a, n in sorted((r["start"], r["count"]) for r in (runs if runs is not None else ())):
                    b = a + n + length - 1
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], b)
                    else:
                        spans.append([a, b])
                kept, at = [], 0
                for a, b in spans:
                    kept.append(t[at:a])
                    at = b
                kept.append(t[at:])
                out.append((doc, len(t), [{"start": a, "end": b} for a, b in spans], b"".join(kept)))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "spans", "kept"]).astype({"doc_id": "Int64"})

    return run


def remove_repeats(docs: DataFrame, length: int = 100, shard_bytes: int = 2_000_000, hot_pieces: int = 1_000) -> DataFrame:
    """``doc_id, n_bytes, spans (array of start, end), kept`` of every document; ``kept`` are the bytes that stay.

    A byte goes if a ``length``-byte string that covers it also starts earlier: in a document with a smaller doc_id, or
    earlier in its own. Strings are compared in the input and never reach from one document into another.

    Null text is empty. A row without doc_id has no place in the order: it is returned whole and removes nothing from
    others. Rows that share id and text are one document, reported each; rows that share an id alone are documents one
    after the other, in order of a digest of their text. Texts of any length are worked on in blocks. An empty table
    gives no rows; other columns are ignored.
    """
    texts = _texts(docs)
    runs = cut_whole(lambda: repeated_windows(texts, length, shard_bytes, hot_pieces), "repeats")
    by_doc = runs.groupBy("doc", "kin").agg(F.collect_list(F.struct("start", "count")).alias("runs")).withColumnRenamed("doc", "doc_id")
    none = F.array().cast("array<struct<start:long,end:long>>")
    schema = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
    changed = near_filter(texts, "doc_id", runs.select("doc")).join(by_doc, ["doc_id", "kin"], "left").mapInPandas(_remove(length), schema)
    text = F.coalesce("text", F.lit(""))
    same = near_filter(texts, "doc_id", runs.select("doc"), others=True)
    return changed.unionByName(same.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), none.alias("spans"), text.cast("binary").alias("kept")))
