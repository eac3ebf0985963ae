"""Exact deduplication of a new batch against an immutable snapshot, screened by static binary-fuse filters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_RUN, cut, mix64, near_filter

FILTER_SCHEMA = "bucket int, seed long, segment int, segments int, cells binary"
_TRIES = 64


def normalised(text: Column) -> Column:
    """Null as empty; each run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ")


def _shape(n: int) -> tuple[int, int]:
    """Segment length (a power of two) and number of segments that starts may fall in, for ``n`` keys and three probes."""
    length = 1 << max(2, min(18, int(np.log(max(n, 2)) / np.log(3.33) + 2.25)))
    factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
    return length, max(1, -(-int(n * factor + 32) // length))


def _probes(keys: np.ndarray, seed: int, length: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Three cells of each key, in three consecutive segments, and its 8-bit fingerprint."""
    h = mix64(keys + np.uint64(seed))
    start = ((h >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
    base = start * np.uint64(length)
    mask = np.uint64(length - 1)
    g = mix64(h)
    cells = np.stack([base + (g & mask), base + np.uint64(length) + ((g >> np.uint64(20)) & mask), base + np.uint64(2 * length) + ((g >> np.uint64(40)) & mask)])
    return cells.astype(np.int64), (h & np.uint64(255)).astype(np.uint8)


def build_filter(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """Seed, segment length, segments and cells of a 3-probe binary-fuse filter over distinct 64-bit keys.

    Cells that a single key uses are peeled off round by round, each round vectorised; keys are then assigned in the
    reverse order, so the three cells of every key xor to its fingerprint. A seed that leaves a core is replaced.
    """
    keys = np.unique(keys.astype(np.uint64))
    length, segments = _shape(len(keys))
    size = (segments + 2) * length
    for attempt in range(_TRIES):
        seed = attempt * 0x9E3779B97F4A7C15 % (1 << 62)
        cells, prints = _probes(keys, seed, length, segments)
        count = np.zeros(size, np.int64)
        owner = np.zeros(size, np.int64)  # xor of the keys' numbers: the number itself where one is left
        for row in cells:
            np.add.at(count, row, 1)
            np.bitwise_xor.at(owner, row, np.arange(len(keys)))
        rounds, left = [], len(keys)
        single = np.flatnonzero(count == 1)
        while len(single):
            key, at = np.unique(owner[single], return_index=True)
            rounds.append((key, single[at]))
            left -= len(key)
            for row in cells[:, key]:
                np.subtract.at(count, row, 1)
                np.bitwise_xor.at(owner, row, key)
            touched = np.unique(cells[:, key])
            single = touched[count[touched] == 1]
        if left == 0:
            table = np.zeros(size, np.uint8)
            for key, own in reversed(rounds):
                a, b, c = cells[:, key]
                table[own] = 0
                table[own] = prints[key] ^ table[a] ^ table[b] ^ table[c]
            return seed, length, segments, table.tobytes()
        if attempt % 8 == 7:
            segments += max(1, segments // 8)
            size = (segments + 2) * length
    raise ValueError("no seed peels this key set")


def in_filter(keys: np.ndarray, seed: int, length: int, segments: int, cells: bytes) -> np.ndarray:
    """Whether each key may be in the filter: never false for a member, true for about 1 in 256 others."""
    table = np.frombuffer(cells, np.uint8)
    at, prints = _probes(keys.astype(np.uint64), seed, length, segments)
    return (table[at[0]] ^ table[at[1]] ^ table[at[2]]) == prints


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id, sha`` of each row; ``sha`` is the digest of the normalised text in UTF-8."""
    sha = F.sha2(normalised(F.col("text")).cast("binary"), 256)
    return docs.select("doc_id", sha.alias("sha"))


def _key(sha: Column) -> Column:
    """First 64 bits of the digest, as a signed long."""
    return F.conv(F.substring(sha, 1, 16), 16, -10).cast("long")


def build_snapshot(groups: DataFrame, buckets: int) -> DataFrame:
    """Filters of an immutable snapshot, one row per bucket of digests (``groups`` has distinct ``sha``)."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        seed, length, segments, cells = build_filter(pdf["key"].to_numpy(np.int64).view(np.uint64))
        return pd.DataFrame({"bucket": [int(pdf["bucket"].iloc[0])], "seed": [seed], "segment": [length], "segments": [segments], "cells": [cells]})

    return groups.select(_bucket("sha", buckets), _key(F.col("sha")).alias("key")).groupBy("bucket").applyInPandas(build, FILTER_SCHEMA)


def _bucket(sha: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(sha), F.lit(buckets)).cast("int").alias("bucket")


def screen(filters: DataFrame, incoming: DataFrame, buckets: int) -> DataFrame:
    """``sha`` of the incoming distinct digests that their bucket's filter lets through."""

    def probe(f: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        if f.empty or pdf.empty:
            return pdf.iloc[:0][["sha"]]
        row = f.iloc[0]
        hit = in_filter(pdf["key"].to_numpy(np.int64).view(np.uint64), int(row.seed), int(row.segment), int(row.segments), row.cells)
        return pdf.loc[hit, ["sha"]]

    keyed = incoming.select("sha", _bucket("sha", buckets), _key(F.col("sha")).alias("key"))
    return filters.groupBy("bucket").cogroup(keyed.groupBy("bucket")).applyInPandas(probe, "sha string")


def exact_dedup(docs: DataFrame, in_snapshot: Column | None = None, keys_per_bucket: int = 200_000) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    ``in_snapshot`` says which rows belong to the immutable snapshot; the rest is the new batch (by default the rows
    whose ``xxhash64(doc_id)`` is odd: every row is on one side or the other). Duplicates inside the batch are grouped
    by digest on their own; their distinct digests are screened by the snapshot's binary-fuse filters, and the positives
    join the exact buckets, where the normalised bytes of one member of either side are compared.

    Null text is empty text; a null doc_id is grouped like any other, and stays only if its group has no other id (a group
    of such rows alone on either side is compared by digest).
    Repeated rows are members each; ``kept`` is true on one row of a group (of equal ids, one of them). Empty input
    gives no rows. Columns other than ``doc_id, text`` are ignored. Groups of any size are counted with partial sums; where
    the rows come back to their group (narrow ones: id and digest), a group that holds a large part of all rows is split by
    the skew handling of adaptive joins, and the window behind it goes by digest and id, so it meets one id's rows only.
    Very long texts are digested whole and compared only where digests meet.
    """
    if in_snapshot is None:
        in_snapshot = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1))), F.lit(2)) == 0
    table = cut(digests(docs).withColumn("old", F.coalesce(in_snapshot, F.lit(False))), "digests", few=True)
    sides = table.groupBy("sha", "old").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n"))
    sides = cut(sides, "groups")
    old, new = sides.filter("old"), sides.filter("not old")
    buckets = max(1, -(-old.count() // keys_per_bucket))
    positive = screen(build_snapshot(old, buckets), new, buckets)
    pairs = (
        old.select("sha", F.col("low").alias("old_id"), F.col("n").alias("old_n"))
        .join(positive, "sha")
        .join(new.select("sha", F.col("low").alias("new_id"), F.col("n").alias("new_n")), "sha")
    )
    pairs = cut(pairs, "positives")
    # bytes of both members; the positives alone carry text on
    ids = pairs.select(F.explode(F.array("old_id", "new_id")).alias("id"), "sha")
    wanted = near_filter(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", ids.select("id"))
    texts = wanted.join(ids, F.col("doc_id") == F.col("id")).select("sha", "id", normalised(F.col("text")).alias("b"))
    texts = texts.filter(F.sha2(F.col("b").cast("binary"), 256) == F.col("sha"))  # of rows that share an id
    same = texts.groupBy("sha").agg((F.min("b") == F.max("b")).alias("same"))
    linked = pairs.join(same, "sha", "left").filter("coalesce(same, old_id IS NULL OR new_id IS NULL)").select("sha", F.least("old_id", "new_id").alias("low2"), (F.col("old_n") + F.col("new_n")).alias("n2"))
    per_side = sides.join(linked, "sha", "left").select(
        "sha", "old", F.coalesce("low2", "low").alias("keep_id"), F.coalesce("n2", "n").alias("group_size")
    )
    joined = table.join(per_side, ["sha", "old"])
    copy = F.row_number().over(Window.partitionBy("sha", "doc_id").orderBy("keep_id"))  # of repeated rows with the kept id, one stays
    return joined.select(
        "doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"),
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (copy == 1)).alias("kept"), F.col("sha").alias("text_sha256"),
    )
