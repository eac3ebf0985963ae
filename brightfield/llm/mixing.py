"""Mixing sources to target weights by pivotal dependent rounding of copy numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import row_numbers, running
from .common import cut, free_name, mix64, words_of


def source_targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """``source, n, source_size, target`` from ``source, n, source_size`` (one row per source).

    Sources in code point order, null last, weigh ``weights`` repeating; all targets together are all sizes together.
    A target stops at ``cap`` times its source's size and the excess is reshared by weight until none is above. That
    ends at min(cap * size, level * weight) with one level for all, found here from running sums over the sources in
    order of cap * size / weight (over ranges of sources where there are many: sources may be hosts).
    """
    place = F.col("source").isNull(), F.col("source").cast("binary")
    listed = row_numbers(sources.select("source", "n", "source_size"), list(place), "place_no")
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("place_no") - 1, F.lit(len(weights))) + 1).cast("int"))
    df = listed.withColumn("w", w.cast("long")).withColumn("most", cap * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("w"))
    df = cut(running(df, [F.col("ratio"), F.col("w"), *place], {"most_before": "most", "w_before": "w"}), "levels", few=True)
    total = df.agg(F.sum("source_size").alias("words"), F.sum("w").alias("all_w"))
    df = df.crossJoin(F.broadcast(total))  # one row
    df = df.withColumn("level", (F.col("words") - F.col("most_before")) / (F.col("all_w") - F.col("w_before")))
    # the first source whose cap is above the level of the sources still open sets the level for all after it
    found = df.filter(F.col("most") >= F.col("level") * F.col("w")).agg(F.min(F.struct("ratio", "w_before", F.col("level").alias("found")))["found"].alias("found"))
    df = df.crossJoin(F.broadcast(found))  # one row
    return df.select("source", "n", "source_size", F.least(F.col("most"), F.coalesce(F.col("found") * F.col("w"), F.col("most"))).cast("double").alias("target"))


def _chance(a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
    """Uniform numbers in [0, 1) that depend on the pair and the seed alone."""
    x = mix64(a.astype(np.int64).view(np.uint64) ^ mix64(b.astype(np.int64).view(np.uint64) + np.uint64(seed)))
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def pivotal(size: np.ndarray, mass: np.ndarray, key: np.ndarray, seed: int) -> tuple[np.ndarray, int]:
    """Pivotal rounding of masses in [0, size], one after the other against the unit still open.

    Each step moves mass between two units, their sum unchanged, until one holds 0 or its whole size; either direction
    has the probability that keeps both expectations. Returns the masses and the index of the unit left open (-1: none).
    """
    mass = mass.astype(np.float64).copy()
    eps = 1e-9
    live = np.flatnonzero((mass > eps * size) & (mass < size * (1 - eps)))
    done = np.ones(len(size), bool)
    done[live] = False
    mass[done] = np.where(mass[done] * 2 > size[done], size[done], 0)
    if not len(live):
        return mass, -1
    u = _chance(key[live], np.roll(key[live], 1), seed)
    i = live[0]
    for n in range(1, len(live)):
        if i < 0:
            i = live[n]
            continue
        j = live[n]
        up, down = min(size[i] - mass[i], mass[j]), min(mass[i], size[j] - mass[j])
        move = up if u[n] * (up + down) < down else -down
        mass[i] += move
        mass[j] -= move
        open_i = eps * size[i] < mass[i] < size[i] * (1 - eps)
        open_j = eps * size[j] < mass[j] < size[j] * (1 - eps)
        if not open_i:
            mass[i] = size[i] if mass[i] * 2 > size[i] else 0.0
        if not open_j:
            mass[j] = size[j] if mass[j] * 2 > size[j] else 0.0
        i = i if open_i else (j if open_j else -1)
    return mass, int(i)


def pivotal_pool(size: np.ndarray, fraction: float, key: np.ndarray, seed: int) -> tuple[np.ndarray, int]:
    """Pivotal rounding where all units share one fraction. Sizes come largest first.

    While the units after it can give or take all that a unit needs, it is paired with them as one: mass moves until the
    unit is integral, with the probabilities that keep expectations, and the fraction of those after it changes by
    little. From the first unit that they cannot serve, units are paired one by one (:func:`pivotal`). So no two units
    follow one draw, and what stays open at the end is among the smallest units.
    """
    mass, pool, f = np.zeros(len(size)), float(size.sum()), float(fraction)
    u = _chance(key, np.roll(key, 1), seed)
    for i, s in enumerate(size):
        pool -= s
        if s <= 0 or f <= 1e-9 or f >= 1 - 1e-9:
            mass[i] = s if f > 0.5 else 0.0
            continue
        own = f * s
        if s - own > f * pool or own > (1 - f) * pool:
            mass[i:], left = pivotal(size[i:], f * size[i:], key[i:], seed)
            return mass, left + i if left >= 0 else -1
        move = s - own if u[i] < f else -own
        mass[i] = own + move
        f = min(1.0, max(0.0, (f * pool - move) / pool))
    return mass, -1


_NODE = "doc_id long, copy_no long, source string, leaf long, home long, size long, mass double, open boolean"
_LEAF = "doc_id long, copy_no long, size long, source_size long, target double, copies long, open boolean, mass double, source string, leaf long"


def _keys(pdf: pd.DataFrame) -> np.ndarray:
    """What tells the units of a source apart, as one number each."""
    return pdf["doc_id"].fillna(-1).to_numpy(np.int64) ^ mix64(pdf["copy_no"].to_numpy(np.int64).view(np.uint64)).view(np.int64)


def _units(sizes: DataFrame, chunk: int = 10_000) -> DataFrame:
    """``doc_id, source, size, copy_no``: rows that are alike are numbered from 0, however many there are.

    They are counted first (with partial sums) and then dealt out again in chunks, so no task holds a hot id.
    """
    alike = sizes.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("rows"))
    once = alike.filter("rows = 1").select("doc_id", "source", "size", F.lit(0).cast("long").alias("copy_no"))
    first = alike.filter("rows > 1").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, F.lit(chunk).cast("long"))).alias("from"))
    again = first.repartition("doc_id", "source", "size", "from")
    numbers = F.sequence(F.col("from"), F.least(F.col("from") + chunk, F.col("rows")) - 1)
    return once.unionByName(again.select("doc_id", "source", "size", F.explode(numbers).alias("copy_no")))


def _node(seed: int, last: bool):
    """The function of one node of the reduction tree; at the root (``last``) no unit stays open."""

    def node(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "doc_id", "copy_no", "home"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        size = pdf["size"].to_numpy(np.float64)
        mass, left = pivotal(size, pdf["mass"].to_numpy(), _keys(pdf), seed)
        if last and left >= 0:
            mass[left], left = (size[left] if mass[left] * 2 > size[left] else 0.0), -1
        return pdf.assign(mass=mass, open=np.arange(len(pdf)) == left)[[x.split()[0] for x in _NODE.split(", ")]]

    return node


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0, seed: int = 0, per_leaf: int = 4_000, fan_in: int = 64) -> DataFrame:
    """Copies of every document so that each source's words come to its target.

    Returns ``doc_id, source, size, source_size, target, copies, taken`` (``taken = copies * size``). Every document of a
    source has the same expected number of copies, target / source_size; the whole part is certain, and the fraction is
    rounded by pivotal steps inside leaves of at most about ``per_leaf`` documents (a source of any size is dealt over
    as many leaves as it needs). A leaf leaves at most one document open; those meet, ``fan_in`` leaves at a time, in a
    reduction tree, and the last one of a source is rounded to the nearer side. So a source misses its target by at
    most half of one document. The outcome depends on the rows and ``seed`` only, not on partitions.

    Null text has size 0 (never taken); a null source is a source of its own, last in order; repeated rows, and rows
    without doc_id, are rounded each and dealt over the leaves like any; an empty table gives no rows. Columns other than
    ``doc_id, text, source`` are ignored.
    """
    sizes = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.size(words_of(F.col("text"))).cast("long").alias("size")), "sizes", few=True)
    sources = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    goals = cut(source_targets(sources, weights, cap), "targets").withColumnRenamed("source", "s")
    leaves = F.ceil(F.col("n") / per_leaf)
    rows = _units(sizes).join(goals, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rows = rows.withColumn("ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    rows = rows.withColumn("leaf", F.pmod(F.xxhash64("doc_id", "size", "copy_no", F.lit(seed)), leaves))

    def leaf(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "doc_id", "copy_no"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        whole = np.floor(pdf["ratio"].to_numpy() + 1e-12)
        size = pdf["size"].to_numpy(np.float64)
        mass, left = pivotal_pool(size, max(0.0, float(pdf["ratio"].iloc[0] - whole[0])), _keys(pdf), seed)
        is_open = np.arange(len(pdf)) == left
        copies = whole + ((mass * 2 > size) & (size > 0) & ~is_open)
        return pdf.assign(copies=copies.astype(np.int64), open=is_open, mass=mass)[[x.split()[0] for x in _LEAF.split(", ")]]

    done = cut(rows.groupBy("source", "leaf").applyInPandas(leaf, _LEAF), "leaves", few=True)
    # reduction tree over the open units: a leaf number loses a factor fan_in on each level
    level = done.filter("open").select("doc_id", "copy_no", "source", "leaf", "size", "mass")
    widest = goals.agg(F.max(leaves)).first()[0] or 1
    rounded = None
    level = level.withColumn("home", F.col("leaf"))
    while True:
        last = widest <= fan_in
        merged = level.withColumn("leaf", F.floor(F.col("leaf") / fan_in)).groupBy("source", "leaf")
        out = cut(merged.applyInPandas(_node(seed + 1, last), _NODE), "node")
        closed = out.filter("not open").select(F.col("source").alias("s"), F.col("home").alias("h"), (F.col("mass") * 2 > F.col("size")).cast("long").alias("extra"))
        rounded = closed if rounded is None else rounded.unionByName(closed)
        if last:
            break
        level, widest = out.filter("open").drop("open"), -(-widest // fan_in)
    # a leaf of a source leaves one unit open at most
    joined = done.join(rounded, F.col("open") & F.col("source").eqNullSafe(F.col("s")) & (F.col("leaf") == F.col("h")), "left")
    copies = F.col("copies") + F.coalesce("extra", F.lit(0))
    return joined.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def take_copies(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """Rows of ``docs`` as often as ``mixed`` takes their doc_id; all its columns, whatever their names.

    Rows without doc_id cannot be named and are left out; of rows that share an id, each is taken as often as the one that
    is taken most.
    """
    own, number, copy = (free_name(x, docs) for x in ("mix_id", "mix_copies", "mix_copy"))
    copies = mixed.filter("copies > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("copies").cast("int")).toDF(own, number)
    joined = docs.join(copies, F.col("doc_id") == F.col(own))
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(number)))).drop(own, number, copy)
