"""Selection under quotas: top rows of groups, largest remainders, round robins, matched samples, packing in order."""

from __future__ import annotations

import bisect
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import sample_order
from ..session import materialise
from .ordered import row_numbers


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group, with their place."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("place") <= k)


def largest_remainder(groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``key, size, quota``: ``total`` dealt in proportion to size; what rounding leaves goes to the largest fractions.

    Ties go to the larger key; a quota never exceeds its group, so some of the total may be left over. ``groups`` has
    one row a group.
    """
    all_ = Window.partitionBy(F.lit(1))
    exact = F.lit(float(total)) * F.col(size) / F.sum(size).over(all_)
    df = groups.withColumn("exact", exact).withColumn("base", F.least(F.col(size), F.floor("exact").cast("long")))
    df = df.withColumn("left", F.lit(total) - F.sum("base").over(all_)).withColumn("open", F.col("base") < F.col(size))
    turn = F.row_number().over(Window.partitionBy("open").orderBy(F.desc(F.col("exact") - F.floor("exact")), F.desc(key)))
    return df.select(key, size, (F.col("base") + (F.col("open") & (turn <= F.col("left"))).cast("long")).alias("quota"))


def quota_sample(df: DataFrame, key: str, id_: str, order: list[Column], total: int) -> DataFrame:
    """``total`` rows: quotas by largest remainder, the best rows of each group, then the best of the rest."""
    groups = df.groupBy(key).agg(F.count(F.lit(1)).alias("group_rows"))
    quotas = largest_remainder(groups, key, "group_rows", total).select(F.col(key).alias("q_key"), "quota")
    ranked = df.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    chosen = ranked.join(quotas, F.col(key).eqNullSafe(F.col("q_key"))).withColumn("by_quota", F.col("place") <= F.col("quota")).drop("q_key", "quota", "place")
    # the best of the rest are few: a distributed top-n
    return chosen.orderBy(F.desc("by_quota"), *order, id_).limit(total)


def round_robin(df: DataFrame, group: str, order: list[Column], limit: int, cap: int | None = None) -> DataFrame:
    """One row of each group in turn, groups in order, until ``limit``; at most ``cap`` of a group. Columns ``turn_no`` added."""
    w = Window.partitionBy(group).orderBy(*order)
    turns = df.withColumn("turn_no", F.row_number().over(w)).filter(F.col("turn_no") <= min(limit, cap or limit))
    return turns.orderBy("turn_no", group).limit(limit)


def matched_sample(pool: DataFrame, reference: DataFrame, key: str, id_: str, seed: int) -> DataFrame:
    """As many rows of each key as the reference has, drawn by hash order."""
    wanted = reference.groupBy(key).agg(F.count(F.lit(1)).alias("wanted"))
    w = Window.partitionBy(key).orderBy(sample_order(F.col(id_), seed), id_)
    return pool.withColumn("draw_no", F.row_number().over(w)).join(wanted, key).filter("draw_no <= wanted").drop("wanted")


def spaced_holdout(df: DataFrame, family: str, order: list[Column], fraction: float = 1 / 3) -> DataFrame:
    """``df`` with ``held_out``: evenly spaced ranks of each family; a family of one gives none, others one at least."""
    part, ranked = Window.partitionBy(family), Window.partitionBy(family).orderBy(*order)
    df = df.withColumn("family_n", F.count(F.lit(1)).over(part)).withColumn("rank_no", F.row_number().over(ranked) - 1)
    h = F.when(F.col("family_n") <= 1, 0).otherwise(F.greatest(F.lit(1), F.bround(F.col("family_n") * fraction))).cast("long")
    df = df.withColumn("holdout_n", h)
    # rank r is one of floor(j n / h) exactly if the least such j gives r back
    j = F.ceil(F.col("rank_no") * F.col("holdout_n") / F.col("family_n"))
    hit = (j < F.col("holdout_n")) & (F.floor(j * F.col("family_n") / F.col("holdout_n")) == F.col("rank_no"))
    return df.withColumn("held_out", (F.col("holdout_n") > 0) & F.coalesce(hit, F.lit(False))).drop("family_n", "rank_no", "holdout_n")


def two_cap_selection(df: DataFrame, size: int, cell: str, world: str, score: str, id_: str, cell_fraction: float = 0.10, world_fraction: float = 0.35) -> DataFrame:
    """Best scores first under a cap for each cell and each world; a second pass keeps the cell cap alone.

    Either cap alone bounds how far down a cell the passes can reach, so each cell gives its first rows only and the
    greedy pass runs over those: at most cells times cap rows.
    """
    cap = max(1, math.ceil(size * cell_fraction))
    world_cap = max(cap, math.ceil(size * world_fraction))
    # a row is passed over for its world only; rows of one cell and world beyond the cap can never be reached
    few = df.withColumn("cell_no", F.row_number().over(Window.partitionBy(cell, world).orderBy(F.desc(score), F.col(id_)))).filter(F.col("cell_no") <= cap).drop("cell_no")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([score, id_], ascending=[False, True], kind="stable").reset_index(drop=True)
        cells, worlds, taken = {}, {}, []
        for second in (False, True):
            for r in pdf.itertuples():
                c, w = getattr(r, cell), getattr(r, world)
                if len(taken) >= size:
                    break
                if (second and r.Index in chosen) or cells.get(c, 0) >= cap or (not second and worlds.get(w, 0) >= world_cap):
                    continue
                taken.append(r.Index)
                cells[c] = cells.get(c, 0) + 1
                worlds[w] = worlds.get(w, 0) + 1
            chosen = set(taken)
        return pdf.loc[taken].assign(pick_no=range(1, len(taken) + 1))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in few.schema) + ", pick_no long"
    return few.withColumn("all_rows", F.lit(1)).groupBy("all_rows").applyInPandas(lambda pdf: run(pdf.drop(columns="all_rows")), schema)


def pack_in_order(df: DataFrame, order: list[str], size: str, most_items: int = 8, most_size: int = 36_000, part: int = 10_000) -> DataFrame:
    """``df`` with ``place_no, batch_no``: rows in order, a new batch where the next row would bring it over either limit.

    Where a batch ends depends on where it began. But a batch holds ``most_items`` rows at most, so it enters a part of
    ``part`` rows at one of as many places: each part is walked from all of them at once, a list with a row for each part
    says which entry it was, and the parts number their rows. An oversize row is a batch by itself.
    """
    if part < most_items:
        raise ValueError("a part must hold a batch")
    numbered = materialise(row_numbers(df, [F.col(c) for c in order], "place_no"), "places")
    sizes = numbered.select((F.col("place_no") - 1).alias("at"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("s")).withColumn("no", F.floor(F.col("at") / part))
    # a part also sees the first rows of the next one, where its last batch may end
    ahead = sizes.filter((F.col("no") > 0) & (F.col("at") % part < most_items)).withColumn("no", F.col("no") - 1)
    seen = sizes.unionByName(ahead)

    def steps(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, int]:
        """A part in order, how many rows a batch holds that begins at each of its rows, and how many rows are its own."""
        pdf = pdf.sort_values("at")
        s = pdf["s"].to_numpy(np.int64)
        total = np.concatenate([[0], np.cumsum(s)])
        place = np.arange(len(s))
        stop = np.maximum.accumulate(np.searchsorted(total, total[:-1] + most_size, side="right") - 1) if (s >= 0).all() else None
        if stop is None:
            raise ValueError("sizes must not be negative")
        step = np.clip(stop - place, 1, most_items)
        return pdf, step, int((pdf["at"] < (int(pdf["no"].iloc[0]) + 1) * part).sum())

    def walk(step: np.ndarray, own: int, entry: int) -> list[int]:
        begins = []
        while entry < own:
            begins.append(entry)
            entry += int(step[entry])
        return [*begins, entry]

    def entries(pdf: pd.DataFrame) -> pd.DataFrame:
        _, step, own = steps(pdf)
        out = [(int(pdf["no"].iloc[0]), e, len(b := walk(step, own, e)) - 1, b[-1] - own) for e in range(most_items)]
        return pd.DataFrame(out, columns=["no", "entry", "batches", "leave"])

    def chain(batches):
        entry = first = 0
        for pdf in batches:
            pdf = pdf.sort_values(["no", "entry"])
            out = []
            for no, group in pdf.groupby("no", sort=False):
                row = group[group["entry"] == entry]
                if not len(row):
                    raise ValueError("a part's rows came apart")
                out.append((no, entry, first))
                first, entry = first + int(row["batches"].iloc[0]), int(row["leave"].iloc[0])
            yield pd.DataFrame(out, columns=["no", "entry", "first"])

    walked = materialise(seen.groupBy("no").applyInPandas(entries, "no long, entry long, batches long, leave long"), "entries")
    # a row of arrays for each part keeps a part's entries together, in one task for all parts
    lists = walked.groupBy("no").agg(F.sort_array(F.collect_list(F.struct("entry", "batches", "leave"))).alias("e"))

    def chained(batches):
        for pdf in batches:
            rows = [(no, x["entry"], x["batches"], x["leave"]) for no, e in zip(pdf["no"], pdf["e"], strict=True) for x in e]
            yield pd.DataFrame(rows, columns=["no", "entry", "batches", "leave"])

    begun = materialise(lists.coalesce(1).sortWithinPartitions("no").mapInPandas(lambda it: chain(chained(it)), "no long, entry long, first long"), "begun")

    def number(pdf: pd.DataFrame, begin: pd.DataFrame) -> pd.DataFrame:
        pdf, step, own = steps(pdf)
        begins = np.zeros(own, np.int64)
        begins[walk(step, own, int(begin["entry"].iloc[0]))[:-1]] = 1
        return pd.DataFrame({"at": pdf["at"].to_numpy()[:own], "batch_no": int(begin["first"].iloc[0]) + np.cumsum(begins) - 1})

    found = seen.groupBy("no").cogroup(begun.groupBy("no")).applyInPandas(number, "at long, batch_no long")
    return numbered.join(found.select((F.col("at") + 1).alias("place_no"), "batch_no"), "place_no")


def repeat_rows(df: DataFrame, times: int, id_: str) -> DataFrame:
    """Every row ``times`` times, its id with the number of the copy."""
    return df.withColumn("copy_no", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumn(id_, F.concat_ws("-", F.col(id_).cast("string"), F.col("copy_no").cast("string")))


def mixture(sources: list[tuple[DataFrame, int]], id_: str, seed: int) -> DataFrame:
    """Sources, each repeated, in one reproducible order."""
    parts = [repeat_rows(df, times, id_).withColumn("source_no", F.lit(i)) for i, (df, times) in enumerate(sources)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.withColumn("shuffle_key", sample_order(F.concat_ws(":", "source_no", id_), seed))


def capped_greedy(df: DataFrame, size: int, order: list[Column], caps: dict[str, int], id_: str) -> DataFrame:
    """Rows in order under a cap for each value of several columns, until ``size``; raises nothing if it falls short.

    A row beyond the cap in any one column can never be taken before those ahead of it leave room, so each combination
    of the capped columns gives its first rows only: the walk sees a bounded number of rows, not the table.
    """
    names, least = list(caps), min(caps.values())
    w = Window.partitionBy(*names).orderBy(*order)
    few = df.withColumn("combo_no", F.row_number().over(w)).filter(F.col("combo_no") <= least).drop("combo_no")
    few = row_numbers(few, order, "order_no")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in few.schema)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("order_no")
        used: dict = {}
        taken = []
        for i, values in zip(pdf.index, zip(*(pdf[c] for c in names), strict=True), strict=True):
            keys = list(zip(names, values, strict=True))
            if len(taken) < size and all(used.get(k, 0) < caps[k[0]] for k in keys):
                taken.append(i)
                for k in keys:
                    used[k] = used.get(k, 0) + 1
        return pdf.loc[taken].drop(columns="all_rows")

    return few.withColumn("all_rows", F.lit(1)).groupBy("all_rows").applyInPandas(run, schema)


def size_matched(pool: DataFrame, reference: DataFrame, key: str, id_: str, sizes: tuple[str, ...], seed: int) -> DataFrame:
    """For each key as many rows as the reference has, chosen one by one so that the running sums of sizes follow the reference's.

    Each choice takes the row that brings the first size nearest to its share of the reference's total, then the second;
    ties fall by hash order (of the first row of equal sizes, then among those). Keys are worked on apart: a task holds
    the different sizes of a key with their counts, not its rows. A null size counts as 0.
    """
    own = [f"size_{i}" for i in range(len(sizes))]
    sized = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(o) for c, o in zip(sizes, own, strict=True)]
    wanted = reference.groupBy(F.col(key).alias("size_key")).agg(F.count(F.lit(1)).alias("wanted"), *(F.coalesce(F.sum(c).cast("double"), F.lit(0.0)).alias(f"goal_{o}") for c, o in zip(sizes, own, strict=True)))
    rows = pool.select("*", F.col(key).alias("size_key"), *sized, sample_order(F.col(id_), seed).alias("draw_key"))
    kinds = rows.groupBy("size_key", *own).agg(F.count(F.lit(1)).alias("n"), F.min("draw_key").alias("first")).join(wanted, "size_key")
    names = ["size_key", *own, "take"]
    schema = ", ".join([f"size_key {pool.schema[key].dataType.simpleString()}", *(f"{o} double" for o in own), "take long"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([own[0], "first"]).reset_index(drop=True)
        goals = [float(pdf[f"goal_{o}"].iloc[0]) for o in own]
        left, first, values = pdf["n"].tolist(), pdf["first"].tolist(), [pdf[o].tolist() for o in own]
        n, sums, take = min(int(pdf["wanted"].iloc[0]), sum(left)), [0.0] * len(own), [0] * len(pdf)
        steps = sorted(set(values[0]))  # the different first sizes, and the kinds of each that have rows left
        members: dict[float, list[int]] = {}
        for i, v in enumerate(values[0]):
            members.setdefault(v, []).append(i)
        above, below = list(range(len(steps) + 1)), list(range(len(steps) + 1))  # next step with rows: at or after i; at or before i, plus 1

        def root(link: list[int], i: int) -> int:
            while link[i] != i:
                link[i] = link[link[i]]
                i = link[i]
            return i

        for k in range(1, n + 1):
            at = bisect.bisect_left(steps, goals[0] * k / n - sums[0])
            near = {s for s in (root(above, at), root(below, at) - 1) if 0 <= s < len(steps)}
            near_kinds = [i for s in near for i in members[steps[s]]]
            best = min(near_kinds, key=lambda i: (tuple(abs(s + v[i] - g * k / n) / max(1.0, g) for s, v, g in zip(sums, values, goals, strict=True)), first[i]))
            take[best] += 1
            left[best] -= 1
            sums = [s + v[best] for s, v in zip(sums, values, strict=True)]
            if not left[best]:
                v = values[0][best]
                members[v].remove(best)
                if not members[v]:
                    gone = bisect.bisect_left(steps, v)
                    above[gone], below[gone + 1] = gone + 1, gone
        return pdf.assign(take=take)[pdf.assign(take=take)["take"] > 0][names]

    taken = kinds.groupBy("size_key").applyInPandas(run, schema)
    order = Window.partitionBy("size_key", *own).orderBy("draw_key", id_)
    return rows.join(taken, ["size_key", *own]).withColumn("draw_no", F.row_number().over(order)).filter("draw_no <= take").select(*pool.columns)


def closest_draw(pool: DataFrame, reference: DataFrame, key: str, id_: str, sizes: tuple[str, ...], attempts: int = 32) -> DataFrame:
    """The best of several matched draws: the one whose size sums are nearest, in the worst of the sizes, to the reference's."""
    wanted = reference.groupBy(key).agg(F.count(F.lit(1)).alias("wanted"))
    copies = pool.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1))))
    w = Window.partitionBy("attempt", key).orderBy(F.sha2(F.concat_ws(":", "attempt", F.col(id_).cast("string")), 256), id_)
    drawn = copies.withColumn("draw_no", F.row_number().over(w)).join(wanted, key).filter("draw_no <= wanted").drop("draw_no", "wanted")
    goal = reference.agg(*(F.sum(c).alias(f"goal_{c}") for c in sizes)).withColumn("k", F.lit(1))
    sums = drawn.groupBy("attempt").agg(*(F.sum(c).alias(c) for c in sizes)).withColumn("k", F.lit(1)).join(goal, "k")
    error = F.greatest(*(F.abs(F.col(c) - F.col(f"goal_{c}")) / F.greatest(F.col(f"goal_{c}"), F.lit(1)) for c in sizes), F.lit(0.0))
    best = sums.agg(F.min_by("attempt", F.struct(error, F.col("attempt"))).alias("attempt"))
    return drawn.join(best, "attempt")
