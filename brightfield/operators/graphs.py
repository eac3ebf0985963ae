"""Boolean task graphs: generation from seeds, evaluation, ancestry, traces.

A task is a row ``id, nodes, updates, query`` with ``nodes`` an array of ``node, kind, op, parents, value`` in
topological order and ``updates`` an array of ``node, action``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TASK = "id long, depth int, nodes array<struct<node:string,kind:string,op:string,parents:array<string>,value:boolean>>, updates array<struct<node:string,action:string>>, query string"
ACTIONS = ("SET TRUE", "SET FALSE", "TOGGLE")


def generate(seeds: DataFrame, sources: int = 3, distractors: int = 2) -> DataFrame:
    """A task for each ``id, depth``: a chain of ``depth`` gates over sources, with sources that nothing reads and two updates."""

    def one(seed: int, depth: int) -> dict:
        rng = np.random.default_rng([7, seed, depth])
        node = lambda name, kind, op=None, parents=(), value=None: {"node": name, "kind": kind, "op": op, "parents": list(parents), "value": value}
        nodes = [node(f"s{i}", "source", value=bool(rng.integers(2))) for i in range(sources)]
        nodes += [node(f"x{i}", "distractor", value=bool(rng.integers(2))) for i in range(distractors)]
        last = "s0"
        for d in range(depth):
            op = ("COPY", "NOT", "AND", "OR")[rng.integers(4)]
            parents = [last] if op in ("COPY", "NOT") else [last, f"s{rng.integers(sources)}"]
            last = f"g{d}"
            nodes.append(node(last, "derived", op, parents))
        updates = [{"node": f"s{rng.integers(sources)}", "action": ACTIONS[rng.integers(3)]} for _ in range(2)]
        return {"id": seed, "depth": depth, "nodes": nodes, "updates": updates, "query": last}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([one(int(i), int(d)) for i, d in zip(pdf["id"], pdf["depth"], strict=True)], columns=["id", "depth", "nodes", "updates", "query"])

    return seeds.select("id", "depth").mapInPandas(run, TASK)


def evaluate(nodes: Column, updates: Column) -> Column:
    """State of every node as a map: sources as given, updates applied in order, gates in topological order.

    Gates read sources only through other gates, so one pass over the gates after all updates gives the final states.
    """
    given = F.map_from_entries(F.transform(F.filter(nodes, lambda n: n["kind"] != "derived"), lambda n: F.struct(n["node"], n["value"])))
    value = lambda m, u: F.when(u["action"] == "SET TRUE", True).when(u["action"] == "SET FALSE", False).otherwise(~F.element_at(m, u["node"]))
    put = lambda m, k, v: F.map_concat(F.map_filter(m, lambda a, b: a != k), F.create_map(k, v))
    states = F.aggregate(updates, given, lambda m, u: put(m, u["node"], value(m, u)))

    def gate(m: Column, n: Column) -> Column:
        first, every = F.element_at(m, F.get(n["parents"], F.lit(0))), F.transform(n["parents"], lambda p: F.element_at(m, p))
        out = F.when(n["op"] == "COPY", first).when(n["op"] == "NOT", ~first).when(n["op"] == "AND", F.forall(every, lambda v: v)).otherwise(F.exists(every, lambda v: v))
        return F.map_concat(m, F.create_map(n["node"], out))

    return F.aggregate(F.filter(nodes, lambda n: n["kind"] == "derived"), states, gate)


def ancestors(nodes: Column, query: Column) -> Column:
    """Nodes that the query node depends on: one walk against topological order."""
    step = lambda acc, n: F.when(F.array_contains(acc, n["node"]), F.array_union(acc, F.coalesce(n["parents"], F.array().cast("array<string>")))).otherwise(acc)
    return F.array_remove(F.aggregate(F.reverse(nodes), F.array(query), step), query)


def trace(nodes: Column, states: Column, query: Column) -> Column:
    """``TRACE: T,F,..`` of all nodes that count, and the answer."""
    bits = F.transform(F.filter(nodes, lambda n: n["kind"] != "distractor"), lambda n: F.when(F.element_at(states, n["node"]), "T").otherwise("F"))
    return F.concat(F.lit("TRACE: "), F.array_join(bits, ","), F.lit("\nFINAL: "), F.when(F.element_at(states, query), "YES").otherwise("NO"))


def score_trace(text: Column, gold: Column) -> Column:
    """``parsed, bit_accuracy, trace_exact, answer_correct`` of a trace against the gold one; bits count over the longer one."""
    pattern = r"^TRACE:\s*([TF](?:\s*,\s*[TF])*)\s*\nFINAL:\s*(YES|NO)$"
    part = lambda t, i: F.regexp_extract(F.trim(F.coalesce(t, F.lit(""))), pattern, i)
    bits = lambda t: F.split(F.regexp_replace(part(t, 1), r"\s+", ""), ",")
    ok = (part(text, 1) != "") & ~F.lower(F.coalesce(text, F.lit(""))).contains("<think>")
    same = F.size(F.filter(F.zip_with(bits(text), bits(gold), lambda a, b: F.coalesce(a == b, F.lit(False))), lambda x: x))
    return F.struct(
        ok.alias("parsed"), F.when(ok, same / F.greatest(F.size(bits(text)), F.size(bits(gold)))).otherwise(0.0).alias("bit_accuracy"),
        (ok & (bits(text) == bits(gold))).alias("trace_exact"), (ok & (part(text, 2) == part(gold, 2))).alias("answer_correct"),
    )


def symbolic_hash(nodes: Column, updates: Column, query: Column) -> Column:
    """The same for tasks that differ in wording only."""
    ordered = F.sort_array(F.transform(nodes, lambda n: F.struct(n["node"], n["kind"], n["op"], F.array_join(F.sort_array(F.coalesce(n["parents"], F.array().cast("array<string>"))), "+"), n["value"])))
    return F.sha2(F.to_json(F.struct(ordered.alias("nodes"), updates.alias("updates"), query.alias("query"))), 256)


def seed_of(key: str) -> int:
    return int(hashlib.sha256(key.encode()).hexdigest(), 16) % 2**31
