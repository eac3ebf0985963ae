"""Seams for models: plain Python callables over texts and conversations, in Arrow batches, with their failures as rows.

A callable is shipped to the workers, so it must be importable there or defined in the driver's script; what it loads once
(a model, a client) belongs in a function that caches it. Nothing here calls a model by itself.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Messages = list[dict]


def _conversations(turns: DataFrame, by: str, order: str) -> DataFrame:
    return turns.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("order"), "role", F.coalesce("text", F.lit("")).alias("text")))).alias("turns"))


def _messages(turns) -> Messages:
    return [{"role": t["role"], "text": t["text"]} for t in turns]


def _called(turns: DataFrame, by: str, order: str, call: Callable[[Messages], str], column: str) -> DataFrame:
    """``by, <column>, error``: what the callable says to each conversation; an exception is that row's error, no more."""
    rows = _conversations(turns, by, order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for turn_list in pdf["turns"]:
                try:
                    out.append((call(_messages(turn_list)), None))
                except Exception as e:  # noqa: BLE001  whatever the caller's function raises
                    out.append((None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame({by: pdf[by], column: [x[0] for x in out], "error": [x[1] for x in out]})

    return rows.mapInPandas(run, f"{by} {dict(rows.dtypes)[by]}, {column} string, error string")


def replies(turns: DataFrame, respond: Callable[[Messages], str], by: str = "session_id", order: str = "turn") -> DataFrame:
    """A participant's next turn in every conversation: ``by, reply, error``."""
    return _called(turns, by, order, respond, "reply")


def verdicts(turns: DataFrame, judge: Callable[[Messages], dict | str], by: str = "session_id", order: str = "turn") -> DataFrame:
    """A judge's verdict on every conversation as JSON text: ``by, verdict, error``. A reply that is no JSON object is an error."""

    def call(messages: Messages) -> str:
        found = judge(messages)
        found = json.loads(found) if isinstance(found, str) else found
        if not isinstance(found, dict):
            raise ValueError("a verdict must be an object")
        return json.dumps(found, sort_keys=True)

    return _called(turns, by, order, call, "verdict")


def redacted(df: DataFrame, redactor: Callable[[str], str], column: str = "text") -> DataFrame:
    """``df`` with a text column passed through the redactor; null stays null."""

    @F.pandas_udf("string")
    def run(text: pd.Series) -> pd.Series:
        return text.map(redactor, na_action="ignore")

    return df.withColumn(column, run(F.col(column)))


def embedded(df: DataFrame, encode: Callable[[list[str]], np.ndarray], text: str = "text", column: str = "embedding", normalise: bool = True) -> DataFrame:
    """``df`` with a vector for each text, of length one unless it is all zeros; null counts as empty."""

    @F.pandas_udf("array<double>")
    def run(values: pd.Series) -> pd.Series:
        found = np.asarray(encode([v or "" for v in values]), np.float64)
        if normalise and len(found):
            length = np.linalg.norm(found, axis=1, keepdims=True)
            found = found / np.where(length > 0, length, 1)
        return pd.Series(list(found))

    return df.withColumn(column, run(F.col(text)))
