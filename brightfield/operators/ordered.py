"""Running sums and ranks over a whole table, without moving it into one task; and folds over ordered groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise


def running(df: DataFrame, order: list[Column], sums: dict[str, str], name: str = "running", small: int = 100_000) -> DataFrame:
    """``df`` with one more column for each ``new: old`` of ``sums``: the sum of ``old`` over the rows before this one in
    ``order``, which must be a total order. Rows are range-partitioned and written, each part sums its own rows, and
    the totals of the parts before it (one small row each) are added. Tables of up to ``small`` rows, counted first, use
    one window.
    """
    if df.limit(small + 1).count() <= small:
        w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.select("*", *(F.coalesce(F.sum(old).over(w), F.lit(0)).alias(new) for new, old in sums.items()))
    parts = df.repartitionByRange(*order).withColumn("part_no", F.spark_partition_id())
    parts = materialise(parts, name)
    w = Window.partitionBy("part_no").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = parts.select("*", *(F.coalesce(F.sum(old).over(w), F.lit(0)).alias(f"{new}_in") for new, old in sums.items()))
    totals = parts.groupBy("part_no").agg(*(F.sum(old).alias(f"{new}_t") for new, old in sums.items()))
    before = Window.orderBy("part_no").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part_no", *(F.coalesce(F.sum(f"{new}_t").over(before), F.lit(0)).alias(f"{new}_o") for new in sums))
    joined = inner.join(F.broadcast(offsets), "part_no")  # one row a part
    return joined.select(*df.columns, *((F.col(f"{new}_in") + F.col(f"{new}_o")).alias(new) for new in sums))


def row_numbers(df: DataFrame, order: list[Column], column: str = "row_no") -> DataFrame:
    """``df`` with its place, from 1, in a total order."""
    return running(df.withColumn("one_row", F.lit(1).cast("long")), order, {"rows_before": "one_row"}).withColumn(column, F.col("rows_before") + 1).drop("one_row", "rows_before")


def first_per_key(df: DataFrame, keys: list[str], order: list[Column], keep: int = 1) -> DataFrame:
    """The first rows of each key in ``order``: a stable de-duplication, unlike dropping duplicates."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("place_no", F.row_number().over(w)).filter(F.col("place_no") <= keep).drop("place_no")


def fold(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], dict], step: Callable[[dict, dict], dict | None], schema: str) -> DataFrame:
    """A state machine over the rows of each group in order; ``step`` changes the state and gives an output row or none.

    For results that depend on what was accepted before, which no window can say. A group's rows are in one task: keys
    must bound them.
    """
    names = [x.split()[0] for x in schema.split(",")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        state = start()
        rows: Iterator[dict | None] = (step(state, r) for r in pdf.sort_values(order, kind="stable").to_dict("records"))
        return pd.DataFrame([r for r in rows if r is not None], columns=names)

    return df.groupBy(*keys).applyInPandas(run, schema)
