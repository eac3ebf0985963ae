"""Structured Streaming over an event directory. The same functions run over a static table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_per_trigger: int | None = None, glob: str | None = None) -> DataFrame:
    reader = spark.readStream.schema(SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and their values by type in windows that do not overlap; later than ``late`` is dropped."""
    out = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sliding_average(events: DataFrame, width: str = "1 hour", slide: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    out = events.withWatermark("ts", late).groupBy(F.window("ts", width, slide), "event_type").agg(F.avg("value").alias("mean"))
    return out.select(F.col("window.start").alias("window_start"), "event_type", "mean")


def sessions(events: DataFrame, gap: str = "96 hours", late: str = "1 day") -> DataFrame:
    """Sessions of each user; events exactly ``gap`` apart stay together."""
    # a session window closes at last event + gap, exclusive: a microsecond more takes the exact gap in
    out = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", F.concat(F.lit(gap), F.lit(" 1 microsecond")))).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_ts"))
    return out.select("user_id", F.col("session_window.start").alias("first_ts"), "last_ts", "n")


def first_events(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Each event id once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def upsert_last(target: str, keys: list[str], order: list[str]) -> Callable[[DataFrame, int], None]:
    """A batch sink that keeps the last row of each key in a Parquet table with two alternating versions.

    A batch that runs again after a failure writes the same rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old, new = f"{target}/v{(number + 1) % 2}", f"{target}/v{number % 2}"
        rows = batch
        if number:
            rows = spark.read.schema(batch.schema).parquet(old).unionByName(batch)
        packed = rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("r")).select("r.*")
        packed.write.mode("overwrite").parquet(new)

    return write


def running_totals(events: DataFrame) -> DataFrame:
    """Custom state: after each batch, every user's events and value so far."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for pdf in batches:
            n, total = n + len(pdf), total + float(pdf["value"].sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, n long, total double", "n long, total double", "update", "NoTimeout")


def run_available(df: DataFrame, checkpoint: str, path: str | None = None, name: str | None = None, mode: str = "append") -> StreamingQuery:
    """Process what is there and stop. Into Parquet files at ``path`` the next run goes on from the checkpoint; the memory
    table ``name`` is for looking at results and cannot be resumed."""
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = writer.format("parquet").start(path) if path else writer.format("memory").queryName(name).start()
    query.awaitTermination()
    return query
