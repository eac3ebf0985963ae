"""Writers: labelled artifacts with a sidecar record, keyed appends, label buckets, split manifests."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FORMATS = {".parquet": "parquet", ".json": "json", ".jsonl": "json", ".csv": "csv", ".tsv": "csv", ".txt": "text", ".orc": "orc"}


def format_of(path: str, chosen: str = "auto") -> str:
    """Format by suffix; Parquet without one."""
    if chosen != "auto":
        return {"jsonl": "json", "tsv": "csv"}.get(chosen, chosen)
    return next((f for suffix, f in FORMATS.items() if path.rstrip("/").endswith(suffix)), "parquet")


def save(df: DataFrame, path: str, *, title: str, description: str, format: str = "auto", tags: list[str] = (), caveats: str = "", sensitivity: str = "", mode: str = "errorifexists", partition_by: list[str] = (), **meta: str) -> dict:
    """Write a table and, beside it, a one-row JSON record of what it is. Title and description are required."""
    if not title.strip() or not description.strip():
        raise ValueError("an artifact needs a title and a description")
    kind = format_of(path, format)
    writer = df.write.mode(mode)
    if kind == "csv":
        writer = writer.option("header", True).option("sep", "\t" if path.rstrip("/").endswith(".tsv") or format == "tsv" else ",")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.format(kind).save(path)
    record = {
        "path": path, "name": path.rstrip("/").rsplit("/", 1)[-1], "title": title, "description": description, "format": kind, "tags": list(tags), "caveats": caveats,
        "sensitivity": sensitivity, "schema": df.schema.simpleString(), "created_at": datetime.now(timezone.utc).isoformat(), **meta,
    }
    df.sparkSession.createDataFrame([(json.dumps(record, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path.rstrip("/") + ".meta")
    return record


def append_new(df: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not there yet, one a key: appending them twice adds nothing."""
    return df.dropDuplicates(keys).join(existing.select(*keys).distinct(), keys, "left_anti")


def save_buckets(df: DataFrame, path: str, label: str) -> None:
    df.write.mode("overwrite").partitionBy(label).json(path)


def split_manifest(df: DataFrame, side: str, family: str, id_: str) -> DataFrame:
    """Rows of each side and family, with a digest of their ids that no order changes, in place of an unbounded list.

    The digest is the sum of the first 32 bits of each id's SHA-256, so an id that occurs twice counts twice.
    """
    first = F.conv(F.substring(F.sha2(F.col(id_).cast("string"), 256), 1, 8), 16, 10).cast("long")
    return df.groupBy(side, family).agg(F.count(F.lit(1)).alias("n"), F.min(id_).alias("first_id"), F.max(id_).alias("last_id"), F.sum(first).cast("decimal(38,0)").alias("id_digest"))


def normalised_annotations(df: DataFrame, key: str, labels: dict[str, str]) -> dict[str, DataFrame]:
    """A parent table and one table of (key, label) for each array column."""
    parent = df.drop(*labels.values())
    return {"parent": parent} | {name: df.select(key, F.explode(F.array_distinct(column)).alias("label")) for name, column in labels.items()}


def metric_rows(df: DataFrame, step: str) -> DataFrame:
    """Wide metric rows as long ones: ``step, key, value``."""
    names = [c for c in df.columns if c != step]
    return df.unpivot([step], names, "key", "value")
