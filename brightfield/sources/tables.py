"""Readers: JSON lines with a stated policy for bad lines, whole documents, and last-row-wins keyed scans."""

from __future__ import annotations

import io
import json
import zipfile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import first_per_key, row_numbers
from ..session import materialise


def read_jsonl(spark: SparkSession, paths: str | list[str], schema: str, on_bad: str = "drop") -> DataFrame:
    """Rows of JSON lines; blank lines never count.

    ``on_bad``: ``drop`` leaves bad lines out, ``keep`` has them with nulls and the line in ``bad_line``, ``fail`` raises
    when a bad line is read. All add ``file``.
    """
    if on_bad not in ("drop", "keep", "fail"):
        raise ValueError("on_bad is drop, keep or fail")
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file")).filter(F.trim("value") != "")
    good = F.trim("value").startswith("{") & F.try_parse_json("value").isNotNull()
    if on_bad == "drop":
        lines = lines.filter(good)
    elif on_bad == "fail":
        lines = lines.filter(F.assert_true(good, F.concat(F.lit("bad line in "), F.col("file"), F.lit(": "), F.substring("value", 1, 80))).isNull())
    row = F.from_json("value", schema)
    kept = [F.when(~good, F.col("value")).alias("bad_line")] if on_bad == "keep" else []
    return lines.select(row.alias("r"), "file", *kept).select("r.*", "file", *(["bad_line"] if kept else []))


def bad_line_count(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    lines = spark.read.text(paths).filter(F.trim("value") != "")
    good = F.trim("value").startswith("{") & F.try_parse_json("value").isNotNull()
    return lines.agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(~good).alias("n_bad"))


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """A log as ``line_no, value``: line numbers follow the order in each file, from 0. Files of any size are read in parts."""
    raw = spark.read.option("lineSep", "\n").text(paths)
    order = ["file", "block_start", "read_no"]
    raw = raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block_start"), F.monotonically_increasing_id().alias("read_no"))
    raw = row_numbers(materialise(raw, "lines"), [F.col(c) for c in order], "line_no")
    first = raw.groupBy("file").agg(F.min("line_no").alias("first_no"))
    return raw.join(first, "file").filter(F.col("value") != "").select((F.col("line_no") - F.col("first_no")).cast("int").alias("line_no"), "value")


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document a file, with its file and the digest of its bytes."""
    files = spark.read.format("binaryFile").load(path)
    text = F.decode("content", "UTF-8")
    return files.select(F.from_json(text, schema).alias("r"), F.col("path").alias("file"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes")).select("r.*", "file", "sha256", "size_bytes")


def read_matrices(spark: SparkSession, path: str, matrix: str = "X", positions: str = "positions", schema: str = "token_abs long, class string") -> DataFrame:
    """Captures from NumPy archives, a file each: ``file, no, vector`` and the columns of ``schema`` from the archive's JSON
    list of positions. Files that cannot be read, or whose matrix and list differ in length, are skipped."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    with np.load(io.BytesIO(content), allow_pickle=False) as z:
                        rows, listed = np.asarray(z[matrix], np.float64), json.loads(str(z[positions]))
                    if rows.ndim != 2 or len(rows) != len(listed):
                        continue
                except (OSError, ValueError, KeyError, zipfile.BadZipFile, EOFError):
                    continue
                yield pd.DataFrame({"file": file, "no": np.arange(len(rows)), "vector": list(rows), **{n: pd.Series([x.get(n) for x in listed], dtype=object) for n in names}})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, f"file string, no long, vector array<double>, {schema}")


def corpus_digest(files: DataFrame) -> DataFrame:
    """Number of files, their bytes, and the digest of their digests in order of name."""
    return files.agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("size_bytes").alias("size_bytes"),
        F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("file", "sha256"))), lambda s: s["sha256"]), ""), 256).alias("sha256"),
    )


def last_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    return first_per_key(df, keys, [F.desc(c) for c in order])


def pending(requested: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What was asked for and is not there yet."""
    return requested.join(done.select(*keys).distinct(), keys, "left_anti")


def require_complete(df: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the reference's keys; raises if a key has none."""
    missing = reference.select(*keys).distinct().join(df, keys, "left_anti")
    if found := missing.take(3):
        raise ValueError(f"no rows for {[tuple(r) for r in found]}")
    return df.join(reference.select(*keys).distinct(), keys, "left_semi")


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    if found := df.groupBy(*keys).count().filter("count > 1").take(3):
        raise ValueError(f"keys with several rows: {[tuple(r)[:-1] for r in found]}")
    return df


def new_messages(messages: DataFrame, sessions: DataFrame, chats: list[str], after: int) -> DataFrame:
    """User messages of the given chats beyond a high-water mark, oldest first."""
    mine = sessions.filter(F.col("chat_id").isin(chats)).select(F.col("id").alias("session_id"), "chat_id")
    return messages.filter((F.col("id") > after) & (F.col("role") == "user")).join(mine, "session_id").orderBy("id")


def high_water_mark(messages: DataFrame) -> DataFrame:
    return messages.filter("role = 'user'").agg(F.coalesce(F.max("id"), F.lit(0)).alias("mark"))
