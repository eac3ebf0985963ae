"""Run specifications, and inputs that come from an earlier run's artifacts."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import format_of

REQUIRED = ("stage",)


def read_spec(spark: SparkSession, path: str) -> dict:
    """A specification from a YAML or JSON file, by suffix: a mapping that names its stage. One small file, read by the driver."""
    text = "\n".join(r.value for r in spark.read.option("wholetext", True).text(path).collect())
    if path.endswith(".json"):
        spec = json.loads(text)
    elif path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as missing:
            raise ValueError("YAML specifications need the yaml package") from missing
        spec = yaml.safe_load(text)
    else:
        raise ValueError(f"a specification ends in .json, .yaml or .yml: {path}")
    if not isinstance(spec, dict) or any(not spec.get(k) for k in REQUIRED):
        raise ValueError(f"a specification is a mapping with {', '.join(REQUIRED)}: {path}")
    return spec


def stage_input(spark: SparkSession, artifacts: DataFrame, spec: dict) -> DataFrame:
    """The table that a stage reads: the artifact ``input_artifact`` of the run ``input_run``, in the format it was saved in.

    ``artifacts`` has a row ``run_id, name, path`` for each artifact. None, or several of that name, are an error.
    """
    run, name = spec.get("input_run"), spec.get("input_artifact")
    if not run or not name:
        raise ValueError("a chained stage names input_run and input_artifact")
    found = artifacts.filter((F.col("run_id") == run) & (F.col("name") == name)).select("path").take(2)
    if len(found) != 1:
        raise ValueError(f"run {run} has {'no' if not found else 'several'} artifact {name}")
    path = found[0].path
    kind = format_of(path)
    reader = spark.read.format(kind)
    if kind == "csv":
        reader = reader.option("header", True).option("inferSchema", True).option("sep", "\t" if path.endswith(".tsv") else ",")
    return reader.load(path)
