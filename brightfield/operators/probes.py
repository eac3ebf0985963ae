"""Probes over append-only logs: a log is rows ``line_no, value``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.json import path_value


def matching_lines(log: DataFrame, pattern: str) -> DataFrame:
    """Number of lines that match, not of matches."""
    return log.agg(F.count_if(F.col("value").rlike(pattern)).alias("n"))


def last_match(log: DataFrame, pattern: str) -> DataFrame:
    """The last match in the log: its first group if the pattern has groups, else all of it."""
    from re import compile

    group = 1 if compile(pattern).groups else 0
    found = log.filter(F.col("value").rlike(pattern)).select("line_no", F.regexp_extract_all("value", F.lit(pattern), F.lit(group)).alias("m"))
    return found.agg(F.max_by(F.element_at("m", -1), "line_no").alias("value"))


def last_record(log: DataFrame, path: str) -> DataFrame:
    """Value at a dotted path in the last line that is a JSON object."""
    ok = F.ltrim("value").startswith("{") & F.try_parse_json(F.col("value")).isNotNull()
    return log.filter(ok).agg(F.max_by(F.col("value"), "line_no").alias("js")).select(path_value(F.col("js"), path).alias("value"))


def metric_points(log: DataFrame) -> DataFrame:
    """``line_no, key, step, value`` of long rows (``key, value, step``) and wide rows (``step, k: v, ..``); other lines are skipped."""
    js = F.try_parse_json(F.col("value"))
    rows = log.filter(F.ltrim("value").startswith("{") & js.isNotNull()).select("line_no", "value", F.from_json("value", "map<string,string>").alias("m"))
    rows = rows.withColumn("step", F.element_at("m", "step").try_cast("double")).filter("step IS NOT NULL AND NOT isnan(step)").withColumn("step", F.col("step").cast("long"))
    long = rows.filter(F.element_at("m", "key").isNotNull()).select("line_no", F.element_at("m", "key").alias("key"), "step", F.element_at("m", "value").alias("v"))
    names = F.map_filter("m", lambda k, v: ~k.isin("step", "timestamp", "run_id", "event", "detail"))
    wide = rows.filter(F.element_at("m", "key").isNull() & F.element_at("m", "event").isNull()).select("line_no", "step", F.explode(names).alias("key", "v")).select("line_no", "key", "step", "v")
    number = F.when(F.lower("v") == "true", 1.0).when(F.lower("v") == "false", 0.0).otherwise(F.col("v").try_cast("double"))
    return long.unionByName(wide).select("line_no", "key", "step", number.alias("value")).filter("value IS NOT NULL AND NOT isnan(value) AND abs(value) < double('infinity')")


def style(value: Column, danger_above=None, danger_below=None, warn_above=None, warn_below=None) -> Column:
    """red, yellow or green by strict thresholds, danger before warning."""
    out = F.when(F.lit(False), "red")
    for limit, above, name in ((danger_above, True, "red"), (danger_below, False, "red"), (warn_above, True, "yellow"), (warn_below, False, "yellow")):
        if limit is not None:
            out = out.when(value > limit if above else value < limit, name)
    return out.otherwise("green")


def sparkline_steps(n: int, width: int = 64) -> list[int]:
    """Places of the points that a line of ``width`` marks shows."""
    return list(range(n)) if n <= width else [round(i * (n - 1) / (width - 1)) for i in range(width)]


def remaining_seconds(durations: DataFrame, order: Column, remaining: int, default: float, last: int = 20) -> DataFrame:
    """Remaining items times the mean of the last positive durations."""
    recent = durations.filter("duration > 0").orderBy(order.desc()).limit(last)
    return recent.agg(F.coalesce(F.avg("duration"), F.lit(default)).alias("mean_s")).withColumn("remaining_s", F.col("mean_s") * remaining)


#: What a declared probe measures, of those that are over data: lines that match, the last match, a value of the last record, the last point of a metric.
KINDS = ("line_count", "last_match", "last_record", "metric")


def declared(log: DataFrame, config: list[dict]) -> DataFrame:
    """``id, label, kind, value, unit, style``: the probes of a declaration over one log.

    A probe has ``id``, ``kind`` and what that needs (``regex``, ``path`` or ``key``), and may have ``label``, ``unit``,
    ``enabled`` and the limits of :func:`style`. A value that is no number has the style green.
    """
    out = None
    for p in config:
        if p["kind"] not in KINDS:
            raise ValueError(f"a probe's kind is one of {', '.join(KINDS)}")
        if not p.get("enabled", True):
            continue
        if p["kind"] == "line_count":
            found = matching_lines(log, p["regex"]).select(F.col("n").cast("string").alias("value"))
        elif p["kind"] == "last_match":
            found = last_match(log, p["regex"])
        elif p["kind"] == "last_record":
            found = last_record(log, p["path"])
        else:
            points = metric_points(log).filter(F.col("key") == p["key"])
            found = points.agg(F.max_by("value", F.struct("step", "line_no")).cast("string").alias("value"))
        limits = {k: p.get(k) for k in ("danger_above", "danger_below", "warn_above", "warn_below")}
        row = found.select(
            F.lit(p["id"]).alias("id"), F.lit(p.get("label") or p["id"]).alias("label"), F.lit(p["kind"]).alias("kind"), "value", F.lit(p.get("unit", "")).alias("unit"),
            style(F.col("value").try_cast("double"), **limits).alias("style"),
        )
        out = row if out is None else out.unionByName(row)
    if out is None:
        raise ValueError("no probe is enabled")
    return out
