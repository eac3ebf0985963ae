"""The run catalog: runs, lineage, metrics and artifacts as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RUNS = "run_id string, stage string, status string, created_at string, started_at string, completed_at string, manifest_json string, manifest_sha256 string"
LINEAGE = "parent_run_id string, child_run_id string, relation string"
METRICS = "run_id string, step long, timestamp string, key string, value double, json_value string"
#: Statuses of a run, and those that end it.
STATUSES = ("pending", "running", "completed", "failed", "guarded", "cancelled")
TERMINAL = ("completed", "failed", "guarded", "cancelled")
ORDERS = ("run_id", "stage", "status", "created_at", "started_at", "completed_at")


def find(runs: DataFrame, stage: str | None = None, status: str | None = None, limit: int = 100, order: str = "created_at", descending: bool = True) -> DataFrame:
    """Runs by stage and status, newest first. Only catalog columns may be ordered by."""
    if order not in ORDERS:
        raise ValueError(f"order must be one of {', '.join(ORDERS)}")
    for column, value in (("stage", stage), ("status", status)):
        if value:
            runs = runs.filter(F.col(column) == value)
    return runs.orderBy(F.desc(order) if descending else F.asc(order), "run_id").limit(limit)


def find_artifacts(runs: DataFrame, artifacts: DataFrame, tag: str | None = None, title: str | None = None, stage: str | None = None, sensitivity: str | None = None, format: str | None = None, run_limit: int = 10_000) -> DataFrame:
    """Labelled artifacts (with a title) of the newest ``run_limit`` runs, by tag, part of the title, and labels."""
    chosen = find(runs, stage, limit=run_limit).select("run_id", "stage", "created_at")
    hit = artifacts.filter(F.coalesce(F.col("title"), F.lit("")) != "")
    if tag:
        hit = hit.filter(F.array_contains("tags", tag))
    if title:
        hit = hit.filter(F.lower("title").contains(title.lower()))
    if sensitivity:
        hit = hit.filter(F.col("sensitivity") == sensitivity)
    if format:
        hit = hit.filter(F.col("format") == format)
    return hit.join(chosen, "run_id")


def parents(lineage: DataFrame, run_id: str) -> DataFrame:
    return lineage.filter(F.col("child_run_id") == run_id).select("parent_run_id", "relation")


def children(lineage: DataFrame, run_id: str) -> DataFrame:
    return lineage.filter(F.col("parent_run_id") == run_id).select("child_run_id", "relation")


def register(runs: DataFrame, new: DataFrame) -> DataFrame:
    """Insert, or replace all but ``created_at``."""
    old = runs.select("run_id", F.col("created_at").alias("first_created"))
    kept = new.join(old, "run_id", "left").withColumn("created_at", F.coalesce("first_created", "created_at")).drop("first_created")
    return runs.join(new, "run_id", "left_anti").unionByName(kept.select(*runs.columns))


def update_status(runs: DataFrame, run_id: str, status: str, now: Column) -> DataFrame:
    if status not in STATUSES:
        raise ValueError(f"unknown status {status}")
    mine = F.col("run_id") == run_id
    out = runs.withColumn("completed_at", F.when(mine & F.lit(status in TERMINAL), now).otherwise(F.col("completed_at")))
    return out.withColumn("status", F.when(mine, F.lit(status)).otherwise(F.col("status")))


def link(lineage: DataFrame, new: DataFrame) -> DataFrame:
    """Edges, the relation of an edge already there replaced."""
    return lineage.join(new, ["parent_run_id", "child_run_id"], "left_anti").unionByName(new)


def orphans(lineage: DataFrame, runs: DataFrame) -> DataFrame:
    """Edges whose ends are not both registered: must be empty."""
    ids = runs.select("run_id")
    lost = lambda end: lineage.join(ids, lineage[end] == ids["run_id"], "left_anti")
    return lost("parent_run_id").unionByName(lost("child_run_id")).distinct()


def merge(local: dict[str, DataFrame], remote: dict[str, DataFrame], on_conflict: str = "skip") -> dict[str, DataFrame]:
    """Tables ``runs, lineage, metrics`` of both catalogs merged, and ``report`` (``added, replaced, skipped, lineage, metrics``).

    ``skip`` keeps the local row of a run that both have, ``replace`` takes the remote one with its metrics. Edges come
    over if both their ends were imported; a replaced run loses its local edges.
    """
    if on_conflict not in ("skip", "replace"):
        raise ValueError("on_conflict is skip or replace")
    runs, theirs = local["runs"], remote["runs"]
    both = theirs.join(runs, "run_id", "left_semi")
    new = theirs.join(runs, "run_id", "left_anti")
    taken = theirs if on_conflict == "replace" else new
    ids = taken.select("run_id")
    gone = both.select("run_id") if on_conflict == "replace" else both.select("run_id").limit(0)
    end = lambda df, column: df.join(ids.withColumnRenamed("run_id", column), column, "left_semi")
    without = lambda df, column: df.join(gone.withColumnRenamed("run_id", column), column, "left_anti")
    edges = end(end(remote["lineage"], "parent_run_id"), "child_run_id")
    metrics = remote["metrics"].join(ids, "run_id", "left_semi")
    kept = without(without(local["lineage"], "parent_run_id"), "child_run_id")
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name)).withColumn("k", F.lit(1))
    report = count(new, "added")
    for df, name in ((gone, "replaced"), (both if on_conflict == "skip" else both.limit(0), "skipped"), (edges, "lineage"), (metrics, "metrics")):
        report = report.join(count(df, name), "k")
    return {
        "runs": runs.join(gone, "run_id", "left_anti").unionByName(taken.select(*runs.columns)),
        "lineage": link(kept, edges.select(*kept.columns)),
        "metrics": local["metrics"].join(gone, "run_id", "left_anti").unionByName(metrics.select(*local["metrics"].columns)),
        "report": report.drop("k"),
    }


def upsert_artifacts(catalog: DataFrame, new: DataFrame, inherited: tuple[str, ...] = ("title", "description", "tags", "caveats", "sensitivity", "format")) -> DataFrame:
    """By path: labels that the new record leaves out are inherited, ``created_at`` stays that of the first save."""
    old = catalog.select("path", *(F.col(c).alias(f"old_{c}") for c in (*inherited, "created_at")))
    joined = new.join(old, "path", "left")
    out = joined.withColumns({c: F.coalesce(c, f"old_{c}") for c in inherited} | {"created_at": F.coalesce("old_created_at", "created_at")})
    return catalog.join(new, "path", "left_anti").unionByName(out.select(*catalog.columns))


def metric_series(metrics: DataFrame, run_id: str, key: str) -> DataFrame:
    """``step, value`` of one metric, scalars only, in order of step and time."""
    rows = metrics.filter((F.col("run_id") == run_id) & (F.col("key") == key) & F.col("value").isNotNull())
    return rows.orderBy("step", "timestamp").select("step", "value")


def last_writes(points: DataFrame, keys: list[str], order: list[Column], value: str = "value") -> DataFrame:
    """The last value written for each key and step."""
    return points.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def latest_points(points: DataFrame, series: list[str], step: str, keep: int = 120) -> DataFrame:
    w = Window.partitionBy(*series).orderBy(F.desc(step))
    return points.withColumn("age_no", F.row_number().over(w)).filter(F.col("age_no") <= keep).drop("age_no")


def moving_average(points: DataFrame, series: list[str], step: str, width: int, value: str = "value") -> DataFrame:
    """``smooth``: the mean of the last ``width`` values, fewer at the head."""
    w = Window.partitionBy(*series).orderBy(step).rowsBetween(-(width - 1), 0)
    return points.withColumn("smooth", F.avg(value).over(w))


def series_trend(points: DataFrame, series: list[str], step: str, value: str = "value", flat: float = 1e-9) -> DataFrame:
    """``first, last, delta, trend`` of each series."""
    ends = points.groupBy(*series).agg(F.min_by(value, step).alias("first"), F.max_by(value, step).alias("last"))
    delta = F.col("last") - F.col("first")
    return ends.withColumn("delta", delta).withColumn("trend", F.when(F.abs(delta) <= flat, "flat").when(delta > 0, "up").otherwise("down"))


def rolling_trend(points: DataFrame, series: list[str], order: list[Column], value: str, width: int = 15) -> DataFrame:
    """Mean of the last ``width`` values and of the ``width`` before them."""
    w = Window.partitionBy(*series).orderBy(*order)
    aged = points.withColumn("age_no", F.row_number().over(w)).filter(F.col("age_no") <= 2 * width)
    recent = F.col("age_no") <= width
    return aged.groupBy(*series).agg(F.avg(F.when(recent, F.col(value))).alias("recent"), F.avg(F.when(~recent, F.col(value))).alias("previous"))


def rolling_rate(points: DataFrame, series: list[str], time: str, counter: str, span: int = 60, least: int = 2) -> DataFrame:
    """``rate``: growth a second of a counter since the latest sample that is ``span`` seconds old, or the oldest one.

    Not below 0; null where less than ``least`` seconds passed.
    """
    seconds = F.col(time).cast("timestamp").cast("double")
    w = Window.partitionBy(*series).orderBy("at_s")
    far = w.rangeBetween(Window.unboundedPreceding, -span)
    at = points.withColumn("at_s", seconds)
    base = F.coalesce(F.max(F.struct("at_s", F.col(counter).alias("c"))).over(far), F.first(F.struct("at_s", F.col(counter).alias("c"))).over(w))
    at = at.withColumn("base", base)
    passed = F.col("at_s") - F.col("base.at_s")
    return at.withColumn("rate", F.when(passed >= least, F.greatest(F.lit(0.0), (F.col(counter) - F.col("base.c")) / passed))).drop("at_s", "base")


def sessionise(events: DataFrame, by: list[str], time: str, gap_seconds: int) -> DataFrame:
    """``session_no`` of each event: a new one begins when more than ``gap_seconds`` passed (exactly that many stay together)."""
    w = Window.partitionBy(*by).orderBy(time)
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    begins = micros - F.lag(micros).over(w) > gap_seconds * 1_000_000
    return events.withColumn("begins", F.coalesce(begins.cast("int"), F.lit(0))).withColumn("session_no", F.sum("begins").over(w)).drop("begins")


def log_summary(rows: DataFrame, by: list[str], step: str, values: list[str]) -> DataFrame:
    """First and last step of each log, and of each value its ends, mean, population deviation and maximum."""
    aggs = [F.min(step).alias("first_step"), F.max(step).alias("last_step")]
    for v in values:
        aggs += [F.min_by(v, step).alias(f"{v}_first"), F.max_by(v, step).alias(f"{v}_last"), F.avg(v).alias(f"{v}_mean"), F.stddev_pop(v).alias(f"{v}_std"), F.max(v).alias(f"{v}_max")]
    return rows.groupBy(*by).agg(*aggs)


def run_id(stage: Column, at: Column, suffix: Column | None = None) -> Column:
    """Time, stage and suffix of a new run."""
    return F.concat_ws("-", F.date_format(at, "yyyyMMdd'T'HHmmss"), stage, *([suffix] if suffix is not None else []))


def over_budget(rows: DataFrame, actual: str, planned: str, tolerance: float) -> DataFrame:
    """Rows whose relative difference from the plan exceeds the tolerance: must be empty."""
    return rows.filter(F.abs(F.col(actual) - F.col(planned)) / F.greatest(F.abs(F.col(planned)), F.lit(1)) > tolerance)


def fallback_series(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """The series of one source, and from the other those whose key the first lacks."""
    return first.unionByName(second.join(first.select(*keys).distinct(), keys, "left_anti"))
