"""Queries over events: metric series, sessions, JSON properties, rates, votes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.json import path_value
from ..operators import align, catalog, probes, stats
from ..streaming import events as stream
from .registry import Tables, query

_DAY = "SELECT event_type, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS step, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metric for each event type, the day as its step; the last event of a day is its value."""
    rows = Tables(spark, sf_dir).events.withColumn("step", F.floor(F.unix_timestamp("ts") / 86400))
    return catalog.last_writes(rows, ["event_type", "step"], [F.col("ts"), F.col("event_id")])


@query(_DAY)
def metric_series_last_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir)


@query(f"SELECT event_type, step, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY step DESC) AS r FROM ({_DAY})) WHERE r <= 10")
def metric_history_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.latest_points(points(spark, sf_dir), ["event_type"], "step", 10)


@query(f"SELECT event_type, step, round(avg(value) OVER (PARTITION BY event_type ORDER BY step ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS smooth FROM ({_DAY})")
def metric_moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.moving_average(points(spark, sf_dir), ["event_type"], "step", 5).select("event_type", "step", F.round("smooth", 6).alias("smooth"))


@query(f"""
    SELECT event_type, first, last, round(last - first, 9) AS delta, CASE WHEN abs(last - first) <= 1e-9 THEN 'flat' WHEN last > first THEN 'up' ELSE 'down' END AS trend
    FROM (SELECT event_type, arg_min(value, step) AS first, arg_max(value, step) AS last FROM ({_DAY}) GROUP BY event_type)""")
def series_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.series_trend(points(spark, sf_dir), ["event_type"], "step").withColumn("delta", F.round("delta", 9))


@query("""
    SELECT event_type, round(avg(value) FILTER (r <= 15), 6) AS recent, round(avg(value) FILTER (r BETWEEN 16 AND 30), 6) AS previous
    FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) GROUP BY event_type""")
def rolling_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = catalog.rolling_trend(Tables(spark, sf_dir).events, ["event_type"], [F.desc("ts"), F.desc("event_id")], "value")
    return out.select("event_type", F.round("recent", 6).alias("recent"), F.round("previous", 6).alias("previous"))


@query("""
    WITH c AS (SELECT event_type, event_id, epoch_us(ts) / 1e6 AS s, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id)::DOUBLE AS counter, ts FROM events),
    m AS (SELECT event_type, s, max(counter) AS counter FROM c GROUP BY ALL),
    b AS (SELECT *, coalesce(max((s, counter)) OVER (PARTITION BY event_type ORDER BY s RANGE BETWEEN UNBOUNDED PRECEDING AND 3600 PRECEDING), first_value((s, counter)) OVER (PARTITION BY event_type ORDER BY s)) AS base FROM m)
    SELECT event_type, counter, CASE WHEN s - base[1] >= 2 THEN round(greatest(0, (counter - base[2]) / (s - base[1])), 9) END AS rate FROM b""")
def rolling_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events a second of each type over the last hour, from a running counter."""
    w = Window.partitionBy("event_type").orderBy("ts", "event_id")
    rows = Tables(spark, sf_dir).events.withColumn("counter", F.row_number().over(w).cast("double")).groupBy("event_type", "ts").agg(F.max("counter").alias("counter"))
    return catalog.rolling_rate(rows, ["event_type"], "ts", "counter", 3600).select("event_type", "counter", F.round("rate", 9).alias("rate"))


@query("""
    WITH g AS (SELECT *, coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 172800000000)::INT, 0) AS b FROM events),
    s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session_no FROM g)
    SELECT user_id, session_no::BIGINT AS session_no, count(*) AS n, round(sum(value), 6) AS total FROM s GROUP BY ALL""")
def sessionize_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a user: a gap of more than two days begins a new one."""
    out = catalog.sessionise(Tables(spark, sf_dir).events, ["user_id"], "ts", 2 * 86400)
    return out.groupBy("user_id", "session_no").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query("SELECT event_type, sum((props->>'$.k')::BIGINT)::BIGINT AS k_sum, count(DISTINCT props->>'$.k') AS k_distinct, count(*) FILTER (props->>'$.missing.key' IS NULL) AS absent FROM events GROUP BY event_type")
def json_path_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = path_value(F.col("props"), "k")
    return Tables(spark, sf_dir).events.groupBy("event_type").agg(F.sum(k.cast("long")).alias("k_sum"), F.count_distinct(k).alias("k_distinct"), F.count_if(path_value(F.col("props"), "missing.key").isNull()).alias("absent"))


@query("SELECT arg_max(props->>'$.k', event_id) AS value FROM events")
def last_record_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value of a path in the last JSON line of a log."""
    log = Tables(spark, sf_dir).events.select(F.col("event_id").alias("line_no"), F.col("props").alias("value"))
    return probes.last_record(log, "k")


@query("SELECT count(*) FILTER (regexp_matches(props, '1[0-9]')) AS n FROM events")
def regex_line_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probes.matching_lines(Tables(spark, sf_dir).events.select(F.col("event_id").alias("line_no"), F.col("props").alias("value")), "1[0-9]")


@query("""
    SELECT event_id, round((value - m) / (s + 0.0001), 6) AS advantage FROM events JOIN (SELECT user_id, avg(value) AS m, stddev_pop(value) AS s FROM events GROUP BY user_id) USING (user_id)""")
def group_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each value against its user's mean and spread."""
    return stats.group_advantages(Tables(spark, sf_dir).events.select("event_id", "user_id", "value"), ["user_id"], "value").select("event_id", F.round("advantage", 6).alias("advantage"))


@query("""
    WITH v AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY ALL),
    w AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS r FROM v)
    SELECT event_type, count(*) AS users_won FROM w WHERE r = 1 GROUP BY event_type""")
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's commonest type, ties to the first seen; then how many users each type won."""
    votes = Tables(spark, sf_dir).events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("f"))
    best = votes.groupBy("user_id").agg(F.max_by("event_type", F.struct(F.col("n"), -F.col("f"))).alias("event_type"))
    return best.groupBy("event_type").agg(F.count(F.lit(1)).alias("users_won"))


@query("""
    WITH l AS (SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS v FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY ALL)
    SELECT a.user_id, a.v AS view, b.v AS click, c.v AS purchase FROM l a JOIN l b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'click' JOIN l c ON a.user_id = c.user_id AND c.event_type = 'purchase'""")
def complete_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with all three types, the last value of each side by side."""
    return align.complete_groups(Tables(spark, sf_dir).events, ["user_id"], "event_type", ["view", "click", "purchase"], [F.col("ts"), F.col("event_id")], "value")


@query(f"SELECT round(corr(a.value, b.value), 6) AS r FROM ({_DAY}) a JOIN ({_DAY}) b ON a.step = b.step AND a.event_type = 'view' AND b.event_type = 'click'")
def series_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    side = lambda kind, name: p.filter(F.col("event_type") == kind).select("step", F.col("value").alias(name))
    return side("view", "a").join(side("click", "b"), "step").agg(F.round(F.corr("a", "b"), 6).alias("r"))


@query("SELECT user_id, round(min(value) * 1.0, 9) AS least, round(max(value), 9) AS most, round(quantile_cont(value, 0.5), 6) AS middle, round(quantile_cont(value, 0.975), 6) AS high FROM events GROUP BY user_id")
def value_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = lambda p: F.round(F.percentile("value", F.lit(p)), 6)
    return Tables(spark, sf_dir).events.groupBy("user_id").agg(F.round(F.min("value"), 9).alias("least"), F.round(F.max("value"), 9).alias("most"), q(0.5).alias("middle"), q(0.975).alias("high"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: tumbling windows, the batch form of the streaming operator."""
    return stream.tumbling_counts(Tables(spark, sf_dir).events).withColumn("total", F.round("total", 6))


@query("""
    SELECT window_start, event_type, round(avg(value), 6) AS mean FROM (
      SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS window_start, event_type, value FROM events) GROUP BY ALL""")
def sliding_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: sliding windows."""
    return stream.sliding_average(Tables(spark, sf_dir).events).withColumn("mean", F.round("mean", 6))


@query("""
    WITH g AS (SELECT *, coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) > 172800000000)::INT, 0) AS b FROM events),
    s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: session windows of two days."""
    return stream.sessions(Tables(spark, sf_dir).events, "48 hours")
