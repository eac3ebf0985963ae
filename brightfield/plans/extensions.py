"""Extensions: operators that an analytics engine is expected to have beside the domain's own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .registry import Tables, query


@query("""
    SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def join_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-way join: the optimizer picks which sides are small enough to send whole."""
    t = Tables(spark, sf_dir)
    joined = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(avg(l_discount), 6) AS discount FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus")
def price_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Tables(spark, sf_dir).lineitem.filter("l_shipdate <= TIMESTAMP '1998-09-02'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.avg("l_discount"), 6).alias("discount"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_returnflag, l_linestatus)::BIGINT AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).lineitem.cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


@query("SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def set_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return t.customer.select("c_custkey").intersect(t.orders.filter("o_orderstatus = 'F'").select("o_custkey"))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def customers_without_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without a large order."""
    t = Tables(spark, sf_dir)
    return t.customer.join(t.orders.filter("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_mktsegment")


@query("""
    SELECT e.event_id, p.event_id AS purchase_id FROM events e ASOF JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY ALL) p ON e.user_id = p.user_id AND e.ts >= p.ts WHERE e.event_type = 'view'""")
def asof_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last purchase of the user at or before each view: one window over both, no join."""
    w = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, 0)
    rows = Tables(spark, sf_dir).events.filter("event_type IN ('view', 'purchase')")
    # of purchases at one moment the largest id counts, whichever row comes first
    bought = F.when(F.col("event_type") == "purchase", F.struct("ts", "event_id"))
    seen = rows.withColumn("p", F.max(bought).over(w)).filter("event_type = 'view' AND p IS NOT NULL")
    return seen.select("event_id", F.col("p.event_id").alias("purchase_id"))


@query("""
    SELECT a.event_id, count(*) AS near FROM events a JOIN events b ON a.user_id = b.user_id AND b.event_type = 'click' AND b.ts BETWEEN a.ts - INTERVAL 1 DAY AND a.ts + INTERVAL 1 DAY WHERE a.event_type = 'purchase' GROUP BY a.event_id""")
def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks within a day of each purchase: an equi-join on the user and the day, then the exact bound."""
    e = Tables(spark, sf_dir).events
    day = F.floor(F.unix_timestamp("ts") / 86400)
    left = e.filter("event_type = 'purchase'").select("event_id", "user_id", F.col("ts").alias("at"), F.explode(F.sequence(day - 1, day + 1)).alias("day"))
    right = e.filter("event_type = 'click'").select("user_id", "ts", day.alias("day"))
    near = F.col("ts").between(F.col("at") - F.expr("INTERVAL 1 DAY"), F.col("at") + F.expr("INTERVAL 1 DAY"))
    return left.join(right, ["user_id", "day"]).filter(near).groupBy("event_id").agg(F.count(F.lit(1)).alias("near"))


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY o_orderpriority")
def status_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).orders.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().fillna(0)


@query("SELECT s_suppkey, l_orderkey, round(revenue, 2) AS revenue, ntile(4) OVER (PARTITION BY s_suppkey ORDER BY revenue, l_orderkey) AS quarter, round(percent_rank() OVER (PARTITION BY s_suppkey ORDER BY revenue, l_orderkey), 9) AS pr FROM (SELECT l_suppkey AS s_suppkey, l_orderkey, round(sum(l_extendedprice), 2) AS revenue FROM lineitem GROUP BY ALL)")
def supplier_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Tables(spark, sf_dir).lineitem.groupBy(F.col("l_suppkey").alias("s_suppkey"), "l_orderkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("revenue"))
    w = Window.partitionBy("s_suppkey").orderBy("revenue", "l_orderkey")
    return rows.select("s_suppkey", "l_orderkey", "revenue", F.ntile(4).over(w).alias("quarter"), F.round(F.percent_rank().over(w), 9).alias("pr"))
