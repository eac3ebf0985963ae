"""The run catalog over stand-ins: an order is a run, its priority the stage, its lines the artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog
from .registry import Tables, query


def runs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).orders.select(
        F.col("o_orderkey").cast("string").alias("run_id"), F.col("o_orderpriority").alias("stage"), F.col("o_orderstatus").alias("status"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("created_at")
    )


def artifacts_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    part = t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("title"), F.array("p_brand", F.substring_index("p_type", " ", 1)).alias("tags"))
    lines = t.lineitem.select(F.col("l_orderkey").cast("string").alias("run_id"), F.col("l_linenumber").alias("no"), "l_partkey", F.col("l_returnflag").alias("sensitivity"), F.col("l_linestatus").alias("format"))
    return lines.join(part, "l_partkey").drop("l_partkey")


def lineage_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order follows the customer's one before it."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = Tables(spark, sf_dir).orders.withColumn("before", F.lag("o_orderkey").over(w)).filter("before IS NOT NULL")
    return rows.select(F.col("before").cast("string").alias("parent_run_id"), F.col("o_orderkey").cast("string").alias("child_run_id"), F.lit("input").alias("relation"))


_RUNS = "runs AS (SELECT o_orderkey::VARCHAR AS run_id, o_orderpriority AS stage, o_orderstatus AS status, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS created_at FROM orders)"
_LINEAGE = "lineage AS (SELECT b::VARCHAR AS parent_run_id, o_orderkey::VARCHAR AS child_run_id, 'input' AS relation FROM (SELECT *, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b FROM orders) WHERE b IS NOT NULL)"


@query(f"WITH {_RUNS} SELECT * FROM runs WHERE stage = (SELECT min(stage) FROM runs) AND status = 'F' ORDER BY created_at DESC, run_id LIMIT 100")
def registry_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest hundred finished runs of a stage."""
    runs = runs_of(spark, sf_dir)
    return catalog.find(runs, runs.agg(F.min("stage")).first()[0], "F")


@query(f"""
    WITH {_RUNS}, newest AS (SELECT * FROM runs ORDER BY created_at DESC, run_id LIMIT 500)
    SELECT run_id, l_linenumber AS no, p_name AS title, p_brand AS brand, stage FROM newest JOIN lineitem ON run_id = l_orderkey::VARCHAR JOIN part ON l_partkey = p_partkey
    WHERE (p_brand = 'Brand#1' OR split_part(p_type, ' ', 1) = 'Brand#1' OR p_brand LIKE 'Brand#%') AND l_returnflag = 'N' AND contains(lower(p_name), 'ring')""")
def artifact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled artifacts of the newest runs, by part of the title and sensitivity."""
    hit = catalog.find_artifacts(runs_of(spark, sf_dir), artifacts_of(spark, sf_dir), title="Ring", sensitivity="N", run_limit=500)
    return hit.filter(F.exists("tags", lambda t: t.startswith("Brand#"))).select("run_id", "no", "title", F.get("tags", F.lit(0)).alias("brand"), "stage")


@query(f"WITH {_LINEAGE} SELECT a.parent_run_id AS run_id, b.child_run_id AS grandchild FROM lineage a JOIN lineage b ON a.child_run_id = b.parent_run_id")
def lineage_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children of children."""
    edges = lineage_of(spark, sf_dir)
    nxt = edges.select(F.col("parent_run_id").alias("child_run_id"), F.col("child_run_id").alias("grandchild"))
    return edges.join(nxt, "child_run_id").select(F.col("parent_run_id").alias("run_id"), "grandchild")


def _halves(spark: SparkSession, sf_dir: str) -> tuple[dict, dict]:
    runs, edges = runs_of(spark, sf_dir), lineage_of(spark, sf_dir)
    metrics = Tables(spark, sf_dir).lineitem.select(F.col("l_orderkey").cast("string").alias("run_id"), F.col("l_linenumber").alias("step"), F.col("l_quantity").alias("value"))
    number = lambda c: F.pmod(F.col(c).cast("long"), F.lit(3))

    def side(keep: tuple[int, ...], status: str) -> dict:
        return {
            "runs": runs.filter(number("run_id").isin(*keep)).withColumn("status", F.concat("status", F.lit(status))),
            "lineage": edges.filter(number("parent_run_id").isin(*keep) & number("child_run_id").isin(*keep)),
            "metrics": metrics.filter(number("run_id").isin(*keep)).withColumn("value", F.col("value") + len(status)),
        }

    return side((0, 1), ""), side((1, 2), "!")


_MERGE = f"""
    WITH {_RUNS}, {_LINEAGE},
    l AS (SELECT * FROM runs WHERE run_id::BIGINT % 3 IN (0, 1)), r AS (SELECT run_id, stage, status || '!' AS status, created_at FROM runs WHERE run_id::BIGINT % 3 IN (1, 2)),
    el AS (SELECT * FROM lineage WHERE parent_run_id::BIGINT % 3 IN (0, 1) AND child_run_id::BIGINT % 3 IN (0, 1)), er AS (SELECT * FROM lineage WHERE parent_run_id::BIGINT % 3 IN (1, 2) AND child_run_id::BIGINT % 3 IN (1, 2)),
    ml AS (SELECT l_orderkey::VARCHAR AS run_id FROM lineitem WHERE l_orderkey % 3 IN (0, 1)), mr AS (SELECT l_orderkey::VARCHAR AS run_id FROM lineitem WHERE l_orderkey % 3 IN (1, 2))"""


@query(_MERGE + """
    SELECT 'added' AS name, (SELECT count(*) FROM r WHERE run_id::BIGINT % 3 = 2) AS n UNION ALL SELECT 'replaced', 0 UNION ALL SELECT 'skipped', (SELECT count(*) FROM r WHERE run_id::BIGINT % 3 = 1)
    UNION ALL SELECT 'lineage', (SELECT count(*) FROM er WHERE parent_run_id::BIGINT % 3 = 2 AND child_run_id::BIGINT % 3 = 2) UNION ALL SELECT 'metrics', (SELECT count(*) FROM mr WHERE run_id::BIGINT % 3 = 2)""")
def registry_merge_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merge of two catalogs that share a third of their runs: what it counts."""
    report = catalog.merge(*_halves(spark, sf_dir), "skip")["report"]
    return report.unpivot([], ["added", "replaced", "skipped", "lineage", "metrics"], "name", "n")


@query(_MERGE + """
    SELECT run_id, stage, status, created_at FROM l WHERE run_id::BIGINT % 3 = 0 UNION ALL SELECT * FROM r""")
def registry_merge_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs after a merge that replaces the shared ones."""
    return catalog.merge(*_halves(spark, sf_dir), "replace")["runs"]


@query(_MERGE + """
    SELECT parent_run_id, child_run_id FROM el WHERE parent_run_id::BIGINT % 3 = 0 AND child_run_id::BIGINT % 3 = 0 UNION SELECT parent_run_id, child_run_id FROM er""")
def registry_merge_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.merge(*_halves(spark, sf_dir), "replace")["lineage"].select("parent_run_id", "child_run_id")


@query(f"""
    WITH RECURSIVE {_LINEAGE}, first AS (SELECT parent_run_id AS run_id FROM lineage WHERE parent_run_id NOT IN (SELECT child_run_id FROM lineage)),
    walk AS (SELECT run_id AS root, run_id, 0 AS depth FROM first UNION ALL SELECT root, child_run_id, depth + 1 FROM walk JOIN lineage ON walk.run_id = parent_run_id WHERE depth < 8)
    SELECT root, count(*) AS descendants, max(depth) AS depth FROM walk WHERE depth > 0 GROUP BY root""")
def lineage_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: descendants of each first run, up to eight generations."""
    edges = lineage_of(spark, sf_dir).select("parent_run_id", "child_run_id")
    at = edges.join(edges.select(F.col("child_run_id").alias("parent_run_id")), "parent_run_id", "left_anti").select(F.col("parent_run_id").alias("root"), F.col("child_run_id").alias("run_id"), F.lit(1).alias("depth"))
    out, level = at, at
    for depth in range(2, 9):
        level = level.join(edges, level["run_id"] == edges["parent_run_id"]).select("root", F.col("child_run_id").alias("run_id"), F.lit(depth).alias("depth"))
        out = out.unionByName(level)
    return out.groupBy("root").agg(F.count(F.lit(1)).alias("descendants"), F.max("depth").alias("depth"))


@query("""
    WITH n AS (SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_quantity DESC) AS r FROM lineitem)
    SELECT l_orderkey::VARCHAR AS run_id, l_linenumber AS step, l_quantity AS value FROM n WHERE r = 1""")
def latest_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last step of each run's metric."""
    rows = Tables(spark, sf_dir).lineitem.select(F.col("l_orderkey").cast("string").alias("run_id"), F.col("l_linenumber").alias("step"), F.col("l_quantity").alias("value"))
    return rows.groupBy("run_id").agg(F.max("step").alias("step"), F.max_by("value", F.struct("step", "value")).alias("value"))
