"""Queries over embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import numeric as N
from ..operators import select, stats
from .registry import Tables, query

_D2 = "list_sum(list_transform(list_zip(x.embedding, y.embedding), lambda z: (z[1]::DOUBLE - z[2]) ** 2))"


def _class(spark: SparkSession, sf_dir: str, label: int) -> DataFrame:
    return Tables(spark, sf_dir).embeddings.filter(F.col("label") == label).select("vec_id", "embedding")


@query(f"""
    WITH k AS (SELECT x.label AS a, y.label AS b, exp(-({_D2}) / 2) AS k FROM embeddings x, embeddings y WHERE x.vec_id <> y.vec_id AND x.label IN (0, 1) AND y.label IN (0, 1))
    SELECT round(avg(k) FILTER (a = 0 AND b = 0) + avg(k) FILTER (a = 1 AND b = 1) - 2 * avg(k) FILTER (a = 0 AND b = 1), 9) AS mmd2 FROM k""")
def mmd_two_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unbiased kernel distance between two classes."""
    return stats.mmd2(_class(spark, sf_dir, 0), _class(spark, sf_dir, 1), "vec_id", "embedding", 1.0).select(F.round("mmd2", 9).alias("mmd2"))


@query(f"""
    WITH k AS (SELECT x.vec_id AS i, y.label AS b, 1 / (1 + ({_D2}) / 2) AS k FROM embeddings x, embeddings y WHERE x.vec_id <> y.vec_id AND x.label = 0 AND y.label IN (0, 1)),
    w AS (SELECT i, avg(k) FILTER (b = 1) - avg(k) FILTER (b = 0) AS w FROM k GROUP BY i)
    SELECT i, round(w - avg(w) OVER (), 9) AS witness FROM w""")
def mmd_witness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.mmd_witness(_class(spark, sf_dir, 0), _class(spark, sf_dir, 1), "vec_id", "embedding", 1.0).select("i", F.round("witness", 9).alias("witness"))


def _probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Tables(spark, sf_dir).embeddings.filter("label IN (0, 1)")
    return rows.select("vec_id", "embedding", (F.col("label") == 1).alias("p"), F.pmod("vec_id", F.lit(5)).alias("trace"))


@query("""
    WITH e AS (SELECT vec_id, label = 1 AS p, vec_id % 5 AS trace, embedding, unnest(range(1, 65)) AS d FROM embeddings WHERE label IN (0, 1)),
    s AS (SELECT g.trace, d, avg(embedding[d]::DOUBLE) FILTER (p) - avg(embedding[d]::DOUBLE) FILTER (NOT p) AS w FROM e JOIN (SELECT unnest(range(5)) AS trace) g ON e.trace <> g.trace GROUP BY ALL),
    c AS (SELECT vec_id, p, sum(embedding[d] * w) AS score FROM e JOIN s USING (trace, d) GROUP BY ALL)
    SELECT count(*) FILTER (x.p) // (SELECT count(*) FROM c WHERE NOT p) AS n_pos, round(avg(CASE WHEN x.score > y.score THEN 1.0 WHEN x.score = y.score THEN 0.5 ELSE 0 END), 6) AS auroc
    FROM c x, c y WHERE x.p AND NOT y.p""")
def loo_auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mean-difference direction learned without a row's own trace tells the classes apart this well."""
    scores = stats.leave_one_out_scores(_probe(spark, sf_dir), "trace", "vec_id", "embedding", F.col("p"))
    return stats.auroc(scores, F.round("score", 12), F.col("p")).select("n_pos", F.round("auroc", 6).alias("auroc"))


@query("""
    WITH m AS (SELECT vec_id % 2 AS half, d, avg(embedding[d]::DOUBLE) FILTER (label = 1) - avg(embedding[d]::DOUBLE) FILTER (label = 0) AS w FROM (SELECT *, unnest(range(1, 65)) AS d FROM embeddings WHERE label IN (0, 1)) GROUP BY ALL)
    SELECT round(sum(a.w * b.w) / (sqrt(sum(a.w * a.w)) * sqrt(sum(b.w * b.w))), 6) AS cosine FROM m a JOIN m b ON a.d = b.d AND a.half = 0 AND b.half = 1""")
def direction_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of the class directions learned on two halves."""
    rows = _probe(spark, sf_dir).withColumn("half", F.pmod("vec_id", F.lit(2)))
    both = stats.mean_direction(rows, "embedding", F.col("p"), ["half"])
    one = lambda h, name: both.filter(F.col("half") == h).select(F.lit(1).alias("k"), F.col("direction").alias(name))
    return one(0, "a").join(one(1, "b"), "k").select(F.round(N.cosine(F.col("a"), F.col("b")), 6).alias("cosine"))


@query("""
    WITH w AS (SELECT label, count(*) AS n FROM embeddings WHERE vec_id % 10 = 0 GROUP BY label)
    SELECT vec_id, label, draw_no FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY sha256('11:' || vec_id), vec_id) AS draw_no FROM embeddings) JOIN w USING (label) WHERE draw_no <= n""")
def depth_matched_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many vectors of each class as a reference set has, drawn by hash."""
    rows = Tables(spark, sf_dir).embeddings.select("vec_id", "label")
    return select.matched_sample(rows, rows.filter("vec_id % 10 = 0"), "label", "vec_id", 11)


@query("SELECT label, count(*) AS n, round(median(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE ** 2)))), 6) AS median_norm FROM embeddings GROUP BY label")
def norm_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).embeddings.withColumn("r", N.norm(F.col("embedding"))).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.percentile("r", F.lit(0.5)), 6).alias("median_norm"))


@query("SELECT vec_id, ['a', 'b', 'c'][(('0x' || substr(sha256(vec_id::VARCHAR), 1, 16))::UBIGINT % 3)::INT + 1] AS variant, ('0x' || substr(sha256(vec_id::VARCHAR), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616 < 0.25 AS first_quarter FROM embeddings")
def hash_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("vec_id").cast("string")
    return Tables(spark, sf_dir).embeddings.select("vec_id", H.choose(key, ["a", "b", "c"]).alias("variant"), H.in_fraction_split(key, 0.25).alias("first_quarter"))
