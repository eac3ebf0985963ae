"""Documents to packed training sequences, in five stages; each stage's result is written and read by the next.

All stages but the last return the columns of ``documents``, whatever further columns there are and whatever their names.
Rows without a doc_id cannot be named by a decision, so they pass the deduplicating stages as they are and are left out of
the mix, which goes by doc_id. An empty table gives an empty one; whole texts are read, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightfield.llm import exact, jaccard, langid, mixing, packing
from brightfield.llm.common import cut, cut_whole, discard, free_name, near_filter, without

#: A document goes if its language cannot be told: no letters, or no language with this mean marginal.
MIN_LANGUAGE_SCORE = 0.35


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the random field can tell.

    Null and empty texts, and those without a letter, go. ``lang`` and ``doc_id`` may be null: the model learns from the
    rows with a language; without any, no language can be told and all rows go. Repeated rows are told each.
    """
    told = free_name("language_found", docs)
    labelled = langid.with_language(docs, langid.fit(docs), told)
    return labelled.filter((F.col(told)["lang_pred"] != "und") & (F.col(told)["score"] >= MIN_LANGUAGE_SCORE)).drop(told)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal normalised texts: the one with the smallest doc_id.

    Null and empty texts are one group. Of repeated rows one stays; of rows that share an id, one of each text that this
    id keeps. Rows without doc_id stay, and the group of such a text keeps its smallest id as well.
    """
    found = cut(exact.exact_dedup(docs), "exact")
    ids = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if("kept").alias("kept"))
    # an id goes if not all its rows stay; of an id with several rows, one row of each text that stays comes back
    gone = cut(ids.filter("doc_id IS NOT NULL AND rows <> kept"), "gone")
    own, other, sha = (free_name(x, docs) for x in ("kept_id", "kept_sha", "text_sha"))
    repeated = gone.filter("kept > 0").select("doc_id").toDF(own)
    stays = found.filter("kept").select("doc_id", "text_sha256").toDF(own, other)
    several = near_filter(docs, "doc_id", repeated).withColumn(sha, F.sha2(exact.normalised(F.col("text")).cast("binary"), 256))
    several = several.join(repeated, F.col("doc_id") == F.col(own), "left_semi")
    again = several.join(stays, (F.col("doc_id") == F.col(own)) & (F.col(sha) == F.col(other)), "left_semi")
    return without(docs, "doc_id", gone.select("doc_id")).unionByName(again.dropDuplicates(["doc_id", sha]).drop(sha))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: the one with the smallest doc_id.

    Texts without words are near nothing and stay. Rows that share an id are one document: all stay or all go. Repeated
    rows and rows without doc_id stay.
    """
    found = jaccard.jaccard_components(docs)
    return without(docs, "doc_id", cut(found.filter("component_id <> doc_id").select("doc_id").distinct(), "near"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it.

    A null source is a source of its own; texts without words are never taken; of rows that share an id, each comes as
    often as the one that is taken most; rows without doc_id are left out.
    """
    return mixing.take_copies(docs, mixing.mix_sources(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequence and place. Copies are packed each; a null text is its end id alone."""
    return packing.best_fit_packing(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("mix_sources", mix_sources),
    ("best_fit_packing", best_fit_packing),
]

#: Language scores and the random copies of the mix cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again; what a stage no longer needs is deleted."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = cut_whole(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return docs
