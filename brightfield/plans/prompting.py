"""Prompt fields, replies and task audits as queries: prompts are made from the documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import prompts
from .registry import Tables, query


def _id(n: int) -> Column:
    return F.col("doc_id") % n


@query("""SELECT doc_id, 'Use case: ' || source || chr(10) || 'Length: approximately 100 tokens' AS prompt, n_chars::INT AS original_target_tokens, source AS use_case FROM documents WHERE n_chars BETWEEN 50 AND 900""")
def prompt_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts whose requested length lies between bounds, the request rewritten."""
    made = F.concat(F.lit("Use case: "), F.col("source"), F.lit("\nLength: approximately "), F.col("n_chars").cast("string"), F.lit(" tokens"))
    return prompts.with_target_length(Tables(spark, sf_dir).documents.select("doc_id", made.alias("prompt")), "prompt", 100, 50, 900)


@query("SELECT round(avg((doc_id % 3 = 0)::INT), 9) AS rate FROM documents WHERE doc_id % 2 = 0")
def dash_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of replies with a long dash among the prompts that do not allow one."""
    rows = Tables(spark, sf_dir).documents.select(
        F.when(_id(2) == 0, "EMDASH: not allowed").otherwise("Emdash: allowed").alias("prompt"), F.when(_id(3) == 0, "so — yes").otherwise("so - yes").alias("reply")
    )
    return prompts.dash_violations(rows, "prompt", "reply").withColumn("rate", F.round("rate", 9))


@query("""
    SELECT doc_id, 'Use case: ' || source || chr(10) || chr(10) || 'Style: ' || lang || chr(10) || chr(10) || 'Length: approximately ' || n_chars || ' tokens' || chr(10) || chr(10) || 'Emdash: ' ||
      CASE WHEN doc_id % 2 = 0 THEN 'allowed' ELSE 'not allowed' END || chr(10) || chr(10) || CASE WHEN doc_id % 3 <> 0 AND sha256('outline:' || doc_id) < 'c' THEN 'Outline:' || chr(10) || 'outline ' || doc_id || chr(10) || chr(10) ELSE '' END
      || 'Prompt:' || chr(10) || substr(text, 1, 30) AS prompt FROM documents""")
def assembled_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts under their flags; three quarters of the outlines are kept."""
    outline = F.when(_id(3) == 0, "").otherwise(F.concat(F.lit("outline "), F.col("doc_id").cast("string")))
    made = prompts.assemble(F.substring("text", 1, 30), F.col("source"), F.col("lang"), F.col("n_chars"), _id(2) == 0, outline, F.col("doc_id"))
    return Tables(spark, sf_dir).documents.select("doc_id", made.alias("prompt"))


@query("""
    SELECT doc_id, CASE WHEN n_chars % 200 > 128 THEN 'target budget ' || n_chars % 200 || '>128' WHEN n_chars % 1100 + n_chars % 200 > 1024 THEN 'context budget ' || (n_chars % 1100 + n_chars % 200) || '>1024'
      WHEN doc_id % 3 <> doc_id % 2 THEN 'decoded target lost terminal answer' END AS reason FROM documents""")
def task_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a task does not fit its budgets, in order."""
    decoded = F.concat(F.lit("TRACE: 01\nFINAL: "), _id(3).cast("string"), F.lit(" \n"))
    reason = prompts.audit_reason(F.col("n_chars") % 200, F.col("n_chars") % 1100, F.trim(F.regexp_replace(decoded, r"\s+$", "")), _id(2).cast("string"))
    return Tables(spark, sf_dir).documents.select("doc_id", reason.alias("reason"))


@query("""SELECT doc_id, doc_id % 2 = 0 AND doc_id % 5 <> 0 AND doc_id % 3 = 0 AS refuses, greatest(1, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')))::INT AS n_tokens FROM documents""")
def reply_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refusals that a given detail makes irrelevant, and the word count where no tokenizer is given."""
    asked = F.concat(F.when(_id(2) == 0, "Monday morning?").otherwise("Soon?"), F.when(_id(5) == 0, " And at what price?").otherwise(""))
    reply = F.when(_id(3) == 0, "I have no tools to verify that.").otherwise("Yes.")
    return Tables(spark, sf_dir).documents.select("doc_id", prompts.refuses_given_detail(reply, asked).alias("refuses"), prompts.token_count(F.col("text")).alias("n_tokens"))


@query("""
    WITH r AS (SELECT user_id, value, event_id % 3 AS s, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events)
    SELECT user_id, round(avg(value / s), 9) AS rate FROM r WHERE n <= 8 AND s > 0 GROUP BY user_id""")
def recent_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean amount a second over the last eight samples."""
    rows = Tables(spark, sf_dir).events.withColumn("seconds", (F.col("event_id") % 3).cast("double"))
    return prompts.recent_rate(rows, ["user_id"], "event_id", "value", "seconds").withColumn("rate", F.round("rate", 9))
