"""Seams for judges, participants, redactors and embedders, criteria, and declared probes, with plain functions in the place of models."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import align, criteria, probes, seams, validate
from .registry import Tables, query


def _last_words(messages: list[dict]) -> str:
    return f"{len(messages)}: {messages[-1]['text'][:10]}"


def _count_judge(messages: list[dict]) -> dict | str:
    n = len(messages)
    if n % 4 == 0:
        return "no verdict"
    return {"score": n % 5, "passed": n % 5 >= 3}


def _no_digits(text: str) -> str:
    return re.sub("[0-9]", "#", text)


def _counts(texts: list[str]) -> np.ndarray:
    return np.array([[len(t), t.count("a"), t.count(" ")] for t in texts], float).reshape(-1, 3)


@query("SELECT conv_id, count(*) || ': ' || substr(arg_max(text, turn), 1, 10) AS reply, NULL::VARCHAR AS error FROM conversations GROUP BY conv_id")
def participant_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next turn of every conversation, by a callable on its messages."""
    return seams.replies(Tables(spark, sf_dir).conversations, _last_words, "conv_id")


@query("""SELECT conv_id, CASE WHEN n % 4 <> 0 THEN '{"passed": ' || (n % 5 >= 3)::VARCHAR || ', "score": ' || n % 5 || '}' END AS verdict, n % 4 = 0 AS failed FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)""")
def judge_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A judge's verdicts as JSON; a reply that is no object is an error of its row."""
    return seams.verdicts(Tables(spark, sf_dir).conversations, _count_judge, "conv_id").select("conv_id", "verdict", F.col("error").isNotNull().alias("failed"))


@query("SELECT conv_id, turn, regexp_replace(text, '[0-9]', '#', 'g') AS text FROM conversations")
def redacted_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns passed through a redactor."""
    return seams.redacted(Tables(spark, sf_dir).conversations.select("conv_id", "turn", "text"), _no_digits)


@query("""
    WITH c AS (SELECT doc_id, length(text)::DOUBLE AS x, (length(text) - length(replace(text, 'a', '')))::DOUBLE AS y, (length(text) - length(replace(text, ' ', '')))::DOUBLE AS z FROM documents)
    SELECT doc_id, round(x / sqrt(x * x + y * y + z * z), 6) AS a, round(y / sqrt(x * x + y * y + z * z), 6) AS b, round(z / sqrt(x * x + y * y + z * z), 6) AS c FROM c""")
def embedded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of length one by an encoder of batches."""
    found = seams.embedded(Tables(spark, sf_dir).documents.select("doc_id", "text"), _counts)
    return found.select("doc_id", *(F.round(F.get("embedding", F.lit(i)), 6).alias(n) for i, n in enumerate("abc")))


CRITERIA = {"name": "smoke", "criteria": [{"id": "grounding", "description": "Says what it knows.", "min_score": 2, "max_failures": 1}, {"id": "tone", "description": "Is polite.", "scope": "batch", "severity": "minor", "rubric": {"1": "polite", "0": "rude"}}]}


@query("SELECT * FROM (VALUES ('grounding', 'Says what it knows.', 'session', 'major', 5, true, 2.0::DOUBLE, 1), ('tone', 'Is polite.', 'batch', 'minor', 2, true, 3.0::DOUBLE, NULL)) AS t(criterion_id, description, scope, severity, levels, evidence_required, min_score, max_failures)")
def criteria_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Criteria of a specification with their defaults."""
    return criteria.criteria_set(CRITERIA).table(spark).withColumn("levels", F.size("rubric")).drop("rubric")


@query("SELECT lang, n >= 40 AS passed, least(4.0::DOUBLE, n / 10) AS score, CASE WHEN n >= 40 THEN 'fine' ELSE 'no verdict could be read' END AS summary FROM (SELECT lang, CASE WHEN count(*) >= 40 THEN count(*) ELSE 0 END AS n FROM documents GROUP BY lang)")
def corpus_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An overseer's replies on whole groups, read with defaults."""
    groups = Tables(spark, sf_dir).documents.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    js = F.concat(F.lit('Verdict: {"passed": true, "summary": "fine", "score": '), (F.col("n") / 10).cast("string"), F.lit("}"))
    return groups.select("lang", criteria.corpus_verdict(F.when(F.col("n") >= 40, js).otherwise("I cannot say")).alias("r")).select("lang", "r.*")


@query("""SELECT * FROM (VALUES ('good', true, 0::BIGINT, []::VARCHAR[], true), ('repeats', false, 0, ['conversation_coherence'], true), ('silent', false, 1, ['response_validity'], true), ('claims', false, 0, ['grounding'], true))
        AS t(session_id, should_pass, critical, found, as_expected)""")
def calibration_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations made to pass and to fail, and whether the findings tell them apart."""
    said = {
        "good": [("user", "Is the blue one in stock?"), ("assistant", "I have not seen the list yet, so I cannot say.")],
        "repeats": [("user", "When?"), ("assistant", "Soon, I think."), ("user", "But when?"), ("assistant", "Soon, I  think.")],
        "silent": [("user", "Hello?")],
        "claims": [("user", "Please book it."), ("assistant", "I booked it for you.")],
    }
    turns = spark.createDataFrame([(k, i, *t) for k, ts in said.items() for i, t in enumerate(ts)], "session_id string, turn long, role string, text string")
    expected = spark.createDataFrame([("good", True, []), ("repeats", False, ["conversation_coherence"]), ("silent", False, ["response_validity"]), ("claims", False, ["grounding"])], "session_id string, should_pass boolean, must_find array<string>")
    return criteria.calibration(validate.trajectory_findings(turns, (validate.Rule(r"(?i)\bI booked\b", "Claims an action."),)), expected)


PROBES = [
    {"id": "errors", "kind": "line_count", "regex": '"error"', "danger_above": 10, "unit": "lines"},
    {"id": "last_type", "kind": "last_match", "regex": '"event_type":"(\\w+)"', "label": "Last type"},
    {"id": "last_user", "kind": "last_record", "path": "user_id", "warn_above": 1e9},
    {"id": "hidden", "kind": "line_count", "regex": ".", "enabled": False},
]


@query("""SELECT 'errors' AS id, 'errors' AS label, 'line_count' AS kind, count_if(event_type = 'error')::VARCHAR AS value, 'lines' AS unit, CASE WHEN count_if(event_type = 'error') > 10 THEN 'red' ELSE 'green' END AS style FROM events
        UNION ALL SELECT 'last_type', 'Last type', 'last_match', arg_max(event_type, event_id), '', 'green' FROM events UNION ALL SELECT 'last_user', 'last_user', 'last_record', arg_max(user_id, event_id)::VARCHAR, '', 'green' FROM events""")
def declared_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probes by declaration over a log of events."""
    log = Tables(spark, sf_dir).events.select(F.col("event_id").alias("line_no"), F.to_json(F.struct("event_id", "event_type", "user_id")).alias("value"))
    return probes.declared(log, PROBES)


@query("SELECT source, doc_id AS id, n_chars AS size, quality = 1 AS good FROM documents JOIN labels USING (doc_id)")
def row_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What names each labelled row elsewhere."""
    t = Tables(spark, sf_dir)
    rows = t.documents.join(t.labels, "doc_id")
    return rows.select(align.pointer(F.col("source"), id=F.col("doc_id"), size=F.col("n_chars")).alias("p"), (F.col("quality") == 1).alias("good")).select("p.*", "good")
