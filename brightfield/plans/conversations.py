"""Queries over conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from ..operators import select, validate
from .registry import Tables, query

RULES = (validate.Rule(r"[0-9]", "A reply holds a digit."), validate.Rule(r"(?i)\bthe the\b", "A reply doubles a word.", "minor", "style"))


def _hit(column: str, pattern: str) -> str:
    """SQL of whether a pattern matches: what may not stand beside a match is matched with it, as DuckDB knows no look-around."""
    bare = pattern.replace(r"(?<!\d)", "(?:^|[^0-9])").replace(r"(?!\d)", "(?:[^0-9]|$)").replace("'", "''")
    return f"regexp_matches({column}, '{bare}')"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).conversations.select(F.col("conv_id").alias("session_id"), "turn", "role", "text")


_FINDINGS = r"""
    WITH said AS (SELECT conv_id, turn, text, trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g')) AS norm FROM conversations WHERE role = 'assistant'),
    firsts AS (SELECT *, min(turn) OVER (PARTITION BY conv_id, norm) AS f FROM said),
    grams AS (SELECT DISTINCT conv_id, turn, array_to_string(list_slice(w, i, i + 3), ' ') AS phrase FROM (
        SELECT conv_id, turn, w, unnest(range(1, len(w) - 2)) AS i FROM (SELECT conv_id, turn, regexp_extract_all(norm, '[\p{L}\p{N}_'']+') AS w FROM said))),
    reuse AS (SELECT phrase, count(DISTINCT conv_id) AS sessions, min((conv_id, turn)) AS at FROM grams GROUP BY phrase HAVING count(DISTINCT conv_id) >= 3),
    found AS (
      SELECT 'response_validity' AS criterion_id, 'The subject produced no assistant response.' AS message, 'critical' AS severity, 'session' AS scope, conv_id::VARCHAR AS session_id, '' AS turn_list, NULL AS evidence
      FROM conversations GROUP BY conv_id HAVING max((role = 'assistant')::INT) = 0
      UNION ALL SELECT 'response_validity', 'The subject produced an empty response.', 'critical', 'session', conv_id::VARCHAR, turn::VARCHAR, NULL FROM firsts WHERE norm = ''
      UNION ALL SELECT 'conversation_coherence', 'The subject repeated an earlier assistant response exactly.', 'major', 'session', conv_id::VARCHAR, f || ',' || turn, text FROM firsts WHERE norm <> '' AND turn > f
      UNION ALL SELECT 'grounding', 'A reply holds a digit.', 'major', 'session', conv_id::VARCHAR, turn::VARCHAR, text FROM firsts WHERE norm <> '' AND regexp_matches(text, '[0-9]')
      UNION ALL SELECT 'style', 'A reply doubles a word.', 'minor', 'session', conv_id::VARCHAR, turn::VARCHAR, text FROM firsts WHERE norm <> '' AND regexp_matches(text, '(?i)\bthe the\b')
      UNION ALL SELECT 'cross_session_reuse', 'A phrase recurs across ' || sessions || ' distinct sessions.', 'minor', 'batch', NULL, '', c.text
      FROM reuse JOIN conversations c ON c.conv_id = reuse.at[1] AND c.turn = reuse.at[2])
"""


@query(_FINDINGS + "SELECT 'deterministic' AS source, * FROM found")
def validation_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No reply, empty replies, repeats, rule hits, and phrases that recur across sessions."""
    found = validate.findings(turns(spark, sf_dir), RULES)
    return found.select("source", "criterion_id", "message", "severity", "scope", "session_id", F.array_join(F.col("turn_indices").cast("array<string>"), ",").alias("turn_list"), "evidence")


@query(_FINDINGS + """
    SELECT 'total' AS kind, '' AS name, count(*) AS n FROM found UNION ALL SELECT 'sessions_with_findings', '', count(DISTINCT session_id) FROM found
    UNION ALL SELECT 'by_criterion', criterion_id, count(*) FROM found GROUP BY criterion_id UNION ALL SELECT 'by_severity', severity, count(*) FROM found GROUP BY severity""")
def findings_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.counts(validate.findings(turns(spark, sf_dir), RULES))


@query(_FINDINGS + """
    SELECT trajectory_count, critical_failure_count, sessions_with_findings, 0 AS judged_session_count, NULL::DOUBLE AS mean_session_score, NULL::DOUBLE AS session_pass_rate,
      round(sessions_with_findings / trajectory_count, 9) AS first_failure_rate, critical_failure_count <= 0 AS gate_passed
    FROM (SELECT count(DISTINCT conv_id) AS trajectory_count FROM conversations), (SELECT count(*) FILTER (severity = 'critical') AS critical_failure_count, count(DISTINCT session_id) AS sessions_with_findings FROM found)""")
def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary of the findings and the release gate."""
    t = turns(spark, sf_dir)
    return validate.gate(validate.report(t, validate.findings(t, RULES))).withColumn("first_failure_rate", F.round("first_failure_rate", 9))


@query(r"""
    WITH said AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[\p{L}\p{N}_'']+') AS w FROM conversations WHERE role = 'assistant'),
    grams AS (SELECT DISTINCT conv_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS phrase FROM (SELECT conv_id, w, unnest(range(1, len(w) - 1)) AS i FROM said))
    SELECT phrase, count(*) AS sessions FROM grams GROUP BY phrase HAVING count(*) >= 2""")
def phrase_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word phrases that two sessions or more share."""
    return validate.phrase_reuse(turns(spark, sf_dir), size=3, least=2).select("phrase", "sessions")


@query(r"""
    SELECT conv_id, turn, list_aggregate(hist, 'count') AS n_history, array_to_string(hist, ' | ') AS history, text AS target FROM (
      SELECT *, list(role || ': ' || text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS hist, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)
    WHERE role = 'assistant' AND before = 'user'""")
def history_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each reply to a user turn with the four messages before it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = Tables(spark, sf_dir).conversations.withColumn("hist", F.collect_list(F.concat(F.col("role"), F.lit(": "), F.col("text"))).over(w.rowsBetween(-4, -1)))
    rows = rows.withColumn("before", F.lag("role").over(w)).filter("role = 'assistant' AND before = 'user'")
    return rows.select("conv_id", "turn", F.size("hist").cast("long").alias("n_history"), F.array_join("hist", " | ").alias("history"), F.col("text").alias("target"))


@query("""
    SELECT conv_id, bool_and(length(text) BETWEEN 20 AND 600) AS passed, count(*) AS turns, count(*) FILTER (length(text) < 20) AS too_short, count(*) FILTER (length(text) > 600) AS too_long
    FROM conversations WHERE role = 'assistant' GROUP BY conv_id""")
def trajectory_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation passes if all its replies do."""
    n = F.length("text")
    replies = Tables(spark, sf_dir).conversations.filter("role = 'assistant'")
    return replies.groupBy("conv_id").agg(F.bool_and(n.between(20, 600)).alias("passed"), F.count(F.lit(1)).alias("turns"), F.count_if(n < 20).alias("too_short"), F.count_if(n > 600).alias("too_long"))


@query(r"""
    SELECT conv_id, turn, norm = ANY_P[1] OR norm = ANY_P[2] OR norm = ANY_P[3] AS repeats FROM (
      SELECT *, list(norm) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS p FROM (
        SELECT conv_id, turn, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS norm FROM conversations WHERE role = 'assistant'))""".replace("norm = ANY_P[1] OR norm = ANY_P[2] OR norm = ANY_P[3]", "coalesce(list_contains(p, norm), false)"))
def recent_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a reply equals one of the three before it."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-3, -1)
    said = Tables(spark, sf_dir).conversations.filter("role = 'assistant'").select("conv_id", "turn", X.normalise(F.col("text")).alias("norm"))
    return said.select("conv_id", "turn", F.array_contains(F.collect_list("norm").over(w), F.col("norm")).alias("repeats"))


@query("""
    SELECT conv_id, CASE WHEN n_chars > 1000 THEN 'long' WHEN regexp_matches(t, '(?i)\\b(will|promise|guarantee)\\b') THEN 'commitment' ELSE 'clean' END AS bucket, n_chars
    FROM (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS t, sum(length(text))::BIGINT AS n_chars FROM conversations GROUP BY conv_id)""")
def session_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coarse class of each session."""
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]), " ")
    rows = Tables(spark, sf_dir).conversations.groupBy("conv_id").agg(joined.alias("t"), F.sum(F.length("text")).cast("long").alias("n_chars"))
    bucket = F.when(F.col("n_chars") > 1000, "long").when(F.col("t").rlike(r"(?i)\b(will|promise|guarantee)\b"), "commitment").otherwise("clean")
    return rows.select("conv_id", bucket.alias("bucket"), "n_chars")


@query(rf"""
    WITH u AS (
      SELECT conv_id, list(text ORDER BY turn, text) FILTER (role = 'user') AS said, coalesce(arg_max_null(text, turn) FILTER (role = 'assistant'), '') AS reply FROM conversations GROUP BY conv_id),
    s AS (SELECT conv_id, reply, coalesce(said[-1], '') AS latest, coalesce(array_to_string(said[:-2], ' '), '') AS prior FROM u),
    f AS (
      SELECT *, {_hit("latest", P.BUSINESS_SIGNAL)} OR {_hit("latest", P.TIME_SIGNAL)} AS business, {_hit("prior", P.BUSINESS_SIGNAL)} OR {_hit("prior", P.TIME_SIGNAL)} AS history,
        {_hit("latest", P.GENERAL_SIGNAL)} AS general, {_hit("latest", P.CASUAL_SIGNAL)} AS casual FROM s),
    m AS (
      SELECT *, CASE WHEN casual AND NOT business AND NOT general THEN 'casual_sms' WHEN business THEN 'business_reply' WHEN general THEN 'general_question' WHEN history THEN 'business_reply'
        WHEN len(list_filter(regexp_split_to_array(latest, '\s+'), lambda x: x <> '')) >= 4 THEN 'casual_sms' ELSE 'business_reply' END AS mode FROM f)
    SELECT conv_id, mode, CASE WHEN {_hit("reply", P.IDENTITY_CLAIM)} THEN 'identity_claim' WHEN {" OR ".join(_hit("reply", p) for _, p in P.PERSONAL_DATA)} THEN 'privacy'
      WHEN {_hit("reply", P.UNSUPPORTED_ACTION)} THEN 'unsupported_action' WHEN {_hit("reply", P.EXTERNAL_ACTION)} THEN 'unsupported_external_action'
      WHEN mode <> 'business_reply' AND {_hit("reply", P.SERVICE_LEAKAGE)} THEN 'service_leakage' WHEN mode = 'business_reply' AND {_hit("reply", P.PRICED_TOTAL)} THEN 'invented_amount'
      WHEN mode = 'business_reply' AND {_hit("reply", P.AMOUNT)} AND contains(reply, '$') THEN 'invented_amount' END AS violation FROM m""")
def conversation_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mode of each conversation from its user turns, and the first rule its last reply breaks."""
    rows = Tables(spark, sf_dir).conversations.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("role") == "user", F.struct("turn", "text")))).alias("u"), F.max_by("text", F.when(F.col("role") == "assistant", F.col("turn"))).alias("reply")
    )
    said = F.transform("u", lambda s: s["text"])
    latest = F.coalesce(F.get(said, F.size(said) - 1), F.lit(""))
    prior = F.array_join(F.slice(said, 1, F.greatest(F.size(said) - 1, F.lit(0))), " ")
    mode = X.infer_mode(latest, prior)
    no = F.lit(False)
    return rows.select("conv_id", mode.alias("mode"), X.response_violation(F.coalesce("reply", F.lit("")), mode, no, no, no, no).alias("violation"))


@query("""
    WITH RECURSIVE s AS (SELECT conv_id, sum(length(text))::BIGINT AS n_chars, row_number() OVER (ORDER BY conv_id) AS i FROM conversations GROUP BY conv_id),
    walk AS (
      SELECT conv_id, n_chars, i, 0::BIGINT AS batch_no, 1 AS items, n_chars AS held FROM s WHERE i = 1
      UNION ALL SELECT s.conv_id, s.n_chars, s.i, CASE WHEN items >= 8 OR held + s.n_chars > 36000 THEN batch_no + 1 ELSE batch_no END,
        CASE WHEN items >= 8 OR held + s.n_chars > 36000 THEN 1 ELSE items + 1 END, CASE WHEN items >= 8 OR held + s.n_chars > 36000 THEN s.n_chars ELSE held + s.n_chars END
      FROM walk JOIN s ON s.i = walk.i + 1)
    SELECT conv_id, n_chars, batch_no FROM walk""")
def batch_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions in order, at most 8 sessions or 36,000 characters a batch."""
    sizes = Tables(spark, sf_dir).conversations.groupBy("conv_id").agg(F.sum(F.length("text")).cast("long").alias("n_chars"))
    return select.pack_in_order(sizes, ["conv_id"], "n_chars").select("conv_id", "n_chars", "batch_no")
