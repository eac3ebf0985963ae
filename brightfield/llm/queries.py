"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import chat, exact, html_tree, jaccard, langid, mixing, packing, quality, suffixes, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.derivatives(warc.responses(_table(spark, sf_dir, "pages")), keep=("page_id",))
    return found.select(
        "page_id", "record_id", "warc_type", "target_uri", "date", "refers_to", "content_type",
        F.element_at("headers", "Source-Payload-Digest").alias("source_payload_digest"),
        F.element_at("headers", "Source-Block-Digest").alias("source_block_digest"),
        F.col("block").cast("string").alias("block"), "block_digest",
    )


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(_table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(_table(spark, sf_dir, "documents"))


PROBE_TEXT = r"\### Assistant: </turn> ok"


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE_TEXT).alias("text")
    )
    return chat.chat_digests(chat.format_chat(turns.unionByName(probe)))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(_table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.remove_repeats(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_tree.extract(_table(spark, sf_dir, "pages"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_rejected",
        *(F.round(f"rate_{k}", 6).alias(f"rate_{k}") for k in quality.HOST_RULES),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_derivatives": op1_warc_derivatives,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_chat_format": op4_chat_format,
    "op5_language_id": op5_language_id,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_mix_sources": op7_mix_sources,
    "op8_html_text": op8_html_text,
    "op9_ngram_jaccard": op9_ngram_jaccard,
    "op10_quality_rules": op10_quality_rules,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {
    "op1_warc_derivatives": r"""
        WITH r AS (
          SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, chr(13) || chr(10) AS nl FROM pages),
        b AS (
          SELECT *, octet_length(encode(html)) AS n, 'HTTP/1.1 200 OK' || nl || 'Content-Type: text/html; charset=utf-8' || nl || 'Content-Length: ' || octet_length(encode(html)) || nl || nl || html AS message,
            sha256('response' || chr(31) || coalesce(page_id::VARCHAR, '') || chr(31) || url || chr(31) || sha256(html)) AS h FROM r),
        s AS (
          SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
              '(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>', ' ', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'),
              '(?i)</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g') AS bare FROM b),
        t AS (
          SELECT *, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(bare, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'),
            ' *\n[ \n]*', chr(10), 'g'), ' ' || chr(10)) AS text FROM s),
        d AS (
          SELECT page_id, url, html, message, h, 'metadata' AS warc_type, 'application/warc-fields' AS content_type,
            'source-status: HTTP/1.1 200 OK' || nl || 'source-header: Content-Type: text/html; charset=utf-8' || nl || 'source-header: Content-Length: ' || n || nl || 'source-bytes: ' || n || nl
              || 'text-chars: ' || length(text) || nl || 'text-lines: ' || CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) END || nl AS block FROM t
          UNION ALL SELECT page_id, url, html, message, h, 'conversion', 'text/plain; charset=utf-8', text FROM t),
        u AS (
          SELECT *, 'sha256:' || sha256(block) AS block_digest, '<urn:uuid:' || h[1:8] || '-' || h[9:12] || '-8' || h[14:16] || '-a' || h[18:20] || '-' || h[21:32] || '>' AS refers_to FROM d),
        v AS (SELECT *, sha256(warc_type || chr(31) || refers_to || chr(31) || block_digest) AS i FROM u)
        SELECT page_id, '<urn:uuid:' || i[1:8] || '-' || i[9:12] || '-8' || i[14:16] || '-a' || i[18:20] || '-' || i[21:32] || '>' AS record_id, warc_type, url AS target_uri, '1970-01-01T00:00:00Z' AS date,
          refers_to, content_type, 'sha256:' || sha256(html) AS source_payload_digest, 'sha256:' || sha256(message) AS source_block_digest, block, block_digest FROM v""",
    "op6_suffix_dedup": r"""
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
        w AS (SELECT doc_id, p, sha256(substr(x, 2 * p + 1, 200)) AS g FROM (SELECT doc_id, x, unnest(range(length(x) // 2 - 99)) AS p FROM d WHERE length(x) >= 200)),
        f AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) AS r FROM w) WHERE r > 1),
        i AS (SELECT doc_id, p, sum(b) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM (SELECT doc_id, p, (coalesce(p - lag(p) OVER (PARTITION BY doc_id ORDER BY p), 101) > 100)::INT AS b FROM f)),
        s AS (SELECT doc_id, k, min(p) AS a, max(p) + 100 AS e FROM i GROUP BY doc_id, k),
        k AS (
          SELECT s.doc_id, count(*) AS n_spans, sum(e - a) AS n_removed, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || any_value(substr(x, 2 * last + 1)) AS kept
          FROM (SELECT *, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before, max(e) OVER (PARTITION BY doc_id) AS last FROM s) s JOIN d USING (doc_id) GROUP BY s.doc_id)
        SELECT doc_id, length(x) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)""",
    "op9_ngram_jaccard": r"""
        WITH RECURSIVE w AS (
          SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        g AS (
          SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)
          UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 4),
        n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
        x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS x FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM x JOIN n p ON a = p.doc_id JOIN n q ON b = q.doc_id WHERE 100 * x >= 75 * (p.n + q.n - x)),
        reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, l.b FROM reach JOIN l ON reach.r = l.a)
        SELECT doc_id, coalesce(max(n), 0) AS n_shingles, min(r) AS component_id FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id""",
    "op3_exact_dedup": r"""
        WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)""",
    "op4_chat_format": r"""
        WITH t AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        e AS (
          SELECT *, regexp_replace(text, '<(\\*)(/?turn>|join/>)', '<\\\1\2', 'g') AS esc,
            coalesce(role <> lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text), true) AS begins
          FROM t)
        SELECT conv_id, count(*) AS n_turns,
          sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
          coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
          sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
          sum(length(esc) + CASE WHEN begins THEN 6 + length(role) + 1 + 8 ELSE 7 END)::BIGINT AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op10_quality_rules": r"""
        WITH d AS (
          SELECT doc_id, source, coalesce(text, '') AS text,
            list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        lines AS (
          SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) AS n_lines FROM (
            SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
          WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
        grams AS (
          SELECT doc_id, i, w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] AS g
          FROM (SELECT doc_id, w, unnest(range(len(w) - 2)) AS i FROM d WHERE len(w) >= 3)),
        again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n >= 2),
        covered AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM again, range(3) AS r(k) GROUP BY doc_id),
        c AS (
          SELECT d.doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
            (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
            coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
          FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
        f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c),
        fails AS (
          SELECT doc_id, source, unnest([
            {'rule': 1, 'bad': base_failed}, {'rule': 2, 'bad': n_words > 0 AND 10 * n_symbols > 3 * n_words},
            {'rule': 3, 'bad': n_lines > 0 AND 10 * n_dup_lines > 3 * n_lines},
            {'rule': 4, 'bad': n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words)}], recursive := true) FROM f),
        host AS (SELECT source, rule, count(*) AS n, sum(bad::INT) AS bad FROM fails GROUP BY source, rule),
        prior AS (SELECT rule, sum(bad) / sum(n) AS m, var_pop(bad / n) - sum(bad) / sum(n) * (1 - sum(bad) / sum(n)) * avg(1 / n) AS v FROM host GROUP BY rule),
        k AS (SELECT rule, m, CASE WHEN v <= 0 THEN 1e6 ELSE least(greatest(m * (1 - m) / v - 1, 1.0), 1e6) END AS k FROM prior),
        rates AS (SELECT source, rule, (bad + m * k) / (n + k) AS rate FROM host JOIN k USING (rule)),
        verdict AS (
          SELECT source, bool_or(rate > 0.5) AS host_rejected, round(any_value(rate) FILTER (rule = 1), 6) AS rate_base, round(any_value(rate) FILTER (rule = 2), 6) AS rate_symbols,
            round(any_value(rate) FILTER (rule = 3), 6) AS rate_lines, round(any_value(rate) FILTER (rule = 4), 6) AS rate_word_length FROM rates GROUP BY source)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT host_rejected AS kept,
          host_rejected, rate_base, rate_symbols, rate_lines, rate_word_length
        FROM f JOIN verdict ON f.source IS NOT DISTINCT FROM verdict.source""",
}

if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
