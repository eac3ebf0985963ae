"""Queries over documents, their labels, the benchmark and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import numeric as N
from ..functions import patterns as P
from ..functions import text as X
from ..operators import align, curate, select, stats
from ..operators.ordered import first_per_key
from .registry import Tables, query

_WORDS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')"
_BARE = r"""'!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~'"""

_KINDS = {kind: pattern.replace("'", "''") for kind, pattern in P.PERSONAL_DATA}


def _bounded(value: str, pattern: str, tag: str) -> str:
    """SQL that puts a tag for what stands between no digits. DuckDB knows no look-around, so the neighbours are matched too and put back: twice, as two matches may share one."""
    bare = pattern.replace(r"(?<!\d)", "").replace(r"(?!\d)", "")
    for _ in range(2):
        value = f"regexp_replace({value}, '(^|[^0-9])(?:{bare})([^0-9]|$)', '\\1{tag}\\2', 'g')"
    return value


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return t.documents.join(t.labels, "doc_id")


@query(rf"""
    SELECT doc_id, len(w) AS word_count, len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: trim(regexp_replace(s, '\s+', ' ', 'g')) <> '')) AS sentence_count,
      len(list_distinct(list_transform(w, lambda x: trim(lower(x), {_BARE})))) AS unique_words, length(text) AS character_count,
      CASE WHEN len(w) > 0 THEN printf('%.4f', len(list_distinct(list_transform(w, lambda x: trim(lower(x), {_BARE})))) / len(w))::DOUBLE ELSE 0 END AS vocabulary_richness
    FROM (SELECT doc_id, text, {_WORDS} AS w FROM documents)""")
def chunk_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word, sentence and vocabulary counts of each document."""
    s = X.chunk_statistics(F.col("text"))
    return Tables(spark, sf_dir).documents.select("doc_id", *(s[k].alias(k) for k in ("word_count", "sentence_count", "unique_words", "character_count", "vocabulary_richness")))


@query(rf"""
    WITH RECURSIVE p AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS s FROM documents),
    s AS (SELECT doc_id, unnest(s) AS s, unnest(range(1, len(s) + 1)) AS i FROM p),
    walk AS (
      SELECT doc_id, i, 0 AS chunk, s AS open FROM s WHERE i = 1
      UNION ALL SELECT s.doc_id, s.i, CASE WHEN open <> '' AND length(open) + length(s) > 200 THEN chunk + 1 ELSE chunk END,
        CASE WHEN open = '' OR length(open) + length(s) > 200 THEN s ELSE open || ' ' || s END FROM walk JOIN s ON s.doc_id = walk.doc_id AND s.i = walk.i + 1),
    c AS (SELECT doc_id, chunk, trim(arg_max(open, i)) AS text, max(chunk) OVER (PARTITION BY doc_id) AS last FROM walk GROUP BY doc_id, chunk),
    w AS (SELECT doc_id, chunk, text, {_WORDS} AS w FROM c WHERE chunk < last OR text <> ''),
    b AS (SELECT *, list_transform(w, lambda x: trim(lower(x), {_BARE})) AS bare, list_filter([length(trim(x, {_BARE})) FOR x IN w], lambda n: n > 0) AS lengths FROM w)
    SELECT doc_id, chunk AS index, text, len(w) AS word_count, len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: trim(regexp_replace(s, '\s+', ' ', 'g')) <> '')) AS sentence_count,
      len(list_distinct(bare)) AS unique_words, CASE WHEN len(lengths) > 0 THEN printf('%.2f', list_sum(lengths) / len(lengths))::DOUBLE ELSE 0 END AS avg_word_length,
      length(text) AS character_count, CASE WHEN len(w) > 0 THEN printf('%.4f', len(list_distinct(bare)) / len(w))::DOUBLE ELSE 0 END AS vocabulary_richness FROM b""")
def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of about 200 characters and their statistics."""
    rows = Tables(spark, sf_dir).documents.select("doc_id", F.posexplode(X.chunks(F.col("text"))).alias("index", "text"))
    s = X.chunk_statistics(F.col("text"))
    return rows.select("doc_id", "index", "text", *(v.alias(k) for k, v in s.items()))


@query("SELECT count(*) AS total, sum(quality)::BIGINT AS correct, round(avg(quality), 9) AS accuracy, round(avg(n_chars), 6) AS average_score FROM documents JOIN labels USING (doc_id)")
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.quality_report(labelled(spark, sf_dir), F.col("quality") == 1, F.col("n_chars"))
    return out.select("total", "correct", F.round("accuracy", 9).alias("accuracy"), F.round("average_score", 6).alias("average_score"))


@query("SELECT source, count(*) AS total, sum(quality)::BIGINT AS correct, round(avg(quality), 9) AS accuracy, round(avg(n_chars), 6) AS average_score FROM documents JOIN labels USING (doc_id) GROUP BY source")
def quality_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.quality_report(labelled(spark, sf_dir), F.col("quality") == 1, F.col("n_chars"), ["source"])
    return out.select("source", "total", "correct", F.round("accuracy", 9).alias("accuracy"), F.round("average_score", 6).alias("average_score"))


@query("""
    WITH c AS (SELECT source, count(*)::DOUBLE AS n, sum(quality)::DOUBLE AS k, 1.959963984540054 AS z FROM documents JOIN labels USING (doc_id) GROUP BY source),
    h AS (SELECT *, z * sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n)) / (1 + z * z / n) AS half, (k / n + z * z / (2 * n)) / (1 + z * z / n) AS mid FROM c)
    SELECT source, n::BIGINT AS n, k::BIGINT AS correct, round(k / n, 9) AS accuracy, round(greatest(0, mid - half), 9) AS wilson_low, round(least(1, mid + half), 9) AS wilson_high FROM h""")
def wilson_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.rate_with_interval(labelled(spark, sf_dir), ["source"], F.col("quality") == 1)
    return out.select("source", "n", "correct", *(F.round(c, 9).alias(c) for c in ("accuracy", "wilson_low", "wilson_high")))


_AUROC = """
    WITH r AS (SELECT {by} quality, rank() OVER ({part} ORDER BY n_chars) + (count(*) OVER (PARTITION BY {by} n_chars) - 1) / 2 AS r FROM documents JOIN labels USING (doc_id)),
    s AS (SELECT {by} sum(quality)::DOUBLE AS p, sum(1 - quality)::DOUBLE AS q, sum(r) FILTER (quality = 1) AS rs FROM r {group})
    SELECT {by} p::BIGINT AS n_pos, q::BIGINT AS n_neg, round((rs - p * (p + 1) / 2) / nullif(p * q, 0), 9) AS auroc, round(2 * (rs - p * (p + 1) / 2) / nullif(p * q, 0) - 1, 9) AS rank_biserial FROM s"""


@query(_AUROC.format(by="", part="", group=""))
def auroc_length_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well length tells good documents from others."""
    out = stats.auroc(labelled(spark, sf_dir), F.col("n_chars"), F.col("quality") == 1)
    return out.select("n_pos", "n_neg", F.round("auroc", 9).alias("auroc"), F.round("rank_biserial", 9).alias("rank_biserial"))


@query(_AUROC.format(by="lang,", part="PARTITION BY lang", group="GROUP BY lang"))
def rank_biserial_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.auroc(labelled(spark, sf_dir), F.col("n_chars"), F.col("quality") == 1, ["lang"])
    return out.select("lang", "n_pos", "n_neg", F.round("auroc", 9).alias("auroc"), F.round("rank_biserial", 9).alias("rank_biserial"))


@query(r"""
    SELECT coalesce(reason, 'accepted') AS reason, count(*) AS n FROM (SELECT CASE
        WHEN trim(regexp_replace(text, '\s+', ' ', 'g')) = '' THEN 'empty'
        WHEN regexp_matches(text, '(?im)(?:<think>|</think>|as an ai|language model|```|^\s*(?:assistant|owner|taylor)\s*:\s*)') THEN 'bad_text'
        WHEN regexp_matches(text, '\b[^\s@]+@[^\s@]+\.[A-Za-z]{2,}\b') THEN 'email'
        WHEN regexp_matches(text, '(?i)(?:https?://|www\.)\S+|\b[A-Za-z0-9.-]+\.(?:com|net|org|io|co)\b') THEN 'url'
        WHEN regexp_matches(text, '(?:^|[^\d])(?:\+?1[\s.-]?)?(?:\(\d{3}\)|\d{3})[\s.-]\d{3}[\s.-]\d{4}(?:[^\d]|$)') THEN 'phone'
        WHEN regexp_matches(text, '(?:^|[^\d])\d{5}(?:-\d{4})?(?:[^\d]|$)') THEN 'zip'
        WHEN regexp_matches(text, '(?i)\b(?:venmo|zelle|cash\s*app|paypal|routing|account\s*(?:number|#)|pass(?:word|code)|access\s*code|door\s*code|security\s*code)\b') THEN 'payment_or_secret'
        WHEN regexp_matches(text, '(?s)<[A-Z][A-Z0-9_-]{1,}>|\{\{.*?\}\}') THEN 'unresolved_marker'
        WHEN greatest(1, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))) NOT BETWEEN 8 AND 400 THEN 'length' END AS reason FROM documents)
    GROUP BY reason""")
def reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the first rule that rejects them."""
    reason = curate.text_reason(F.col("text"), 8, 400)
    return Tables(spark, sf_dir).documents.select(F.coalesce(reason, F.lit("accepted")).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(r"""
    WITH k AS (SELECT doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS k FROM documents)
    SELECT doc_id, doc_id > min(doc_id) OVER (PARTITION BY k) AS duplicate_of_first FROM k""")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an earlier document has the same normalised text."""
    docs = Tables(spark, sf_dir).documents.select("doc_id", X.normalise(F.col("text")).alias("key_text"))
    return curate.exact_first(docs, F.col("key_text"), ["doc_id"]).select("doc_id", "duplicate_of_first")


@query()
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents rejected by the frequency cap or as near duplicates of accepted ones, in order of doc_id."""
    docs = Tables(spark, sf_dir).documents
    target = F.element_at(F.split("text", "\n"), 1)
    return curate.near_duplicate_fold(docs.select(F.col("doc_id").alias("id"), target.alias("target"), F.col("text").alias("combined")))


@query("""
    SELECT doc_id, ('0x' || substr(sha256(source || ':' || doc_id), 1, 8))::BIGINT % 10 = 0 AS in_eval, ('0x' || substr(sha256(doc_id::VARCHAR), 1, 4))::BIGINT % 5 = 0 AS in_fifth,
      ('0x' || substr(sha256('7:' || doc_id), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616 < 0.1 AS in_tenth, ('0x' || substr(sha256(doc_id::VARCHAR), 57, 8))::BIGINT % 2147483648 + 5 AS seed
    FROM documents""")
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic splits and a base seed."""
    key = F.col("doc_id").cast("string")
    return Tables(spark, sf_dir).documents.select(
        "doc_id", H.in_modulus_split(F.concat_ws(":", "source", key)).alias("in_eval"), H.in_modulus_split(key, 5, 4).alias("in_fifth"),
        H.in_fraction_split(F.concat(F.lit("7:"), key), 0.1).alias("in_tenth"), H.base_seed(key, 5).alias("seed"),
    )


@query("""
    WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS r, count(*) OVER (PARTITION BY source) AS n FROM documents),
    h AS (SELECT *, CASE WHEN n <= 1 THEN 0 ELSE greatest(1, round_even(n * (1.0::DOUBLE / 3), 0))::BIGINT END AS h FROM r)
    SELECT doc_id, source, list_contains(list_transform(range(h), lambda j: (j * n) // h), r) AS held_out FROM h""")
def stratified_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of each source at evenly spaced places."""
    return select.spaced_holdout(Tables(spark, sf_dir).documents.select("doc_id", "source"), "source", [F.col("doc_id")])


@query("SELECT source, doc_id, n_chars, place FROM (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS place FROM documents) WHERE place <= 3")
def topk_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.top_k(Tables(spark, sf_dir).documents.select("source", "doc_id", "n_chars"), ["source"], [F.desc("n_chars"), F.col("doc_id")], 3)


_QUOTA = """
    WITH g AS (SELECT source, count(*) AS size FROM documents GROUP BY source), e AS (SELECT *, 100.0::DOUBLE * size / sum(size) OVER () AS x FROM g),
    b AS (SELECT *, least(size, floor(x)::BIGINT) AS base FROM e), l AS (SELECT *, 100 - sum(base) OVER () AS open_left, base < size AS open FROM b),
    q AS (SELECT source, size, base + CASE WHEN open AND row_number() OVER (PARTITION BY open ORDER BY x - floor(x) DESC, source DESC) <= open_left THEN 1 ELSE 0 END AS quota FROM l)"""


@query(_QUOTA + " SELECT source, size, quota::BIGINT AS quota FROM q")
def largest_remainder_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """100 places dealt to sources in proportion to their documents."""
    sizes = Tables(spark, sf_dir).documents.groupBy("source").agg(F.count(F.lit(1)).alias("size"))
    return select.largest_remainder(sizes, "source", "size", 100)


@query(_QUOTA + """
    , r AS (SELECT doc_id, d.source, n_chars, row_number() OVER (PARTITION BY d.source ORDER BY n_chars DESC, doc_id) <= quota AS by_quota FROM documents d JOIN q USING (source))
    SELECT doc_id, source, n_chars, by_quota FROM r ORDER BY by_quota DESC, n_chars DESC, doc_id LIMIT 100""")
def quota_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest documents under the quotas, filled up by length."""
    docs = Tables(spark, sf_dir).documents.select("doc_id", "source", "n_chars")
    return select.quota_sample(docs, "source", "doc_id", [F.desc("n_chars"), F.col("doc_id")], 100)


_ROBIN = "SELECT doc_id, lang, turn_no FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('3:' || doc_id), doc_id) AS turn_no FROM documents) WHERE turn_no <= {cap} ORDER BY turn_no, lang LIMIT 50"


@query(_ROBIN.format(cap=50))
def round_robin_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = Tables(spark, sf_dir).documents.select("doc_id", "lang")
    return select.round_robin(docs, "lang", [H.sample_order(F.col("doc_id"), 3), F.col("doc_id")], 50)


@query(_ROBIN.format(cap=5))
def capped_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most a tenth of the sample from one language: it may come out smaller."""
    docs = Tables(spark, sf_dir).documents.select("doc_id", "lang")
    return select.round_robin(docs, "lang", [H.sample_order(F.col("doc_id"), 3), F.col("doc_id")], 50, 5)


@query("""
    WITH r AS (SELECT source, quality = 1 AS win, n_chars, doc_id, row_number() OVER (PARTITION BY source, quality = 1 ORDER BY n_chars, doc_id) AS k FROM documents JOIN labels USING (doc_id))
    SELECT a.source, a.k, a.doc_id AS win_id, a.n_chars AS win_len, b.doc_id AS lose_id, b.n_chars AS lose_len FROM r a JOIN r b ON a.source = b.source AND a.k = b.k AND a.win AND NOT b.win""")
def rank_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The k-th shortest good document of a source with its k-th shortest other one."""
    out = align.rank_pairs(labelled(spark, sf_dir), ["source"], F.col("quality") == 1, "n_chars", "doc_id")
    return out.select("source", F.col("k").cast("long").alias("k"), "win_id", "win_len", "lose_id", "lose_len")


@query("""
    WITH r AS (SELECT source, doc_id AS id, c, row_number() OVER (PARTITION BY source, c ORDER BY doc_id) AS k FROM (
      SELECT source, doc_id, CASE WHEN quality = 1 THEN 'correct' WHEN toxic = 1 THEN 'cap' ELSE 'wrong' END AS c FROM documents JOIN labels USING (doc_id))),
    n AS (SELECT source, count_if(c = 'correct')::BIGINT AS x, count_if(c = 'cap')::BIGINT AS y, count_if(c = 'wrong')::BIGINT AS z FROM r GROUP BY source),
    p0 AS (SELECT *, least(x, y) AS a FROM n), p1 AS (SELECT *, least(x - a, z) AS b FROM p0), p2 AS (SELECT *, least(y - a, z - b) AS c FROM p1),
    plan AS (
      SELECT source, 0 AS kind, 'correct' AS l, 'cap' AS m, 0 AS fl, 0 AS fm, a AS pairs FROM p2 UNION ALL SELECT source, 1, 'correct', 'wrong', a, 0, b FROM p2
      UNION ALL SELECT source, 2, 'cap', 'wrong', a, b, c FROM p2 UNION ALL SELECT source, 3, 'correct', 'correct', a + b, a + b, (x - a - b) // 2 FROM p2
      UNION ALL SELECT source, 4, 'cap', 'cap', a + c, a + c, (y - a - c) // 2 FROM p2 UNION ALL SELECT source, 5, 'wrong', 'wrong', b + c, b + c, (z - b - c) // 2 FROM p2),
    rows AS (SELECT *, unnest(range(pairs)) AS i FROM plan WHERE pairs > 0)
    SELECT rows.source, kind, l AS left_class, m AS right_class, u.id AS left_id, v.id AS right_id FROM rows
      JOIN r u ON u.source = rows.source AND u.c = l AND u.k = fl + CASE WHEN l = m THEN 2 * i + 1 ELSE i + 1 END
      JOIN r v ON v.source = rows.source AND v.c = m AND v.k = fm + CASE WHEN l = m THEN 2 * i + 2 ELSE i + 1 END""")
def contrast_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs inside each source: good, toxic and other documents, unlike ones first."""
    rows = labelled(spark, sf_dir).withColumn("outcome", align.outcome(F.col("quality") == 1, F.col("toxic") == 1))
    return align.contrast_pairs(rows, ["source"], "outcome", "doc_id")


@query("""
    SELECT count(*) AS n, round(avg((quality = toxic)::INT), 9) AS agreement, count(*) FILTER (quality = 1 AND toxic = 0) AS lost, count(*) FILTER (quality = 0 AND toxic = 1) AS gained FROM labels""")
def paired_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of two verdicts on the same documents."""
    rows = Tables(spark, sf_dir).labels
    side = lambda c: rows.select("doc_id", (F.col(c) == 1).alias("v"))
    return align.agreement(side("quality"), side("toxic"), ["doc_id"], "v").withColumn("agreement", F.round("agreement", 9))


@query(rf"""
    WITH w AS (SELECT lang = 'en' AS side, list_filter(regexp_split_to_array(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), ' '), lambda x: x <> '') AS w FROM documents),
    g AS (SELECT side, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM (SELECT side, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, (VALUES (1), (2), (3)) s(n))),
    c AS (SELECT n, g, count(*) FILTER (side) AS a, count(*) FILTER (NOT side) AS b FROM g GROUP BY n, g), t AS (SELECT n, sum(a) AS ta, sum(b) AS tb FROM c GROUP BY n)
    SELECT n, round(sqrt(sum((a / ta - b / tb) ** 2)), 9) AS l2 FROM c JOIN t USING (n) GROUP BY n""")
def ngram_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of word n-gram distributions between English and the other documents."""
    return stats.ngram_l2(Tables(spark, sf_dir).documents, "text", F.col("lang") == "en").select("n", F.round("l2", 9).alias("l2"))


@query("""
    SELECT source, count(quality) AS n, coalesce(sum(quality), 0)::BIGINT AS correct, round(avg(quality), 9) AS accuracy FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def candidate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources with their labels; a source without any keeps its row."""
    t = Tables(spark, sf_dir)
    rows = t.documents.select("doc_id", "source").join(t.labels, "doc_id", "left")
    return rows.groupBy("source").agg(F.count("quality").alias("n"), F.coalesce(F.sum("quality"), F.lit(0)).alias("correct"), F.round(F.avg("quality"), 9).alias("accuracy"))


@query("""
    SELECT source, count(*) FILTER (quality = 1 AND toxic = 0) AS good_clean, count(*) FILTER (quality = 1 AND toxic = 1) AS good_toxic, count(*) FILTER (quality = 0 AND toxic = 0) AS bad_clean, count(*) FILTER (quality = 0 AND toxic = 1) AS bad_toxic
    FROM documents JOIN labels USING (doc_id) GROUP BY source""")
def confusion_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, t = F.col("quality") == 1, F.col("toxic") == 1
    return labelled(spark, sf_dir).groupBy("source").agg(F.count_if(q & ~t).alias("good_clean"), F.count_if(q & t).alias("good_toxic"), F.count_if(~q & ~t).alias("bad_clean"), F.count_if(~q & t).alias("bad_toxic"))


@query(r"""
    SELECT source, count(*) AS n, round(1 - count(DISTINCT k) / count(*), 9) AS duplicate_rate FROM (SELECT source, sha256(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS k FROM documents) GROUP BY source""")
def duplicate_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Tables(spark, sf_dir).documents.select("source", F.sha2(X.normalise(F.col("text")), 256).alias("k"))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(1 - F.count_distinct("k") / F.count(F.lit(1)), 9).alias("duplicate_rate"))


@query("""
    SELECT source, lang, count(*) AS n, sum(quality)::BIGINT AS correct FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (source, lang)""")
def per_prompt_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detail, subtotals and the total in one pass."""
    return labelled(spark, sf_dir).rollup("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.sum("quality").cast("long").alias("correct"))


@query(r"""
    WITH d AS (SELECT DISTINCT doc_id, w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4] || ' ' || w[i+5] || ' ' || w[i+6] || ' ' || w[i+7] AS g FROM (
           SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents))),
    b AS (SELECT DISTINCT item_id, w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4] || ' ' || w[i+5] || ' ' || w[i+6] || ' ' || w[i+7] AS g FROM (
           SELECT item_id, w, unnest(range(1, len(w) - 6)) AS i FROM (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM benchmark)))
    SELECT doc_id, item_id, count(*) AS shared FROM d JOIN b USING (g) GROUP BY doc_id, item_id""")
def contamination_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight-word passages that documents share with benchmark items."""
    t = Tables(spark, sf_dir)
    grams = lambda df, id_: df.select(id_, F.explode(F.array_distinct(X.ngrams(X.split_words(F.lower("text")), 8))).alias("g"))
    return grams(t.documents, "doc_id").join(grams(t.benchmark, "item_id"), "g").groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("shared"))


@query(rf"""
    WITH s AS (SELECT doc_id, len({_WORDS}) AS n, regexp_matches(text, '[^\x00-\x7F]') AS odd FROM documents), o AS (SELECT list(n ORDER BY n) AS l, avg(n) AS m, avg(odd::INT) AS r FROM s)
    SELECT len(l) AS count, round(m, 6) AS mean_words, l[least(len(l), floor(len(l) * 0.95)::BIGINT + 1)] AS p95_words, round(r, 9) AS non_ascii_rate FROM o""")
def lexical_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean length, the 95th percentile as an element of the sorted lengths, share of texts with non-ASCII characters."""
    rows = Tables(spark, sf_dir).documents.select(F.size(X.split_words(F.col("text"))).alias("n"), F.col("text").rlike(r"[^\x00-\x7F]").alias("odd"))
    # lengths are counted, so the percentile walks distinct lengths instead of rows
    by = rows.groupBy("n").agg(F.count(F.lit(1)).alias("m"), F.count_if("odd").alias("odd"))
    w = Window.orderBy("n")
    upto = by.withColumn("upto", F.sum("m").over(w)).withColumn("all", F.sum("m").over(Window.partitionBy()))
    place = F.least(F.col("all"), F.floor(F.col("all") * 0.95) + 1)
    return upto.agg(F.max("all").alias("count"), F.round(F.sum(F.col("n") * F.col("m")) / F.max("all"), 6).alias("mean_words"), F.min(F.when(F.col("upto") >= place, F.col("n"))).alias("p95_words"),
                    F.round(F.sum("odd") / F.max("all"), 9).alias("non_ascii_rate"))


@query(r"""
    SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '(?i)<a\b')) AS n_links, len(regexp_extract_all(html, '(?i)<p\b')) AS n_paragraphs,
      regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host FROM pages""")
def page_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, host, links and paragraphs of raw pages."""
    return Tables(spark, sf_dir).pages.select(
        "page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_count("html", F.lit(r"(?i)<a\b")).alias("n_links"),
        F.regexp_count("html", F.lit(r"(?i)<p\b")).alias("n_paragraphs"), F.regexp_extract("url", "^https?://([^/:?#]+)", 1).alias("host"),
    )


@query(r"""
    SELECT doc_id, len(regexp_extract_all(text, '(?i)\bwait\b')) AS waits, len(regexp_extract_all(text, '(?i)\bthe\b')) AS articles, len(regexp_extract_all(text, '[?]')) AS questions,
      regexp_extract(text, '(-?\d+(?:\.\d+)?)', 1) AS first_number, regexp_matches(text, '(?i)(^|[^a-zA-Z])(de|la|le)([^a-zA-Z]|$)') AS romance FROM documents""")
def marker_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda p: F.regexp_count("text", F.lit(p)).cast("long")
    return Tables(spark, sf_dir).documents.select(
        "doc_id", count(r"(?i)\bwait\b").alias("waits"), count(r"(?i)\bthe\b").alias("articles"), count("[?]").alias("questions"),
        F.regexp_extract("text", r"(-?\d+(?:\.\d+)?)", 1).alias("first_number"), F.col("text").rlike(r"(?i)(^|[^a-zA-Z])(de|la|le)([^a-zA-Z]|$)").alias("romance"),
    )


@query(rf"""
    WITH d AS (SELECT doc_id, text, trim(string_split(text, '</think>')[-1]) AS shown, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS folded FROM documents),
    f AS (
      SELECT doc_id, text, regexp_replace(regexp_replace(text, '(?i)(?:https?://|www\.)\S+', '[URL]', 'g'), '{_KINDS["email"]}', '[EMAIL]', 'g') AS r,
        trim(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '(?is)<think>.*?</think>', '', 'g'), '(?i)^\s*(?:assistant|owner|taylor|business representative)\s*:\s*', ''), '\s+', ' ', 'g')) AS target,
        CASE WHEN regexp_matches(rtrim(text), '[.!?]["'')\]]*\n?$') THEN rtrim(text) WHEN length(regexp_extract(text, '(?s)^(.*[.!?]["'')\]]*)', 1)) >= 200 THEN regexp_extract(text, '(?s)^(.*[.!?]["'')\]]*)', 1) END AS whole,
        CASE WHEN length(text) <= 1200 THEN text ELSE regexp_replace(substr(text, 1, 1200), '\s\S*\n?$', '') END AS excerpt,
        coalesce(regexp_extract_all(shown, '(?im)^\s*\**answer\**\s*:\s*(.+?)\s*$', 1)[-1], shown) AS visible,
        list_filter(string_split(folded, ' '), lambda x: x <> '') AS w,
        list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s FROM d),
    l AS (SELECT doc_id, list_filter([trim(x) FOR x IN string_split(CASE WHEN length(text) > 3000 THEN right(text, 3000) ELSE text END, chr(10))], lambda x: x <> '') AS ls FROM documents),
    c AS (SELECT doc_id, max(k) AS most FROM (SELECT doc_id, x, count(*) AS k FROM (SELECT doc_id, unnest(list_filter(ls, lambda x: length(x) < 80)) AS x FROM l) GROUP BY ALL) GROUP BY doc_id),
    o AS (SELECT *, [lower(regexp_extract(x, '([\p{{L}}\p{{N}}_'']+)', 1)) FOR x IN s] AS firsts FROM f)
    SELECT doc_id, substr(sha256({_bounded(_bounded("r", _KINDS["phone"], "[PHONE]"), _KINDS["zip"], "[ZIP]")}), 1, 16) AS redacted, substr(sha256(target), 1, 16) AS target,
      substr(sha256(whole), 1, 16) AS whole_sentences, substr(sha256(excerpt), 1, 16) AS excerpt, substr(sha256(visible), 1, 16) AS visible,
      len(w) >= 4 AND len(list_filter(range(1, len(w) - 1), lambda i: w[i] = w[i + 1] AND w[i] = w[i + 2])) > 0 AS triple, len(ls) >= 8 AND coalesce(most, 0) >= 6 AS looped,
      len(list_filter(range(1, len(firsts) - 1), lambda i: firsts[i] <> '' AND firsts[i] = firsts[i + 1] AND firsts[i] = firsts[i + 2])) > 0 AS openings
    FROM o JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)""")
def text_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redacted, cleaned and cut forms of each document, by digest."""
    t = F.col("text")
    forms = {"redacted": X.redact(t), "target": X.clean_target(t), "whole_sentences": X.truncate_to_last_sentence(t), "excerpt": X.excerpt(t), "visible": X.answer_text(t)}
    return Tables(spark, sf_dir).documents.select("doc_id", *(F.substring(F.sha2(v, 256), 1, 16).alias(k) for k, v in forms.items()), X.has_triple_word(t).alias("triple"), X.looped_tail(t).alias("looped"), X.repeats_openings(t).alias("openings"))


@query("""
    WITH v AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}'']+')) AS word FROM documents) GROUP BY word) SELECT word, n FROM v WHERE n >= 20""")
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that occur twenty times or more."""
    words = Tables(spark, sf_dir).documents.select(F.explode(X.tokens(F.lower("text"), r"[\p{L}\p{N}']+")).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter("n >= 20")


@query()
def softmax_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bag-of-words classifier of the source language, fitted on four fifths and applied to the rest."""
    docs = Tables(spark, sf_dir).documents.filter("lang IS NOT NULL AND text IS NOT NULL").withColumn("held", H.in_modulus_split(F.col("doc_id").cast("string"), 5))
    model = stats.softmax_model(docs.filter("NOT held"), "text", "lang")
    names = F.array(*map(F.lit, model.stages[0].labels))
    return model.transform(docs.filter("held")).select("doc_id", "lang", F.element_at(names, F.col("prediction").cast("int") + 1).alias("predicted"))


@query()
def logistic_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality against length in steps of 500 characters: a logistic curve for each language."""
    return stats.depth_logistic(labelled(spark, sf_dir), "lang", F.floor(F.col("n_chars") / 500), F.col("quality") == 1)


@query("""
    WITH c AS (SELECT lang AS grp, floor(n_chars / 500) AS x, count(*) AS n, sum(quality) AS c FROM documents JOIN labels USING (doc_id) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER w AS i, sum(n) OVER w AS sn, sum(c) OVER w AS sc FROM c WINDOW w AS (PARTITION BY grp ORDER BY x)),
    m AS (SELECT a.grp, a.i AS j, b.i AS k, (b.sc - a.sc + a.c) / (b.sn - a.sn + a.n) AS mean FROM r a JOIN r b ON a.grp = b.grp AND b.i >= a.i),
    h AS (SELECT r.grp, r.i, j, max(mean) AS high FROM r JOIN m ON r.grp = m.grp AND j <= r.i AND k >= r.i GROUP BY ALL)
    SELECT r.grp, x, n, round(c / n, 9) AS rate, round(min(high), 9) AS fitted FROM r JOIN h USING (grp, i) GROUP BY r.grp, x, n, c""")
def isotonic_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of good documents by length, and the nearest ones that fall."""
    out = stats.isotonic_decreasing(labelled(spark, sf_dir), "lang", F.floor(F.col("n_chars") / 500), F.col("quality") == 1)
    return out.withColumns({c: F.round(c, 9) for c in ("rate", "fitted")})


@query()
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.bootstrap_summary(stats.bootstrap(labelled(spark, sf_dir), F.floor(F.col("n_chars") / 500), F.col("quality") == 0))


@query("""
    WITH RECURSIVE p AS (SELECT doc_id, lang, source, 1 / (1 + exp(-(ln(n_chars + 1.0::DOUBLE) - 7.3))) AS p FROM documents),
    s AS (SELECT doc_id, lang, source, round(4 * p * (1 - p), 9) AS boundary, row_number() OVER (ORDER BY round(4 * p * (1 - p), 9) DESC, doc_id) AS i, count(*) OVER () AS n FROM p),
    walk AS (
      SELECT 0::BIGINT AS i, []::BIGINT[] AS ids, []::VARCHAR[] AS sources, []::VARCHAR[] AS langs
      UNION ALL SELECT i, CASE WHEN fits THEN list_append(ids, doc_id) ELSE ids END, CASE WHEN fits THEN list_append(sources, source) ELSE sources END, CASE WHEN fits THEN list_append(langs, lang) ELSE langs END FROM (
        SELECT walk.i + 1 AS i, doc_id, source, lang, ids, sources, langs, len(ids) < 40 AND len(list_filter(sources, lambda x: x = s.source)) < 4 AND NOT list_contains(ids, doc_id)
          AND (walk.i >= n OR len(list_filter(langs, lambda x: x = s.lang)) < 14) AS fits FROM walk JOIN s ON s.i = walk.i % n + 1 WHERE walk.i < 2 * n)),
    picked AS (SELECT unnest(ids) AS doc_id, unnest(range(1, len(ids) + 1)) AS pick_no FROM walk WHERE i = (SELECT max(i) FROM walk))
    SELECT doc_id, lang, source, boundary, pick_no FROM s JOIN picked USING (doc_id)""")
def frontier_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty documents of middling length under caps for language and source."""
    p = N.sigmoid(F.ln(F.col("n_chars") + 1.0) - 7.3)
    rows = Tables(spark, sf_dir).documents.select("doc_id", "lang", "source", F.round(4 * p * (1 - p), 9).alias("boundary"))
    return select.two_cap_selection(rows, 40, "source", "lang", "boundary", "doc_id")


@query("""
    SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source, sha256(text) ORDER BY doc_id) AS r FROM documents) WHERE r = 1""")
def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each text in a source."""
    rows = Tables(spark, sf_dir).documents.select("source", "doc_id", F.sha2("text", 256).alias("k"))
    return first_per_key(rows, ["source", "k"], [F.col("doc_id")]).select("source", "doc_id")
