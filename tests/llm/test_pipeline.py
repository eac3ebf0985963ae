"""Stages of the pipeline, each against a brute-force version of its decision."""

import re
from collections import Counter

import corpus_pipeline
from brightfield.llm import common, jaccard, mixing
from pyspark.sql import functions as F


def test_stages(spark, docs):
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars")
    named = dict(corpus_pipeline.STAGES)
    told = named["language_id"](spark, rows, "").cache()
    letters = {r.doc_id for r in rows.collect() if r.text and any(c.isalpha() for c in r.text)}
    assert {r.doc_id for r in told.collect()} <= letters and told.columns == rows.columns and told.count() > 0.8 * len(letters)

    single = named["exact_dedup"](spark, told, "").cache()
    groups = {}
    for r in told.collect():
        k = re.sub(r"[\x20\x09-\x0D]+", " ", r.text)
        groups[k] = min(groups.get(k, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in single.collect()) == sorted(groups.values())

    apart = named["ngram_jaccard"](spark, single, "").cache()
    component = {r.doc_id: r.component_id for r in jaccard.jaccard_components(single).collect()}
    assert sorted(r.doc_id for r in apart.collect()) == sorted({*component.values()}) and apart.count() < single.count()

    mixed = named["mix_sources"](spark, apart, "").cache()
    copies = {r.doc_id: r.copies for r in mixing.mix_sources(apart).collect() if r.copies}
    assert Counter(r.doc_id for r in mixed.collect()) == Counter(copies) and mixed.columns == rows.columns

    packed = named["best_fit_packing"](spark, mixed, "").collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(copies)


def test_repeated_and_null_rows(spark, odd, empty):
    rows = odd.select("doc_id", "text", "lang", "source", "n_chars")
    left = corpus_pipeline.exact_dedup(spark, rows, "").collect()
    assert sorted((str(r.doc_id), (r.text or "")[:5]) for r in left) == [("5", "one t"), ("6", "other"), ("None", ""), ("None", "one t")]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty.select("doc_id", "text", "lang", "source", "n_chars"), "").collect() == []


CLASHES = ["gone_id", "kept_id", "Near_Word", "near_bits", "near_place", "mix_id", "mix_copies", "mix_copy", "language_found", "kept_sha", "text_sha", "rows", "kept", "key", "second", "n", "rep", "size", "copies", "label", "leaf"]


def test_clashing_names(spark, docs):
    """Columns named like any that the stages use inside come through as they are."""
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars")
    wide = rows.select("*", *(F.concat(F.lit(f"{c} "), F.col("doc_id")).alias(c) for c in CLASHES))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain, found = stage(spark, rows, ""), stage(spark, wide, "")
        assert found.columns == wide.columns, name
        got = found.collect()
        assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in plain.collect()), name
        assert all(r[c] == f"{c} {r.doc_id}" for r in got for c in CLASHES), name
    assert corpus_pipeline.best_fit_packing(spark, wide, "").count() >= rows.count()


def test_run_deletes_what_it_no_longer_needs(spark, tmp_path, docs):
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    before = set(common._written.paths)
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert packed.count() > 0 and set(common._written.paths) - before == {packed._cut_path}
