"""The registered queries on the smallest tables: against DuckDB where there is SQL, by shape elsewhere."""

import duckdb
import pytest
from brightfield.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op2_best_fit_packing": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
    "op5_language_id": {"doc_id", "held_out", "lang_pred", "score"},
    "op7_mix_sources": {"doc_id", "size", "source_size", "target", "taken"},
    "op8_html_text": {"page_id", "url", "text", "n_chars"},
    "pipeline": {"doc_id", "piece", "sequence_id", "offset", "length"},
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "pages", "conversations"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    want = duck.sql(queries.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    place = [want.columns.index(c) for c in df.columns]
    assert sorted(map(str, (tuple(r) for r in df.collect()))) == sorted(map(str, (tuple(r[i] for i in place) for r in want.fetchall())))


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_rows(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    assert COLUMNS[name] <= set(df.columns)
    table, key = ("pages", "page_id") if name.startswith("op8") else ("documents", "doc_id")
    ids = {r[0] for r in duck.sql(f"SELECT {key} FROM {table}").fetchall()}
    got = {r[0] for r in df.select(key).collect()}
    assert got <= ids and (name == "pipeline" or got == ids)
    if name == "op5_language_id":
        truth = dict(duck.sql("SELECT doc_id, lang FROM documents").fetchall())
        held = [r for r in df.collect() if r.held_out]
        assert sum(truth[r.doc_id] == r.lang_pred for r in held) >= 0.9 * len(held)
