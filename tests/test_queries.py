"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import math
import os
import re

import duckdb
import pytest
from brightfield.plans import registry

SF = "/root/testdata/sf0.001"
SLOW = {"near_duplicates", "batch_packing", "softmax_languages"}


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if hasattr(v, "as_tuple"):
        return f"{float(v):.9g}"
    if isinstance(v, int) and not isinstance(v, bool):
        return f"{float(v):.9g}"
    return str(v.replace(tzinfo=None)) if hasattr(v, "tzinfo") else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.sql(registry.ORACLES[name])
    assert columns == sorted(want.columns)
    place = [want.columns.index(c) for c in columns]
    assert sorted(tuple(cell(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(cell(r[i]) for i in place) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    df = registry.QUERIES[name](spark, SF)
    assert df.columns and df.collect() is not None


def test_near_duplicates_one_by_one(spark, duck):
    """The registered query against the rule said row by row."""
    rows = duck.sql("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()
    norm = lambda t: " ".join(t.lower().split())
    counts, buckets, want = {}, {}, {}
    for i, text in rows:
        key, c = norm(text.split("\n")[0]), norm(text)
        sketch = {c[k : k + 5] for k in range(len(c) - 4)}
        near = buckets.setdefault((len(sketch) // 20, key[:12]), [])
        if counts.get(key, 0) >= 8:
            want[i] = "target_frequency_cap"
        elif any((len(sketch & o) / len(sketch | o) if sketch | o else 1) >= 0.9 for o in near):
            want[i] = "near_duplicate"
        else:
            want[i] = None
            near.append(sketch)
            counts[key] = counts.get(key, 0) + 1
    assert {r.id: r.reason for r in registry.QUERIES["near_duplicates"](spark, SF).collect()} == want
    assert "near_duplicate" in want.values()


def test_document_chunks_one_by_one(spark, duck):
    want = []
    for i, text in duck.sql("SELECT doc_id, text FROM documents").fetchall():
        done, held = [], ""
        for x in re.split(r"(?<=[.!?])\s+", text):
            if held and len(held) + len(x) > 200:
                done, held = [*done, held.strip(" ")], x
            else:
                held = f"{held} {x}" if held else x
        want += [(i, k, c) for k, c in enumerate([*done, *([held.strip(" ")] if held.strip(" ") else [])])]
    got = registry.QUERIES["document_chunks"](spark, SF).select("doc_id", "index", "text").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def against_sql(spark, name, table, rows, folder):
    """A registered query on one small table (a DuckDB SELECT) against its SQL."""
    con = duckdb.connect()
    con.execute(f"CREATE TABLE {table} AS {rows}")
    con.execute(f"COPY {table} TO '{folder}/{table}.parquet'")
    df = registry.QUERIES[name](spark, str(folder))
    columns = ", ".join(df.columns)
    want = con.execute(f"SELECT {columns} FROM ({registry.ORACLES[name]})").fetchall()
    assert want and sorted(tuple(map(cell, r)) for r in df.collect()) == sorted(tuple(map(cell, r)) for r in want)


def test_arm_ranks_at_the_edge_of_a_pass(spark, tmp_path):
    """A time counts as its nearest second, so the last half second of ten days belongs to the next pass."""
    rows = """SELECT i::BIGINT AS event_id, make_timestamp((s * 1000000)::BIGINT) AS ts, u::BIGINT AS user_id, e AS event_type FROM (VALUES
        (1, 863999.6::DOUBLE, 1, 'a'), (2, 864000.0, 1, 'b'), (3, 10.0, 1, 'b'), (4, 20.0, 1, 'c'), (5, 863999.5, 2, 'a'), (6, 864001.0, 2, 'b'), (7, 863998.5, 2, 'b'),
        (8, -864000.5, 4, 'a'), (9, -864100.0, 4, 'b'), (10, -10.3, 4, 'b'), (11, 3.0, 4, 'a')) t(i, s, u, e)"""
    against_sql(spark, "arm_ranks", "events", rows, tmp_path)


def test_reply_targets_at_the_cut(spark, tmp_path):
    """A line break as the 60th character is the white space to cut at; tags in capitals stay; a null reply does not count."""
    rows = """SELECT c::BIGINT AS conv_id, t::BIGINT AS turn, 'assistant' AS role, x AS text FROM (VALUES
        (1, 1, repeat('a', 30) || ' bcde' || chr(10) || 'f g h'), (2, 1, 'so <THINK>x</THINK> it' || chr(11) || ' is ' || chr(160)), (3, 1, 'first'), (3, 2, NULL),
        (4, 1, repeat('a', 30) || ' bcde' || chr(13) || 'f g h'), (5, 1, repeat('a', 30) || ' bcd' || chr(133) || ' f g')) t(c, t, x)"""
    against_sql(spark, "reply_targets", "conversations", rows, tmp_path)


def test_text_cleanup_odd_characters(spark, tmp_path):
    """White space, word boundaries, ends of lines and edges of numbers are those of the SQL."""
    rows = """SELECT i::BIGINT AS doc_id, x AS text FROM (VALUES (1, 'é' || 'a@b.com, jos' || 'é@b.com'), (2, 'a@b.co' || 'é'), (3, chr(160) || 'x' || chr(160)), (4, chr(11)), (5, NULL),
        (6, 'Yes!' || chr(13)), (7, repeat('word ', 240) || chr(10)), (8, repeat('a', 1190) || ' bcdefgh' || chr(10) || chr(10) || 'x'), (9, repeat('a', 1190) || ' bcdefgh' || chr(13) || chr(10) || 'x'),
        (10, 'the the ' || chr(11) || ' the end'), (11, 'We go.' || chr(11) || 'We see. We win. We.'), (12, 'Answer: a' || chr(13) || 'b' || chr(10)), (13, '555-123-4567 1 555-123-4567'),
        (14, '555-123-4567(555) 123-4567'), (15, 'see www.a' || chr(11) || 'b c'), (16, 'End?' || chr(10) || chr(160))) t(i, x)"""
    against_sql(spark, "text_cleanup", "documents", rows, tmp_path)
