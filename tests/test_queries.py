"""Every registered query of the relational part against its SQL in DuckDB."""

import math
import re
import sqlite3

import duckdb
import pytest

from weir.functions import search
from weir.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    rel = duck.sql(ORACLES[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=str)


def test_every_query_has_its_sql():
    assert set(QUERIES) - set(ORACLES) == {"search_stemmed"} and set(ORACLES) <= set(QUERIES)  # DuckDB has no stemmer without an extension


def test_search_stemmed_equals_a_full_text_index(spark, sf):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE d USING fts5(text, tokenize = 'porter unicode61')")
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    con.executemany("INSERT INTO d(rowid, text) VALUES (?, ?)", [tuple(r) for r in rows])
    want = sorted(x for (x,) in con.execute("SELECT rowid FROM d WHERE d MATCH 'licensed'"))
    assert sorted(r.doc_id for r in QUERIES["search_stemmed"](spark, sf).collect()) == want and want
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(d, instance)")
    words = sorted({w for r in rows for w in re.findall("[a-z]+", r.text.lower())} | set("caresses ponies ties agreed plastered motoring hopping falling fizzed filing happy sky rationalization adoption controlling probate rate cease hopefulness analogi eed".split()))
    con.execute("DELETE FROM d")
    con.executemany("INSERT INTO d(rowid, text) VALUES (?, ?)", list(enumerate(words)))
    stored = {i: t for t, i in con.execute("SELECT term, doc FROM v")}
    assert {w: search.stem(w) for w in words} == {w: stored[i] for i, w in enumerate(words)}
