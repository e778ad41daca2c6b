"""Every registered query against the comparison engine, on the same tables."""

from collections import Counter

import duckdb
import pytest
from conftest import SF_DIR

from __spark_entry__ import entry
from tidewatch.workload.registry import REGISTRY

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
QUERIES = {name: fn for name, (fn, _) in REGISTRY.items()}
SQL = {name: sql for name, (_, sql) in REGISTRY.items() if sql}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(None if r[i] is None else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    result = duck.execute(SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert _rows(df.columns, df.collect()) == _rows(columns, result.fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0


def test_evidence_cards_hold_no_planted_value(spark):
    cards = QUERIES["evidence_cards"](spark, SF_DIR)
    planted = ["2341 2341", "23412341", "DE1234F", "7654321", "0062821", "1२34567", "5678-9012", "5678-901२", "K1234567", "ABCDEFGHIJKLMNOP",
               "abcdefghijklmnopqrstuvwx", "MIIB", "hunter2", "9876543210"]
    text = cards.select("context_snippet_safe").toPandas()["context_snippet_safe"]
    assert len(text) > 100
    for value in planted:
        assert not text.str.contains(value, regex=False).any(), value
    assert text.str.contains('"masked_context":"', regex=False).all()
