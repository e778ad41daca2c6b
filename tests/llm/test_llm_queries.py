"""The registered queries: SQL where there is one, fixed shapes else."""

from collections import Counter

import duckdb
import pytest
from conftest import SF_DIR

from tidewatch.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    df = QUERIES[name](spark, SF_DIR)
    result = con.execute(SQL[name])
    columns = [d[0] for d in result.description]
    order = sorted(df.columns)
    assert order == sorted(columns)
    got = Counter(tuple(r[c] for c in order) for r in df.collect())
    assert got == Counter(tuple(r[columns.index(c)] for c in order) for r in result.fetchall())


def test_a_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_leaks_in_the_documents(spark):
    leaks = QUERIES["op2_string_tiling"](spark, SF_DIR).collect()
    assert leaks and all(r.coverage >= 0.6 for r in leaks)
