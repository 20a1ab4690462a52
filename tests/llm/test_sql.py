"""The queries whose rows SQL can give."""

from collections import Counter

import duckdb
import pytest

from gridloom.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_the_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    found, want = queries.queries()[name](spark, FOLDER), con.sql(queries.oracle_sql()[name])
    columns = sorted(found.columns)
    assert columns == sorted(want.columns)
    plain = lambda r: tuple(f"{v:.9g}" if isinstance(v, float) else v for v in r)
    at = [want.columns.index(c) for c in columns]
    assert Counter(plain(r) for r in found.select(*columns).collect()) == Counter(plain(r[i] for i in at) for r in want.fetchall())
