"""Every registered query that SQL can express gives the rows that DuckDB gives."""

import math
from collections import Counter

import duckdb
import pytest

from gridloom.plans import queries as plans

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v if isinstance(v, str | bool | None.__class__) else f"{v:.9g}" if isinstance(v, int | float) else str(v)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), Counter(tuple(plain(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_the_query_agrees_with_sql(spark, duck, name):
    found = plans.queries()[name](spark, FOLDER)
    want = duck.sql(plans.oracle_sql()[name])
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == rows(want.columns, want.fetchall())


def test_every_query_has_its_sql():
    assert set(plans.queries()) == set(plans.oracle_sql())
