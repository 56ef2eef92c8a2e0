"""Every registered query with a SQL twin gives the same rows in DuckDB."""

from __future__ import annotations

import duckdb
import pytest
from conftest import SF

import __spark_entry__ as entry
from medialake.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def text(v):
    if v is None:
        return "~"
    return str(v).lower() if isinstance(v, bool) else repr(round(v, 6)) if isinstance(v, float) else str(v)


def canon(rows, cols):
    at = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(text(r[i]) for i in at) for r in rows)


def test_every_query_has_a_twin():
    assert set(SQL) == set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cur = duck.execute(SQL[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert canon(df.collect(), df.columns) == canon(cur.fetchall(), cols)
