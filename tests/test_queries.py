"""Every registered query with SQL against DuckDB, and all others by their own rules."""

from __future__ import annotations

import math

import __spark_entry__ as entry
import duckdb
import pytest
from warpline.plans import app_queries, kernel_queries

OWN = kernel_queries.QUERIES | app_queries.QUERIES
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return None if v is None else round(v, 9) + 0.0 if isinstance(v, float) and math.isfinite(v) else v


def ordered(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=lambda r: tuple((v is None, 0 if v is None else v) for v in r))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [k for k, (_, sql) in OWN.items() if sql is not None])
def test_query_equals_sql(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    want = duck.execute("SELECT " + ", ".join(f'"{c}"' for c in cols) + f" FROM ({entry.oracle_sql()[name]})").fetchall()
    assert ordered(df.select(*cols).collect()) == ordered(want)


@pytest.mark.parametrize("name", [k for k, (_, sql) in OWN.items() if sql is None])
def test_query_without_sql_is_stable(spark, sf, name):
    run = entry.queries()[name]
    first, second = (run(spark, sf).count() for _ in range(2))
    assert first == second > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["cid", "pos", "x"]
