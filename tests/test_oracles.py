"""Every query against its DuckDB twin at the smallest scale."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from glintframe.plans import all_queries

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    return value


def rows_of(names, rows):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(all_queries.SQL))
def test_same_rows_as_duckdb(spark, duck, name):
    df = all_queries.QUERIES[name](spark, str(DATA))
    got = duck.execute(all_queries.SQL[name])
    names = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, df.collect()) == rows_of(names, got.fetchall())


@pytest.mark.parametrize("name", sorted(set(all_queries.QUERIES) - set(all_queries.SQL)))
def test_runs_without_an_oracle(spark, name):
    assert all_queries.QUERIES[name](spark, str(DATA)).limit(5).count() >= 1
