"""Every query with SQL gives what DuckDB gives, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from tidewatch import oracles
from tidewatch.queries import queries

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return float(f"{value:.9g}")
    return value


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query(spark, duck, sf_dir, name):
    df = queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    want = duck.sql(oracles.oracle_sql()[name])
    assert sorted(want.columns) == columns
    places = [want.columns.index(c) for c in columns]
    assert got == sorted(repr([plain(r[i]) for i in places]) for r in want.fetchall())


def test_flagship_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1


def test_oracles_belong_to_queries():
    assert set(oracles.oracle_sql()) <= set(queries())
