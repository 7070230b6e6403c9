"""Every catalog query against DuckDB running the same relation."""

from __future__ import annotations

import os

import duckdb
import pytest

from catalith import registry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF_DIR}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return repr(round(value, 6))
    return "null" if value is None else str(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return [columns[i] for i in order], sorted(tuple(plain(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_agrees_with_oracle(spark, duck, name):
    df, rel = registry.queries()[name](spark, SF_DIR), duck.sql(registry.oracle_sql()[name])
    assert table(df.columns, df.collect()) == table(rel.columns, rel.fetchall())
