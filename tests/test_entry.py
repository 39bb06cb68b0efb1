"""Registered queries against their SQL, on the smallest tables."""

import sys

import duckdb
import pytest

sys.path.insert(0, __file__.rsplit("/", 2)[0])

import __spark_entry__ as entry_module
from lumenfold.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def ordered(rows):
    return sorted(rows, key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, duck, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    want = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert ordered(tuple(r) for r in df.select(*columns).collect()) == ordered(tuple(r[i] for i in at) for r in want.fetchall())


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def test_names():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
