"""Every reference query against its SQL on the smallest tables."""

import math
from decimal import Decimal

import duckdb
import pytest

from factloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return f"decimal {v}" if isinstance(v, Decimal) else repr(v)


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in rows])


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, sf, name):
    df = registry.QUERIES[name](spark, sf)
    assert name in registry.ORACLE_SQL
    expected = db.sql(registry.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(expected.columns)
    assert sorted_rows(df.columns, df.collect()) == sorted_rows(expected.columns, expected.fetchall())


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["provision_id", "capacity"] and df.count() > 0
