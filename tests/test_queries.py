"""Every warehouse query against its SQL on the smallest tables, when they are there."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__
from millrace.plans import registry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        if f.endswith(".parquet"):
            c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{FOLDER}/{f}'")
    return c


def plain(rows):
    return Counter(tuple(float(v) if isinstance(v, float) else v for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    want = con.sql(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, FOLDER)
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(map(tuple, got.select(*want.columns).collect())) == plain(want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 5
    assert set(registry.queries()) <= set(__spark_entry__.queries())
    assert set(registry.oracle_sql()) == set(registry.queries())
