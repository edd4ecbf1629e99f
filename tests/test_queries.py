"""Registered queries against their SQL on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

from tracewright.plans import registry

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(TABLES):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{TABLES}/{f}'")
    return c


def told(v):
    return repr(float(v)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_agrees_with_its_sql(spark, con, name):
    found = registry.queries()[name](spark, TABLES)
    rows = found.collect()
    sql = registry.oracle_sql().get(name)
    if not sql:
        return
    want = con.sql(sql)
    columns = sorted(found.columns)
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert Counter(tuple(told(r[c]) for c in columns) for r in rows) == Counter(tuple(told(r[i]) for i in at) for r in want.fetchall())
