"""The driver's contract on the smallest tables, and every SQL against its query."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from terrasift.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def same(v):
    import decimal

    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 5)
    return tuple(map(same, v)) if isinstance(v, (list, tuple)) else v


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    df = catalog.queries()[name](spark, DATA)
    cur = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(str([same(r[names.index(c)]) for c in sorted(names)]) for r in cur.fetchall())
    got = sorted(str([same(r[c]) for c in sorted(names)]) for r in df.collect())
    assert got == want
