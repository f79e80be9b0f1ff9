"""The SQL of the subpackage against its queries on the smallest tables."""

import os

import duckdb
import pytest

from terrasift.llm import queries
from tests.test_entry import DATA, same

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    df = queries.QUERIES[name](spark, DATA)
    cur = con.execute(queries.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(str([same(r[names.index(c)]) for c in sorted(names)]) for r in cur.fetchall())
    assert sorted(str([same(r[c]) for c in sorted(names)]) for r in df.collect()) == want and want
