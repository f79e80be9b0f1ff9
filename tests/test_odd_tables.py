"""Every query of the general problems on odd and on empty tables."""

import os

import pytest

from terrasift.plans import dealt
from tests.tables import DATA, odd_tables

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(dealt.QUERIES))
def test_odd(spark, tmp_path, name):
    (tmp_path / "odd").mkdir()
    (tmp_path / "none").mkdir()
    df = dealt.QUERIES[name](spark, odd_tables(str(tmp_path / "odd"), 40))
    rows = df.collect()
    assert len(rows) == len(set(map(str, rows))) and rows
    none = dealt.QUERIES[name](spark, odd_tables(str(tmp_path / "none"), None))
    assert none.columns == df.columns and none.count() == 0
