"""Every query of the text problems on odd and on empty tables."""

import os

import pytest

from terrasift.llm import queries
from tests.tables import DATA, odd_tables

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_odd(spark, tmp_path, name):
    (tmp_path / "odd").mkdir()
    (tmp_path / "none").mkdir()
    df = queries.QUERIES[name](spark, odd_tables(str(tmp_path / "odd"), 200))
    rows = df.collect()
    assert rows or name in ("p8_found", "p9_found")
    none = queries.QUERIES[name](spark, odd_tables(str(tmp_path / "none"), None))
    assert none.columns == df.columns and none.count() == (name == "p8_use")
