"""Containers hold what they may, items stay whole, and little space is lost."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terrasift.llm.packing import fill, pack


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=200))
def test_fill(sizes):
    sizes = np.array(sizes, np.int64)
    box = fill(sizes, 60)
    assert (box >= 0).all()
    if len(sizes):
        loads = np.bincount(box, sizes)
        assert loads.max() <= 60 and loads.min() > 0
        assert len(loads) <= 1.7 * sizes.sum() / 60 + 6


def test_use():
    sizes = np.clip(np.random.default_rng(1).lognormal(6.4, 0.8, 20_000).astype(np.int64), 1, 4096)
    loads = np.bincount(fill(sizes, 4096), sizes)
    assert sizes.sum() / (len(loads) * 4096) > 0.97


def test_rows(spark):
    sizes = [(1, 10), (2, None), (3, 0), (4, 25), (5, 100), (5, 100), (6, 7), (7, 50)]
    out = pack(spark.createDataFrame(sizes, "k int, n int"), F.col("k"), F.col("n"), 50).collect()
    total = {}
    for r in out:
        total[r.key] = total.get(r.key, 0) + r.n
    assert total == {1: 10, 2: 0, 3: 0, 4: 25, 5: 200, 6: 7, 7: 50}
    assert all((r.container is None) == (r.n == 0) for r in out)
    loads = {}
    for r in out:
        if r.n:
            loads[r.container] = loads.get(r.container, 0) + r.n
    assert max(loads.values()) <= 50
    assert {r.key for r in out if r.part > 0} == {5}
    assert pack(spark.createDataFrame([], "k int, n int"), F.col("k"), F.col("n"), 50).count() == 0
