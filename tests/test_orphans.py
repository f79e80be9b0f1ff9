"""Orphan references against a loop over rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from terrasift.operators.orphans import Reference, orphan_counts, orphans

T0 = datetime(2024, 1, 1)


def data(seed):
    rnd = random.Random(seed)
    day = lambda: T0 + timedelta(hours=rnd.randint(0, 24 * 90))
    targets = []
    for i in range(40):
        born = day()
        gone = born + timedelta(days=rnd.randint(0, 40)) if rnd.random() < 0.5 else None
        targets.append((f"t{i}", None if rnd.random() < 0.05 else born, gone))
    targets += [targets[0], (None, T0, T0), ("t0 ", T0, None), ("", T0, None)]
    refs = []
    for i in range(2500):
        key = "t7" if rnd.random() < 0.4 else "gone!" if rnd.random() < 0.1 else f"t{rnd.randint(0, 59)}"
        refs.append((i, rnd.choice([key] * 20 + [None, "", "t0 "]), None if rnd.random() < 0.01 else day()))
    return refs + refs[:30], targets


def brute(refs, targets):
    by = {}
    for k, b, g in targets:
        if k is not None:
            by.setdefault(k, []).append((b, g))
    out = []
    for i, k, t in refs:
        if not k:
            continue
        if k not in by:
            out.append((i, t, "missing"))
            continue
        born = min((b for b, _ in by[k] if b), default=None)
        gone = max(g for _, g in by[k]) if all(g for _, g in by[k]) else None
        if t and gone and t > gone:
            out.append((i, t, "deleted"))
        elif t and born and t < born:
            out.append((i, t, "late"))
    return out


def reference(spark, refs, targets):
    r = spark.createDataFrame(refs, "id long, ref string, at timestamp_ntz").withColumns({"born": F.lit("clash"), "k": F.lit(1)}).repartition(3)
    t = spark.createDataFrame(targets, "id string, b timestamp_ntz, g timestamp_ntz").withColumn("there", F.lit("clash"))
    return Reference("child", "ref", r, F.col("id"), F.col("ref"), F.col("at"), t, F.col("id"), F.col("b"), F.col("g"))


@pytest.mark.parametrize("parts", [1, 10, 1000])
def test_brute(spark, parts):
    refs, targets = data(parts)
    ref = reference(spark, refs, targets)
    want = brute(refs, targets)
    assert {(int(r.child_key), r.reason) for r in orphans(ref, parts).collect()} == {(i, w) for i, _, w in want}
    counts = {}
    for _, t, w in want:
        m = t and datetime(t.year, t.month, 1)
        counts[(m, w)] = counts.get((m, w), 0) + 1
    assert {(r.period, r.reason): r.n_references for r in orphan_counts(ref, parts=parts).collect()} == counts


def test_empty(spark):
    refs, targets = data(1)
    none = spark.createDataFrame([], "id long, ref string, at timestamp_ntz")
    ref = reference(spark, refs, targets)
    empty_refs = Reference(**{**ref.__dict__, "rows": none})
    assert orphans(empty_refs).count() == 0 and orphan_counts(empty_refs).count() == 0
    empty_targets = Reference(**{**ref.__dict__, "target": ref.target.limit(0)})
    assert {r.reason for r in orphans(empty_targets).collect()} == {"missing"}
