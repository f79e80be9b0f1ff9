"""The ledger against a brute-force replay of arrivals, in one and in many partitions."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from terrasift.operators.history import as_recorded, ledger, versions

T0 = datetime(2024, 1, 1)


def replay(rows):
    """Arrivals one by one; rows: (entity, valid, order, rec, a)."""
    held, out = {}, []
    for e, v, o, rec, a in sorted(set(rows), key=lambda r: r[3]):
        line = held.setdefault(e, [])
        line.append((v, o, rec, a))
        line.sort(key=lambda x: x[:3])
        i = [x[2] for x in line].index(rec)
        nxt = line[i + 1][0] if i + 1 < len(line) else None
        if i:
            before = line[i - 1][2]
            for row in out:
                if row["obs"] == before and row["to"] is None:
                    row["to"] = rec
            out.append({"e": e, "obs": before, "vt": v, "from": rec, "to": None})
        out.append({"e": e, "obs": rec, "vt": nxt, "from": rec, "to": None})
    return {(r["e"], r["obs"], r["vt"], r["from"], r["to"]) for r in out}, held


def brute_versions(held):
    got = set()
    for e, line in held.items():
        last = object()
        for _, _, rec, a in line:
            if a != last:
                got.add((e, rec))
            last = a
    return got


@pytest.mark.parametrize("coalesce,shape,range_rows,splits", [
    ("true", "mixed", 10**6, 10**6), ("false", "mixed", 10**6, 10**6), ("false", "down", 30, 10**6), ("false", "up", 50, 10**6), ("true", "mixed", 20, 3), ("true", "backwards", 10**6, 10**6), ("true", "backwards", 60, 7),
])
def test_replay(spark, coalesce, shape, range_rows, splits):
    rnd = random.Random(7)
    rows = []
    n = 400
    for rec in range(n):
        e = rnd.choice(["hot", "hot", "hot", "a", "b", None])
        v = {"mixed": rnd.randint(0, 300), "down": n - rec, "backwards": n - rec if rec else -1, "up": rec + rnd.choice([0, 0, 0, -40])}[shape]
        rows.append((e, None if rnd.random() < 0.01 else T0 + timedelta(minutes=v), rnd.randint(0, 2), rec, rnd.choice(["x", "y", None])))
    rows += rnd.sample(rows, 20)
    df = spark.createDataFrame(rows, "e string, v timestamp_ntz, o long, rec long, a string").withColumn("entity", F.lit("clash"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    try:
        led = ledger(df.repartition(3), F.col("e"), F.col("v"), F.col("rec"), {"a": F.col("a")}, F.col("o"), range_rows, splits)
        got = {(r.entity, r.observation, r.valid_to, r.recorded_from, r.recorded_to) for r in led.collect()}
        seen = {(r.entity, r.observation) for r in versions(led).collect()}
        now = as_recorded(led).count()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    clean = [(e, v or datetime.min, o, rec, a) for e, v, o, rec, a in rows if e]
    want, held = replay(clean)
    want = {(e, obs, None if vt == datetime.min else vt, f, t) for e, obs, vt, f, t in want}
    assert got == want
    assert seen == brute_versions(held)
    assert now == len(set(clean))


def test_empty(spark):
    df = spark.createDataFrame([], "e string, v timestamp_ntz, rec long, a string")
    assert ledger(df, F.col("e"), F.col("v"), F.col("rec"), {"a": F.col("a")}).count() == 0
