"""Dewey labels of nested records."""

import json

from pyspark.sql import functions as F

from terrasift.operators.nested import node_tables, shred


def nodes(spark, bodies, paths=None, lists=()):
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "id int, body string").withColumns({"label": F.lit("clash"), "record_id": F.lit(1)})
    return [(int(r.record_id), r.label, r.schema_path, r.kind, r.value) for r in shred(df, F.col("id"), F.col("body"), paths, lists).collect()]


def test_all_nodes(spark):
    body = json.dumps({"a": [{"b": 1}, None, {"b": [2, "x"]}], "c": {"d": None, "e/f": True}})
    assert nodes(spark, [body]) == [
        (0, "a", "a", "array", None), (0, "a/0", "a/*", "object", None), (0, "a/0/b", "a/*/b", "scalar", "1"), (0, "a/2", "a/*", "object", None), (0, "a/2/b", "a/*/b", "array", None),
        (0, "a/2/b/0", "a/*/b/*", "scalar", "2"), (0, "a/2/b/1", "a/*/b/*", "scalar", "x"), (0, "c", "c", "object", None), (0, "c/e~1f", "c/e~1f", "scalar", "true"),
    ]


def test_wanted(spark):
    inner = json.dumps([{"k": [1]}, {"k": {"o": 1}}])
    bodies = [json.dumps(json.dumps({"l": inner})), '{"l": [{"k"', None, "", "7", '{"l": {"k": null}}', '{"l": "text"}', '{"l": "[1, 2"}', '{"x": [1]}', '{"l": []}', '{"l": [[5]]} x']
    got = nodes(spark, bodies, ["l/*", "l/*/k/*"], ["l", "l/*/k"])
    assert [(i, lab) for i, lab, *_ in got] == [(0, "l/0"), (0, "l/0/k/0"), (0, "l/1"), (0, "l/1/k/0"), (5, "l/0")]


def test_deep_and_long(spark):
    deep = "[" * 500 + "1" + "]" * 500
    got = nodes(spark, [deep, json.dumps({"t": "x" * 500_000}), "[" * 100_000])
    assert max(lab.count("/") for i, lab, *_ in got if i == 0) == 499
    assert [len(v) for i, *_, v in got if i == 1] == [500_000]
    assert {i for i, *_ in got} == {0, 1}


def test_tables(spark):
    df = spark.createDataFrame([("r", '{"a": [{"b": [1, 2]}]}'), ("r", '{"a": [{"b": [1, 2]}]}')], "id string, body string")
    t = node_tables(shred(df, F.col("id"), F.col("body")).distinct(), {"a": "a/*", "b": "a/*/b/*"})
    assert [tuple(r) for r in t["b"].orderBy("label").collect()] == [("r", "a/0/b/0", "a/0/b", "scalar", "1"), ("r", "a/0/b/1", "a/0/b", "scalar", "2")]
    assert t["a"].count() == 1
    assert shred(df.limit(0), F.col("id"), F.col("body")).count() == 0
