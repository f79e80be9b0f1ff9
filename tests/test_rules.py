"""Rule checks, grading ways and guards on small fixtures; nulls, ties and empty tables."""

from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from terrasift.operators import logs as G
from terrasift.operators import rules as K


def test_rule_tables(spark):
    steps = spark.createDataFrame([("a", 1, 1), ("a", 2, 1), ("a", 3, 4), ("b", 1, 3), ("b", 2, 2), ("b", 3, 3), ("c", 1, 5), ("d", 1, None), ("e", None, 2), ("e", 1, 1)], "r string, d int, g int")
    assert {x.r: (x.n, x.rising, x.falling) for x in K.grade_order(steps, ["r"], "d", "g").collect()} == {"a": (3, True, False), "b": (3, False, False), "c": (1, True, True), "e": (2, False, True)}
    assert K.grade_order(steps.limit(0), ["r"], "d", "g").count() == 0
    e = spark.createDataFrame([([3, 1, None, 2, 2],), ([7],), ([],), (None,)], "e array<int>").select(K.edge_pairs(F.col("e")).alias("p")).collect()
    assert [x.p and [tuple(y) for y in x.p] for x in e] == [[(1, 2), (2, 3)], [], [], None]
    i = spark.createDataFrame([(1, True, 2, False), (2, True, 1, True), (1, True, 1, False), (1, True, 1, True), (None, True, 1, False)], "lo int, li boolean, hi int, hi_i boolean")
    assert [x.f for x in i.select(K.interval_fault(F.col("lo"), F.col("li"), F.col("hi"), F.col("hi_i")).alias("f")).collect()] == [None, "reversed", "empty", None, None]
    rules = spark.createDataFrame([("1", "n", "x", {"u": "m"}), ("2", "n", "y", {"u": "m"}), ("3", "n", "x", {"u": " "}), ("4", "n", "x", {}), ("5", None, "x", {}), ("6", "z", "x", {})], "rule string, method string, input string, payload map<string,string>")
    methods = spark.createDataFrame([("n", "x", "u")], "method string, input string, needs string")
    assert sorted(map(tuple, K.payload_faults(rules, methods).collect())) == [("2", "wrong_input"), ("3", "missing_payload"), ("4", "missing_payload"), ("5", "unknown_method"), ("6", "unknown_method")]
    labels = spark.createDataFrame([("f", 1, "甲、乙"), ("f", 2, "丙"), ("w", 1, "甲、乙"), ("w", 2, "乙、丙"), ("m", 1, "甲"), ("m", 2, "甲"), ("n", 1, None), ("n", 1, "、")], "r string, grade int, text string")
    assert sorted(map(str, map(tuple, K.fragment_grades(labels, ["r"]).collect()))) == sorted(map(str, [("f", "fragment", "甲", 1), ("f", "fragment", "乙", 1), ("f", "fragment", "丙", 2), ("w", "whole", "甲乙", 1), ("w", "whole", "乙丙", 2), ("m", "manual", None, None)]))


def test_grading(spark):
    v = spark.createDataFrame([(1, "n", 5, True), (2, "b", 5, False), (3, "b", 5, None), (4, "?", 5, True), (5, None, 5, True)], "k int, m string, n int, b boolean")
    g = v.select("k", K.grade_by_method(F.col("m"), {"n": F.col("n"), "b": K.boolean_grade(F.col("b"), 1, 4)}).alias("g")).collect()
    assert [tuple(x.g) for x in g] == [(5, K.GRADED), (4, K.GRADED), (None, K.NO_MATCH), (None, K.MANUAL), (None, K.MANUAL)]
    bands = spark.createDataFrame([("r", 1, ["甲", "7"], None, None, "m"), ("r", 2, None, None, D(10), "m"), ("r", 3, [], D(10), None, "m"), ("r", 4, None, D(20), D(30), "m"), ("s", 1, None, D(0), D(9), None)], "rule string, grade int, aliases array<string>, lo decimal(20,6), hi decimal(20,6), unit string")
    values = spark.createDataFrame([(i, r, x) for i, (r, x) in enumerate([("r", " 甲 "), ("r", "7"), ("r", "5"), ("r", "10"), ("r", "25"), ("r", "-1"), ("r", "-"), ("r", None), ("s", "5"), ("t", "5")])], "k int, rule string, value string")
    assert [x.grade for x in K.classify(values, ["k"], ["rule"], bands).orderBy("k").collect()] == [1, None, 2, 3, None, None, None, None, None, None]
    b = spark.createDataFrame([("r", 1, "a"), ("r", 2, "b"), ("r", 3, "b")], "rule string, ix int, label string")
    x = spark.createDataFrame([("r", "a"), ("r", "b"), ("r", "c"), (None, "a")], "rule string, label string")
    assert sorted((r.label, r.ix or 0) for r in K.label_index(x, ["rule"], b).collect()) == [("a", 0), ("a", 1), ("b", 0), ("c", 0)]


def test_guards(spark):
    m = spark.createDataFrame([([D(1), D(2)],), ([],), (None,), ([D(1), None],), ([D(1), D(-2)],)], "v array<decimal(20,6)>").select(K.guarded_mean(F.col("v")).alias("m")).collect()
    assert [(x.m.mean and float(x.m.mean), x.m.error) for x in m] == [(1.5, None), (None, "empty"), (None, "empty"), (None, "missing"), (None, "negative")]
    p = spark.createDataFrame([(1.0, 4.0), (1.0, 0.0), (-1.0, 4.0), (None, 4.0)], "a double, b double").select(K.guarded_percent(F.col("a"), F.col("b")).alias("p")).collect()
    assert [x.p for x in p] == [25.0, None, None, None]
    t = spark.createDataFrame([("甲： 好",), ("page 1-2",), (" 3-4 ",), (None,), ("太長太長太長太長太：x",)], "t string").select(K.graded_line(F.col("t")).alias("g"), K.page_number(F.col("t")).alias("n")).collect()
    assert [(x.g and tuple(x.g), x.n) for x in t] == [(("甲", "好"), None), (None, None), (None, "3-4"), (None, None), (None, None)]
    rows = spark.createDataFrame([(112, "雲台市甲路", "Ab", "open"), (113, "雲台市乙路", "xab", "done"), (113, "往雲台市", None, "open")], "y int, a string, t string, s string")
    assert [r.a for r in K.of_year(rows, "y", 113, "市", "a", "雲台").collect()] == ["雲台市乙路"]
    with pytest.raises(Exception, match="no rows of the year 99"):
        K.of_year(rows, "y", 99, "市", "a", "雲台").collect()
    assert K.search(rows, ["t"], "AB").count() == 2 and K.search(rows.withColumnRenamed("s", "status"), ["t"], "ab", "done").count() == 1
    f = rows.select(K.both_given(F.col("t"), F.col("a")).alias("b"), K.within_size(F.col("t"), 2).alias("w"), K.in_order(F.col("y"), F.lit(112)).alias("o")).collect()
    assert [tuple(x) for x in f] == [(True, True, True), (True, False, False), (False, True, False)]
    j = spark.createDataFrame([("k", True), ("k", None), ("l", True)], "k string, c boolean")
    assert sorted(map(tuple, G.passed(j, ["k"], F.col("c")).collect())) == [("k", False, 2), ("l", True, 1)]
    e = spark.createDataFrame([({"a": "1", "b": "", "c": "2"},), (None,)], "m map<string,string>").select(K.extra_keys(F.col("m"), ["a", "b"]).alias("m")).collect()
    assert [x.m for x in e] == [{"a": "1"}, None]
    left, cat = spark.createDataFrame([("(甲) 路",), ("乙",), (None,)], "n string"), spark.createDataFrame([("甲路",), ("丙",)], "e string")
    assert sorted(map(tuple, K.by_alias(left, "n", cat, "e", spark.createDataFrame([("乙", "丙")], "alias string, means string")).collect())) == [("(甲) 路", "甲路"), ("乙", "丙")]


def test_bands_by_pieces(spark, monkeypatch):
    """More rules than go to all tasks: the same rows."""
    from terrasift.operators import bands as B

    rows = [("r", 1, D(0), True, D(5), False), ("r", 2, D(4), True, D(9), True), ("s", 1, None, True, None, True)]
    b = spark.createDataFrame(rows, "rule string, grade int, lo decimal(20,6), lo_incl boolean, hi decimal(20,6), hi_incl boolean")
    v = spark.createDataFrame([(r, None if i == 3 else D(i)) for r in ("r", "s", "t", None) for i in range(12)] * 2, "rule string, v decimal(20,6)")
    few = sorted(map(str, B.match_bands(v, b, "v", ["rule"]).collect()))
    monkeypatch.setattr(B, "MOST_RULES", 1)
    assert sorted(map(str, B.match_bands(v, b, "v", ["rule"]).collect())) == few and len(few) == 96
