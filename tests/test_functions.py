"""Column functions on edge values."""

import math
from decimal import Decimal

from pyspark.sql import functions as F

from terrasift.functions import geo, numbers, text
from terrasift.functions.dates import parse_date


def col(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_numbers(spark):
    values = [" 1,234.5 ", "12%", "12％", "12%％", "-", "—", "", None, "nan", "Infinity", "5 m", "0", "　7　", "-1", "1e2", "％"]
    got = col(spark, values, numbers.parse_number)
    D = Decimal
    assert got == [D("1234.5"), D(12), D(12), None, None, None, None, None, None, None, None, D(0), D(7), D(-1), D(100), None]
    assert col(spark, values[4:8] + ["0", "無", " — "], numbers.is_missing) == [True, True, True, True, False, False, True]
    assert col(spark, ["無", "十", "12", "多", None], numbers.numeral) == [0, 10, 12, None, None]


def test_strict_sum(spark):
    df = spark.createDataFrame([(1, 1), (1, None), (2, 1), (2, 3)], "k int, v int")
    assert {r.k: r.s for r in df.groupBy("k").agg(numbers.strict_sum(F.col("v")).alias("s")).collect()} == {1: None, 2: 4}
    assert df.limit(0).agg(numbers.strict_sum(F.col("v")).alias("s")).collect()[0].s is None


def test_dates(spark):
    got = col(spark, ["2024-02-29", "2023-02-29", "1130229", "1120229", "0010101", "113022", "2024/01/01", "", None, " 1121012 ", "1129999"], parse_date)
    assert [str(x) if x else None for x in got] == ["2024-02-29", None, "2024-02-29", None, "1912-01-01", None, None, None, None, "2023-10-12", None]


def test_text(spark):
    assert col(spark, ["臺北市ABC 12é3", "路", "", None, "a"], text.tokens) == [["臺北", "北市", "abc", "12", "3"], ["路"], [], None, ["a"]]
    assert col(spark, ["=1", " +2", "a", "-", "@x", "\tq", None], text.csv_safe) == ["'=1", "' +2", "a", "'-", "'@x", "'\tq", None]
    assert col(spark, ["<a href=\"x\">'&", None], text.html_escape) == ["&lt;a href=&quot;x&quot;&gt;&#x27;&amp;", None]
    assert col(spark, ["泰山區、五股區", " a , b ", "", None], text.split_list) == [["泰山區", "五股區"], ["a", "b"], [], None]
    assert col(spark, ["a、b（c）　d"], text.compact) == ["abcd"]
    assert col(spark, ["a\nb\r\nc", "a"], lambda c: text.line_slice(c, F.lit(2), F.lit(3))) == ["b\nc", None]
    assert col(spark, ["ABxA", None], lambda c: text.in_order(c, ["A", "AB"])) == [["AB", "A"], None]
    df = spark.createDataFrame([("寬 5 7", "57"), ("1,234.00 元", "1234"), ("x15", "5"), ("5.0", "5"), ("5.5", "5")], "t string, n string")
    assert [r.x for r in df.select(text.holds_number(F.col("t"), F.col("n")).alias("x")).collect()] == [False, True, False, True, False]


def test_first(spark):
    df = spark.createDataFrame([(" - ", "無", " x "), (None, None, None), ("inf", "nan", "3.5")], "a string, b string, c string")
    rows = df.select(text.first_text(*map(F.col, "abc")).alias("t"), text.first_number(*map(F.col, "abc")).alias("n")).collect()
    assert [(r.t, r.n) for r in rows] == [("x", None), (None, None), ("inf", 3.5)]


def test_intervals(spark):
    got = col(spark, ["10公尺以上未滿20公尺", "未滿5%或30%以上", "8㎡以下", "無", None], text.intervals)
    as_rows = [None if g is None else [(r.lo and float(r.lo), r.lo_incl, r.hi and float(r.hi), r.hi_incl) for r in g] for g in got]
    assert as_rows == [[(10, True, 20, False)], [(None, True, 5, False), (30, True, None, False)], [(None, True, 8, True)], [], None]


def test_geo(spark):
    df = spark.createDataFrame([(250000.0, 2655023.0), (306686.96, 2773378.81), (None, 1.0)], "x double, y double")
    rows = geo.with_wgs84(df, F.col("x"), F.col("y"), "g").collect()
    assert math.isclose(rows[0].g.lon, 121.0, abs_tol=1e-9) and 23.9 < rows[0].g.lat < 24.1
    assert abs(rows[1].g.lon - 121.562) < 0.01 and rows[2].g.lon is None
    p = spark.createDataFrame([(121.0, 24.0, 122.0, 24.0), (119.0, 21.5, 119.0, 21.5), (None, 24.0, 1.0, 1.0)], "a double, b double, c double, d double")
    d = p.select(geo.haversine_m(*map(F.col, "abcd")).alias("d"), geo.plausible(F.col("a"), F.col("b")).alias("ok")).collect()
    assert abs(d[0].d - 101_582) < 50 and d[1].d == 0 and [r.ok for r in d] == [True, True, False]


def test_criteria(spark):
    assert len(text.SIMPLIFIED) == len(text.TRADITIONAL) == 24
    assert col(spark, [" 未满１,０５m²　", "＋1,234 M^2$", "－3％", "1,23", None], text.numeric_text) == ["未滿１,０５m2", "+1234 m2", "-3%", "1,23", None]
    tails = ["寬度10公尺以上以道路寬度衡量", "以道路寬度衡量", "寬以道路寬", "甲以該區判定以都市計畫制定", "甲", "", None]
    assert col(spark, tails, text.without_tail) == ["寬度10公尺以上", "以道路寬度衡量", "寬以道路寬", "甲以該區判定", "甲", "", None]
    got = col(spark, ["1,000㎡以上未满2,000㎡"], text.intervals)[0]
    assert [(float(r.lo), float(r.hi)) for r in got] == [(1000, 2000)]
