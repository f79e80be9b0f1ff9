"""Checks of rule tables, grading by method, and the small predicates around them.

All are expressions or joins on keys; rule tables are small, values may be any number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrasift.functions.numbers import is_missing, parse_number
from terrasift.functions.text import compact, split_list
from terrasift.operators.bands import inside

MANUAL, GRADED, NO_MATCH = "external decision required", "graded", "no match"


# ---- rule tables ---------------------------------------------------------------------


def interval_fault(lo: Column, lo_incl: Column, hi: Column, hi_incl: Column) -> Column:
    """``reversed`` if an interval ends before it begins, ``empty`` if it is one point that an open end leaves out, else null."""
    return F.when(lo > hi, "reversed").when((lo == hi) & ~(lo_incl & hi_incl), "empty")


def grade_order(steps: DataFrame, rule: list[str], distance: str, grade: str) -> DataFrame:
    """Per rule whether grades never fall and whether they never rise along the distance: ``rule, n, rising, falling``.

    Null grades are left out; of equal distances the lower grade comes first.
    """
    w = Window.partitionBy(*rule).orderBy(F.col(distance).asc_nulls_first(), F.col(grade))
    moved = steps.where(F.col(grade).isNotNull()).withColumn("_d", F.col(grade) - F.lag(grade).over(w))
    ok = lambda c: F.coalesce(F.bool_and(c), F.lit(True))
    return moved.groupBy(*rule).agg(F.count("*").alias("n"), ok(F.col("_d") >= 0).alias("rising"), ok(F.col("_d") <= 0).alias("falling"))


def edge_pairs(edges: Column) -> Column:
    """``array<struct<lo, hi>>``: each edge with the next one, in order; none for fewer than two edges."""
    e = F.array_sort(F.array_distinct(F.filter(edges, lambda x: x.isNotNull())))
    n = F.greatest(F.size(e) - 1, F.lit(0))
    return F.zip_with(F.slice(e, 1, n), F.slice(e, 2, n), lambda a, b: F.struct(a.alias("lo"), b.alias("hi")))


def payload_faults(rules: DataFrame, methods: DataFrame) -> DataFrame:
    """``rule, code`` of rules (rule, method, input, payload: map of what they hold) that do not fit ``methods`` (method, input, needs).

    unknown_method, wrong_input, or missing_payload when nothing stands under the key the method needs.
    """
    known = methods.select("method", F.col("input").alias("_input"), "needs", F.lit(True).alias("_known"))
    j = rules.join(known, "method", "left")
    held = F.element_at("payload", F.col("needs"))
    code = F.when(F.col("_known").isNull(), "unknown_method").when(~F.col("input").eqNullSafe(F.col("_input")), "wrong_input").when(F.col("needs").isNotNull() & (held.isNull() | (F.trim(held) == "")), "missing_payload")
    return j.select("rule", code.alias("code")).where("code is not null")


def fragment_grades(labels: DataFrame, rule: list[str]) -> DataFrame:
    """``rule, way, word, grade``: words that stand for a grade (labels: rule, grade, text).

    Way ``fragment``: the parts of each text, if no part stands for two grades of its
    rule; else ``whole``: the whole texts, if these differ; else ``manual``, one row
    without word. A blank text has no word.
    """
    parts = labels.select(*rule, "grade", compact(F.col("text")).alias("whole"), F.explode(F.array_distinct(F.transform(split_list(F.col("text")), compact))).alias("part")).where("part <> ''")
    clash = lambda c: parts.groupBy(*rule, c).agg(F.countDistinct("grade").alias("_n")).groupBy(*rule).agg((F.max("_n") > 1).alias(f"_{c}"))
    way = clash("part").join(clash("whole"), rule).select(*rule, F.when(~F.col("_part"), "fragment").when(~F.col("_whole"), "whole").otherwise("manual").alias("way"))
    j = parts.join(way, rule)
    word = F.when(F.col("way") == "fragment", F.col("part")).when(F.col("way") == "whole", F.col("whole"))
    return j.select(*rule, "way", word.alias("word"), F.when(F.col("way") != "manual", F.col("grade")).alias("grade")).distinct()


# ---- grading -------------------------------------------------------------------------


def boolean_grade(value: Column, if_true: int, if_false: int) -> Column:
    """The grade of a real boolean; null for null."""
    return F.when(value, if_true).when(~value, if_false)


def grade_by_method(method: Column, ways: dict[str, Column]) -> Column:
    """``struct<grade, status>``: the grade by the way of its method; a method without a way is for a person to decide."""
    grade, known = F.lit(None).cast("int"), F.lit(False)
    for name, way in ways.items():
        grade = F.when(method == name, way.cast("int")).otherwise(grade)
        known = known | (method == name)
    status = F.when(~F.coalesce(known, F.lit(False)), MANUAL).when(grade.isNull(), NO_MATCH).otherwise(GRADED)
    return F.struct(grade.alias("grade"), status.alias("status"))


def classify(values: DataFrame, key: list[str], rule: list[str], bands: DataFrame) -> DataFrame:
    """``key, grade``: the one band of a rule that a written value fits, else null.

    ``values``: key, rule, value. ``bands``: rule, grade, aliases (array or null), lo, hi
    (lo null: 0), unit (null: no numbers). A value that is an alias of a band fits it;
    otherwise a number that is not negative fits a band with a unit and no aliases
    whose half-open interval holds it. Missing values and values that fit several
    bands have no grade.
    """
    v = F.trim("value")
    number = parse_number(F.col("value"))
    j = values.join(bands, rule, "left")
    alias = F.coalesce(F.array_contains("aliases", v), F.lit(False))
    numeric = F.col("unit").isNotNull() & (F.coalesce(F.size("aliases"), F.lit(0)) <= 0) & (number >= 0)
    within = inside(number, F.coalesce("lo", F.lit(0)), F.lit(True), F.col("hi"), F.lit(False))
    fits = ~is_missing(F.col("value")) & (alias | F.coalesce(numeric & within, F.lit(False)))
    g = j.groupBy(*key).agg(F.countDistinct(F.when(fits, F.col("grade"))).alias("_n"), F.min(F.when(fits, F.col("grade"))).alias("grade"))
    return g.select(*key, F.when(F.col("_n") == 1, F.col("grade")).alias("grade"))


def label_index(values: DataFrame, rule: list[str], bands: DataFrame) -> DataFrame:
    """``values`` (rule, label) with the index of the band of that label; null if there is none or several."""
    one = bands.groupBy(*rule, "label").agg(F.min("ix").alias("ix"), F.max("ix").alias("_m"))
    return values.join(one.withColumn("ix", F.when(F.col("ix") == F.col("_m"), F.col("ix"))).drop("_m"), [*rule, "label"], "left")


def by_alias(left: DataFrame, name: str, catalogue: DataFrame, entry: str, aliases: DataFrame) -> DataFrame:
    """``left`` joined to ``catalogue`` where names agree without blanks and punctuation, once ``aliases`` (alias, means) are resolved."""
    a = aliases.select(compact(F.col("alias")).alias("_k"), compact(F.col("means")).alias("_means")).dropDuplicates(["_k"])
    side = left.withColumn("_k", compact(F.col(name))).join(a, "_k", "left").withColumn("_k", F.coalesce("_means", "_k")).drop("_means")
    return side.join(catalogue.withColumn("_k", compact(F.col(entry))), "_k").drop("_k")


# ---- guards and predicates -----------------------------------------------------------


def guarded_mean(values: Column) -> Column:
    """``struct<mean, error>``: the mean of an array of decimals, unrounded; an empty array or a negative value is an error."""
    bad = F.when(F.coalesce(F.size(values), F.lit(0)) <= 0, "empty").when(F.exists(values, lambda x: x.isNull()), "missing").when(F.exists(values, lambda x: x < 0), "negative")
    total = F.aggregate(values, F.lit(0).cast("decimal(38,6)"), lambda a, x: (a + x).cast("decimal(38,6)"))
    return F.struct(F.when(bad.isNull(), total / F.size(values)).alias("mean"), bad.alias("error"))


def guarded_percent(part: Column, whole: Column) -> Column:
    """``part`` of ``whole`` in percent; null where the whole is not positive or the part negative."""
    return F.when((whole > 0) & (part >= 0), part / whole * 100)


def both_given(*texts: Column) -> Column:
    """Whether all texts hold more than blanks."""
    out = F.lit(True)
    for t in texts:
        out = out & (F.coalesce(F.trim(t), F.lit("")) != "")
    return out


def in_order(first: Column, last: Column) -> Column:
    """Whether a period does not end before it begins; an open end is in order."""
    return F.coalesce(first <= last, F.lit(True))


def within_size(text: Column, most: int) -> Column:
    """Whether a text has no more than ``most`` characters; null counts as none."""
    return F.coalesce(F.length(text), F.lit(0)) <= most


def extra_keys(row: Column, keys: list[str]) -> Column:
    """The entries of a map under the wanted keys that hold something."""
    return F.map_filter(row, lambda k, v: k.isin(*keys) & v.isNotNull() & (v != ""))


def search(rows: DataFrame, columns: list[str], text: str, status: str | None = None) -> DataFrame:
    """Rows whose columns, put together, hold ``text`` whatever its case; with ``status`` only those of it."""
    hit = rows.where(F.lower(F.concat_ws(" ", *columns)).contains(text.lower()))
    return hit if status is None else hit.where(F.col("status") == status)


def of_year(rows: DataFrame, year_column: str, year: int, city: str, address: str, pattern: str) -> DataFrame:
    """Rows of a year in a city whose address begins as ``pattern`` says; a year without any row is an error when read."""
    there = rows.agg(F.count_if(F.col(year_column) == year).alias("_n")).select(F.when(F.col("_n") == 0, F.raise_error(F.lit(f"no rows of the year {year}"))).otherwise(F.lit(True)).alias("_there"))
    wanted = rows.where((F.col(year_column) == year) & F.col(address).contains(city) & F.col(address).rlike(f"^(?:{pattern})"))
    return wanted.join(F.broadcast(there)).where("_there").drop("_there")  # one row


def graded_line(text: Column) -> Column:
    """``struct<label, body>`` of a line ``label：body`` with a short label; null for other lines."""
    label = F.regexp_extract(text, r"^\s*([^：:\s]{1,8})\s*[：:]", 1)
    return F.when(label != "", F.struct(label.alias("label"), F.trim(F.regexp_extract(text, r"^[^：:]*[：:](.*)$", 1)).alias("body")))


def page_number(text: Column) -> Column:
    """``n-n`` of a line that is a page number only, else null."""
    return F.nullif(F.regexp_extract(text, r"^\s*([0-9]+-[0-9]+)\s*$", 1), F.lit(""))
