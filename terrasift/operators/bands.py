"""Values graded by bands: interval joins, equality joins, and checks of band tables.

Band tables belong to rule tables, which are published documents: small next to the
values, but not of a fixed size. Their number is looked at before they go to all
tasks; values never do. The interval test runs over the few bands of one rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrasift.functions.text import intervals

MOST_RULES, SALT = 10_000, 32


def inside(value: Column, lo: Column, lo_incl: Column, hi: Column, hi_incl: Column) -> Column:
    """Membership in an interval; a null bound is open."""
    above = lo.isNull() | (value > lo) | ((value == lo) & lo_incl)
    below = hi.isNull() | (value < hi) | ((value == hi) & hi_incl)
    return above & below


def match_bands(values: DataFrame, bands: DataFrame, value: str, rule: list[str]) -> DataFrame:
    """``values`` with ``grade`` and ``reason``.

    ``bands``: the rule columns, ``grade, lo, lo_incl, hi, hi_incl``. A value gets a
    grade only if exactly one grade has an interval that holds it; otherwise the
    reason is ``no_value``, ``no_band`` or ``several_bands``. The bands of a rule
    become one array, so each value meets its rule once and is never multiplied or
    grouped; repeated rows stay as they are. Up to ``MOST_RULES`` rules go to all
    tasks; with more, values and rules meet in ``SALT`` pieces of each rule.
    """
    held = bands.groupBy(*rule).agg(F.collect_list(F.struct("grade", "lo", "lo_incl", "hi", "hi_incl")).alias("_bands"))
    few = held.limit(MOST_RULES + 1).count() <= MOST_RULES
    v = F.col(value)
    hits = F.filter("_bands", lambda x: inside(v, x["lo"], x["lo_incl"], x["hi"], x["hi_incl"]))
    grades = F.array_distinct(F.transform(hits, lambda x: x["grade"]))
    if few:
        met = values.join(F.broadcast(held), rule, "left")
    else:
        dealt = values.withColumn("_salt", F.pmod(F.xxhash64(*values.columns), F.lit(SALT)).cast("int"))
        met = dealt.join(held.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))), [*rule, "_salt"], "left").drop("_salt")
    out = met.withColumn("_g", F.when(v.isNotNull() & F.col("_bands").isNotNull(), grades))
    n = F.coalesce(F.when(F.col("_g").isNotNull(), F.size("_g")), F.lit(0))
    reason = F.when(v.isNull(), "no_value").when(n == 0, "no_band").when(n > 1, "several_bands")
    return out.withColumns({"grade": F.when(n == 1, F.element_at("_g", 1)), "reason": reason}).drop("_bands", "_g")


def cut_grade(value: Column, edges: list[float], larger_is_better: bool) -> Column:
    """1-based grade by cut points. Larger is better: edges descending, an edge itself is the better grade."""
    passed = [F.when(value < e, 1).otherwise(0) if larger_is_better else F.when(value >= e, 1).otherwise(0) for e in edges]
    total = F.lit(1)
    for p in passed:
        total = total + p
    return F.when(value.isNotNull(), total)


def facility_grade(exists: Column, inside_section: Column, distance: Column, edges: list[float], worst: int, near_is_better: bool = True) -> Column:
    """Absent: the far end; inside the section: the near end, even with a distance; else by distance."""
    absent, near = (worst, 1) if near_is_better else (1, worst)
    return F.when(~exists, absent).when(inside_section, near).otherwise(cut_grade(distance, edges, not near_is_better))


def rate_lookup(pairs: DataFrame, cells: DataFrame, rule: list[str], subject: str, comparable: str) -> DataFrame:
    """``pairs`` with the ``rate`` in the matrix cell of two grades; null when there is none."""
    c = cells.select(*rule, F.col("subject_ix").alias(subject), F.col("comparable_ix").alias(comparable), "rate")
    return pairs.join(c, [*rule, subject, comparable], "left")


def transpose(cells: DataFrame) -> DataFrame:
    other = {"subject_ix": "comparable_ix", "comparable_ix": "subject_ix"}
    return cells.select(*[F.col(other.get(c, c)).alias(c) for c in cells.columns])


def step_matrix(sizes: DataFrame, rule: list[str]) -> DataFrame:
    """Cells ``step * (j - i)`` of a square matrix of ``size`` grades."""
    ix = F.sequence(F.lit(1), F.col("size"))
    return sizes.withColumn("subject_ix", F.explode(ix)).withColumn("comparable_ix", F.explode(ix)).select(
        *rule, "subject_ix", "comparable_ix", ((F.col("comparable_ix") - F.col("subject_ix")) * F.col("step")).alias("rate")
    )


def adjacency(bands: DataFrame, rule: list[str]) -> DataFrame:
    """``overlap`` and ``gap`` between neighbours of each rule's sorted intervals."""
    w = Window.partitionBy(*rule).orderBy(F.col("lo").asc_nulls_first(), F.col("hi").asc_nulls_last())
    prev = bands.withColumns({"p_hi": F.lag("hi").over(w), "p_incl": F.lag("hi_incl").over(w), "n": F.row_number().over(w)}).where("n > 1")
    code = (
        F.when(F.col("p_hi").isNull() | F.col("lo").isNull() | (F.col("p_hi") > F.col("lo")), "overlap")
        .when((F.col("p_hi") == F.col("lo")) & F.col("p_incl") & F.col("lo_incl"), "overlap")
        .when((F.col("p_hi") < F.col("lo")) | (~F.col("p_incl") & ~F.col("lo_incl")), "gap")
    )
    return prev.select(*rule, F.col("lo").alias("at"), code.alias("code")).where("code is not null")


def contiguous(items: DataFrame, rule: list[str], ix: str) -> DataFrame:
    """Whether each rule's indexes are 1..n without repeats."""
    return items.groupBy(*rule).agg(((F.min(ix) == 1) & (F.max(ix) == F.count("*")) & (F.countDistinct(ix) == F.count("*"))).alias("ok"))


def repeated(items: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return items.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def matrix_faults(cells: DataFrame, sizes: DataFrame, rule: list[str], most: float) -> DataFrame:
    """``code`` per faulty matrix: shape, diagonal, magnitude, antisymmetry."""
    m = cells.groupBy(*rule).agg(
        F.count("rate").alias("n"), F.max(F.greatest("subject_ix", "comparable_ix")).alias("top"),
        F.max(F.when(F.col("subject_ix") == F.col("comparable_ix"), F.abs("rate"))).alias("diagonal"), F.max(F.abs("rate")).alias("largest"),
    )
    mirror = cells.select(*rule, F.col("comparable_ix").alias("subject_ix"), F.col("subject_ix").alias("comparable_ix"), (-F.col("rate")).alias("mirror"))
    odd = cells.join(mirror, [*rule, "subject_ix", "comparable_ix"]).where("rate <> mirror").select(*rule).distinct().withColumn("odd", F.lit(True))
    j = sizes.join(m, rule, "left").join(odd, rule, "left")
    codes = F.array(
        F.when(F.coalesce((F.col("n") != F.col("size") * F.col("size")) | (F.col("top") != F.col("size")), F.lit(True)), "shape"),
        F.when(F.col("diagonal") != 0, "diagonal"), F.when(F.col("largest") > most, "magnitude"), F.when(F.col("odd"), "antisymmetry"),
    )
    return j.select(*rule, F.explode(F.filter(codes, lambda x: x.isNotNull())).alias("code"))


def criterion_kind(bodies: Column) -> Column:
    """What the criteria of a rule's grades describe: manual, facility, count, numeric or categorical.

    The first that fits: an empty body or a reference to a note is manual; a state
    inside the section together with a state of absence is a facility; absence alone
    is manual; numbers of items are a count; intervals in every body are numeric.
    """
    has = lambda word: F.exists(bodies, lambda b: b.contains(word))
    empty = F.coalesce(F.size(bodies) == 0, F.lit(True)) | F.exists(bodies, lambda b: F.coalesce(F.trim(b) == "", F.lit(True)))
    counts = F.forall(bodies, lambda b: b.rlike(r"^\s*(無|(?:[零一二兩三四五六七八九十]|[0-9]+)\s*項(以上)?)\s*$"))
    return (
        F.when(empty | has("詳備註") | has("人工判定"), "manual").when(has("區段內") & has("無"), "facility").when(has("或無"), "manual")
        .when(has("項") & counts, "count").when(F.forall(bodies, lambda b: F.size(intervals(b)) > 0), "numeric").otherwise("categorical")
    )
