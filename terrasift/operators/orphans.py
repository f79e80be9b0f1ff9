"""References to records that do not exist.

A reference row points with a key to a target table whose rows exist from
``born`` until ``gone``. A reference whose key is neither null nor empty is

* ``missing`` when no target row has the key,
* ``deleted`` when the reference is later than the target's ``gone``,
* ``late`` when it is earlier than the target's ``born``,

in this order, at most one of them. Keys are compared exactly.

Plan: references are pre-aggregated by key and period (map-side combine), which
tells how often each key occurs. Keys holding more than one part in ``parts`` of
all references are heavy; there can be at most ``parts`` of them, so broadcasting
their target rows has a proven bound. Heavy references never shuffle: they meet
their target in a broadcast join. All others go through a shuffle join. Both
results are united. The count report works on the pre-aggregated groups and looks
at single rows only in the few periods in which a target was born or removed.

Defined cases: null or empty keys are no references; a null reference time or a
null ``born``/``gone`` makes the comparison with it false; several target rows of
one key are taken together (earliest ``born``; removed only if every row has a
``gone``, then the latest); repeated reference rows count once by child key;
empty tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAVY_PARTS = 1000
SALT = 64

FOUND = "child_table string, ref_field string, child_key string, reason string"


@dataclass(frozen=True)
class Reference:
    """One reference field: who refers, by which key, when, and to what."""

    child_table: str
    ref_field: str
    rows: DataFrame
    child_key: Column
    key: Column
    at: Column
    target: DataFrame
    target_key: Column
    born: Column
    gone: Column


def _references(ref: Reference) -> DataFrame:
    out = ref.rows.select(ref.child_key.cast("string").alias("child_key"), ref.key.cast("string").alias("k"), ref.at.alias("at"))
    return out.where("k is not null and k <> ''")


def _targets(ref: Reference) -> DataFrame:
    rows = ref.target.select(ref.target_key.cast("string").alias("k"), ref.born.alias("b"), ref.gone.alias("g")).where("k is not null")
    return rows.groupBy("k").agg(
        F.min("b").alias("born"),
        F.when(F.count("*") == F.count("g"), F.max("g")).alias("gone"),
        F.lit(True).alias("there"),
    )


def _groups(references: DataFrame, period: str) -> DataFrame:
    """Partial and final aggregation by key and period."""
    return references.groupBy("k", F.date_trunc(period, "at").cast("timestamp_ntz").alias("period")).agg(
        F.count("*").alias("n"), F.min("at").alias("first_at"), F.max("at").alias("last_at")
    )


def _heavy_keys(groups: DataFrame, parts: int) -> DataFrame:
    """Keys with more than a ``parts``-th of all references: at most ``parts`` keys."""
    per_key = groups.groupBy("k").agg(F.sum("n").alias("kn"))
    total = per_key.agg(F.sum("kn").alias("total"))
    return per_key.crossJoin(F.broadcast(total)).where(F.col("kn") * parts > F.col("total")).select("k")


def _with_target(refs: DataFrame, targets: DataFrame, heavy: DataFrame) -> DataFrame:
    """``refs`` left-joined to ``targets``: heavy keys by broadcast, the others by shuffle."""
    hot = heavy.join(targets, "k", "left")
    marked = refs.join(F.broadcast(hot.select("k", F.struct("there", "born", "gone").alias("hot"))), "k", "left")
    by_broadcast = marked.where("hot is not null").select(*refs.columns, "hot.there", "hot.born", "hot.gone")
    by_shuffle = marked.where("hot is null").drop("hot").join(targets.hint("shuffle_hash"), "k", "left").select(*refs.columns, "there", "born", "gone")
    return by_broadcast.unionByName(by_shuffle)


def _reason(at: str = "at") -> Column:
    return (
        F.when(F.col("there").isNull(), "missing")
        .when(F.col(at) > F.col("gone"), "deleted")
        .when(F.col(at) < F.col("born"), "late")
    )


def orphans(ref: Reference, parts: int = HEAVY_PARTS, period: str = "month") -> DataFrame:
    """Every orphan reference of one field: ``child_table, ref_field, child_key, reason``."""
    refs, targets = _references(ref), _targets(ref)
    heavy = _heavy_keys(_groups(refs, period), parts)
    found = _with_target(refs, targets, heavy).withColumn("reason", _reason()).where("reason is not null")
    return (
        found.groupBy("child_key", "reason").agg(F.lit(1).alias("_one"))
        .select(F.lit(ref.child_table).alias("child_table"), F.lit(ref.ref_field).alias("ref_field"), "child_key", "reason")
    )


def orphan_counts(ref: Reference, period: str = "month", parts: int = HEAVY_PARTS) -> DataFrame:
    """Orphan references per table, field, period and reason.

    ``n_references`` counts stored reference rows. Whole (key, period) groups are
    settled by their first and last time; only groups that a target's birth or
    removal cuts through are looked at row by row.
    """
    refs, targets = _references(ref), _targets(ref)
    groups = _groups(refs, period)
    heavy = _heavy_keys(groups, parts)
    joined = _with_target(groups, targets, heavy)
    first, last = _reason("first_at"), _reason("last_at")
    judged = joined.select("k", "period", "n", first.alias("r1"), last.alias("r2"), "there", "born", "gone")
    settled = judged.where(F.col("r1").eqNullSafe(F.col("r2"))).where("r1 is not null").select("period", "n", F.col("r1").alias("reason"))
    # the rows of a cut period meet its target in ``SALT`` pieces, so that a key's month is not one task
    piece = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))
    cut = judged.where(~F.col("r1").eqNullSafe(F.col("r2"))).select("k", "period", piece.alias("_piece"), "there", "born", "gone")
    dealt = refs.select("k", "at", F.date_trunc(period, "at").cast("timestamp_ntz").alias("period"), F.pmod(F.xxhash64("child_key", "at"), F.lit(SALT)).cast("int").alias("_piece"))
    rows = dealt.join(cut, ["k", "period", "_piece"])
    by_row = rows.withColumn("reason", _reason()).where("reason is not null").groupBy("period", "reason").agg(F.count("*").alias("n")).select("period", "n", "reason")
    return (
        settled.unionByName(by_row)
        .groupBy("period", "reason")
        .agg(F.sum("n").alias("n_references"))
        .select(F.lit(ref.child_table).alias("child_table"), F.lit(ref.ref_field).alias("ref_field"), "period", "reason", "n_references")
    )
