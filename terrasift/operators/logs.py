"""Append-only logs: latest state, accepted writes, caches, spacing, repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrasift.operators.ordered import with_previous, with_rank, with_running_max


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key. A ``max_by`` aggregate: combined before the shuffle, no sort of a key's rows."""
    rest = [c for c in rows.columns if c not in key]
    top = F.max_by(F.struct(*rest), F.struct(*order)).alias("_top")
    return rows.groupBy(*key).agg(top).select(*key, *[F.col("_top")[c].alias(c) for c in rest]).select(*rows.columns)


def accepted_writes(rows: DataFrame, key: list[str], order: list[str], revision: str, bucket: Column) -> DataFrame:
    """Replays compare-and-set: a write with revision r is accepted when r is one more than the last seen before it.

    ``expected`` is what the writer had to hold. Only the previous row matters, as a
    rejected write is answered by a reload of the stored revision. ``bucket``: see
    ``ordered``.
    """
    prev = F.coalesce(F.col("_p")[revision], F.lit(0))
    out = with_previous(rows, key, order, [revision], bucket, "_p")
    return out.withColumns({"expected": prev + 1, "accepted": F.coalesce(F.col(revision) == prev + 1, F.lit(False))}).drop("_p")


def changed_fields(rows: DataFrame, key: list[str], order: list[str], fields: list[str], bucket: Column) -> DataFrame:
    """Fields that differ from the row before, one row each: ``key, order, field, old, new``."""
    out = with_previous(rows, key, order, fields, bucket, "_p").where("_p is not null")
    pairs = [F.struct(F.lit(f).alias("field"), F.col("_p")[f].cast("string").alias("old"), F.col(f).cast("string").alias("new")) for f in fields]
    return out.select(*key, *order, F.inline(F.array(*pairs))).where("not (old <=> new)")


def fifo_cache(entries: DataFrame, at: str, rows: str, budget: int, key: list[str]) -> DataFrame:
    """Entries a first-in-first-out cache still holds: the newest whose rows together fit the budget.

    An entry larger than the budget is never held. The running sum goes over days
    first and then inside the one day in which the budget ends, so that no task sorts
    the whole log.
    """
    fit = entries.where(F.col(rows) <= budget)
    day = F.to_date(at)
    per_day = fit.groupBy(day.alias("_d")).agg(F.sum(rows).alias("_n"))
    newer = per_day.withColumn("_newer", F.sum("_n").over(Window.orderBy(F.desc("_d"))) - F.col("_n"))
    j = fit.withColumn("_d", day).join(F.broadcast(newer.where(F.col("_newer") < budget)), "_d")
    w = Window.partitionBy("_d").orderBy(F.desc(at), *key)
    return j.withColumn("_run", F.col("_newer") + F.sum(rows).over(w)).where(F.col("_run") <= budget).drop("_d", "_n", "_newer", "_run")


def newest(rows: DataFrame, key: list[str], at: str, tie: str, keep: int) -> DataFrame:
    """The ``keep`` newest rows of each key."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(at), tie))
    return rows.withColumn("_r", rank).where(F.col("_r") <= keep).drop("_r")


def expired(at: Column, now: Column, seconds: int) -> Column:
    """Whether more than ``seconds`` have passed."""
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) > seconds * 1_000_000


def spaced(rows: DataFrame, key: list[str], at: str, tie: str, seconds: float) -> DataFrame:
    """When each call of a key may run at the earliest, if calls are at least ``seconds`` apart.

    With calls in order, start_i = max(at_i, start_{i-1} + gap), which is a running
    maximum of at_i - i*gap, plus i*gap: no loop.
    """
    gap = int(seconds * 1_000_000)
    day = F.unix_date(F.to_date(at))
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    base = with_rank(rows, key, [at, tie], day, "_i").withColumn("_m", micros).withColumn("_s", F.col("_m") - F.col("_i") * gap)
    run = with_running_max(base, key, [at, tie], "_s", day, "_run")
    return run.withColumn("wait_us", F.col("_run") + F.col("_i") * gap - F.col("_m")).drop("_i", "_m", "_s", "_run")


def repeated_pages(pages: DataFrame, key: list[str], page: str, content: Column) -> DataFrame:
    """Pages whose content was delivered before under the same key: ``key, page, first_page``."""
    d = pages.select(*key, page, F.sha2(content, 256).alias("digest"))
    first = d.groupBy(*key, "digest").agg(F.min(page).alias("first_page"), F.count("*").alias("n")).where("n > 1")
    return d.join(first, [*key, "digest"]).where(F.col(page) > F.col("first_page")).select(*key, page, "first_page")


def member_changes(old: DataFrame, new: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """Members added, removed or changed between two states: ``key, change``; equal members are left out."""
    o = old.select(*key, F.struct(*fields).alias("_o"), F.lit(True).alias("_in_old"))
    n = new.select(*key, F.struct(*fields).alias("_n"), F.lit(True).alias("_in_new"))
    j = o.join(n, key, "full")
    change = F.when(F.col("_in_old").isNull(), "added").when(F.col("_in_new").isNull(), "removed").when(~F.col("_o").eqNullSafe(F.col("_n")), "changed")
    return j.select(*key, change.alias("change")).where("change is not null")


def ready(rows: DataFrame, group: list[str], good: Column) -> DataFrame:
    """Whether all rows of a group are good; a null is not."""
    return rows.groupBy(*group).agg(F.bool_and(F.coalesce(good, F.lit(False))).alias("ready"), F.count("*").alias("n"))


def passed(rows: DataFrame, keys: list[str], criterion: Column) -> DataFrame:
    """Per key whether all criteria are true, and how many there are: ``keys, passed, requests``; a null is not true."""
    return rows.groupBy(*keys).agg(F.bool_and(F.coalesce(criterion, F.lit(False))).alias("passed"), F.count("*").alias("requests"))
