"""The row before and running values per key, without one task per key.

A window over a key sorts all its rows in one task, which a key with a third of all
rows makes the slowest. Here a key's rows are cut into buckets of its order (a day, a
range of numbers). Windows run inside buckets; what crosses a bucket's border comes
from one summary row per bucket, combined before the shuffle. The bucket must not
decrease with the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bucketed(rows: DataFrame, bucket: Column) -> DataFrame:
    return rows.withColumn("_b", F.coalesce(bucket.cast("long"), F.lit(-(2**62))))


def _join(rows: DataFrame, side: DataFrame, key: list[str]) -> DataFrame:
    names = {k: f"_s_{k}" for k in key} | {"_b": "_s_b"}
    on = None
    for k, s in names.items():
        same = F.col(k).eqNullSafe(F.col(s))
        on = same if on is None else on & same
    return rows.join(side.withColumnsRenamed(names), on, "left").drop(*names.values())


def with_previous(rows: DataFrame, key: list[str], order: list[str], columns: list[str], bucket: Column, name: str = "previous") -> DataFrame:
    """``rows`` with a struct of ``columns`` of the row before in its key; null for a key's first row."""
    r = _bucketed(rows, bucket)
    near = F.lag(F.struct(*columns)).over(Window.partitionBy(*key, "_b").orderBy(*order))
    lasts = r.groupBy(*key, "_b").agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_last"))
    far = lasts.select(*key, "_b", F.lag("_last").over(Window.partitionBy(*key).orderBy("_b")).alias("_far"))
    return _join(r.withColumn("_near", near), far, key).withColumn(name, F.coalesce("_near", "_far")).drop("_near", "_far", "_b")


def with_next(rows: DataFrame, key: list[str], order: list[str], columns: list[str], bucket: Column, name: str = "next") -> DataFrame:
    """``rows`` with a struct of ``columns`` of the row after in its key; null for a key's last row."""
    r = _bucketed(rows, bucket)
    near = F.lead(F.struct(*columns)).over(Window.partitionBy(*key, "_b").orderBy(*order))
    firsts = r.groupBy(*key, "_b").agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("_first"))
    far = firsts.select(*key, "_b", F.lead("_first").over(Window.partitionBy(*key).orderBy("_b")).alias("_far"))
    return _join(r.withColumn("_near", near), far, key).withColumn(name, F.coalesce("_near", "_far")).drop("_near", "_far", "_b")


def with_rank(rows: DataFrame, key: list[str], order: list[str], bucket: Column, name: str = "rank") -> DataFrame:
    """``rows`` with their position in the order of their key, from 1."""
    r = _bucketed(rows, bucket)
    near = F.row_number().over(Window.partitionBy(*key, "_b").orderBy(*order))
    counts = r.groupBy(*key, "_b").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*key).orderBy("_b")) - F.col("_n")
    return _join(r.withColumn("_near", near), counts.select(*key, "_b", before.alias("_far")), key).withColumn(name, F.col("_near") + F.col("_far")).drop("_near", "_far", "_b")


def with_running_max(rows: DataFrame, key: list[str], order: list[str], value: str, bucket: Column, name: str = "running") -> DataFrame:
    """``rows`` with the largest ``value`` of their key so far."""
    r = _bucketed(rows, bucket)
    near = F.max(value).over(Window.partitionBy(*key, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    tops = r.groupBy(*key, "_b").agg(F.max(value).alias("_top"))
    far = tops.select(*key, "_b", F.max("_top").over(Window.partitionBy(*key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_far"))
    return _join(r.withColumn("_near", near), far, key).withColumn(name, F.greatest("_near", "_far")).drop("_near", "_far", "_b")


def asof_join(left: DataFrame, right: DataFrame, key: list[str], at: str, columns: list[str], bucket: Column, name: str = "match") -> DataFrame:
    """``left`` with a struct of ``columns`` of the latest ``right`` row of its key not after it; null when there is none.

    Both sides are laid on one line per key and bucket and the last right row is
    carried forward, so no pair is formed that is not the answer. Of right rows of one
    moment the greatest struct counts. Rows with a null moment match nothing.
    """
    rest = [c for c in left.columns if c not in (*key, at)]
    l = left.select(*key, at, F.struct(*rest, F.lit(True).alias("_is_left")).alias("_row"), F.lit(None).cast(right.select(F.struct(*columns).alias("m")).schema["m"].dataType).alias("_m"), F.lit(1).alias("_side"))
    r = right.where(F.col(at).isNotNull()).select(*key, at, F.lit(None).cast(l.schema["_row"].dataType).alias("_row"), F.struct(*columns).alias("_m"), F.lit(0).alias("_side"))
    line = _bucketed(l.unionByName(r), bucket)
    w = Window.partitionBy(*key, "_b").orderBy(F.col(at).asc_nulls_first(), "_side", "_m").rowsBetween(Window.unboundedPreceding, 0)
    near = line.withColumn("_near", F.last("_m", ignorenulls=True).over(w))
    lasts = line.where("_side = 0").groupBy(*key, "_b").agg(F.max_by("_m", F.struct(at, "_m")).alias("_last"))
    every = line.select(*key, "_b").distinct().join(lasts, [*key, "_b"], "left")
    far = every.select(*key, "_b", F.last("_last", ignorenulls=True).over(Window.partitionBy(*key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_far"))
    out = _join(near.where("_side = 1"), far, key)
    return out.select(*key, at, *[F.col("_row")[c].alias(c) for c in rest], F.when(F.col(at).isNotNull(), F.coalesce("_near", "_far")).alias(name)).select(*left.columns, name)
