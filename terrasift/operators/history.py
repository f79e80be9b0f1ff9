"""Bitemporal ledger of changing attributes.

An observation says what an entity's attributes were at a valid moment; it is
recorded at a later, independent moment (here an arrival number). The ledger keeps
every interval that was ever believed:

``valid_from .. valid_to``        when the attributes held (to: exclusive, null = open)
``recorded_from .. recorded_to``  while this row was the belief (null = still is)

A late observation falls into an interval that is already there. It splits the
interval: the old row is closed in recorded time, a shorter one and a new one are
written. Nothing is overwritten, so every past state can be read with
``recorded_from <= t and (recorded_to is null or recorded_to > t)``.

Sweep line: with the observations of an entity in valid order, the interval a late
observation x splits belongs to the nearest earlier-recorded observation on its
left, and x itself ends at the nearest earlier-recorded one on its right. A stack
finds both in one pass over a sorted partition.

Skew: rows are *range*-partitioned by (entity, valid time, order, recorded), so an
entity of any size is spread over many tasks, none of which holds more than its
range; the number of ranges follows the number of rows. What crosses a border is settled by one small summary per partition (at most
two entries each, so bounded by the number of partitions) and, for the few
observations whose neighbour lies in another partition, by an as-of window over
that one partition. An interval that was split more than ``MOST_SPLITS`` times (a
backfill that arrives backwards) has its rows chained in pieces of arrival numbers.

Every row names the observation that ends it (``closed_by``), so what was valid
before is found by a join of intervals, without an order of all rows of an entity.

Defined cases: observations with a null entity or null recorded number are left
out; null attributes equal null attributes; a null valid time sorts first; the same
observation stored twice counts once; ties in valid time go by order, then by
recorded number; empty input gives an empty ledger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrasift.operators.ordered import with_next
from terrasift.session import cut_lineage

KEY = ["entity", "valid", "ord", "rec"]
ROWS_A_RANGE = 500_000
MOST_SPLITS = 1_000_000


def _nearest_smaller_left(rec: np.ndarray, seg: np.ndarray) -> np.ndarray:
    """For each row the index of the nearest smaller ``rec`` before it in its segment, else -1."""
    out = np.full(len(rec), -1, np.int64)
    stack: list[int] = []
    values, starts, now = rec.tolist(), seg.tolist(), -1
    for i, r in enumerate(values):
        if starts[i] != now:
            now, stack = starts[i], []
        while stack and values[stack[-1]] > r:
            stack.pop()
        if stack:
            out[i] = stack[-1]
        stack.append(i)
    return out


def _changes(column: pa.ChunkedArray) -> np.ndarray:
    """Whether each value differs from the one before; the first one does. Nulls equal nulls."""
    ids = column.combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    out = np.ones(len(ids), bool)
    out[1:] = ids[1:] != ids[:-1]
    return out


def _sweep(rows: pa.Table) -> pa.Table:
    """Neighbours as far as one sorted partition tells them."""
    new = _changes(rows["entity"])
    same = ~(new | _changes(rows["valid"]) | _changes(rows["ord"]) | _changes(rows["rec"]))
    if same.any():
        rows = rows.filter(pa.array(~same))
        new = _changes(rows["entity"])
    n = len(rows)
    seg = np.cumsum(new)
    rec = rows["rec"].to_numpy()
    left = _nearest_smaller_left(rec, seg)
    right = _nearest_smaller_left(rec[::-1], seg[::-1])[::-1]
    right = np.where(right >= 0, n - 1 - right, -1)
    take = lambda name, at: rows[name].combine_chunks().take(pa.array(at, pa.int64(), mask=at < 0))
    more = {
        "pid": pa.array(np.full(n, TaskContext.get().partitionId()), pa.int32()), "pos": pa.array(np.arange(n), pa.int64()),
        "pred": take("rec", left), "succ_valid": take("valid", right), "succ": take("rec", right), "first_seg": pa.array(seg == 1), "last_seg": pa.array(seg == (seg[-1] if n else 0)),
    }
    for name, column in more.items():
        rows = rows.append_column(name, column)
    return rows


def ledger(
    df: DataFrame, entity: Column, valid: Column, recorded: Column, attributes: dict[str, Column], order: Column | None = None,
    rows_a_range: int = ROWS_A_RANGE, most_splits: int = MOST_SPLITS, keep: list[str] | None = None,
) -> DataFrame:
    """The bitemporal ledger of ``df``.

    Columns: ``entity, observation, valid_from, in_moment, valid_to, closed_by,
    recorded_from, recorded_to, digest`` and the attributes (those named in ``keep``,
    by default all). ``observation`` is the recorded number of the observation that gave the attributes, ``closed_by`` that
    of the one that ends the interval; ``in_moment`` orders observations of one
    moment; ``digest`` is one number for all attributes.
    """
    names = list(attributes) if keep is None else keep
    rows = df.select(
        entity.cast("string").alias("entity"), valid.cast("timestamp_ntz").alias("valid"), F.coalesce((order if order is not None else F.lit(0)).cast("long"), F.lit(-(2**62))).alias("ord"),
        recorded.cast("long").alias("rec"), *[c.cast("string").alias(f"a_{k}") for k, c in attributes.items()],
    ).where("entity is not null and rec is not null")
    rows = rows.withColumn("fp", F.xxhash64(F.to_json(F.struct(*[f"a_{k}" for k in attributes])))).drop(*[f"a_{k}" for k in attributes if k not in names])
    rows = cut_lineage(rows)  # ranges are found by sampling, so the rows are read twice
    ranges = -(-rows.count() // rows_a_range)
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = rows.repartitionByRange(ranges, *KEY) if ranges > usual else rows.repartitionByRange(*KEY)
    sorted_rows = spread.sortWithinPartitions(*KEY)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema.fields)}, pid int, pos long, pred long, succ_valid timestamp_ntz, succ long, first_seg boolean, last_seg boolean"

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield from _sweep(pa.Table.from_batches(held)).to_batches(max_chunksize=20_000)

    swept = cut_lineage(sorted_rows.mapInArrow(sweep, schema))
    edge = (
        swept.where("first_seg or last_seg").groupBy("pid", "entity")
        .agg(F.min("rec").alias("least"))
        .orderBy("pid").collect()
    )  # at most two rows a partition
    by_entity: dict[str, list] = {}
    for e in edge:
        by_entity.setdefault(e["entity"], []).append((e["pid"], e["least"]))
    by_entity = {k: v for k, v in by_entity.items() if len(v) > 1}
    if not by_entity:
        done = swept.select("*", F.lit(None).cast("int").alias("left_pid"), F.lit(None).cast("int").alias("right_pid"))
    else:
        done = swept.mapInPandas(_across(by_entity), schema + ", left_pid int, right_pid int")
        done = _settle(done, schema)
    return _intervals(done, names, most_splits)


def _across(by_entity: dict[str, list]):
    """Looks up, for rows at a partition's border, the partition their neighbour is in.

    A row looks beyond the border only if some partition there has an earlier-recorded
    row, which one comparison with the least number there tells for all rows at once.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            left_pid, right_pid, rec = [None] * len(pdf), [None] * len(pdf), pdf["rec"].to_numpy()
            asks_left = (pdf["first_seg"] & pdf["pred"].isna()).to_numpy()
            asks_right = (pdf["last_seg"] & pdf["succ"].isna()).to_numpy()
            edge = np.flatnonzero((asks_left | asks_right) & pdf["entity"].isin(by_entity.keys()).to_numpy())
            for (entity, pid), at in pdf.iloc[edge].groupby(["entity", "pid"]).indices.items():
                at = edge[at]
                near = by_entity[entity]
                earlier, later = [x for x in reversed(near) if x[0] < pid], [x for x in near if x[0] > pid]
                if earlier:
                    for i in at[asks_left[at] & (rec[at] > min(x[1] for x in earlier))]:
                        left_pid[i] = next(p for p, least in earlier if least < rec[i])
                if later:
                    for i in at[asks_right[at] & (rec[at] > min(x[1] for x in later))]:
                        right_pid[i] = next(p for p, least in later if least < rec[i])
            yield pdf.assign(left_pid=pd.array(left_pid, dtype="Int32"), right_pid=pd.array(right_pid, dtype="Int32"))

    return run


def _settle(done: DataFrame, schema: str) -> DataFrame:
    """Fills neighbours that lie in another partition, by as-of windows over that partition."""
    done = cut_lineage(done)

    def asof(side: str) -> DataFrame:
        """(rec, found) for rows whose neighbour lies in partition ``side_pid``: there the nearest row with a smaller ``rec``."""
        ask = done.where(f"{side}_pid is not null").select("entity", F.col(f"{side}_pid").alias("at"), "rec", F.lit(None).cast("struct<pos:bigint,rec:bigint,valid:timestamp_ntz>").alias("there"))
        have = done.join(ask.select("entity", F.col("at").alias("pid")).distinct(), ["entity", "pid"], "left_semi").select(
            "entity", F.col("pid").alias("at"), "rec", F.struct("pos", "rec", "valid").alias("there")
        )
        w = Window.partitionBy("entity", "at").orderBy("rec").rowsBetween(Window.unboundedPreceding, -1)
        best = F.max("there").over(w) if side == "left" else F.min("there").over(w)
        return ask.unionByName(have).select("entity", "rec", F.col("there").isNull().alias("asks"), best.alias(f"{side}_found")).where("asks").drop("asks")

    out = done.join(asof("left"), ["entity", "rec"], "left").join(asof("right"), ["entity", "rec"], "left")
    return out.withColumn("pred", F.coalesce("pred", "left_found.rec")).withColumn("succ_valid", F.when(F.col("succ").isNotNull(), F.col("succ_valid")).otherwise(F.col("right_found.valid"))).withColumn("succ", F.coalesce("succ", "right_found.rec")).drop("left_found", "right_found")


def _intervals(done: DataFrame, names: list[str], most_splits: int) -> DataFrame:
    """One row for every interval that was ever believed: an observation's first, and one more each time a later one split it."""
    attrs = F.struct(F.col("valid").alias("valid_from"), F.col("ord").alias("in_moment"), F.col("fp").alias("digest"), *[F.col(f"a_{k}").alias(k) for k in names])
    first = done.select("entity", F.col("rec").alias("observation"), F.col("rec").alias("recorded_from"), F.col("succ_valid").alias("valid_to"), F.col("succ").alias("closed_by"), attrs.alias("own"))
    split = done.where("pred is not null")
    later = split.select("entity", F.col("pred").alias("observation"), F.col("rec").alias("recorded_from"), F.col("valid").alias("valid_to"), F.col("rec").alias("closed_by"), F.lit(None).cast(first.schema["own"].dataType).alias("own"))
    busiest = split.groupBy("entity", "pred").count().agg(F.max("count")).first()[0] or 0
    key, rows = ["entity", "observation"], first.unionByName(later)
    if busiest <= most_splits:
        w = Window.partitionBy(*key).orderBy("recorded_from")
        rows = rows.withColumns({"recorded_to": F.lead("recorded_from").over(w), "own": F.first("own", ignorenulls=True).over(w)})
    else:
        # arrival numbers are distinct, so a piece holds at most ``most_splits`` rows of an interval
        piece = F.floor(F.col("recorded_from") / most_splits)
        pieces = rows.withColumn("piece", piece).groupBy(*key, "piece").agg(F.first("own", ignorenulls=True).alias("own"))
        owner = pieces.where("own is not null").select(*key, F.col("own").alias("whose"))
        whose = pieces.select(*key, "piece").join(owner, key)
        chained = with_next(rows.drop("own"), key, ["recorded_from"], ["recorded_from"], piece, "after").withColumn("piece", piece)
        rows = chained.join(whose, [*key, "piece"]).select(*key, "recorded_from", "valid_to", "closed_by", F.col("after.recorded_from").alias("recorded_to"), F.col("whose").alias("own"))
    return rows.select(*key, "own.valid_from", "own.in_moment", "valid_to", "closed_by", "recorded_from", "recorded_to", "own.digest", *[f"own.{k}" for k in names])


def as_recorded(led: DataFrame, recorded: int | None = None) -> DataFrame:
    """What was believed when ``recorded`` had arrived; by default what is believed now."""
    if recorded is None:
        return led.where("recorded_to is null")
    return led.where((F.col("recorded_from") <= recorded) & (F.col("recorded_to").isNull() | (F.col("recorded_to") > recorded)))


def openings(current: DataFrame) -> DataFrame:
    """``entity, observation, closed_by, digest, valid_from, in_moment``: the intervals of one belief whose attributes differ from those of the interval they follow, or that follow none.

    An interval follows the one that its observation closes; each is closed by one
    observation at most, so the join is one to one.
    """
    current = cut_lineage(current.select("entity", "observation", "closed_by", "digest", "valid_from", "in_moment"))  # used twice
    before = current.where("closed_by is not null").select("entity", F.col("closed_by").alias("observation"), F.col("digest").alias("_before"))
    return current.join(before, ["entity", "observation"], "left").where("_before is null or _before <> digest").drop("_before")


def versions(led: DataFrame) -> DataFrame:
    """Current versions: neighbouring intervals with equal attributes become one.

    ``entity, observation, valid_from, valid_to``; the observation is the one that
    opens the version.
    """
    opening = openings(as_recorded(led)).select("entity", "observation", "valid_from", "in_moment")
    out = with_next(opening, ["entity"], ["valid_from", "in_moment", "observation"], ["valid_from"], F.unix_date(F.to_date("valid_from")), "_n")
    return out.select("entity", "observation", "valid_from", F.col("_n.valid_from").alias("valid_to"))
