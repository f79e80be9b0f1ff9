"""Filling containers of fixed capacity with items that are not split.

Harmonic packing: an item of size s belongs to class k when s is in
(capacity/(k+1), capacity/k]; k items of class k always fit into one container.
Every worker packs its own partition by class with this fixed count, without a
shuffle or any word to another worker, so the operator scales with the input. The
space that a class leaves free is then given, largest fitting item first, to items
of smaller classes of the same partition. An item larger than the capacity is cut
into full containers and one rest, which is packed like any other item.

A partition leaves at most one container per class not full, so the loss against
packing everything together is bounded by classes x partitions containers.

Defined cases: an item of null or no size takes no room and has a null container;
repeated rows are packed as often as they occur; an empty table gives an empty
result. Container numbers are unique over the whole result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fill(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item (sizes 1..capacity)."""
    out = np.full(len(sizes), -1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i in np.argsort(sizes, kind="stable")[::-1].tolist():
        stacks[sizes[i]].append(i)
    there = 0
    for s in np.unique(sizes).tolist():
        there |= 1 << s
    container = 0
    while there:
        size = there.bit_length() - 1
        k, free, placed, top = capacity // size, capacity, 0, size
        low = capacity // (k + 1) + 1
        while there:
            room = there & ((1 << (min(free, top) + 1)) - 1)
            size = room.bit_length() - 1
            if size < 1:
                break
            if placed < k and size < low:
                placed = k  # the class is used up; what follows are smaller classes
            elif placed == k and size >= low:
                top = low - 1  # the class has its count in this container
                continue
            out[stacks[size].pop()] = container
            placed += placed < k
            free -= size
            if not stacks[size]:
                there &= ~(1 << size)
        container += 1
    return out


def pack(df: DataFrame, key: Column, size: Column, capacity: int) -> DataFrame:
    """``key, part, n, container``: which part of which item lies in which container."""
    rows = df.select(key.alias("key"), size.cast("long").alias("n"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        # in an order of their own, so that a task run again packs alike
        pdf = pd.concat(held, ignore_index=True).sort_values(["n", "key"], kind="stable", ignore_index=True)
        n = pdf["n"].fillna(0).to_numpy(np.int64)
        empty = n <= 0
        full, rest = np.where(empty, 0, n // capacity), np.where(empty, 0, n % capacity)
        parts = np.where(empty, 1, full + (rest > 0))
        row = np.repeat(np.arange(len(n)), parts)
        part = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
        used = np.where(part < full[row], capacity, rest[row])
        whole, loose = used == capacity, (used > 0) & (used < capacity)
        box = np.full(len(row), -1, np.int64)
        box[whole] = np.arange(whole.sum())
        box[loose] = fill(used[loose], capacity) + whole.sum()
        base = TaskContext.get().partitionId() << 36
        container = pd.array(box + base, dtype="Int64")
        container[box < 0] = pd.NA
        yield pd.DataFrame({"key": pdf["key"].to_numpy()[row], "part": part.astype(np.int32), "n": used, "container": container})

    return rows.mapInPandas(run, f"key {kind}, part int, n long, container long")
