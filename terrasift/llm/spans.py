"""Long exact spans shared between records.

A character of a record is covered when it lies in a stretch of ``SPAN`` code
points that also stands verbatim in another record. The operator finds the maximal
runs of covered characters, exactly, without comparing pairs of records.

Content-defined chunks. A gear hash (each step shifts the state left by one bit and
adds the gear value of the next character) is rolled over the text, so that its
state depends on the last ``GEAR`` characters only. Every window of ``SPAN``
characters is given the chunk border where this hash is smallest among the first
``REACH`` places of the window. The border depends on nothing outside the window:
equal windows have the same border at the same distance, however much was inserted
before them. Windows with one border form a variable chunk, and the ``SPAN - REACH
+ 1`` characters after the border lie in all of them; their digest is the key.

1. Per block of texts: borders, keys, chunk digests (narrow, vectorised). Chunks
   that two records of the block share are settled there; of each only two copies
   go on, and later blocks of the task settle it without sending any, so a chunk
   that a third of all rows hold arrives twice per task. A key that a task has sent
   ``LOCAL_HOT`` times (say of a footer shorter than ``SPAN`` in unlike mails) is sent
   no more: further chunks go on under their record as open and hot ones, and one row
   tells the key's task that the key is hot, so no task holds all rows of a key.
2. One shuffle by key. Keys of a single record are dropped; chunks whose digest
   occurs in two records are covered whole. What is left are chunks at the ends of
   shared stretches: same key, but not all of their windows are shared.
3. Records with such chunks meet their text (a merge join by record; the text of
   every record takes part in this shuffle), and the windows of one key
   are compared with each other at equal distance from the border, in a dictionary
   per distance, so linearly. A key with more than ``HOT`` such chunks is split by
   its windows' digests before this shuffle: each window goes to the task of its own
   digest, and of equal windows in one batch only two copies go on.
4. Runs are merged per record.

Equal digests of a chunk count only under an equal key, so two independent 64-bit
digests have to agree.

Defined cases: null texts and texts shorter than ``SPAN`` have no run; a record
repeated under the same id is one record; equal texts under two ids cover each
other wholly; ids are taken as they are; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN = 200
GEAR = 16
REACH = 64
KEY = SPAN - REACH + 1
BLOCK = 1_000_000
SLOT_BITS = 22
MOST_KNOWN = 1_000_000  # memory of a task; beyond it chunks go on twice per block
HOT = 20_000
LOCAL_HOT = 2048
_U64 = np.uint64


@lru_cache(maxsize=1)
def _tables():
    rng = np.random.default_rng(20_240_229)
    gear = rng.integers(0, 2**32, 65536, dtype=np.uint32)
    digest = rng.integers(0, 2**64, 65536, dtype=_U64)
    base = 0x9E3779B97F4A7C15
    return gear, digest, base, pow(base, -1, 2**64)


@lru_cache(maxsize=2)
def _powers(n: int):
    _, _, base, inverse = _tables()
    out = []
    for b in (base, inverse):
        p = np.full(n, b, _U64)
        p[0] = 1
        out.append(np.cumprod(p))
    return out


def chunks(text: str, lengths: np.ndarray) -> dict[str, np.ndarray]:
    """Chunks of consecutive texts: text number, first and last window start, border, key, digest.

    Positions are those in ``text``, the texts joined; windows never reach over the
    end of their own text.
    """
    gear, digest, _, _ = _tables()
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    low = c & np.uint32(0xFFFF)
    h = gear[low] + (c >> np.uint32(16)) * np.uint32(0x9E3779B1)
    step = 1
    while step < GEAR:
        nxt = h.copy()
        nxt[step:] += h[:-step] << np.uint32(step)
        h, step = nxt, step * 2
    pad = np.full(SPAN, 0xFFFFFFFF, np.uint32)
    v = (np.concatenate([h, pad]).astype(_U64) << _U64(32)) | np.arange(len(h) + SPAN, dtype=_U64)
    step = 1
    while step < REACH:
        v[:-step] = np.minimum(v[:-step], v[step:])
        step *= 2
    many = np.maximum(lengths - SPAN + 1, 0)
    total = int(many.sum())
    if not total:
        return {k: np.zeros(0, np.int64) for k in ("doc", "first", "last", "border", "key", "own")}
    doc = np.repeat(np.arange(len(lengths)), many)
    at = np.arange(total) - np.repeat(np.cumsum(many) - many, many) + starts[doc]
    border = (v[at + GEAR - 1] & _U64(0xFFFFFFFF)).astype(np.int64) - (GEAR - 1)
    new = np.ones(total, bool)
    new[1:] = (border[1:] != border[:-1]) | (doc[1:] != doc[:-1])
    i = np.flatnonzero(new)
    first, last, border, doc = at[i], at[np.append(i[1:], total) - 1], border[i], doc[i]
    power, inverse = _powers(1 << max(20, int(len(c) + 1).bit_length()))
    sums = np.zeros(len(c) + 1, _U64)
    np.cumsum((digest[low] + c) * power[: len(c)], out=sums[1:])
    key = (sums[border + KEY] - sums[border]) * inverse[border]
    own = (sums[last + SPAN] - sums[first]) * inverse[first]
    own ^= ((border - last) * REACH + (border - first) + 1).astype(_U64) * _U64(0xD6E8FEB86659FD93)
    return {"doc": doc, "first": first, "last": last, "border": border, "key": key, "own": own}


def merge_runs(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unites overlapping and touching intervals."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    i = np.flatnonzero(new)
    return start[i], end[np.append(i[1:], len(start)) - 1]


def _place(border: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Border and the distances of the first and last window from it, in one number."""
    return (border * REACH + (border - first)) * REACH + (border - last)


def _unplace(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    border = place // (REACH * REACH)
    return border, border - place // REACH % REACH, border - place % REACH


def _scan(limit: int, local_hot: int):
    """Step 1 on batches (id, text).

    Rows: chunks (runs null); the settled runs of a record (own null); chunks of a hot
    key (runs empty, key in own); signs that a key is hot (place null, runs null).
    """
    names = ["key", "own", "id", "place", "runs"]

    def block(known: set, slots: np.ndarray, often: np.ndarray, told: set, ids: pa.Array, number: np.ndarray, texts: list[str], offsets: np.ndarray) -> pa.RecordBatch:
        lengths = np.array([len(t) for t in texts], np.int64)
        got = chunks("".join(texts), lengths)
        piece = got["doc"]
        shift = (np.cumsum(lengths) - lengths - offsets)[piece]
        doc, first, last, border = number[piece], got["first"] - shift, got["last"] - shift, got["border"] - shift
        order = np.lexsort((doc, got["own"], got["key"]))
        key, own, d = got["key"][order], got["own"][order], doc[order]
        new = np.ones(len(order), bool)
        new[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
        group = np.cumsum(new) - 1
        begin = np.flatnonzero(new)
        stop = np.append(begin[1:], len(order)) - 1
        shared = d[begin] != d[stop]
        k, o = key[begin], own[begin]
        slot = (k >> _U64(64 - SLOT_BITS)).astype(np.int64)
        sent = np.zeros(len(k), bool)
        for i in np.flatnonzero(slots[slot]):
            sent[i] = (k[i], o[i]) in known
        if len(known) < MOST_KNOWN:
            fresh = shared & ~sent
            known.update(zip(k[fresh].tolist(), o[fresh].tolist()))
            slots[slot[fresh]] = True
        goes_on = ~shared[group]
        goes_on[begin], goes_on[stop] = True, True
        goes_on &= ~sent[group]
        shared |= sent
        settled = order[shared[group]]
        keep = np.sort(order[goes_on])  # in the order of the texts, in which ids and places pack well
        at_slot = (got["key"][keep] >> _U64(64 - SLOT_BITS)).astype(np.int64)
        is_hot = often[at_slot] >= local_hot
        often += np.bincount(at_slot, minlength=len(often)).astype(often.dtype)
        hot, keep = keep[is_hot], keep[~is_hot]
        tell = np.array(sorted(set(got["key"][hot].tolist()) - told), _U64)
        told.update(tell.tolist())
        runs_of: list[list[int]] = []
        run_doc = np.unique(doc[settled])
        where = np.argsort(doc[settled], kind="stable")
        bounds = np.searchsorted(doc[settled][where], run_doc)
        for a, b in zip(bounds, np.append(bounds[1:], len(where))):
            s, e = merge_runs(first[settled][where[a:b]], last[settled][where[a:b]] + SPAN)
            runs_of.append(np.column_stack([s, e]).ravel().tolist())
        n, h, m, s = len(keep), len(hot), len(run_doc), len(tell)
        both, lists = np.concatenate([keep, hot]), pa.list_(pa.int64())
        spread = (np.concatenate([doc[hot], run_doc]).astype(_U64) + _U64(1)) * _U64(0x9E3779B97F4A7C15)
        i64 = lambda *parts: pa.array(np.concatenate([p.view(np.int64) for p in parts]), pa.int64())
        return pa.RecordBatch.from_arrays(
            [
                i64(got["key"][keep], spread, tell),
                pa.concat_arrays([i64(got["own"][keep], got["key"][hot]), pa.nulls(m + s, pa.int64())]),
                ids.take(pa.array(np.concatenate([doc[both], run_doc, np.zeros(s, np.int64)]), pa.int64())),
                pa.concat_arrays([pa.array(_place(border[both], first[both], last[both]), pa.int64()), pa.nulls(m + s, pa.int64())]),
                pa.concat_arrays([pa.nulls(n, lists), pa.array([[]] * h + runs_of, lists), pa.nulls(s, lists)]),
            ],
            names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set = set()  # chunks of two records that this task has sent on
        slots = np.zeros(1 << SLOT_BITS, bool)  # where their keys are, to look up few others
        often = np.zeros(1 << SLOT_BITS, np.uint32)  # chunks sent by slot of their key; keys that share a slot count together
        told: set = set()  # hot keys whose task knows
        held_by_task = (known, slots, often, told)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            same = ids.dictionary_encode()
            number, ids = same.indices.to_numpy(zero_copy_only=False).astype(np.int64), same.dictionary
            part: list[tuple[int, str, int]] = []
            held = 0
            for i in range(len(texts)):
                t = texts[i].as_py()
                for at in range(0, len(t) - SPAN + 1, limit):
                    piece = t if len(t) < limit else t[at : at + limit + SPAN - 1]
                    part.append((number[i], piece, at))
                    held += len(piece)
                    if held >= limit:
                        yield block(*held_by_task, ids, *_columns(part))
                        part, held = [], 0
            if part:
                yield block(*held_by_task, ids, *_columns(part))

    return run


def _columns(part: list[tuple[int, str, int]]):
    return np.array([p[0] for p in part], np.int64), [p[1] for p in part], np.array([p[2] for p in part], np.int64)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 3a on batches (id, items, text): settled runs per record, and the windows of open chunks."""
    names = ["key", "id", "many", "border", "first", "last", "windows", "runs"]
    for batch in batches:
        items, texts = batch.column(1), batch.column(2)
        flat = items.flatten()
        keys, flags, old = flat.field(0).to_numpy(zero_copy_only=False), flat.field(2).to_numpy(zero_copy_only=False), flat.field(3)
        borders, firsts, lasts = _unplace(flat.field(1).fill_null(0).to_numpy(zero_copy_only=False))
        hot: dict[tuple, list] = {}
        bounds = items.offsets.to_numpy() - items.offsets[0].as_py()
        out: list[list] = [[] for _ in names]
        for i in range(batch.num_rows):
            a, b = bounds[i], bounds[i + 1]
            text, key, border, first, last = None, keys[a:b], borders[a:b], firsts[a:b], lasts[a:b]
            covered, is_open, many, is_hot = (flags[a:b] & bit != 0 for bit in (1, 2, 4, 8))
            starts, ends = [first[covered]], [last[covered] + SPAN]
            for r in old.slice(a, b - a).drop_null().to_pylist():
                starts.append(np.array(r[0::2]))
                ends.append(np.array(r[1::2]))
            s, e = merge_runs(np.concatenate(starts).astype(np.int64), np.concatenate(ends).astype(np.int64))
            if len(s):
                for col, x in zip(out, ((i + 1) * 0x9E3779B97F4A7C15 % 2**64 - 2**63, i, False, None, None, None, None, np.column_stack([s, e]).ravel().tolist())):
                    col.append(x)
            for j in np.flatnonzero(is_open):
                text = texts[i].as_py() if text is None else text
                lo, hi = int(first[j]), int(last[j])
                if hi + SPAN > len(text):
                    continue
                if is_hot[j]:
                    for w in range(lo, hi + 1):
                        digest = blake2b(text[w : w + SPAN].encode(), digest_size=16).hexdigest()
                        hot.setdefault((int(key[j]), int(border[j]) - w, digest), []).append((i, w, bool(many[j])))
                    continue
                for col, x in zip(out, (int(key[j]), i, bool(many[j]), int(border[j]), lo, hi, text[lo : hi + SPAN], None)):
                    col.append(x)
        for (k, away, digest), held in hot.items():
            two = any(m for _, _, m in held) or len({batch.column(0)[i] for i, _, _ in held}) > 1
            if two:
                for i, w, m in held:
                    if not m:
                        for col, x in zip(out, (k ^ (i + 1) * 0x9E3779B97F4A7C15 % 2**62, i, False, None, None, None, None, [w, w + SPAN])):
                            col.append(x)
            own = int.from_bytes(blake2b(f"{k} {away} {digest}".encode(), digest_size=8).digest(), "big", signed=True)
            for i, w, _ in held[:1] if two else held:
                for col, x in zip(out, (own, i, two, w + away, w, w, f"{k} {digest}", None)):
                    col.append(x)
        types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())]
        cols = [pa.array(c, t) for c, t in zip(out, types)]
        cols[1] = batch.column(0).take(cols[1])
        yield pa.RecordBatch.from_arrays(cols, names)


def shared_windows(group: list[tuple]) -> list[tuple]:
    """(id, start, end) covered in the open chunks of one key: (id, many, border, first, last, text)."""
    if len(group) < 2:
        return []
    least, most = {}, {}
    for away in range(min(b - l for _, _, b, _, l, _ in group), max(b - f for _, _, b, f, _, _ in group) + 1):
        seen: dict = {}
        there = [(i, g[5][g[2] - away - g[3] : g[2] - away - g[3] + SPAN]) for i, g in enumerate(group) if g[3] <= g[2] - away <= g[4]]
        for i, window in there:
            who = True if group[i][1] else (group[i][0],)
            held = seen.setdefault(window, who)
            if held is not True and (who is True or held != who):
                seen[window] = True
        for i, window in there:
            if seen[window] is True and not group[i][1]:
                least.setdefault(i, away)
                most[i] = away
    return [(group[i][0], group[i][2] - most[i], group[i][2] - least[i] + SPAN) for i in least]


def _compare(kind: pa.DataType):
    """Step 3b on rows sorted by key; settled runs pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group = None, []
        for batch in batches:
            ids, runs = [], []
            c = batch.to_pydict()
            for key, who, many, border, first, last, text, old in zip(*(c[k] for k in ("key", "id", "many", "border", "first", "last", "windows", "runs"))):
                if old is not None:
                    ids.append(who)
                    runs.append(old)
                    continue
                if key != now:
                    for w, s, e in shared_windows(group):
                        ids.append(w)
                        runs.append([s, e])
                    now, group = key, []
                group.append((who, many, border, first, last, text))
            yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(runs, pa.list_(pa.int64()))], ["id", "runs"])
        got = shared_windows(group)
        yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], kind), pa.array([[g[1], g[2]] for g in got], pa.list_(pa.int64()))], ["id", "runs"])

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        who, starts, ends = [], [], []
        for i, lists in enumerate(batch.column(1).to_pylist()):
            flat = np.array([x for r in lists for x in r], np.int64)
            s, e = merge_runs(flat[0::2], flat[1::2])
            who += [i] * len(s)
            starts.append(s)
            ends.append(e)
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(who, pa.int64())), pa.array(cat(starts), pa.int64()), pa.array(cat(ends), pa.int64())], ["id", "span_start", "span_end"])


def shared_spans(df: DataFrame, key: Column, text: Column, hot: int = HOT, block: int = BLOCK, local_hot: int = LOCAL_HOT) -> DataFrame:
    """``id, span_start, span_end``: maximal runs covered by text of another record."""
    docs = df.select(key.alias("id"), text.cast("string").alias("text")).where(F.col("id").isNotNull() & (F.length("text") >= SPAN))
    kind = docs.schema["id"].dataType
    ddl = kind.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(kind)
    found = docs.mapInArrow(_scan(block, local_hot), f"key long, own long, id {ddl}, place long, runs array<bigint>")
    by_key = Window.partitionBy("key", "settled")
    by_chunk = Window.partitionBy("key", "settled", "own")
    single, covered = ~F.col("many"), ~F.col("settled") & F.col("many")
    apart = F.col("settled") & F.col("place").isNotNull()  # a chunk of a hot key
    judged = (
        found.withColumn("settled", F.col("runs").isNotNull()).repartition("key", "settled")
        .withColumn("copy", F.row_number().over(by_chunk.orderBy("id")))
        .withColumn("many", F.min("id").over(by_chunk) != F.max("id").over(by_chunk))
        .withColumns({
            "told": F.bool_or(F.col("place").isNull()).over(by_key) & ~F.col("settled"),
            "shared": F.min("id").over(by_key) != F.max("id").over(by_key), "some_single": F.bool_or(single).over(by_key),
            "size": F.sum((single | (F.col("copy") == 1)).cast("int")).over(by_key),
        })
        .where("(settled or shared or told) and (settled or place is not null)")
        .select(
            "id", F.when(apart, F.col("own")).otherwise(F.col("key")).alias("key"), "place",
            F.when(apart, 2 + 8).otherwise(
                F.when(covered, 1).otherwise(0) + F.when(~F.col("settled") & (single | ((F.col("some_single") | F.col("told")) & (F.col("copy") == 1))), 2).otherwise(0)
                + F.when(F.col("many"), 4).otherwise(0) + F.when(F.col("told") | (F.col("size") > hot), 8).otherwise(0)
            ).alias("flags"),
            "runs",
        )
    )
    per_doc = judged.groupBy("id").agg(F.collect_list(F.struct("key", "place", "flags", "runs")).alias("items"))
    # a merge join: rows come in the order of their ids, so that a task run again forms the same batches
    opened = per_doc.hint("merge").join(docs, "id").select("id", "items", "text").mapInArrow(
        _contexts, f"key long, id {ddl}, many boolean, border long, first long, last long, windows string, runs array<bigint>"
    )
    runs = opened.repartition("key").sortWithinPartitions("key").mapInArrow(_compare(arrow), f"id {ddl}, runs array<bigint>")
    return runs.groupBy("id").agg(F.collect_list("runs").alias("runs")).mapInArrow(_merge, f"id {ddl}, span_start long, span_end long")


def shared_share(spans: DataFrame, df: DataFrame, key: Column, text: Column) -> DataFrame:
    """Per record its length, the covered characters and their share (null for an empty or null text)."""
    sums = spans.groupBy("id").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared"))
    base = df.select(key.alias("id"), F.coalesce(F.length(text), F.lit(0)).cast("long").alias("n_chars")).distinct()
    return base.join(sums, "id", "left").select(
        "id", "n_chars", F.coalesce("shared", F.lit(0)).alias("shared_chars"),
        F.when(F.col("n_chars") > 0, F.round(F.coalesce("shared", F.lit(0)) / F.col("n_chars"), 6)).alias("share"),
    )
