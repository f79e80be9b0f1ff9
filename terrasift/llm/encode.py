"""Encoding of a whole corpus with a public tokenizer.

Texts of ordinary length are encoded where they are read, without a shuffle. Long
texts are cut into segments that are encoded as rows of their own, on any worker,
and put together again per document.

Exactness of the cuts (byte-level BPE). The tokenizer first splits a text by a
pattern that scans left to right and depends on nothing left of its position, so
two texts may be concatenated token by token wherever a split is certain:

* between a non-blank and a blank, a line end or a change between letters, digits
  and signs (for characters whose class is the same in every Unicode version), and
* before the last of several blanks.

A long stretch without such a place ("unsplit text") is one single unit of the
tokenizer, within which merges may reach over any cut. Its halves are encoded
apart and joined in a tree: around each join a window of tokens is encoded again,
twice as large each time, until its first and last token agree with what stands
on either side. A sequence of BPE tokens is the encoding of its text exactly if
each neighbouring pair is, so after agreement the whole is exact. A long stretch
that is neither (characters of unknown class) is encoded in one piece.

Defined cases: null and empty texts have an empty list; strings of special tokens
are ordinary text; repeated rows give repeated rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEGMENT_CHARS = 16_384

_LET = "A-Za-zÀ-ÖØ-öぁ-ゖァ-ヺ一-鿿가-힣"
_DIG = "0-9"
_SIGN = r"!-&(-/:-@\[-`{-~、。，：；"
_SAFE = re.compile(
    rf"(?<=\S)(?=[ \n])|(?<=[{_LET}])(?=[{_DIG}{_SIGN}'])|(?<=[{_DIG}])(?=[{_LET}{_SIGN}'])|(?<=[{_SIGN}])(?=[{_LET}{_DIG}])|(?<=[ \n\t\r])(?=[ \n\t\r]\S)"
)
_UNIT = re.compile(rf" ?[{_LET}]+| ?[{_DIG}]+| ?[{_SIGN}']+|[ \n\t\r]+")


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """Place of a tokenizer file; ``folder`` defaults to the installed public files."""
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def byte_bpe(path: str):
    """A byte-level BPE of a ``.tiktoken`` file, without special tokens."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def whole_text_encoder(path: str) -> Callable[[str], np.ndarray]:
    """An encoder of whole texts by the file's kind."""
    if path.endswith(".tiktoken"):
        enc = byte_bpe(path)
        return lambda text: np.asarray(enc.encode_to_numpy(text, disallowed_special=()), np.int32)
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = True
        return lambda text: np.array(tok.encode(text, add_special_tokens=False).ids, np.int32)
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda text: np.array(sp.encode(text), np.int32)


# ---- segments ----------------------------------------------------------------


def _last_safe(text: str, low: int, high: int) -> int | None:
    """The last safe cut in (low, high]."""
    reach = 64
    while True:
        a = max(low + 1, high - reach)
        last = None
        for m in _SAFE.finditer(text, a, min(len(text), high + 2)):
            if m.start() <= high:
                last = m.start()
        if last is not None and last > low:
            return last
        if a == low + 1:
            return None
        reach *= 4


def segments(text: str, size: int) -> list[tuple[str, bool]]:
    """Segments of ``text`` and whether each continues the unit of the one before."""
    out, at, n = [], 0, len(text)
    while n - at > size:
        cut = _last_safe(text, at, at + size)
        if cut is not None:
            out.append((text[at:cut], False))
            at = cut
            continue
        m = next((m for m in _SAFE.finditer(text, at + size) if m.start() > at), None)
        end = m.start() if m else n
        stretch = text[at:end]
        if _UNIT.fullmatch(stretch) and not (end == n and stretch.isspace()):
            out += [(stretch[i : i + size], i > 0) for i in range(0, len(stretch), size)]
        else:
            out.append((stretch, False))
        at = end
    if at < n:
        out.append((text[at:], False))
    return out


def join_tokens(enc, left: list[int], right: list[int]) -> list[int]:
    """Tokens of one unit from those of its two parts, by growing windows around the join."""
    width = 4
    while True:
        a, b = max(0, len(left) - width), min(len(right), width)
        window = b"".join(map(enc.decode_single_token_bytes, left[a:] + right[:b]))
        again = enc._encode_single_piece(window)
        if (a == 0 or again[0] == left[a]) and (b == len(right) or again[-1] == right[b - 1]):
            return left[:a] + again + right[b:]
        if a == 0 and b == len(right):
            return again
        width *= 2


def join_tree(enc, parts: list[list[int]]) -> list[int]:
    """Joins the parts of one unit pairwise, level by level."""
    while len(parts) > 1:
        parts = [join_tokens(enc, parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def encode_segments(enc, parts: list[tuple[str, bool]]) -> list[list[int]]:
    """Tokens of each segment; parts of one unit are encoded as pieces of a unit."""
    unit = [glued or (i + 1 < len(parts) and parts[i + 1][1]) for i, (_, glued) in enumerate(parts)]
    return [enc._encode_single_piece(t.encode()) if u else enc.encode_ordinary(t) for (t, _), u in zip(parts, unit)]


def assemble(enc, ids: list[list[int]], glued: list[bool]) -> list[int]:
    """Tokens of the document from those of its segments."""
    out, i = [], 0
    while i < len(ids):
        j = i + 1
        while j < len(ids) and glued[j]:
            j += 1
        out += join_tree(enc, ids[i:j]) if j - i > 1 else ids[i]
        i = j
    return [int(x) for x in out]


# ---- DataFrame operators --------------------------------------------------------


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))


def encode(df: DataFrame, key: Column, text: Column, path: str, segment_chars: int = SEGMENT_CHARS, counts_only: bool = False) -> DataFrame:
    """``key`` and ``ids`` (array<int>), or ``n_tokens`` (int) with ``counts_only``."""
    rows = df.select(key.alias("key"), text.cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    splits = path.endswith(".tiktoken")
    result = "n_tokens int" if counts_only else "ids array<int>"

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = whole_text_encoder(path)
        for batch in batches:
            arrays, held, start = [], 0, 0
            for i, t in enumerate(batch.column(1)):
                t = t.as_py()
                arrays.append(run(t) if t else np.zeros(0, np.int32))
                held += len(arrays[-1])
                if held > 2_000_000 or i + 1 == batch.num_rows:
                    got = pa.array([len(a) for a in arrays], pa.int32()) if counts_only else _lists(arrays)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(arrays)), got], ["key", result.split()[0]])
                    arrays, held, start = [], 0, i + 1

    if not splits:
        return rows.mapInArrow(whole, f"key {kind}, {result}")
    is_long = F.coalesce(F.length("text"), F.lit(0)) > segment_chars
    short = rows.where(~is_long).mapInArrow(whole, f"key {kind}, {result}")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                parts = segments(batch.column(2)[i].as_py(), segment_chars)
                unit = [g or (j + 1 < len(parts) and parts[j + 1][1]) for j, (_, g) in enumerate(parts)]
                n = len(parts)
                same = pa.array([i] * n, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(same), batch.column(1).take(same), pa.array(range(n), pa.int32()), pa.array([g for _, g in parts]), pa.array(unit), pa.array([t for t, _ in parts], pa.string())],
                    ["row", "key", "seg", "glued", "unit", "text"],
                )

    def encode_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = byte_bpe(path)
        for batch in batches:
            c = batch.to_pydict()
            ids = [np.array(enc._encode_single_piece(t.encode()) if u else enc.encode_ordinary(t), np.int32) for t, u in zip(c["text"], c["unit"])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(3), _lists(ids)], ["row", "key", "seg", "glued", "ids"])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = byte_bpe(path)
        for batch in batches:
            for i in range(batch.num_rows):
                parts = batch.column(1)[i].as_py()
                ids = np.array(assemble(enc, [p["ids"] for p in parts], [p["glued"] for p in parts]), np.int32)
                got = pa.array([len(ids)], pa.int32()) if counts_only else _lists([ids])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), got], ["key", result.split()[0]])

    cut = rows.where(is_long).select(F.monotonically_increasing_id().alias("row"), "key", "text").mapInArrow(split, f"row long, key {kind}, seg int, glued boolean, unit boolean, text string")
    coded = cut.repartition("row", "seg").mapInArrow(encode_parts, f"row long, key {kind}, seg int, glued boolean, ids array<int>")
    whole_docs = coded.groupBy("row").agg(F.first("key").alias("key"), F.sort_array(F.collect_list(F.struct("seg", "glued", "ids"))).alias("parts")).select("key", "parts")
    return short.unionByName(whole_docs.mapInArrow(together, f"key {kind}, {result}"))
