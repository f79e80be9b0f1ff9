"""Evidence retrieval: scope, chunks, BM25, citations.

Questions are a table like the pieces they are held against. Both are dealt into
blocks; a task holds one block of questions against one of pieces and keeps the best
of each question, so that neither table goes to the driver or to all tasks. The work
is questions times pieces.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from terrasift.functions.text import chunk_starts, tokens
from terrasift.operators.layout import bounding_box

STEP, LENGTH = 680, 800
K1, B = 1.2, 0.75
QUESTIONS_A_BLOCK, PIECES_A_BLOCK, PIECES_A_STEP = 2_000, 16_000, 512


def in_scope(documents: DataFrame, queries: DataFrame) -> DataFrame:
    """Documents valid for each query: equal scope, and the day within both ends of the validity (an open end counts)."""
    same = ["ruleset_id", "locality", "land_use"]
    q = queries.select("query_id", *same, "day")
    return documents.join(q, same).where("valid_from <= day and (valid_to is null or day <= valid_to)")


def chunks(docs: DataFrame, key: list[str], text: str) -> DataFrame:
    """Overlapping windows: ``key, start, stop, chunk``."""
    starts = docs.select(*key, text, F.explode(chunk_starts(F.col(text), STEP)).alias("start"))
    chunk = F.substr(F.col(text), F.col("start") + 1, F.lit(LENGTH))
    return starts.select(*key, "start", (F.col("start") + F.length(chunk)).alias("stop"), chunk.alias("chunk"))


def best_of_block(asked: pa.Table, held: pa.Table, key: list[str], k: int, n: int, avg_len: float) -> tuple:
    """(question, piece, score) rows of the ``k`` best pieces of each question; of equal scores the lower key.

    ``asked``: terms, dfs. ``held``: the key and the terms of a piece, joined by blanks.
    """
    import numpy as np

    at: dict[str, list[int]] = {}
    df_of: dict[str, int] = {}
    for i, (terms, dfs) in enumerate(zip(asked["terms"].to_pylist(), asked["dfs"].to_pylist())):
        for t, df in zip(terms, dfs):
            at.setdefault(t, []).append(i)
            df_of[t] = df
    posts = {t: np.array(x, dtype=np.intp) for t, x in at.items()}
    idf = {t: float(np.log(1 + (n - df + 0.5) / (df + 0.5))) for t, df in df_of.items()}
    ids = [held[c].to_pylist() for c in key]
    # nulls first and strings by their bytes, as in Spark
    order = sorted(range(held.num_rows), key=lambda i: [(c[i] is not None, c[i].encode() if isinstance(c[i], str) else c[i]) for c in ids])
    texts = held["terms"].to_pylist()
    top = (np.empty(0, np.intp), np.empty(0, np.intp), np.empty(0))
    least, scores = np.zeros(asked.num_rows), np.zeros((PIECES_A_STEP, asked.num_rows))
    for low in range(0, len(order), PIECES_A_STEP):
        step = order[low : low + PIECES_A_STEP]
        for row, i in enumerate(step):
            toks = texts[i].split(" ")
            norm = K1 * (1 - B + B * len(toks) / avg_len)
            found = [(posts[t], idf[t] * tf * (K1 + 1) / (tf + norm)) for t, tf in Counter(toks).items() if t in posts]
            if found:
                sizes = [len(p) for p, _ in found]
                scores[row] = np.bincount(np.concatenate([p for p, _ in found]), np.repeat([w for _, w in found], sizes), asked.num_rows)
            else:
                scores[row] = 0
        part = np.round(scores[: len(step)], 6)
        row, q = np.nonzero(part > least)
        # pieces come in the order of their keys, so a later one of equal score never displaces an earlier one
        q, piece, score = (np.concatenate(x) for x in zip(top, (q, row + low, part[row, q])))
        by = np.lexsort((piece, -score, q))
        q, piece, score = q[by], piece[by], score[by]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        top = (q[rank < k], piece[rank < k], score[rank < k])
        full = rank == k - 1
        least[q[full]] = score[full]
    return top[0], np.array(order, dtype=np.intp)[top[1]], top[2]


def bm25(pieces: DataFrame, key: list[str], chunk: str, questions: DataFrame, k: int) -> DataFrame:
    """The ``k`` best pieces of each question: ``query_id, key, score, rank``.

    ``questions``: query_id, question; any number of them and of terms. Scores are
    rounded to 6 digits before ranking; equal scores rank by key.
    """
    toks = pieces.select(*key, tokens(F.col(chunk)).alias("toks")).where("size(toks) > 0")
    n, avg_len = toks.agg(F.count("*"), F.avg(F.size("toks"))).first()
    across, down = -(-questions.count() // QUESTIONS_A_BLOCK) or 1, -(-n // PIECES_A_BLOCK) or 1
    df = toks.select(F.explode(F.array_distinct("toks")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    terms = questions.select("query_id", F.explode(F.array_distinct(tokens(F.col("question")))).alias("term")).distinct()
    asked = terms.join(df, "term").groupBy("query_id").agg(F.collect_list("term").alias("terms"), F.collect_list("df").alias("dfs"))
    part = lambda n, *c: F.pmod(F.xxhash64(*c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select(part(across, "query_id").alias("_across"), every(down).alias("_down"), "query_id", "terms", "dfs")
    right = toks.select(every(across).alias("_across"), part(down, *key).alias("_down"), *key, F.array_join("toks", " ").alias("terms"))
    out = StructType([questions.schema["query_id"], *[pieces.schema[c] for c in key], StructField("score", DoubleType())])

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not (a.num_rows and b.num_rows):
            return pa.table([a["query_id"].slice(0, 0), *[b[c].slice(0, 0) for c in key], pa.array([], pa.float64())], names=out.names)
        q, piece, score = best_of_block(a, b, key, k, n, avg_len)
        return pa.table([a["query_id"].take(pa.array(q)), *[b[c].take(pa.array(piece)) for c in key], pa.array(score)], names=out.names)

    best = left.groupBy("_across", "_down").cogroup(right.groupBy("_across", "_down")).applyInArrow(run, out)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), *key))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)


def citation_id(*parts: Column) -> Column:
    """A stable id of a place in a document."""
    return F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256)


def chunk_box(start: Column, chunk: Column, text: Column, boxes: Column) -> Column:
    """The box around the lines of a page if the chunk is the full page, else null: only then is it exact."""
    return F.when((start == 0) & (F.length(chunk) == F.length(text)) & (F.size(boxes) > 0), bounding_box(boxes))


def page_slice(text: Column, offset: Column, length: int = 2000) -> Column:
    """``struct<quote, next_start>``: a slice of a text and where the next begins (null at the end)."""
    quote = F.substr(text, offset + 1, F.lit(length))
    after = offset + F.length(quote)
    return F.struct(quote.alias("quote"), F.when(after < F.length(text), after).alias("next_start"))
