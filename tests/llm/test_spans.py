"""Shared spans against all windows of all texts in a dictionary."""

import random

import pytest
from pyspark.sql import functions as F

from terrasift.llm.spans import SPAN, _scan, shared_share, shared_spans


def brute(docs):
    where = {}
    for d, t in docs:
        for i in range(len(t or "") - SPAN + 1):
            where.setdefault(t[i : i + SPAN], set()).add(d)
    out = set()
    for d, t in set(docs):
        end = start = None
        for i in range(len(t or "") - SPAN + 1):
            if len(where[t[i : i + SPAN]]) > 1:
                if end is not None and i <= end:
                    end = i + SPAN
                else:
                    if end is not None:
                        out.add((d, start, end))
                    start, end = i, i + SPAN
        if end is not None:
            out.add((d, start, end))
    return out


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcde測é𝒳") for _ in range(rnd.randint(1, 6)))
    say = lambda n: " ".join(word() for _ in range(n))
    base = [say(150) for _ in range(6)]
    boiler = say(40)[:170]
    docs = []
    for i in range(60):
        parts = []
        for _ in range(rnd.randint(1, 4)):
            b = rnd.choice(base)
            a = rnd.randint(0, len(b) - 1)
            n = rnd.choice([150, 199, 200, 201, 230, 263, 300, 450, 900])
            parts += [b[a : a + n], rnd.choice(["", "x", say(5), boiler])]
        docs.append((i, "".join(parts)))
    docs += [(60, None), (61, ""), (62, "short"), (63, "a" * 900), (64, "b" + "a" * 400), (65, "-" * 250 + say(60)), docs[0], docs[0], (66, docs[1][1]), (67, say(900)), (68, "z" * 199)]
    docs += [(100 + i, boiler + str(i) + say(30)) for i in range(40)]
    rnd.shuffle(docs)
    return docs


@pytest.mark.parametrize("seed,hot,block,local", [(1, 20_000, 1_000_000, 256), (2, 3, 1_000_000, 2), (3, 5, 700, 1), (4, 0, 5_000, 256), (5, 20_000, 900, 0), (6, 20_000, 2_000, 3)])
def test_brute(spark, seed, hot, block, local):
    docs = corpus(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"id": F.lit("clash"), "key": F.lit(1), "runs": F.lit(2)}).repartition(3)
    got = shared_spans(df, F.col("doc_id"), F.col("text"), hot=hot, block=block, local_hot=local).collect()
    assert sorted(map(tuple, got)) == sorted(brute(docs))


def test_repeats_inside_a_record(spark):
    """A window that stands twice in one record and once in another, in every split into batches."""
    rnd = random.Random(9)
    say = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    x = say(230)
    docs = [(1, say(50) + x + say(300) + x + say(40)), (2, say(80) + x[:215] + say(70)), (3, say(20) + x[10:] + say(70)), (4, say(400))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        for hot in (0, 20_000):
            for block in (100, 1_000_000):
                got = shared_spans(df.repartition(4), F.col("doc_id"), F.col("text"), hot=hot, block=block).collect()
                assert sorted(map(tuple, got)) == sorted(brute(docs)), (hot, block)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def test_share(spark):
    docs = [(1, "q" * 100 + "abcdefghij" * 30), (2, "abcdefghij" * 30), (3, None), (4, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = {r.id: r for r in shared_share(shared_spans(df, F.col("doc_id"), F.col("text")), df, F.col("doc_id"), F.col("text")).collect()}
    assert (rows[1].shared_chars, rows[1].n_chars, rows[1].share) == (300, 400, 0.75)
    assert rows[2].share == 1 and rows[3].share is None and rows[4].shared_chars == 0
    assert shared_spans(df.limit(0), F.col("doc_id"), F.col("text")).count() == 0


def test_string_ids(spark):
    t = "".join(chr(97 + i * 7 % 26) for i in range(900))
    df = spark.createDataFrame([("a", t), ("b", "zz" + t[100:500])], "k string, text string")
    assert sorted(map(tuple, shared_spans(df, F.col("k"), F.col("text")).collect())) == sorted(brute([("a", t), ("b", "zz" + t[100:500])]))


@pytest.mark.parametrize("length", [150, 199])
def test_short_footer(spark, length):
    """A third of all mails hold one footer shorter than a span between unlike texts: its keys are not sent by all of them."""
    rnd = random.Random(4)
    say = lambda n: "".join(rnd.choice("abcdefghijklmnop ") for _ in range(n))
    footer = say(length)
    docs = [(i, say(260) + (footer if i % 3 == 0 else say(40)) + say(80)) for i in range(2400)]
    docs.append((9999, docs[3][1][100:]))
    df = spark.createDataFrame(docs, "id long, text string").repartition(2)
    rows = df.mapInArrow(_scan(20_000, 64), "key long, own long, id long, place long, runs array<bigint>")
    most = rows.groupBy("key").count().agg(F.max("count")).first()[0]
    assert most <= 2 * (64 + 40)
    assert length < 199 or (most > 64 and rows.where("size(runs) = 0").count() > 100)
    assert sorted(map(tuple, shared_spans(df, F.col("id"), F.col("text"), block=20_000, local_hot=64).collect())) == sorted(brute(docs))
