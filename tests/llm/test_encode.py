"""Segmented encoding against the whole text in one call."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terrasift.llm.encode import assemble, byte_bpe, encode, encode_segments, segments, tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.tiktoken")


def split_and_join(text, size):
    enc, parts = byte_bpe(PATH), segments(text, size)
    assert "".join(t for t, _ in parts) == text
    return assemble(enc, encode_segments(enc, parts), [g for _, g in parts])


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab s'tre  \n\t09.,-=（，測試é　​\x1c\xa0'"), st.characters(codec="utf-8")), max_size=200), st.integers(1, 40))
def test_any_text(text, size):
    assert split_and_join(text, size) == byte_bpe(PATH).encode_ordinary(text)


def test_unsplit():
    rnd = random.Random(3)
    for alphabet in ("a", "ab", "the", "臺北市霧澤區", "0123", "=-", " ", "abcdefghijklmnopqrstuvwxyz"):
        for n in (50, 333, 2000):
            text = "".join(rnd.choice(alphabet) for _ in range(n))
            for size in (7, 64):
                assert split_and_join(text, size) == byte_bpe(PATH).encode_ordinary(text), (alphabet, n, size)
                assert split_and_join("x " + text + " y", size) == byte_bpe(PATH).encode_ordinary("x " + text + " y")


def test_rows(spark):
    texts = [None, "", " ", "<|endoftext|> a", "a" * 5000, "long text, with words\r\n" * 400, "臺" * 3000, "same", "same"]
    df = spark.createDataFrame([(min(i, 7), t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    enc = byte_bpe(PATH)
    want = sorted((min(i, 7), enc.encode_ordinary(t or "")) for i, t in enumerate(texts))
    got = sorted((r.key, r.ids) for r in encode(df, F.col("doc_id"), F.col("text"), PATH, segment_chars=256).collect())
    assert got == want
    counts = sorted((r.key, r.n_tokens) for r in encode(df, F.col("doc_id"), F.col("text"), PATH, segment_chars=256, counts_only=True).collect())
    assert counts == sorted((k, len(v)) for k, v in want)
    assert encode(df.limit(0), F.col("doc_id"), F.col("text"), PATH).count() == 0


def test_other_files(spark):
    df = spark.createDataFrame([(1, "Plain words <s>"), (2, None)], "k int, text string")
    for name in ("word_bpe_49k.json", "piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken"):
        got = {r.key: r.ids for r in encode(df, F.col("k"), F.col("text"), tokenizer_path(name)).collect()}
        assert got[2] == [] and len(got[1]) > 2
