"""Sources, sinks and streams on files in a temporary folder."""

import json
import re

import pytest
from pyspark.sql import functions as F

from terrasift.operators.logs import repeated_pages
from terrasift.sources import records, sinks
from terrasift.streaming import tables as S


def test_json_and_csv(spark, tmp_path):
    (tmp_path / "a.json").write_text("﻿" + json.dumps([{"名稱": "甲", "n": 1}, {"n": None}, 5]), encoding="utf-8")
    rows = records.json_arrays(spark, str(tmp_path / "a.json"))
    assert rows.count() == 3
    assert [(r.n_rows, r.n_bad) for r in records.missing_keys(rows, ["n"]).collect()] == [(3, 1)]
    (tmp_path / "b.csv").write_text('k,v\n1,"a\nb"\n2,\n', encoding="utf-8")
    assert [r.row for r in records.csv_rows(spark, str(tmp_path / "b.csv")).collect()] == [{"k": "1", "v": "a\nb"}, {"k": "2", "v": None}]


def test_catalogue(spark, tmp_path):
    ident = "1fcc8dd3-d295-4102-b52c-f809794e4cd9"
    doc = {"paths": {f"/api/datasets/{ident}/json": {"get": {"summary": "Parks", "description": "City PARK list"}}, "/other": {"get": {"summary": "x"}}}}
    (tmp_path / "c.json").write_text(json.dumps(doc))
    c = records.catalogue(spark, str(tmp_path / "c.json"))
    assert [tuple(r) for r in records.keyword_filter(c, ["park", "CITY"]).collect()] == [(ident, "Parks", "City PARK list")]
    assert records.keyword_filter(c, ["bus"]).count() == 0


def test_paged(spark, tmp_path):
    pages = [[{"a": 1}, {"a": 2}], [{"a": "x", "b": [1]}], [{"a": 1}, {"a": 2}], []]
    for i, p in enumerate(pages):
        (tmp_path / f"page={i}.json").write_text(json.dumps(p))
    spark.dataSource.register(records.PagedDataset)
    df = spark.read.format("paged_dataset").option("path", str(tmp_path)).load()
    assert sorted((r.page, r.ix, r.row["a"]) for r in df.collect()) == [(0, 0, "1"), (0, 1, "2"), (1, 0, "x"), (2, 0, "1"), (2, 1, "2")]
    whole = df.groupBy("page").agg(F.to_json(F.array_sort(F.collect_list(F.struct("ix", F.col("row")["a"].alias("a"))))).alias("body")).withColumn("k", F.lit(1))
    assert [(r.page, r.first_page) for r in repeated_pages(whole, ["k"], "page", F.col("body")).collect()] == [(2, 0)]
    with pytest.raises(Exception, match="no empty page"):
        spark.read.format("paged_dataset").option("path", str(tmp_path)).option("max_pages", "2").load().count()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "=1+1", None), (2, "<b>", "x")], "k int, a string, b string")
    sinks.write_csv(df, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("*.csv"))
    assert "'=1+1" in text
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_csv(df, str(tmp_path / "out"))
    sinks.write_json(df, str(tmp_path / "js"))
    assert {tuple(json.loads(x).values()) for p in (tmp_path / "js").glob("*.json") for x in p.read_text().splitlines()} == {(1, "=1+1", None), (2, "<b>", "x")}
    assert [r.html for r in sinks.html_rows(df, ["k", "a", "b"]).collect()] == ["<tr><td>1</td><td>=1+1</td><td>—</td></tr>", "<tr><td>2</td><td>&lt;b&gt;</td><td>x</td></tr>"]
    vals = spark.createDataFrame([("r", "f", "v")], "record string, field string, value string")
    cells = spark.createDataFrame([("s", "A1", "f"), ("s", "A2", "g")], "sheet string, cell string, field string")
    assert sorted((r.cell, r.value) for r in sinks.fill_cells(vals, cells, ["record"]).collect()) == [("A1", "v"), ("A2", "not provided")]


def test_streams(spark, tmp_path):
    data = spark.sql("select id, timestamp_seconds(1700000000 + id * 60) as ts, concat('k', id % 2) as k, id div 2 + 1 as rev from range(10)")
    data.unionByName(data.where("id < 3")).coalesce(1).write.parquet(str(tmp_path / "in"))
    src = lambda: S.stream(spark, str(tmp_path / "in"), "id long, ts timestamp, k string, rev long")
    assert S.collect_stream(S.without_repeats(src(), ["id"], "ts", "1 day"), "t_rep").count() == 10
    w = S.collect_stream(S.windowed_counts(src(), ["k"], "ts", "1 day", "5 minutes"), "t_win", "complete")
    assert sum(r.n for r in w.collect()) == 13
    s = S.collect_stream(S.sessions(src(), ["k"], "ts", "1 hour", "3 minutes"), "t_ses", "complete")
    assert s.count() == 2
    a = S.collect_stream(S.accepted_stream(src(), "k", "rev", "ts"), "t_acc").collect()
    assert sum(r.accepted for r in a) == 10 and len(a) == 13
    q = S.latest_by_batch(src(), "k", "rev", str(tmp_path / "state"), str(tmp_path / "chk"))
    q.awaitTermination()
    ddl = "id long, ts timestamp, k string, rev long"
    state = lambda: {r.k: r.rev for r in S.latest_rows(spark, str(tmp_path / "state"), ddl).collect()}
    assert state() == {"k0": 5, "k1": 5}
    before = {p.parent.name for p in (tmp_path / "state").glob("bucket=*/v=0")}
    spark.sql("select 99L as id, timestamp_seconds(1700000999) as ts, 'k1' as k, 9L as rev").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    S.latest_by_batch(src(), "k", "rev", str(tmp_path / "state"), str(tmp_path / "chk")).awaitTermination()
    assert state() == {"k0": 5, "k1": 9}
    assert len(before) == 2 and len(list((tmp_path / "state").glob("bucket=*/v=1"))) == 1
    assert S.latest_rows(spark, str(tmp_path / "none"), ddl).count() == 0
