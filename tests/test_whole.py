"""Queries that answer for whole tables, counted on the tables themselves."""

import hashlib
import os
import re
from collections import Counter

import pyarrow.parquet as pq
import pytest

from terrasift.operators.facilities import source_shares
from terrasift.plans import reference

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def texts() -> dict:
    t = pq.read_table(f"{DATA}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    return dict(zip(t["doc_id"], t["text"]))


@pytest.mark.parametrize("name", ["bm25_mails", "bm25_pages"])
def test_bm25(spark, name):
    asked = {d for d, t in texts().items() if d % 20 == 0 and t and t.strip()}
    rows = reference.QUERIES[name](spark, DATA).collect()
    assert {r.query_id for r in rows} == asked
    if name == "bm25_mails":
        assert all(any(r.doc_id == q for r in rows if r.query_id == q) for q in asked)


def test_slices(spark):
    want = {}
    for d, t in texts().items():
        for at in range(0, max(len(t), 1), 2000) if t is not None else ():
            want[d, at] = (hashlib.md5(t[at : at + 2000].encode()).hexdigest(), at + 2000 if at + 2000 < len(t) else None)
    got = {(r.doc_id, r.offset): (r.digest, r.next_start) for r in reference.QUERIES["page_slices"](spark, DATA).collect()}
    assert max(at for _, at in want) > 2000 and got == want


def test_terms(spark):
    tf, df = Counter(), Counter()
    for t in texts().values():
        found = []
        for run in re.findall("[㐀-鿿]+|[a-z0-9]+", (t or "").lower()):
            found += [run] if run[0] < "㐀" or len(run) == 1 else [run[i : i + 2] for i in range(len(run) - 1)]
        tf.update(found)
        df.update(set(found))
    got = {r.term: (r.tf, r.df) for r in reference.QUERIES["term_counts"](spark, DATA).collect()}
    assert min(df.values()) == 1 and got == {t: (tf[t], df[t]) for t in tf}


def test_sources(spark):
    t = pq.read_table(f"{DATA}/facilities.parquet", columns=["facility_id", "source_key", "address"]).to_pylist()
    rows = set(map(lambda r: tuple(r.values()), t))
    n, with_address = Counter(k for _, k, _ in rows), Counter(k for _, k, a in rows if a is not None)
    got = {r.source_key: (r.n, r.with_address, r.share) for r in reference.QUERIES["rows_per_source"](spark, DATA).collect()}
    assert got == {k: (n[k], with_address[k], round(n[k] / len(rows), 6)) for k in n} and len(n) > 4
    fixture = spark.createDataFrame([("a", "x"), ("a", None), ("b", "y"), ("c", "z")], "source_key string, address string")
    assert sorted(tuple(r) for r in source_shares(fixture, ["a", "c"]).collect()) == [("a", 2, 1, 0.666667), ("c", 1, 1, 0.333333)]
    assert source_shares(fixture, []).count() == 0


def test_cells(spark, tmp_path):
    blank = spark.createDataFrame([(1, " " * 30 + "=1+1 " + "x" * 50), (4, "=" + "y" * 50), (5, " " * 30 + "z")], "doc_id long, text string")
    blank.write.parquet(str(tmp_path / "documents.parquet"))
    cells = {r.doc_id: r.cell for r in reference.QUERIES["guarded_csv"](spark, str(tmp_path)).collect()}
    assert cells == {1: "'" + " " * 30 + "=1+1 " + "x" * 50, 4: "'==" + "y" * 50, 5: " " * 30 + "z"}
    got = {r.doc_id: r.cell for r in reference.QUERIES["guarded_csv"](spark, DATA).collect()}
    held = {d: ("=", "", " @", "-")[d % 4] + t for d, t in texts().items() if t is not None}
    assert got == {d: ("'" if re.match("[=+@\t\r-]", c.lstrip(" ")) else "") + c for d, c in held.items()}


def test_chunk_boxes(spark):
    rows = reference.QUERIES["chunk_boxes"](spark, DATA).collect()
    pages = {}
    for r in pq.read_table(f"{DATA}/source_documents.parquet", columns=["id", "pages"]).to_pylist():
        for p in r["pages"] or []:
            pages[r["id"], p["page"]] = (len(p["text"] or ""), [x["bbox"] for x in p["lines"] or []])
    got = {(r.document_id, r.page, r.start): (r.stop, (r.x1, r.y1, r.x2, r.y2)) for r in rows}
    want = {}
    for (d, p), (n, boxes) in pages.items():
        box = tuple(f(b[i] for b in boxes) for i, f in enumerate((min, min, max, max))) if boxes and n <= 800 else (None,) * 4
        for at in range(0, n, 680):
            want[d, p, at] = (min(at + 800, n), box if at == 0 else (None,) * 4)
    assert got == want


def test_criteria_read(spark):
    t = pq.read_table(f"{DATA}/pdf_drafts.parquet", columns=["draft_id"])
    rows = reference.QUERIES["criteria_read"](spark, DATA).collect()
    assert sorted(r.draft_id for r in rows) == sorted(set(t["draft_id"].to_pylist()))
