"""Relational operators on small tables."""

from decimal import Decimal

from pyspark.sql import functions as F

from terrasift.operators import bands as B
from terrasift.operators import evidence as E
from terrasift.operators import facilities as O
from terrasift.operators import layout as L
from terrasift.operators import logs as G
from terrasift.operators import retrieval as R

D = Decimal
BANDS = "rule string, grade int, lo decimal(20,6), lo_incl boolean, hi decimal(20,6), hi_incl boolean"


def test_bands(spark):
    bands = spark.createDataFrame([("r", 1, D(0), True, D(5), False), ("r", 2, D(5), True, D(10), True), ("r", 3, D(10), True, None, False), ("r", 2, D(20), True, D(30), True)], BANDS)
    values = spark.createDataFrame([(1, "r", D("4.99")), (2, "r", D(5)), (3, "r", D(10)), (4, "r", D(-1)), (5, "r", None), (6, "q", D(1)), (7, "r", D(25)), (1, "r", D("4.99"))], "k int, rule string, v decimal(20,6)")
    got = sorted((r.k, r.grade, r.reason) for r in B.match_bands(values.withColumn("grade_", F.lit(1)), bands, "v", ["rule"]).collect())
    assert got == [(1, 1, None), (1, 1, None), (2, 2, None), (3, None, "several_bands"), (4, None, "no_band"), (5, None, "no_value"), (6, None, "no_band"), (7, None, "several_bands")]
    adjacent = {(int(r.at), r.code) for r in B.adjacency(bands, ["rule"]).collect()}
    assert adjacent == {(10, "overlap"), (20, "overlap")}
    gap = spark.createDataFrame([("g", 1, D(0), True, D(5), False), ("g", 2, D(6), True, None, False), ("h", 1, None, True, D(5), False), ("h", 2, D(5), False, None, False)], BANDS)
    assert {(r.rule, r.code) for r in B.adjacency(gap, ["rule"]).collect()} == {("g", "gap"), ("h", "gap")}


def test_grades(spark):
    df = spark.createDataFrame([(None,), (8.0,), (20.0,), (19.99,), (3.0,)], "v double")
    assert [r.g for r in df.select(B.cut_grade(F.col("v"), [28, 20, 12, 8], True).alias("g")).collect()] == [None, 4, 2, 3, 5]
    assert [r.g for r in df.select(B.cut_grade(F.col("v"), [8, 12, 20, 28], False).alias("g")).collect()] == [None, 2, 4, 3, 1]
    f = spark.createDataFrame([(False, True, 1.0), (True, True, 9e9), (True, False, 600.0), (True, False, None)], "e boolean, i boolean, d double")
    assert [r.g for r in f.select(B.facility_grade(*map(F.col, "eid"), [500, 1000], 3).alias("g")).collect()] == [3, 1, 2, None]
    assert [r.g for r in f.select(B.facility_grade(*map(F.col, "eid"), [1000, 500], 3, False).alias("g")).collect()] == [1, 3, 2, None]


def test_matrix(spark):
    sizes = spark.createDataFrame([("a", 3, D("2.5"))], "rule string, size int, step decimal(9,4)")
    cells = B.step_matrix(sizes, ["rule"])
    pair = spark.createDataFrame([("a", 1, 3), ("a", 4, 1), ("b", 1, 1)], "rule string, s int, c int")
    assert [(r.s, r.rate) for r in B.rate_lookup(pair, cells, ["rule"], "s", "c").orderBy("rule", "s").collect()] == [(1, D("5.0000")), (4, None), (1, None)]
    assert B.rate_lookup(pair, B.transpose(cells), ["rule"], "s", "c").where("s = 1 and c = 3").collect()[0].rate == D("-5.0000")
    assert B.matrix_faults(cells, sizes, ["rule"], 10).count() == 0
    bad = cells.where("not (subject_ix = 1 and comparable_ix = 1)").withColumn("rate", F.when(F.col("subject_ix") == 3, F.col("rate") + 9).otherwise(F.col("rate")))
    assert {r.code for r in B.matrix_faults(bad, sizes, ["rule"], 8).collect()} == {"shape", "diagonal", "magnitude", "antisymmetry"}
    assert {r.ok for r in B.contiguous(cells, ["rule", "subject_ix"], "comparable_ix").collect()} == {True}


def test_retrieval(spark):
    docs = spark.createDataFrame([("d1", 1, "道路寬度 " * 400), ("d2", 1, "parking lot width"), ("d3", 1, ""), ("d4", 1, None)], "document_id string, page int, text string")
    c = R.chunks(docs, ["document_id", "page"], "text")
    starts = sorted((r.document_id, r.start, r.stop) for r in c.collect())
    assert starts == [("d1", 0, 800), ("d1", 680, 1480), ("d1", 1360, 2000), ("d2", 0, 17)]
    q = spark.createDataFrame([(1, "Width of Parking"), (2, "!!!"), (3, "道路")], "query_id int, question string")
    hits = R.bm25(c, ["document_id", "page", "start"], "chunk", q, 2).orderBy("query_id", "rank").collect()
    assert [(h.query_id, h.document_id, h.rank) for h in hits] == [(1, "d2", 1), (3, "d1", 1), (3, "d1", 2)]
    assert R.bm25(c, ["document_id", "page", "start"], "chunk", q.where("query_id = 2"), 2).count() == 0
    s = spark.createDataFrame([("abcdef", 0), ("abcdef", 4), ("abcdef", 9)], "t string, o int").select(R.page_slice(F.col("t"), F.col("o"), 4).alias("s")).collect()
    assert [(r.s.quote, r.s.next_start) for r in s] == [("abcd", 4), ("ef", None), ("", None)]


def test_retrieval_whole(spark, monkeypatch):
    """Any number of questions and terms, in several blocks, against brute force; equal scores rank by key."""
    import math
    import random
    from collections import Counter

    monkeypatch.setattr(R, "QUESTIONS_A_BLOCK", 7)
    monkeypatch.setattr(R, "PIECES_A_BLOCK", 30)
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 12))) for _ in range(200)]
    asked = [" ".join(rnd.sample("abcdefghxyz", rnd.randint(0, 5))) for _ in range(20)] + [" ".join(f"w{i}" for i in range(100_001)) + " a"]
    pieces = spark.createDataFrame([(str(i % 23), i, t) for i, t in enumerate(texts)], "d string, i int, chunk string")
    got = {(r.query_id, r["rank"]): (r.d, r.i, r.score) for r in R.bm25(pieces, ["d", "i"], "chunk", spark.createDataFrame(list(enumerate(asked)), "query_id int, question string"), 5).collect()}
    held = [(str(i % 23), i, Counter(t.split())) for i, t in enumerate(texts) if t]
    df, avg = Counter(t for *_, c in held for t in c), sum(c.total() for *_, c in held) / len(held)
    want = {}
    for q, text in enumerate(asked):
        rows = []
        for d, i, c in held:
            score = sum(math.log(1 + (len(held) - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * c.total() / avg)) for t in set(text.split()) & c.keys())
            rows += [(-round(score, 6), d, i)] if score else []
        want |= {(q, n): (d, i, -s) for n, (s, d, i) in enumerate(sorted(rows)[:5], 1)}
    assert got.keys() == want.keys()
    assert all(got[x][:2] == want[x][:2] and abs(got[x][2] - want[x][2]) < 2e-6 for x in want)


def test_scope(spark):
    docs = spark.sql("select 'r' ruleset_id, 'l' locality, 'u' land_use, date'2024-01-01' valid_from, cast(null as date) valid_to, 1 document_id union all select 'r','l','u',date'2024-01-01',date'2024-02-01',2 union all select 'r','x','u',date'2024-01-01',null,3")
    q = spark.sql("select 1 query_id, 'r' ruleset_id, 'l' locality, 'u' land_use, date'2024-02-01' day union all select 2,'r','l','u',date'2024-02-02' union all select 3,'r','l','u',null")
    assert sorted((r.query_id, r.document_id) for r in R.in_scope(docs, q).collect()) == [(1, 1), (1, 2), (2, 1)]


def test_district(spark):
    rows = [(1, "樹林區", "x", "y"), (2, "泰山區、樹林區", None, None), (3, "板橋區", "樹林區水源街", "樹林"), (4, None, "新北市樹林市中山路", None), (5, "", None, "樹林公園"), (6, "樹林口", None, "z"), (7, "樹林區機車收費", None, None), (8, None, None, None)]
    df = spark.createDataFrame(rows, "k int, field string, address string, name string")
    districts = spark.createDataFrame([("樹林區",), ("板橋區",), ("泰山區",)], "district string")
    got = {r.k: r.match_basis for r in O.match_district(df, ["k"], "field", "address", "name", "樹林區", districts).collect()}
    assert got == {1: "district_field", 2: "district_field", 3: None, 4: "address", 5: "name_keyword", 6: None, 7: "district_field", 8: None}


def test_box(spark):
    pts = [("a", 121 + i / 100, 24.0) for i in range(101)] + [("b", 121.0, 24.0)] * 3 + [("a", 0.0, 0.0), ("a", None, 24.0)]
    boxes = O.reference_box(spark.createDataFrame(pts, "g string, longitude double, latitude double"), ["g"])
    b = boxes.collect()
    assert len(b) == 1 and round(b[0].min_lon, 6) == 121.005 and round(b[0].max_lon, 6) == 121.995 and b[0].n_points == 101
    loose = spark.createDataFrame([(1, "a", 121.5, 24.0), (2, "a", 122.4, 24.0), (3, "a", None, None), (4, "b", 121.0, 24.0)], "k int, g string, longitude double, latitude double")
    assert {r.k: r.verdict for r in O.adjudicate(loose, boxes, ["g"]).collect()} == {1: "kept", 2: "rejected", 3: "unverified", 4: "unverified"}


def test_slots(spark):
    rec = spark.createDataFrame([("f", "i")], "factor string, item string")
    src = spark.createDataFrame([("f", "i", "ok"), ("f", "j", "skipped_heavy"), ("f", "k", "error"), ("f", "l", "no_district_matches"), ("f", "l", "error")], "factor string, item string, status string")
    gap = spark.createDataFrame([("g", "m", "c")], "factor string, item string, category string")
    got = {r["item"]: (r.record_count, r.status, r.survey_required) for r in O.slot_report(rec, src, gap).collect()}
    assert got == {"i": (1, "ok", False), "j": (0, "skipped_heavy", True), "k": (0, "error", True), "l": (0, "no_district_matches", True), "m": (0, "no_open_data_source", True)}


def test_logs(spark):
    rows = spark.sql("select * from values ('a', 1, timestamp_ntz'2024-01-01 00:00:00', 10), ('a', 2, timestamp_ntz'2024-01-02 00:00:00', 500), ('a', 3, timestamp_ntz'2024-01-02 00:00:00.5', 60), ('b', 1, timestamp_ntz'2024-01-03 00:00:00', 30) t(k, i, at, n)")
    assert sorted((r.k, r.i) for r in G.latest(rows, ["k"], ["at", "i"]).collect()) == [("a", 3), ("b", 1)]
    assert sorted(r.n for r in G.fifo_cache(rows, "at", "n", 100, ["i"]).collect()) == [10, 30, 60]
    assert sorted(r.n for r in G.fifo_cache(rows, "at", "n", 95, ["i"]).collect()) == [30, 60]
    assert sorted((r.k, r.i) for r in G.newest(rows, ["k"], "at", "i", 1).collect()) == [("a", 3), ("b", 1)]
    wait = {(r.k, r.i): r.wait_us for r in G.spaced(rows, ["k"], "at", "i", 1.1).collect()}
    assert wait == {("a", 1): 0, ("a", 2): 0, ("a", 3): 600_000, ("b", 1): 0}
    writes = spark.createDataFrame([("c", 1, 1), ("c", 2, 2), ("c", 3, 2), ("c", 4, 3), ("c", 5, None)], "k string, id int, rev int")
    assert {r.id: r.accepted for r in G.accepted_writes(writes, ["k"], ["id"], "rev", F.floor(F.col("id") / 2)).collect()} == {1: True, 2: True, 3: False, 4: True, 5: False}
    ch = G.changed_fields(writes, ["k"], ["id"], ["rev"], F.floor(F.col("id") / 2)).collect()
    assert [(r.id, r.old, r.new) for r in sorted(ch, key=lambda r: r.id)] == [(2, "1", "2"), (4, "2", "3"), (5, "3", None)]
    pages = spark.createDataFrame([("s", 0, "x"), ("s", 1, "y"), ("s", 3, "x"), ("t", 4, "x")], "k string, page int, body string")
    assert [tuple(r) for r in G.repeated_pages(pages, ["k"], "page", F.col("body")).collect()] == [("s", 3, 0)]


def test_evidence(spark):
    pages = spark.createDataFrame([("d", 1, "寬度 5 公尺，修正率 12%\n深 1,234.0 m"), ("d", 2, None)], "document_id string, page int, text string")
    drafts = [(1, "d", 1, "寬度 5 公尺", "5", None, None), (2, "d", 1, "「寬度 5 公尺」", "5", None, None), (3, "d", 1, "寬度 7 公尺", "7", None, None), (4, "d", 1, "深 1,234.0 m", "1234", None, D(3)), (5, "d", 1, "修正率 12%", None, None, D(12)),
              (6, "d", 1, "修正率 12%", None, None, D(2)), (7, "d", 2, "x", "x", None, None), (8, "d", 1, " ", "5", None, None), (9, "d", 1, "寬度 5 公尺", None, None, None), (10, None, 1, "x", "1", None, None)]
    df = spark.createDataFrame(drafts, "draft_id int, document_id string, page int, quote string, subject string, comparable string, entered_rate decimal(9,4)")
    assert {r.draft_id: r.reason for r in E.verify(df, pages).collect()} == {1: None, 2: None, 3: "not_on_page", 4: None, 5: None, 6: "value_not_in_quote", 7: "no_page", 8: "no_quote", 9: "no_value", 10: "no_page"}
    rows = spark.createDataFrame([("a", "x", 1), ("a", "x", 2), ("b", "x", 1), ("b", None, 2)], "k string, v string, o int")
    assert [tuple(r) for r in E.without_conflicts(rows, ["k"], ["v"], ["o"]).collect()] == [("a", "x", 2)]
    assert [tuple(r) for r in E.only_choice(rows.where("v is not null"), ["k"], "v").orderBy("k").collect()] == [("a", "x"), ("b", "x")]
    patch = spark.createDataFrame([("a", "1", 2), ("a", "2", 1), ("b", "3", 1)], "k string, v string, p int")
    now = spark.createDataFrame([("a", " - "), ("b", "7")], "k string, v string")
    assert [tuple(r) for r in E.blank_patches(patch, now, ["k"], "v", "p").collect()] == [("a", "2", 1)]


def test_evidence_forms(spark):
    """Against brute force: NFKC without white space on quote, page and values."""
    import re
    import unicodedata

    page = "寬度 12 公尺，修正率 5%\n面積 1,234 m2\n使用分區 住宅區 ⽤途 樓店"
    form = lambda t: re.sub(r"\s+", "", unicodedata.normalize("NFKC", t))
    quotes = ["寬度１２公尺", "寬 度\u300012", "寬度 12", "寬度 13", "用途 ⽤途", "⽤途", "用途", "樓店", "樓店", "「寬度１２\n公尺」", "面積 １，２３４ｍ２", "修正率５％", "\u3000", "\n"]
    values = ["12", "１２", "13", "用途", "⽤途", "樓店", "1234", "１，２３４ｍ２", "5％", ""]
    pages = spark.createDataFrame([("d", 1, page)], "document_id string, page int, text string")
    drafts = [(i, "d", 1, q, v) for i, (q, v) in enumerate((q, v) for q in quotes for v in values)]

    def want(quote, value):
        quote = quote.strip()
        if not quote:
            return "no_quote"
        if form(quote) not in form(page):
            if not (quote[0] == "「" and quote[-1] == "」" and form(quote[1:-1]) in form(page)):
                return "not_on_page"
            quote = quote[1:-1]
        v = form(value).replace(",", "").removesuffix("%")
        hay = re.sub(r"(?<=\d),(?=\d{3}(?:\D|$))", "", unicodedata.normalize("NFKC", quote))
        if re.fullmatch(r"[+-]?\d+(?:\.\d+)?", v):
            ok = re.search(r"(?<![\d.])" + re.escape(format(float(v), "g")) + r"(?:\.0+)?(?![\d.])", hay)
        else:
            ok = v and v in form(hay)
        return None if ok else "value_not_in_quote"

    df = spark.createDataFrame(drafts, "draft_id int, document_id string, page int, quote string, subject string").withColumns({"comparable": F.lit(None).cast("string"), "entered_rate": F.lit(None).cast("decimal(9,4)")})
    got = {r.draft_id: r.reason for r in E.verify(df, pages).collect()}
    assert got == {i: want(q, v) for i, _, _, q, v in drafts}
    assert {None, "no_quote", "not_on_page", "value_not_in_quote"} == set(got.values())


def test_layout(spark):
    box = "array<struct<text: string, bbox: array<double>>>"
    four = [("a", [10.0, 10.0, 50.0, 30.0]), ("b", [200.0, 12.0, 240.0, 32.0]), ("c", [10.0, 60.0, 50.0, 80.0]), ("d", [10.0, 11.0, 20.0, 31.0])]
    grid = [(f"{v}", [60.0 * c, 20.0 * r, 60.0 * c + 40, 20.0 * r + 15]) for r, line in enumerate([[0, 2], [-2, 0], [1], [0, 1]]) for c, v in enumerate(line)] + [("1 0", [0.0, 300.0, 40.0, 315.0])]
    drawn = spark.createDataFrame([(1, four), (2, [("ab", [0.0, 0.0, 20.0, 10.0]), ("寬", [100.0, 0.0, 120.0, 10.0])]), (3, grid)], f"k int, lines {box}").withColumns({"width": F.lit(500.0), "height": F.lit(1000.0)})
    rows = {r.k: [(b.row, b.text) for b in r.b] for r in drawn.select("k", L.row_boxes(F.col("lines")).alias("b")).collect()}
    assert rows[1] == [(0, "a"), (0, "d"), (0, "b"), (1, "c")]
    assert {r.k: r.text for r in L.layout_text(drawn, ["k"]).collect()}[2] == "ab      寬"
    assert [(r.k, r.block, r["size"], r.cells) for r in L.printed_matrices(drawn, ["k"]).collect()] == [(3, 0, 2, [0.0, 2.0, -2.0, 0.0])]
    widths = spark.createDataFrame([("ab寬Ａﾊ😀é",), ("",)], "t string").select(L.display_width(F.col("t")).alias("w")).collect()
    assert [r.w for r in widths] == [10, 0]
    pages = spark.createDataFrame([(1, None, None), (2, [], 100.0), (3, [("x", [0.0, 0.0, 10.0, 10.0]), (None, None), ("y", [1.0])], None)], "k int, lines array<struct<text: string, bbox: array<double>>>, width double")
    assert [(r.k, r.rows, r.text) for r in L.layout_text(pages, ["k"]).orderBy("k").collect()] == [(1, 0, ""), (2, 0, ""), (3, 1, "x")]
    df = spark.createDataFrame([("1 2.5 －3",), ("1 x",), ("",), (None,)], "t string")
    assert [r.n and [float(x) for x in r.n] for r in df.select(L.number_row(F.col("t")).alias("n")).collect()] == [[1.0, 2.5, -3.0], None, None, None]
    lines = spark.createDataFrame([("p", "a b", 0.0, 0.0, 10.0, 10.0), ("p", "c", 12.0, 0.0, 14.0, 10.0)], "k string, text string, x1 double, y1 double, x2 double, y2 double")
    cells = spark.createDataFrame([("p", 1, "abc", True, 0.0, 0.0, 20.0, 10.0), ("p", 2, "", False, 50.0, 0.0, 60.0, 10.0)], "k string, cell_id int, expected string, numeric boolean, c_x1 double, c_y1 double, c_x2 double, c_y2 double")
    assert [(r.cell_id, r.actual, r.exact) for r in L.cell_scores(lines, cells, ["k"]).orderBy("cell_id").collect()] == [(1, "a bc", True), (2, "", True)]


def test_ordered(spark):
    import random

    from terrasift.operators import ordered as P

    rnd = random.Random(1)
    data = [(rnd.choice(["hot", "hot", "a", None]), i, rnd.randint(0, 9) if i % 7 else None) for i in range(60)]
    df = spark.createDataFrame(data, "k string, i int, v int").withColumns({"_near_": F.lit(1)})
    b = F.floor(F.col("i") / 5)
    out = P.with_running_max(P.with_rank(P.with_next(P.with_previous(df, ["k"], ["i"], ["v", "i"], b), ["k"], ["i"], ["i"], b), ["k"], ["i"], b), ["k"], ["i"], "v", b)
    got = {r.i: (r.previous and (r.previous.v, r.previous.i), r.next and r.next.i, r["rank"], r.running) for r in out.collect()}
    by: dict = {}
    for k, i, v in data:
        by.setdefault(k, []).append((i, v))
    for line in by.values():
        for n, (i, v) in enumerate(line):
            seen = [x for _, x in line[: n + 1] if x is not None]
            assert got[i] == ((line[n - 1][1], line[n - 1][0]) if n else None, line[n + 1][0] if n + 1 < len(line) else None, n + 1, max(seen) if seen else None)
    assert P.with_previous(df.limit(0), ["k"], ["i"], ["v"], b).count() == 0


def test_extraction(spark):
    pages = spark.createDataFrame([(1, "1 面積\n12\n7\n3%\nx"), (2, "面積\n12\n7\n3"), (3, "面積\n12"), (4, "面積 12\n1\n2"), (5, "面積\n無\n1,200\nnote"), (6, None), (7, "面積\n1\n2\n3%\n4")], "k int, text string")
    labels = spark.createDataFrame([("面積", ["無"])], "label string, words array<string>")
    got = sorted((r.k, r.subject, r.comparable, r.rate) for r in E.labelled_values(pages, ["k"], labels).collect())
    assert got == [(1, "12", "7", "3%"), (5, "無", "1,200", None)]
    t = spark.createDataFrame([("☑ 有 □ 無",), ("□有 ■無",), (None,)], "t string")
    assert [tuple(r) for r in t.select(E.ticked(F.col("t"), "有"), E.ticked(F.col("t"), "無")).collect()] == [(True, False), (False, True), (False, False)]
    m = spark.createDataFrame([("ab1 ab1",), ("ab1 ab2",), ("x",), (None,)], "t string")
    assert [r.m for r in m.select(E.single_match(F.col("t"), "ab[0-9]").alias("m")).collect()] == ["ab1", None, None, None]


def test_changes(spark):
    old = spark.createDataFrame([("a", 1), ("b", None), ("c", 3)], "k string, v int")
    new = spark.createDataFrame([("a", 1), ("b", 2), ("d", None)], "k string, v int")
    assert sorted(tuple(r) for r in G.member_changes(old, new, ["k"], ["v"]).collect()) == [("b", "changed"), ("c", "removed"), ("d", "added")]
    r = spark.createDataFrame([("a", True), ("a", None), ("b", True)], "k string, g boolean")
    assert sorted(tuple(x) for x in G.ready(r, ["k"], F.col("g")).collect()) == [("a", False, 2), ("b", True, 1)]


def test_criteria(spark):
    rows = [(["10以上", "未滿10"], "numeric"), (["無", "一項", "2項以上"], "count"), (["區段內", "無", "未滿5m"], "facility"), (["未滿5m或無", "5m以上"], "manual"), (["甲", "乙"], "categorical"), (["x", ""], "manual"), ([], "manual"), (["詳備註"], "manual"), (None, "manual")]
    df = spark.createDataFrame([(i, b) for i, (b, _) in enumerate(rows)], "i int, b array<string>")
    assert [r.k for r in df.select("i", B.criterion_kind(F.col("b")).alias("k")).orderBy("i").collect()] == [k for _, k in rows]


def test_asof(spark):
    import random

    from terrasift.operators.ordered import asof_join

    rnd = random.Random(2)
    left = [(rnd.choice("ab"), rnd.randint(0, 40) if i % 9 else None, i) for i in range(50)]
    right = [(rnd.choice("abc"), rnd.randint(0, 40), i) for i in range(12)] + [("a", None, 99)]
    l = spark.createDataFrame(left, "k string, at int, i int").withColumn("_m_", F.lit(1))
    r = spark.createDataFrame(right, "k string, at int, j int")
    got = {x.i: x.match and x.match.j for x in asof_join(l, r, ["k"], "at", ["j"], F.floor(F.col("at") / 7)).collect()}
    for k, at, i in left:
        best = max(((a, j) for kk, a, j in right if at is not None and a is not None and kk == k and a <= at), default=None)
        assert got[i] == (best and best[1])
    assert len(got) == 50
