"""Personal items: spans as they stand, decoys, scores and placeholders."""

from pyspark.sql import functions as F

from terrasift.llm.address import Gazetteer
from terrasift.llm.personal import Finder, disclosing_runs, disclosure, personal_items, redact, redacted, seeds, shadow
from tests.llm.test_address import gaz

FOUND = [
    ("承辦人：郗笙奕　電話：0949-790976", [("person_name", "郗笙奕"), ("phone", "0949-790976")]),
    ("所有權人 冉璦（身分證字號 Ｏ２７８５０３８６０）設籍 霧港市青嵐區\n菊風智路二段205-3號。", [("person_name", "冉璦"), ("national_id", "Ｏ２７８５０３８６０"), ("street_address", "霧港市青嵐區\n菊風智路二段205-3號")]),
    ("Reviewed by Orla Maravent (casimir.lindqvarn[at]files[dot]invalid).", [("person_name", "Orla Maravent"), ("email", "casimir.lindqvarn[at]files[dot]invalid")]),
    ("Contact: Elske Maravent, tel. (02)0137-7028, a.b+c (at) mail.example", [("person_name", "Elske Maravent"), ("phone", "(02)0137-7028"), ("email", "a.b+c (at) mail.example")]),
    ("Prepared for Ms Linnea Fennimark, 344 Quarrymoor Lane, on behalf of the owners.", [("person_name", "Linnea Fennimark"), ("street_address", "344 Quarrymoor Lane")]),
    ("附件由 ysolde＠mail.example 寄出後轉交酆昕璟估價師複核", [("email", "ysolde＠mail.example"), ("person_name", "酆昕璟")]),
    ("會勘時虞霈先生表示鄰地已於去年整地，另洽 +886 2 0780 6752。", [("person_name", "虞霈"), ("phone", "+886 2 0780 6752")]),
    ("戈珞女士來電（０９４７-062-854 分機 60）詢問", [("person_name", "戈珞"), ("phone", "０９４７-062-854")]),
    ("鄰地占用人住青嵐區榆雨勤路2段3巷187-3號對面", [("street_address", "青嵐區榆雨勤路2段3巷187-3號")]),
    ("通訊地址：芷星謙大道 3 段917之2號5樓", [("street_address", "芷星謙大道 3 段917之2號")]),
    ("統一證號 G 190249013 之申請人未到場", [("national_id", "G 190249013")]),
    ("圖幅 310-972，坐標 310972.11, 27972310.25", []), ("發票 QD-82106602 已核銷", []), ("收文字號 3381304191 已歸檔", []), ("案號 1131011-534-535 第 10 次補正", []),
    ("Sheet 10 of 22; checksum 21055724", []), ("Façade Aurélie lot 17-844, frontage 95 m", []), ("比準地 青嵐段 202 地號", []), ("區段編號 Q0226-00 抄錄 567 筆", []), ("ID Z372140077", []),
]


def test_spans(spark):
    f = Finder(Gazetteer.collect(gaz(spark), roads=True))
    for text, want in FOUND:
        plain, at = shadow(text)
        ids = f.identifiers(plain)
        bare = plain
        for s, e, _ in ids:
            bare = bare[:s] + "\x00" * (e - s) + bare[e:]
        got = sorted((at[s], kind, text[at[s] : at[e - 1] + 1]) for s, e, kind in [*ids, *((s, e, "person_name") for s, e in seeds(bare))])
        assert [(k, x) for _, k, x in got] == want, text


def test_rows(spark):
    names = Gazetteer.collect(gaz(spark), roads=True)
    texts = [(i, t) for i, (t, _) in enumerate(FOUND)] + [(100, None), (101, ""), (102, "承辦人：尚未指派\n尚未指派人員\n指派前尚未到場")] + [(200 + i, f"尚未指派 第 {i} 項") for i in range(40)]
    texts.append(texts[0])
    df = spark.createDataFrame(texts, "unit int, text string").withColumns({"kind": F.lit("clash"), "term": F.lit(1)})
    items = personal_items(df, names)
    got = {(r.unit, r.kind, r.found) for r in items.collect()}
    assert got == {(i, k, x) for i, (_, w) in enumerate(FOUND) for k, x in w}
    out = {r.unit: r.text for r in redacted(df, items).collect()}
    assert out[0] == "承辦人：[PERSON_NAME]　電話：[PHONE]" and out[100] is None and out[101] == "" and out[11] == FOUND[11][0]
    assert "尚未指派" in out[102]
    assert personal_items(df.limit(0), names).count() == 0


def test_unlisted_roles(spark):
    """Names beside roles that are on no list, or beside none, are given away by their terms; without disclosure all runs would be names."""
    people = ["郗笙奕", "冉璦", "虞霈", "戈珞漪", "酆昕璟", "瞿霈璦"]
    west = ["Orla Maravent", "Elske Lindqvarn", "Ivo Maravent"]
    texts = [f"承辦人：{p}，已歸檔\n道路寬度與使用分區" for p in people] + [f"Contact: {w}, filed. Plaza Nova lot" for w in west]
    texts += [f"管理員{p}已到場" for p in people] + [f"巡查時見{p}在場" for p in people] + [f"Surveyor {w} was here, Plaza Nova lot" for w in west] + ["道路寬度", "Plaza Nova", "使用分區"] * 5
    df = spark.createDataFrame(list(enumerate(texts)), "unit int, text string")
    names = Gazetteer.collect(gaz(spark), roads=True)
    found = lambda t: {(r.unit, r.found) for r in personal_items(df, names, t).collect() if r.kind == "person_name"}
    want = {(i, p) for i, t in enumerate(texts) for p in people + west if p in t and not any(p in q and q in t and p != q for q in people)}
    assert found(0.25) == want
    assert found(1.01) == set()
    off = found(float("-inf"))
    assert (9, "管理員郗") in off and len(off - want) > 20
    scores = {r.term: r.score for r in disclosure(df).collect()}
    assert scores["霈"] > 0.5 and "道" not in scores and "Plaza" not in scores


def test_runs():
    x, o = 0.9, 0.0
    assert disclosing_runs([o, x, x, o, x, o, x, x, x, x, x, x], 0.25) == [(1, 3), (6, 10), (10, 12)]
    assert disclosing_runs([], 0.25) == [] and disclosing_runs([x] * 5, 0.25) == [(0, 4)] and disclosing_runs([x], 0.25) == []


def test_longer_lower_form(spark):
    """A letter that lower() makes two does not hide the addresses of its text."""
    text = "İstanbul İpek 設籍 霧港市青嵐區\n菊風智路二段205-3號。"
    df = spark.createDataFrame([(1, text)], "unit int, text string")
    items = personal_items(df, Gazetteer.collect(gaz(spark), roads=True))
    assert [(r.kind, r.found) for r in items.collect()] == [("street_address", "霧港市青嵐區\n菊風智路二段205-3號")]
    assert redacted(df, items).collect()[0].text == "İstanbul İpek 設籍 [STREET_ADDRESS]。"


def test_redact():
    assert redact("a b c", [(0, 1, "email"), (0, 1, "email"), (4, 5, "phone")]) == "[EMAIL] b [PHONE]"


def test_long(spark):
    """Very long runs are read once, not once per character."""
    import time

    f = Finder(Gazetteer.collect(gaz(spark), roads=True))
    for unit in ("a", "a.", "1", "09", "承辦人：郗笙奕 0949-790976\n", "路", "雲", "A b ", "x@", "x@y.", "(", "菊風智路1", "[at]"):
        text = unit * (400_000 // len(unit))
        start = time.time()
        plain, at = shadow(text)
        f.identifiers(plain)
        seeds(plain)
        assert time.time() - start < 15, unit
    assert [m for m in f.identifiers(".a@b.co, x")][0] == (1, 7, "email")
