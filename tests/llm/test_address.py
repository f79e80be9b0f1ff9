"""Reading, alignment, and places against a plain comparison of parts."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from terrasift.llm.address import Gazetteer, alignment_cost, cluster_roads, han_number, place_pairs, places, tokens

CITY = [(1, "city", "雲臺市", "Yuntai City", None), (50, "city", "霧港市", "Wugang City", None)]
ROADS = [("菊風智路", "Jufengzhi Rd."), ("榆雨勤路", "Yuyuqin Rd."), ("芷星謙大道", "Zhixingqian Blvd."), ("松雪平街", "Songxueping St.")]


def gazetteer_rows():
    rows, n = list(CITY), 2
    for city in (1, 50):
        for d, en in (("青嵐區", "Qinglan District"), ("霧澤區", "Wuze District")):
            n = max(r[0] for r in rows) + 1
            rows.append((n, "district", d, en, city))
            for name, western in ROADS[:2] if d == "青嵐區" else ROADS[2:]:
                rows.append((max(r[0] for r in rows) + 1, "road", name, western, n))
    return rows


def gaz(spark):
    return spark.createDataFrame(gazetteer_rows(), "place_id long, kind string, name_zh string, name_en string, parent_id long")


def test_numbers():
    assert [han_number(x) for x in ("十", "十四", "二十五", "一百零三", "007", "三", "一二", "x")] == ["10", "14", "25", "103", "7", "3", "12", None]


def test_reading(spark):
    g = Gazetteer.collect(gaz(spark))
    want = {"city": "雲台市", "section": "2", "lane": "17", "alley": "14", "no": "5", "suffix": "3"}
    for text in (
        "雲臺市青嵐區菊風智路二段17巷十四弄5號之3", "３２８-雲台青嵐菊風智路 ２ 段１７巷１４弄５之三號，4樓", "菊風智路2段17巷14弄5-3號", "王小明先生 / 青嵐區永福里14鄰菊風智路2段17巷14弄5號之3（屋主X）",
        "4F., No. 5-3, Aly. 14, Lane 17, Sec. 2, Jufengzhi Road, Qinglan Dist., Yuntai City", "NO 5-3,ALLEY 14,LN. 17,SECTION 2,JUFENGZHI RD.",
    ):
        got = g.read(text)
        assert {k: got[k] for k in want} == want, text
    for text in (None, "", "  ", "青嵐段 12-3 地號", "青嵐區菊風智路"):
        assert g.read(text) is None


def test_alignment():
    t = lambda x: tokens(x, "east")
    assert alignment_cost(t("菊風智路"), t("菊風智路")) == 0
    assert alignment_cost(t("菊豐智路"), t("菊風智路")) == 1
    assert alignment_cost(t("菊智路"), t("菊風智路")) == 1
    assert alignment_cost(t("菊風智智路"), t("菊風智路")) == 1
    assert alignment_cost(t("路"), t("菊風智路")) == 2  # one gap of three
    assert alignment_cost(["jufengzhi", "rd"], ["jufengzhi", "road"]) == 0
    assert alignment_cost(t("芷星謙大道"), t("菊風智路")) > 1.5


def spell(rnd, city, district, road, west, sec, lane, no, suf, typo):
    if rnd.random() < 0.2 and not typo:
        parts = [f"No. {no}" + (f"-{suf}" if suf else "")] + ([f"Lane {lane}"] if lane else []) + ([f"Sec. {sec}"] if sec else []) + [west, f"{'Qinglan' if district == '青嵐區' else 'Wuze'} Dist."]
        return ", ".join([*parts, "Wugang City"] if city == "霧港市" else parts)
    r = road
    if typo:
        i = rnd.randrange(3)
        r = rnd.choice([road[:i] + "訢" + road[i + 1 :], road[:i] + road[i + 1 :], road[: i + 1] + road[i:]])
    head = (city if city == "霧港市" else rnd.choice(["", "雲臺市", "雲台"])) + (district if typo or rnd.random() < 0.7 else "")
    return head + r + (f"{sec}段" if sec else "") + (f"{lane}巷" if lane else "") + (rnd.choice([f"{no}號之{suf}", f"{no}之{suf}號", f"{no}-{suf}號"]) if suf else f"{no}號") + rnd.choice(["", "，3樓", "，5F", "十二樓"])


def test_places(spark):
    rnd, rows, truth = random.Random(5), [], {}
    spots = []
    for city in ("雲臺市", "霧港市"):
        for d, roads in (("青嵐區", ROADS[:2]), ("霧澤區", ROADS[2:])):
            for road, west in roads:
                for sec, lane, no, suf in ((None, None, 7, None), (4, None, 7, None), (None, 600, 7, None), (None, None, 8, None), (None, None, 7, 5)):
                    spots.append((city, d, road, west, sec, lane, no, suf))
    for i, s in enumerate(spots):
        for j in range(4):
            key = f"r{i:03}-{j}"
            rows.append((key, spell(rnd, *s, typo=j == 3)))
            truth[key] = i
    rows += [("n1", None), ("n2", " "), ("n3", "青嵐段 12-3 地號"), rows[0]]
    df = spark.createDataFrame(rows, "record string, address string").withColumns({"city": F.lit("clash"), "place": F.lit("clash")})
    got = {tuple(r) for r in place_pairs(places(df, F.col("record"), F.col("address"), gaz(spark))).collect()}
    want = {(a, b) for a, b in itertools.combinations(sorted(truth), 2) if truth[a] == truth[b]}
    assert got == want
    assert places(df.limit(0), F.col("record"), F.col("address"), gaz(spark)).count() == 0


def test_unknown_road(spark):
    rows = [("a", "雲臺市青嵐區新生路3號"), ("b", "青嵐區新生路３號"), ("c", "青嵐區新生路4號")]
    df = spark.createDataFrame(rows, "record string, address string")
    assert [tuple(r) for r in place_pairs(places(df, F.col("record"), F.col("address"), gaz(spark))).collect()] == [("a", "b")]


def test_any_order(spark):
    rows = [
        ("a1", "青嵐區菊風智路5號"), ("a2", "青嵐区菊風智路5号"), ("a3", "青崗區菊風智路5號"), ("a4", "菊風智路5號,青嵐區"), ("a5", "Jufengzhi Rd. No. 5"), ("a6", "Qinglan District, Jufengzhi Road No.5"), ("a7", "雲臺市青岚區菊風智路5號"), ("a8", "菊風智路5號（雲臺市青嵐區）"),
        ("a9", "雲召市青嵐區菊風智路5號"), ("aa", "會址在雲臺市青嵐區菊風智路5號"), ("ab", "No. 5, Jufengzhi Rd., Qinglun Dist."),
        ("b1", "菊風智路二段5號"), ("b2", "No. 5, Jufengzhi Rd., Sec. 2"), ("b3", "Sec. 2, Jufengzhi Rd., No. 5, Yuntai City"), ("b4", "Yuntai City, Qinglan Dist., Sec 2 Jufengzhi Rd, No 5"),
        ("c1", "霧港市青嵐區菊風智路5號"), ("c2", "菊風智路5號，霧港市"), ("d", "菊風智路5之1號"),
    ]
    df = spark.createDataFrame(rows, "record string, address string")
    got = {r.record: r.place for r in places(df, F.col("record"), F.col("address"), gaz(spark)).collect()}
    assert len(got) == len(rows)
    kinds = {}
    for record, place in got.items():
        kinds.setdefault(place, set()).add(record[0])
    assert sorted(map(sorted, kinds.values())) == [["a"], ["b"], ["c"], ["d"]], got


def test_typos_in_every_part(spark):
    """Recall of pairs whose city, district or road has a wrong, lost or doubled character; numbers must agree."""
    rnd, rows, truth = random.Random(8), [], {}
    for i, (city, d, (road, _)) in enumerate((c, d, r) for c in ("雲臺市", "霧港市") for d, rs in (("青嵐區", ROADS[:2]), ("霧澤區", ROADS[2:])) for r in rs):
        for part in range(3):
            for kind in range(3):
                for j in range(3):
                    names = [city, d, road]
                    x = names[part]
                    at = rnd.randrange(2 if part < 2 else 3)
                    names[part] = (x[:at] + rnd.choice("訢甲乙丙") + x[at + 1 :], x[:at] + x[at + 1 :], x[:at] + x[at] + x[at:])[kind]
                    truth[f"r{i}-{part}{kind}{j}"] = (i, j)
                    rows.append((f"r{i}-{part}{kind}{j}", f"{''.join(names)}{7 + j}號"))
    df = spark.createDataFrame(rows, "record string, address string")
    got = {tuple(r) for r in place_pairs(places(df, F.col("record"), F.col("address"), gaz(spark)), block=2).collect()}
    want = {(a, b) for a, b in itertools.combinations(sorted(truth), 2) if truth[a] == truth[b]}
    lost = sorted(want - got)
    assert len(got & want) >= 0.95 * len(want), (len(lost), [dict(rows)[a] for a, _ in lost][:9])
    assert not got - want


def test_roads_on_no_list(spark):
    """Misspellings of a road that no list has meet each other."""
    rows = [(f"k{i}", x) for i, x in enumerate(["青嵐區新生北路3號", "青嵐區新生化路3號", "青嵐區新北路3號", "雲臺市青嵐區新生北北路3號", "No. 3, Xinsheng Rd., Qinglan Dist.", "No. 3, Xinshemg Road, Qinglan Dist."])] + [("z", "青嵐區大同南路3號")]
    df = spark.createDataFrame(rows, "record string, address string")
    got = {r.record: r.place for r in places(df, F.col("record"), F.col("address"), gaz(spark)).collect()}
    assert len({got[f"k{i}"] for i in range(4)}) == 1 and got["k4"] == got["k5"] and len(set(got.values())) == 3


def _clusters(spark, rows, block):
    df = spark.createDataFrame(rows, "city string, district string, road string, script string")
    out = {}
    for r in cluster_roads(df, block).collect():
        out.setdefault(r["name"], set()).add((r.city, r.district, r.road, r.script))
    return sorted(map(sorted, ([tuple(map(str, x)) for x in c] for c in out.values())))


def test_links_on_no_list(spark):
    """Spellings that are near only each other, not the least one of what they share, are one place too."""
    east = [["丁區甲乙丙路", "丁區丑乙丙路"], ["乙區寅乙丙路"], ["丁區新生北路", "丁區新生化路"], ["丁區卯路", "丁區辰路"], ["申酉路", "丁區申酉戌亥路", "乙區未酉路"]]
    west = [["Xinmenglu Road", "Xznmxngyu Rd.", "Xinmenwwu Road"], ["A Rd.", "B Rd."], ["Xueqian Road"], ["Xueqian Street"]]
    groups = [[f"{x}3號" for x in g] for g in east] + [[f"No. 3, {x}" for x in g] for g in west]
    df = spark.createDataFrame([(x, x) for g in groups for x in g], "record string, address string")
    got = {}
    for r in places(df, F.col("record"), F.col("address"), gaz(spark)).collect():
        got.setdefault(r.place, set()).add(r.record)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups))


def test_all_links_on_no_list(spark):
    """The clusters are those of all pairs that cost no more than the threshold."""
    rnd, rows = random.Random(4), set()
    for _ in range(50):
        city, district = rnd.choice(["雲台市", "霧港市"]), rnd.choice([None, "青嵐區", "霧澤區"])
        name = [rnd.choice("甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳午未申酉戌亥天地玄黃") for _ in range(rnd.choice([1, 2, 3, 4]))]
        word = "".join(rnd.choice(["ju", "feng", "zhi", "yu", "xue", "ping", "o"]) for _ in range(rnd.choice([1, 2, 3, 4])))
        kind, street = rnd.choice(["路", "街", "大道"]), rnd.choice(["road", "street"])
        for _ in range(3):
            rows |= {(city, district, "".join(name) + kind, "east"), (city, district, f"{word} {street}", "west")}
            name[rnd.randrange(len(name))] = rnd.choice("甲乙丙丁戊")
            at = rnd.randrange(len(word))
            word = word[:at] + rnd.choice("aegnx") + word[at + rnd.choice([0, 1, 1]) :]
    rows = sorted(rows, key=str)
    label = {r: i for i, r in enumerate(rows)}
    for a, b in itertools.combinations(rows, 2):
        if a[0] == b[0] and a[3] == b[3] and (None in (a[1], b[1]) or a[1] == b[1]) and label[a] != label[b] and alignment_cost(tokens(a[2], a[3]), tokens(b[2], b[3])) <= 1.5:
            label |= {r: label[a] for r in rows if label[r] == label[b]}
    want = {}
    for r, i in label.items():
        want.setdefault(i, []).append(tuple(map(str, r)))
    assert _clusters(spark, rows, 30) == sorted(map(sorted, want.values()))


def test_more_roads_than_any_broadcast(spark, monkeypatch):
    """Roads are matched by joins: more of them than may go to all tasks are no error."""
    from terrasift.llm import address

    monkeypatch.setattr(address, "MOST_PLACES", 3)
    df = spark.createDataFrame([("a", "青嵐區菊風智路5號"), ("b", "菊豐智路5號")], "record string, address string")
    assert [tuple(r) for r in place_pairs(places(df, F.col("record"), F.col("address"), gaz(spark))).collect()] == [("a", "b")]
    with pytest.raises(ValueError):
        Gazetteer.collect(gaz(spark), roads=True)


def test_long(spark):
    import time

    g = Gazetteer.collect(gaz(spark))
    for unit in ("1", "路", "一", "雲臺市", "no 1,", "a", "no1,a", "菊風智路1", "1巷", "里1鄰"):
        start = time.time()
        g.read(unit * (300_000 // len(unit)))
        assert time.time() - start < 15, unit
