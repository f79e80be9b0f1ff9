"""Visual form: what is equal, what is not, and quotes on pages."""

import unicodedata

from pyspark.sql import functions as F

from terrasift.llm.visual import LOOK_ALIKES, SYMBOLS, Scores, consistent, letter_bigrams, normalize_text, plain, quotes_in_form, stands, units


def counted(words):
    counts = {}
    for w in words:
        line = ["^", *w, "$"]
        for pair in zip(line, line[1:]):
            counts[pair] = counts.get(pair, 0) + 1
    return Scores(counts)


LATIN = counted(["House", "Section", "parcel", "type"] * 20)


def form(t):
    return consistent(t, LATIN)


def test_equal():
    same = [
        ("ＷＩＤＴＨ　１２％", "WIDTH 12%"), ("Señorial", "Señorial"), ("a​b­c﻿", "abc"), ("a b c　d", "a b c d"), ("⾯⽐⽤", "面比用"),
        ("路樓", "路樓"), ("Кőѕzеg Ноuѕе", "Kőszeg House"), ("ΗοuѕΕ", "HousE"), ("e‍́", "é"), ("ﾊﾝ", "ハン"), ("面︀", "面"), ("ё", "ë"), ("⻑⻄⻘", "長西青"),
    ]
    for a, b in same:
        assert form(a) == form(b), (a, b)


def test_different():
    for a, b in [("Facade", "Façade"), ("a  b", "a b"), ("A", "a"), ("12", "13"), ("a\nb", "a b"), ("臺", "台"), ("m²", "m2"), ("O", "0")]:
        assert form(a) != form(b), (a, b)
    assert plain("a\r\nb") == "a\r\nb"


def test_lattice():
    s = counted(["House", "Section", "parcel", "type"] * 20 + ["Привет", "дорога", "посёлок"] * 20)
    assert consistent("Ноuѕе рarсеl", s) == "House parcel"
    assert consistent("Пpивeт дopoгa", s) == consistent("Привет дорога", s) == "Привет дорога"
    assert consistent("Séс", s) == "Séc"
    assert consistent("", s) == ""
    # the scores choose: the same looks, another corpus, another form
    assert consistent("Poo", counted(["Роо"] * 50)) == "Роо" and consistent("Роо", counted(["Poo"] * 50)) == "Poo"
    # the best path of all paths, by brute force
    import itertools

    twins = lambda c: [c, *(k for k, v in LOOK_ALIKES.items() if v == c)]
    for w in ("Pap", "oxe", "Hоu"):
        ways = itertools.product(*(twins(LOOK_ALIKES.get(c, c)) for c in w))
        total = lambda p: sum(s(a, b) for a, b in zip(["^", *p], [*p, "$"]))
        assert abs(max(map(total, ways)) - total(s.path(w))) < 1e-9


def test_one_form_for_equal_looks():
    """Against the definition: texts whose letters look alike pairwise, and only those, have one form, also in part."""
    import random

    rnd = random.Random(5)
    some = "Paуeѕ оΟo寬ёéñᎪաԼ1 -Пив"
    look = lambda t: unicodedata.normalize("NFC", "".join(LOOK_ALIKES.get(c, c) for c in unicodedata.normalize("NFD", plain(t))))
    other = {}
    for k, v in LOOK_ALIKES.items():
        other.setdefault(v, [v]).append(k)
    disguise = lambda t: "".join(rnd.choice(other.get(LOOK_ALIKES.get(c, c), [c])) for c in t)
    kinds = set()
    for s in (Scores({}), counted(["Роо", "ауе"] * 50), LATIN):
        for _ in range(700):
            page = "".join(rnd.choice(some) for _ in range(rnd.randint(0, 14)))
            a = rnd.randint(0, len(page))
            quote = disguise(page[a : a + rnd.randint(1, 9)])
            if rnd.random() < 0.3:
                quote = quote[:-1] + rnd.choice(some)
            p, q = units(page), units(quote)
            want = bool(look(quote)) and look(quote) in look(page)
            if quote and unicodedata.combining(q[0] if q else "x"):
                continue
            assert stands(q, p, s.read(p), s) == want, (page, quote)
            kinds.add((want, stands(q, p, p, None)))
    assert kinds == {(True, True), (True, False), (False, False)}


def test_without_viterbi(spark):
    """Switched off, the search for the best path is missed in the rows."""
    pages = spark.createDataFrame([("d", 1, "Señorial Plaza lot 5"), ("d", 2, "abc ｄ")], "document_id string, page int, text string")
    q = spark.createDataFrame([(1, "d", 1, "Рlаzа lot"), (2, "d", 2, "abc d"), (3, "d", 1, "iаl Рlа"), (4, "d", 1, "аzа")], "quote_id long, document_id string, page int, quote string")
    scores = letter_bigrams([pages.select("text"), q.select("quote")])
    rows = lambda s: sorted(r.quote_id for r in quotes_in_form(q, pages, s).collect())
    assert rows(scores) == [1, 2, 3, 4] and rows(None) == [2]
    assert len(scores.pairs) <= len(SYMBOLS) ** 2


def test_rows(spark):
    pages = spark.createDataFrame(
        [("d", 1, "Señorial Plaza, 12% \n路樓"), ("d", 2, None), ("d", 3, "one"), ("d", 3, "ｔｗo"), ("d", 1, "Señorial Plaza, 12% \n路樓")], "document_id string, page int, text string"
    )
    quotes = [
        (1, "d", 1, "Plaza, 12%"), (2, "d", 1, "Рlаzа， １２％"), (3, "d", 1, ""), (4, "d", 1, None), (5, "d", 2, "x"), (6, "d", 9, "Plaza"), (7, "e", 1, "Plaza"), (8, "d", 1, "Plaza, 13%"),
        (9, "d", 3, "two"), (10, "d", 3, "one"), (11, "d", 1, "​"), (12, "d", 1, "路樓"), (2, "d", 1, "Рlаzа， １２％"), (13, None, None, "x"),
    ]
    q = spark.createDataFrame(quotes, "quote_id long, document_id string, page int, quote string").withColumns({"text": F.lit("clash"), "verbatim": F.lit(1)})
    scores = letter_bigrams([pages.select("text"), q.select("quote")])
    assert sorted(r.quote_id for r in quotes_in_form(q, pages, scores).collect()) == [2, 9, 12]
    assert quotes_in_form(q.limit(0), pages, scores).count() == 0
    out = [r.form for r in normalize_text(pages.orderBy("page"), F.col("text"), scores).collect()]
    assert None in out and "two" in out
    assert letter_bigrams([pages.limit(0).select("text")]).pairs == {}


def test_long():
    import time

    s = counted(["При", "Po"] * 3)
    for unit in ("Привет", "о", "Pоrtо ", "é", "​", "路"):
        start = time.time()
        out = consistent(unit * (200_000 // len(unit)), s)
        assert time.time() - start < 30 and (unit == "​" or out), unit
