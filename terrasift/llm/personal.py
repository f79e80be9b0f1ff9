"""Personal information inside free text: found by kind, replaced by typed placeholders.

Two sorts of items:

*Identifiers* (e-mail addresses also in disguise, phone numbers, identity numbers,
street addresses) have a form of their own. They are matched on a shadow of the text
in which widths, look-alikes and invisible characters are made plain; each character
of the shadow knows its place, so what is reported is exactly the text as it stands.

*Names* have none; what gives them away is the company they keep. A few roles and
titles are seeds: what stands beside them is a sample of the protected persons. Over
the whole corpus it is counted how often each term (an ideograph, a capitalised word)
occurs and how often in that company; its disclosure is the normalised pointwise
mutual information of the two,

    log2(P(person | term) / P(person)) / log2(1 / P(person))

with ``PRIOR`` occurrences at the corpus' own rate added: 1 means that the term
occurs as part of a person only, 0 that it tells nothing. Names are then read from
the disclosure, wherever they stand:

* a run of 2 to 4 terms each of which discloses at least ``DISCLOSURE`` is a name,
  also beside a role that is on no list, or beside none;
* what stands beside a seed is a name if its terms do so on average, so that a name
  may hold a common character; "to be announced" after a role is none.

1. A pass counts terms and seeds, per batch before the shuffle.
2. A pass finds identifiers and the names made of ideographs: the disclosing
   ideographs go to all tasks, no more of them than there are ideographs. Runs of
   capitalised words come out grouped, each distinct run once a batch with all its
   places, so that a name that a third of all texts hold is one row a batch.
3. Words of the distinct runs meet their scores in a join, the runs their places.

Defined cases: null and empty texts have no item; an item that occurs twice in one
text is one found row and is replaced twice; of overlapping items the first kind in
the order email, national_id, phone, street_address, person_name counts; repeated
records are found once (and counted for the scores as often as they are stored); of a
longer run of disclosing terms than four every four are one item; a unit stands for
one text; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasift.llm.address import _TAIL, ROAD_KINDS, Gazetteer
from terrasift.llm.visual import _PLAIN, LOOK_ALIKES
from terrasift.session import cut_lineage

DISCLOSURE = 0.25
PRIOR = 1.0
MOST_TERMS = 4  # terms of a name
KINDS = ("email", "national_id", "phone", "street_address", "person_name")
PLACEHOLDERS = {k: f"[{k.upper()}]" for k in KINDS}

# fixed values, seeds of the counts: roles before a name, titles after it, words that end it
ROLES = ("所有權人", "承辦人", "聯絡人", "承租人", "出租人", "代收人", "代理人", "收件人", "負責人", "經辦人", "簽收人", "屋主", "地主", "業主", "買方", "賣方")
LOOSE_ROLES = ("代收人", "屋主", "地主", "業主", "聯絡人", "承租人", "承辦人")
LEADS = ("會勘時", "轉交", "洽詢", "通知", "會同", "委由")
TITLES = ("先生", "女士", "小姐", "估價師", "地政士", "建築師", "律師", "技師", "代書", "主任", "經理")
STOPS = ("身分證", "電話", "手機", "設籍", "地址", "住址", "行動")
WESTERN_ROLES = ("Reviewed by", "Prepared for", "Prepared by", "Contact", "Attention", "Attn", "Owner", "Tenant", "Signed by")
WESTERN_TITLES = ("Mr", "Ms", "Mrs", "Miss", "Dr")
STREET_WORDS = ("Lane", "Road", "Street", "Avenue", "Drive", "Way", "Close", "Crescent", "Terrace", "Boulevard", "Gardens", "Row", "Hill", "Walk", "Grove", "Square", "Rd", "St", "Ave", "Blvd", "Ln")

_H = "㐀-鿿"
_ANY = lambda words: "|".join(sorted(map(re.escape, words), key=len, reverse=True))
# begins only where a run of its characters begins, so that long runs are read once
_EMAIL = re.compile(
    r"(?<![A-Za-z0-9._%+-])[._%+-]*+(?P<e>[A-Za-z0-9][A-Za-z0-9._%+-]*+(?: ?@ ?| ?[(\[{] ?at ?[)\]}] ?)[A-Za-z0-9-]++(?:(?:\.| ?[(\[{] ?dot ?[)\]}] ?)[A-Za-z0-9-]++)+)", re.I
)
_ID = re.compile(r"(?<![A-Za-z0-9])[A-Za-z] ?[12][0-9]{8}(?![0-9A-Za-z])")
_PHONE = re.compile(
    r"(?<![0-9A-Za-z+.-])(?:\+886[- ]?\(?0?\)?9[0-9]{2}[- ]?[0-9]{3}[- ]?[0-9]{3}|\+886[- ]?\(?0?\)?[2-8][0-9]?[- ]?[0-9]{3,4}[- ]?[0-9]{4}"
    r"|09[0-9]{2}[- ]?[0-9]{3}[- ]?[0-9]{3}|\(0[2-8][0-9]?\)[- ]?[0-9]{3,4}[- ]?[0-9]{4}|0[2-8][0-9]?[- ][0-9]{3,4}[- ]?[0-9]{4})(?![0-9]|-[0-9])"
)
_NAME = rf"(?P<n>[{_H}]{{2,4}}?)"
_NAMES = [
    re.compile(rf"(?:{_ANY(ROLES)})(?:[:：] ?| ){_NAME}(?= ?(?:{_ANY(TITLES + STOPS)})|[^{_H}]|$)", re.M),
    re.compile(rf"(?:{_ANY(LOOSE_ROLES)}){_NAME}(?= ?(?:{_ANY(TITLES + STOPS)})|[^{_H}]|$)", re.M),
    re.compile(rf"(?:{_ANY(LEADS)}) ?{_NAME}(?={_ANY(TITLES)})", re.M),
    re.compile(rf"(?:^|(?<=[^{_H}])){_NAME}(?={_ANY(TITLES)})", re.M),
    re.compile(rf"(?:\b(?:{_ANY(WESTERN_ROLES)}):? (?:(?:{_ANY(WESTERN_TITLES)})\.? )?|\b(?:{_ANY(WESTERN_TITLES)})\.? )(?P<n>[A-Z][\w'’-]+(?: [A-Z][\w'’-]+){{1,3}})"),
]
_WEST_STREET = re.compile(rf"(?<![\w/.-])[0-9]{{1,5}}[A-Za-z]?(?:-[0-9]+)? (?:[A-Z][\w'’-]+ ){{1,3}}(?:{_ANY(STREET_WORDS)})\b\.?")
_SOLID = re.compile(r"\S+")
_CAPITAL = "A-ZÀ-ÖØ-Þ"
_HAN_RUN = re.compile(rf"[{_H}]+")
_WORD_RUN = re.compile(rf"(?<![\w'’-])[{_CAPITAL}][\w'’-]+(?: [{_CAPITAL}][\w'’-]+)+")
_TERM = re.compile(rf"[{_H}]|(?<![\w'’-])[{_CAPITAL}][\w'’-]+")


class _Shadow(dict):
    """Per character what stands for it in the shadow; characters that are left out or become several are kept apart."""

    def __init__(self):
        super().__init__()
        self.odd: set[str] = set()

    def __missing__(self, o: int):
        ch = chr(o)
        got = "".join(LOOK_ALIKES.get(c, c) for c in _PLAIN[o] or "")
        if len(got) != 1:
            self.odd.add(ch)
        self[o] = got
        return got


_SHADOW = _Shadow()


def shadow(text: str) -> tuple[str, Sequence[int]]:
    """A plain twin of ``text`` and, for each of its characters, the place in ``text``."""
    plain = text.translate(_SHADOW)
    if _SHADOW.odd.isdisjoint(text):
        return plain, range(len(text))
    at: list[int] = []
    for i, ch in enumerate(text):
        n = len(_SHADOW[ord(ch)])
        if n == 1:
            at.append(i)
        else:
            at += [i] * n
    return plain, at


class Finder:
    """Finds items in one text."""

    def __init__(self, names: Gazetteer):
        short = lambda xs, end: sorted({x.removesuffix(end) for x in xs}, key=len, reverse=True)
        cities, districts = _ANY(short(names.cities, "市")) or "(?!)", _ANY(short(names.districts, "區")) or "(?!)"
        tail = re.sub(r"\?P<\w+>", "?:", _TAIL)
        village = rf"(?:[{_H}]{{2,3}}里)?(?:[0-9]{{1,4}}鄰)?"
        kinds = "|".join(ROAD_KINDS)
        self.roads = {r.name for r in names.roads}
        self.lengths = sorted(set(map(len, self.roads)), reverse=True)
        longest = max([6, *self.lengths])
        # an address is found by its end (a word for a road and the numbers) and then read back to its first place name
        self._end = re.compile(rf"(?:{kinds}){tail}")
        self._begin = re.compile(rf"(?:(?:{cities})市?(?:(?:{districts})區?)?{village}|(?:{districts})區?{village})[{_H}]{{1,{longest}}}?(?:{kinds})$")
        self._back = sum(max(map(len, xs), default=0) + 1 for xs in (names.cities, names.districts)) + len("三字里1234鄰") + longest + 2

    def _streets(self, plain: str) -> list[tuple[int, int]]:
        dense: list[int] = []
        for m in _SOLID.finditer(plain):
            dense.extend(range(m.start(), m.end()))
        solid = "".join(_SOLID.findall(plain)).replace("臺", "台").replace("号", "號")
        text = solid.lower()
        if len(text) != len(solid):  # a letter whose lower form is longer stays, so that places agree
            text = "".join(c if len(c.lower()) != 1 else c.lower() for c in solid)
        if "號" not in text:
            return []
        out, after = [], 0
        for m in self._end.finditer(text):
            kind = m.start() + (2 if text.startswith("大道", m.start()) else 1)
            low = max(after, kind - self._back)
            head = self._begin.search(text[low:kind])
            # without a city or district an official road is the first place name
            start = low + head.start() if head else next((kind - n for n in self.lengths if kind - n >= after and text[kind - n : kind] in self.roads), None)
            if start is not None:
                out.append((dense[start], dense[m.end() - 1] + 1))
                after = m.end()
        return out

    def identifiers(self, plain: str) -> list[tuple[int, int, str]]:
        """(start, end, kind) in the shadow, without overlaps."""
        found = [(*m.span("e"), "email") for m in _EMAIL.finditer(plain)]
        found += [(m.start(), m.end(), kind) for kind, p in (("national_id", _ID), ("phone", _PHONE)) for m in p.finditer(plain)]
        found += [(s, e, "street_address") for s, e in self._streets(plain)]
        found += [(m.start(), m.end(), "street_address") for m in _WEST_STREET.finditer(plain)]
        taken, out = bytearray(len(plain)), []
        for s, e, kind in sorted(found, key=lambda x: (KINDS.index(x[2]), x[0], -x[1])):
            if 1 not in taken[s:e]:
                taken[s:e] = b"\x01" * (e - s)
                out.append((s, e, kind))
        return sorted(out)


def seeds(plain: str) -> list[tuple[int, int]]:
    """(start, end) of what stands beside a role or a title, without overlaps."""
    used, out = bytearray(len(plain)), []
    for p in _NAMES:
        for m in p.finditer(plain):
            s, e = m.span("n")
            if 1 not in used[s:e]:
                used[s:e] = b"\x01" * (e - s)
                out.append((s, e))
    return sorted(out)


def disclosing_runs(scores: list[float], threshold: float) -> list[tuple[int, int]]:
    """(first, end) of the runs of 2 to ``MOST_TERMS`` neighbours that all reach the threshold; longer runs are cut."""
    out, first = [], 0
    for i, score in enumerate([*scores, float("-inf")]):
        if score < threshold or i - first == MOST_TERMS:
            if i - first >= 2:
                out.append((first, i))
            first = i + (score < threshold)
    return out


class Disclosure(dict):
    """Scores of ideographs; one that was never seen beside a seed tells nothing."""

    def __missing__(self, ch: str) -> float:
        return float("-inf")

    def names(self, plain: str, near: list[tuple[int, int]], threshold: float) -> list[tuple[int, int]]:
        """(start, end) of names made of ideographs: beside a seed by the mean, anywhere by every term."""
        out = []
        for s, e in near:
            known = [max(self[c], 0.0) for c in plain[s:e] if "㐀" <= c <= "鿿"]
            if known and sum(known) / len(known) >= threshold:
                out.append((s, e))
        used = bytearray(len(plain))
        for s, e in out:
            used[s:e] = b"\x01" * (e - s)
        for m in _HAN_RUN.finditer(plain):
            line = [float("-inf") if used[i] else self[plain[i]] for i in range(*m.span())]
            out += [(m.start() + a, m.start() + b) for a, b in disclosing_runs(line, threshold)]
        return sorted(out)


def term_counts(texts: DataFrame) -> DataFrame:
    """``term, n, k``: occurrences of every term and those beside a seed; the term '' counts all terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: Counter = Counter()
            k: Counter = Counter()
            for t in batch.column(0).to_pylist():
                plain, _ = shadow(t)
                n.update(_TERM.findall(plain))
                for s, e in seeds(plain):
                    k.update(_TERM.findall(plain, s, e))
            n[""], k[""] = n.total(), k.total()
            yield pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64()), pa.array([k[t] for t in n], pa.int64())], ["term", "n", "k"])

    counted = texts.select("text").where("text is not null and text <> ''").mapInArrow(run, "term string, n long, k long")
    return counted.groupBy("term").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))


def disclosure(texts: DataFrame) -> DataFrame:
    """``term, score``: normalised mutual information of a term with persons, of all terms that occur beside a seed."""
    counts = cut_lineage(term_counts(texts).where("k > 0"))  # the vocabulary beside seeds; used several times
    base = counts.where("term = ''").agg(F.first(F.col("k") / F.col("n")).alias("base"))
    given = (F.col("k") + PRIOR * F.col("base")) / (F.col("n") + PRIOR)
    score = F.when(F.col("base") >= 1, F.lit(1.0)).otherwise(F.log(given / F.col("base")) / F.log(1 / F.col("base")))
    return counts.where("term <> ''").crossJoin(F.broadcast(base)).select("term", score.alias("score"))  # one row


_PLACE = "struct<unit:{unit},start:bigint,stop:bigint,found:string>"


def find_items(texts: DataFrame, names: Gazetteer, scores: dict[str, float], threshold: float) -> DataFrame:
    """``kind, run, beside, places``: identifiers and names of ideographs (run is null), and runs of capitalised words.

    ``texts``: unit (any type), text. One row a batch for each kind or distinct run.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    unit_type = texts.schema["unit"].dataType
    place = pa.struct([("unit", to_arrow_type(unit_type)), ("start", pa.int64()), ("stop", pa.int64()), ("found", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, known = Finder(names), Disclosure(scores)
        for batch in batches:
            held: dict[tuple, list] = {}
            for i, t in enumerate(batch.column(1)):
                text = t.as_py()
                if not text:
                    continue
                plain, at = shadow(text)
                ids = finder.identifiers(plain)
                bare = plain
                for s, e, _ in ids:
                    bare = bare[:s] + "\x00" * (e - s) + bare[e:]
                put = lambda kind, run, near, s, e: held.setdefault((kind, run, near), []).append((i, at[s], at[e - 1] + 1, text[at[s] : at[e - 1] + 1]))  # noqa: B023, E731
                for s, e, kind in ids:
                    put(kind, None, False, s, e)
                near = seeds(bare)
                for s, e in known.names(bare, [x for x in near if _HAN_RUN.match(bare, x[0])], threshold):
                    put("person_name", None, False, s, e)
                west = {x: True for x in near if not _HAN_RUN.match(bare, x[0])}
                for m in _WORD_RUN.finditer(bare):
                    inside = sorted(x for x in west if m.start() <= x[0] and x[1] <= m.end())
                    rest = m.start()
                    for s, e in inside:
                        west[s, e] = False
                        for a, b, beside in ((rest, s - 1, False), (s, e, True)):
                            if bare.find(" ", a, b) > 0:
                                put("person_name", bare[a:b], beside, a, b)
                        rest = e + 1
                    if bare.find(" ", rest, m.end()) > 0:
                        put("person_name", bare[rest : m.end()], False, rest, m.end())
                for (s, e), alone in west.items():
                    if alone:
                        put("person_name", bare[s:e], True, s, e)
            kind, words, beside, sizes, flat = [], [], [], [0], []
            for (k, r, b), places in held.items():
                kind.append(k)
                words.append(r)
                beside.append(b)
                flat += places
                sizes.append(len(flat))
            units = batch.column(0).take(pa.array([f[0] for f in flat], pa.int64()))
            cols = [pa.array([f[j] for f in flat], t) for j, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.string()))]
            where = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays([units.cast(place.field("unit").type), *cols], fields=list(place)))
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.string()), pa.array(words, pa.string()), pa.array(beside, pa.bool_()), where], ["kind", "run", "beside", "places"])

    ddl = f"kind string, run string, beside boolean, places array<{_PLACE.format(unit=unit_type.simpleString())}>"
    return texts.select("unit", "text").where("text is not null").mapInArrow(run, ddl)


def named_runs(runs: DataFrame, scores: DataFrame, threshold: float) -> DataFrame:
    """``run, beside, names``: the names in distinct runs of words, as (first, last) character and length."""
    words = runs.select("run", "beside", F.posexplode(F.split("run", " ")).alias("pos", "term"))
    scored = words.join(scores, "term", "left").groupBy("run", "beside").agg(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("score", F.lit(float("-inf"))).alias("score")))).alias("s"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for run, beside, s in zip(*(c.to_pylist() for c in batch.columns)):
                line, ends = [x["score"] for x in s], [0]
                for w in run.split(" "):
                    ends.append(ends[-1] + len(w) + 1)
                spans = disclosing_runs(line, threshold)
                if beside and sum(max(x, 0.0) for x in line) / len(line) >= threshold:
                    spans = [(0, len(line))]
                out.append([(ends[a], ends[b] - 1) for a, b in spans])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))], ["run", "beside", "names"])

    return scored.mapInArrow(read, "run string, beside boolean, names array<struct<a:bigint,b:bigint>>").where("size(names) > 0")


def personal_items(texts: DataFrame, names: Gazetteer, threshold: float = DISCLOSURE) -> DataFrame:
    """``unit, kind, start, stop, found``: identifiers, and the names that the disclosure of their terms gives away."""
    scores = disclosure(texts)
    # ideographs only: bounded by the alphabet
    han = {r["term"]: r["score"] for r in scores.where(f"term rlike '^[{_H}]$'").collect()}
    items = cut_lineage(find_items(texts, names, han, threshold))
    plain = items.where("run is null").select("kind", F.inline("places"))
    runs = items.where("run is not null")
    named = named_runs(runs.select("run", "beside").distinct(), scores, threshold)
    # the shadow of a word is as long as the word unless characters are left out; then the whole run is taken
    spans = runs.join(named, ["run", "beside"]).select("kind", "run", "names", F.inline("places"))
    each = spans.select("kind", "unit", "start", "stop", "found", F.length("run").alias("n"), F.inline("names"))
    whole = F.length("found") != F.col("n")
    cut = each.select(
        "kind", "unit", F.when(whole, F.col("start")).otherwise(F.col("start") + F.col("a")).alias("start"), F.when(whole, F.col("stop")).otherwise(F.col("start") + F.col("b")).alias("stop"),
        F.when(whole, F.col("found")).otherwise(F.substr("found", F.col("a") + 1, F.col("b") - F.col("a"))).alias("found"),
    )
    keys = ["unit", "kind", "start", "stop", "found"]
    return plain.select(*keys).unionByName(cut.select(*keys).distinct())


def redact(text: str, items: list[tuple[int, int, str]]) -> str:
    """``text`` with a typed placeholder for each (start, stop, kind)."""
    out, at = [], 0
    for s, e, kind in sorted(set(items)):
        if s >= at:
            out += [text[at:s], PLACEHOLDERS[kind]]
            at = e
    return "".join([*out, text[at:]])


def redacted(texts: DataFrame, items: DataFrame) -> DataFrame:
    """``unit, text`` with the items replaced; texts without items as they are."""
    per_unit = items.groupBy("unit").agg(F.collect_set(F.struct("start", "stop", "kind")).alias("items"))

    @F.pandas_udf("string")
    def put(text, its):
        import pandas as pd

        return pd.Series([t if t is None or x is None else redact(t, [(i["start"], i["stop"], i["kind"]) for i in x]) for t, x in zip(text, its)], dtype=object)

    once = texts.groupBy("unit").agg(F.first("text").alias("text"))
    return once.join(per_unit, "unit", "left").select("unit", put("text", "items").alias("text"))
