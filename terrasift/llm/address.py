"""Postal addresses of one place written differently.

1. Each address is read into its parts (one narrow pass): city, district, road as
   written, section, lane, alley, door number and suffix; Chinese or western, the
   parts in any order, any number script, with floors, rooms, villages, postal codes
   and added text on persons left aside. A misspelt city or district is the official
   one that costs least to turn it into, if no other costs as little.
2. Roads as written and official names become token and q-gram shingles; MinHash
   signatures of them are cut into bands of ``ROWS`` values, and only what agrees in a
   whole band is compared. Distinct spellings are matched, not records, so the work
   follows the vocabulary.
3. Candidates are verified by affine-gap alignment of their tokens. Substitution
   costs nothing between a word and its abbreviation; otherwise words cost by the
   share of letters that differ, single characters one. The cheapest official name
   is taken if it costs no more than ``MOST`` and no other costs as little.
4. Of the spellings of roads that are on no list all are linked that cost no more than
   ``MOST`` with each other. Eastern ones share a key then, without the character or
   the gap that differs; in a key each is linked with the least one only, which holds
   all together. Western ones, whose words may differ in three letters of eight, are
   compared with all of their city and word for the street, by blocks, first by their
   bigrams. The links are followed to their end.
5. Records of one city, road and numbers are one place.

The names of cities and districts go to all tasks: there are as many as a country has.
Roads, whose number has no such bound, are matched by joins.

Defined cases: null or blank addresses and those without door number are no place;
a missing district is taken from the road, a missing city is the first city of the
reference table, every other missing part is a part of its own; repeated records
count once (with several addresses, the first place in order); an empty table gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasift.session import cut_lineage

MOST_PLACES = 200_000
BANDS, ROWS = 128, 2
MOST = 1.5
GAP_OPEN, GAP_EXTEND = 1.0, 0.5
GAP = 1 + int((MOST - GAP_OPEN) / GAP_EXTEND)  # the longest gap that MOST allows, which is less than two differences
RECORDS_A_BLOCK, SALT = 2_000, 8
WORDS_A_BLOCK = 1_000
NUMBERS = ("section", "lane", "alley", "no", "suffix")

# fixed values: words of western addresses and their abbreviations
ABBREVIATIONS = {"rd": "road", "st": "street", "blvd": "boulevard", "dist": "district", "ln": "lane", "aly": "alley", "sec": "section", "ave": "avenue"}
ROAD_KINDS = ("大道", "路", "街")

_VARIANTS = str.maketrans("臺号区县", "台號區縣")  # fixed values

_DIGITS = "零一二三四五六七八九"


def han_number(text: str) -> str | None:
    """A number in ASCII digits or in Chinese words up to 999, as digits without leading zeros."""
    if text.isascii() and text.isdigit():
        return str(int(text))
    total, now = 0, 0
    for ch in text.replace("〇", "零").replace("廿", "二十").replace("卅", "三十"):
        if ch in "百十":
            total += (now or 1) * (100 if ch == "百" else 10)
            now = 0
        elif ch in _DIGITS:
            now = now * 10 + _DIGITS.index(ch)
        elif ch.isdigit():
            now = now * 10 + int(ch)
        else:
            return None
    return str(total + now)


def flat(text: str) -> str:
    """Compatibility form in lower case, without blanks and ignorable characters, variants as one."""
    return re.sub(r"\s+", "", _one_form(text))


def _one_form(text: str) -> str:
    t = unicodedata.normalize("NFKC", text).lower().translate(_VARIANTS)
    return re.sub(r"[\u200b-\u200f\u2060\ufeff\u00ad]+", "", re.sub(r"[‐-―−]", "-", t))


_N = r"(?:[0-9]{1,6}|[零〇一二三四五六七八九十百]{1,7})"
_TAIL = rf"(?:(?P<section>{_N})段)?(?:(?P<lane>{_N})巷)?(?:(?P<alley>{_N})弄)?(?P<no>{_N})(?:(?:之|-)(?P<s1>{_N}))?號(?:(?:之|-)(?P<s2>{_N})(?![0-9樓f]))?"
_EAST_END = re.compile(rf"(?P<kind>{'|'.join(ROAD_KINDS)}){_TAIL}")
_HAN = "㐀-鿿"
_WEST_NUMBERS = [
    (part, re.compile(rf"(?<![a-z])(?:{words})\.? ?([0-9]{{1,6}})(?![0-9])(?:-([0-9]{{1,6}}))?"))
    for part, words in (("no", "no"), ("alley", "alley|aly"), ("lane", "lane|ln"), ("section", "section|sec"))
]
_WEST_KIND = re.compile(r"(?:boulevard|blvd|avenue|ave|street|st|road|rd)(?![a-z])")
_WEST_AREA = {"district": re.compile(r"(?:district|dist)(?![a-z])\.?"), "city": re.compile(r"city(?![a-z])")}


def _western(text: str) -> dict:
    """Parts of a western address in any order: numbers by their word, names by the word after them."""
    out: dict = {}
    for piece in re.split("[,;、/()]", text):
        for part, rx in _WEST_NUMBERS:
            m = rx.search(piece)
            if m and part not in out:
                out[part] = str(int(m[1]))
                if part == "no" and m[2]:
                    out["suffix"] = str(int(m[2]))
                piece = f"{piece[: m.start()]} {piece[m.end() :]}"
        for part, rx in _WEST_AREA.items():
            m = rx.search(piece)
            if m and part not in out:
                start = end = len(piece[: m.start()].rstrip())
                while start and (piece[start - 1].isalpha() or piece[start - 1] in "'-"):
                    start -= 1
                if start < end:
                    out[part] = re.sub("[^a-z]", "", piece[start:end])
                    piece = f"{piece[:start]} {piece[m.end() :]}"
        kinds = list(_WEST_KIND.finditer(piece))
        apart = [m for m in kinds if not piece[m.start() - 1 : m.start()].isalpha()]
        if kinds and "road" not in out:
            m = (apart or kinds)[-1]
            name = re.sub("[^a-z]", "", piece[: m.start()])
            if name:
                out["road"] = f"{name} {ABBREVIATIONS.get(m[0], m[0])}"
    return out


@dataclass(frozen=True)
class Road:
    """An official road with its district and city, in both scripts."""

    road_id: int
    city: str
    district: str
    name: str
    western: str


class Gazetteer:
    """Official names: ``place_id, kind, name_zh, name_en, parent_id`` rows."""

    def __init__(self, rows: list):
        by_id = {r["place_id"]: r for r in rows}
        flat_name = lambda r: flat(r["name_zh"])
        cities = sorted((r for r in rows if r["kind"] == "city"), key=lambda r: r["place_id"])
        self.first_city = flat_name(cities[0]) if cities else ""
        self.cities = {flat_name(r) for r in cities}
        self.districts = {flat_name(r) for r in rows if r["kind"] == "district"}
        self.western = {}
        self.roads: list[Road] = []
        for r in rows:
            if r["kind"] != "road" and r["name_en"]:
                self.western[re.sub(r"(city|district)$", "", re.sub("[^a-z]", "", r["name_en"].lower()))] = flat_name(r)
        for r in rows:
            d = by_id.get(r["parent_id"]) if r["kind"] == "road" else None
            if d is not None:
                c = by_id.get(d["parent_id"])
                self.roads.append(Road(r["place_id"], flat_name(c) if c else "", flat_name(d), flat_name(r), flat(r["name_en"] or "")))
        either = lambda names, end: "|".join(sorted((re.escape(n.removesuffix(end)) for n in names), key=len, reverse=True)) or "(?!)"
        # one stray character may stand before the word for a city or district
        city, district = rf"(?P<city>{either(self.cities, '市')})(?:[{_HAN}]?市)?", rf"(?P<district>{either(self.districts, '區')})(?:[{_HAN}]?區)?"
        rest = rf"(?:[{_HAN}]{{2,3}}里)?(?:[0-9]{{1,4}}鄰)?(?P<road>[{_HAN}]+)$"
        self._heads = [re.compile(x + rest) for x in (rf"{city}(?:{district})?", district, "")]
        self._else = {"city": re.compile(rf"({either(self.cities, '市')})市"), "district": re.compile(rf"({either(self.districts, '區')})區")}

    @staticmethod
    def collect(places: DataFrame, roads: bool = False) -> Gazetteer:
        """Cities and districts, of which there are as many as a country has; with ``roads`` also roads, at most ``MOST_PLACES``."""
        rows = places.select("place_id", "kind", "name_zh", "name_en", "parent_id").where("name_zh is not null").distinct()
        if not roads:
            return Gazetteer(rows.where("kind in ('city', 'district')").collect())
        held = rows.limit(MOST_PLACES + 1).collect()
        if len(held) > MOST_PLACES:
            raise ValueError(f"the reference table of names has more than {MOST_PLACES} rows")
        return Gazetteer(held)

    @staticmethod
    def _nearest(written: str | None, official: list[str], most: float) -> str | None:
        """The official name that costs least to turn ``written`` into, if it is the only one and costs no more than ``most``."""
        if written is None or written in official or len(written) > 60:
            return written
        costs = sorted((alignment_cost(list(written), list(o)), o) for o in official if abs(len(o) - len(written)) <= most + 1)
        good = costs and costs[0][0] <= most and (len(costs) == 1 or costs[1][0] > costs[0][0])
        return costs[0][1] if good else written

    def _eastern(self, t: str) -> dict | None:
        for m in _EAST_END.finditer(t):
            stop = start = m.end("kind")
            while start and ("㐀" <= t[start - 1] <= "鿿" or t[start - 1].isdigit()) and stop - start < 200:
                start -= 1
            head = next((h for h in (rx.search(t[start:stop]) for rx in self._heads) if h and len(h["road"]) > len(m["kind"])), None)
            if head:
                break
        else:
            return None
        g, named = m.groupdict(), head.groupdict()
        out = {k: han_number(g[k]) if g[k] else None for k in ("section", "lane", "alley", "no")}
        s = g["s1"] or g["s2"]
        out["suffix"] = han_number(s) if s else None
        city = next((c for c in self.cities if named.get("city") and c.startswith(named["city"])), None)
        district = next((d for d in self.districts if named.get("district") and d.startswith(named["district"])), None)
        road = named["road"]
        # a misspelt city before an official district; junk may stand before it
        before = t[start:stop][: head.start()]
        if city is None and before.endswith("市"):
            size = {len(c) for c in self.cities}
            near = [self._nearest(before[-n:], sorted(self.cities), 1.0) for n in sorted({n + d for n in size for d in (0, -1, 1)}) if n > 1]
            city = next((c for c in near if c in self.cities), None)
        # names that are not official: up to the word for a city or a district
        for part, mark, known in (("city", "市", city), ("district", "區", district)):
            at = road.find(mark, 1, len(road) - len(m["kind"]) - 1)
            if known is None and at > 0:
                written = self._nearest(road[: at + 1], sorted(self.cities if part == "city" else self.districts), 1.0)
                city, district = (written, district) if part == "city" else (city, written)
                road = re.sub(rf"^[{_HAN}]{{2,3}}里(?=[{_HAN}]{{2}})", "", road[at + 1 :])
        # names that stand after the number or before some other text
        around = f"{t[:start]}|{t[m.end() :]}"
        found = {k: rx.search(around) for k, rx in self._else.items()}
        out["city"] = city or (f"{found['city'][1]}市" if found["city"] else self.first_city)
        out["district"] = district or (f"{found['district'][1]}區" if found["district"] else None)
        out["road"], out["script"] = road, "east"
        return out

    def read(self, text: str | None) -> dict | None:
        """The parts of an address, or None if it has no door number."""
        if not text or not text.strip():
            return None
        out = self._eastern(flat(text))
        if out:
            return out
        got = _western(re.sub(r"\s+", " ", _one_form(text)))
        if "no" not in got or "road" not in got:
            return None
        out = {k: got.get(k) for k in NUMBERS}
        names = {"city": self.cities, "district": self.districts}
        for part, official in names.items():
            known = [w for w, o in self.western.items() if o in official]
            near = self._nearest(got.get(part), sorted(known), 1.0)
            out[part] = self.western.get(near, near) if near else None
        out["city"] = out["city"] or self.first_city
        out["road"], out["script"] = got["road"], "west"
        return out


# ---- tokens, shingles and alignment ------------------------------------------------


def tokens(road: str, script: str) -> list[str]:
    """Characters and kind of an eastern name, words of a western one."""
    if script == "west":
        return [ABBREVIATIONS.get(w, w) for w in re.findall("[a-z]+", road)]
    kind = next((k for k in ROAD_KINDS if road.endswith(k)), "")
    return [*road[: len(road) - len(kind)], kind] if kind else list(road)


def western_tokens(name: str) -> list[str]:
    """Words of an official western name written without blanks."""
    m = re.match(r"([a-z'-]+?)(road|rd|street|st|boulevard|blvd|avenue|ave)\.?$", name)
    return [re.sub("[^a-z]", "", m[1]), ABBREVIATIONS.get(m[2], m[2])] if m else re.findall("[a-z]+", name)


def shingles(city: str, toks: list[str], script: str) -> list[str]:
    """Token and q-gram shingles, none of which holds for more than one city or script."""
    if script == "west":
        grams = [w[i : i + 3] for w in (f"^{t}$" for t in toks[:1]) for i in range(len(w) - 2)]
        out = [f"t{t}" for t in toks[:1]] + [f"q{g}" for g in grams]
    else:
        line = ["^", *toks]
        out = [f"t{i}{t}" for i, t in enumerate(toks[:-1])] + [f"q{a}{b}" for a, b in zip(line, line[1:])]
        out += [f"r{len(toks) - i}{t}" for i, t in enumerate(toks[:-1])]
    return sorted({f"{script[0]}{city}{x}" for x in out})


def _word_cost(a: str, b: str) -> float:
    """0 for equal words or abbreviations of each other, else the share of letters that differ."""
    if a == b or ABBREVIATIONS.get(a, a) == ABBREVIATIONS.get(b, b):
        return 0.0
    if len(a) == 1 and len(b) == 1:
        return 1.0
    if not (a.isascii() and b.isascii()):
        return 2.0
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return 4.0 * row[-1] / max(len(a), len(b))


def alignment_cost(a: list[str], b: list[str]) -> float:
    """Least cost of turning ``a`` into ``b`` with affine gaps (three-state dynamic programme)."""
    big = float("inf")
    n, m = len(a), len(b)
    match = [[big] * (m + 1) for _ in range(n + 1)]
    left = [[big] * (m + 1) for _ in range(n + 1)]
    up = [[big] * (m + 1) for _ in range(n + 1)]
    match[0][0] = 0.0
    for i in range(n + 1):
        for j in range(m + 1):
            if i and j:
                match[i][j] = min(match[i - 1][j - 1], left[i - 1][j - 1], up[i - 1][j - 1]) + _word_cost(a[i - 1], b[j - 1])
            if i:
                up[i][j] = min(match[i - 1][j] + GAP_OPEN, left[i - 1][j] + GAP_OPEN, up[i - 1][j] + GAP_EXTEND)
            if j:
                left[i][j] = min(match[i][j - 1] + GAP_OPEN, up[i][j - 1] + GAP_OPEN, left[i][j - 1] + GAP_EXTEND)
    return min(match[n][m], left[n][m], up[n][m])


# ---- DataFrame operators --------------------------------------------------------------

_PARTS = ("city", "district", "road", "script", *NUMBERS)


def read_addresses(records: DataFrame, record: Column, address: Column, names: Gazetteer) -> DataFrame:
    """``record`` and the parts of its address; records that name no place are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, cols = [], {k: [] for k in _PARTS}
            for i, text in enumerate(batch.column(1).to_pylist()):
                got = names.read(text)
                if got:
                    at.append(i)
                    for k in _PARTS:
                        cols[k].append(got[k])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(cols[k], pa.string()) for k in _PARTS]], ["record", *_PARTS])

    rows = records.select(record.cast("string").alias("record"), address.cast("string").alias("address")).where("record is not null and address is not null")
    return rows.mapInArrow(run, "record string, " + ", ".join(f"{k} string" for k in _PARTS))


@lru_cache(maxsize=1)
def _turns() -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and summands that turn one hash into ``BANDS * ROWS`` independent ones."""
    rng = np.random.default_rng(20_260_131)
    return rng.integers(0, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, BANDS * ROWS, np.uint64)


def bands(grams: list[str]) -> list[int]:
    """The bands of the MinHash signature of a set of shingles; none for an empty set."""
    if not grams:
        return []
    factor, add = _turns()
    one = np.array([int.from_bytes(blake2b(g.encode(), digest_size=8).digest(), "big") for g in grams], np.uint64)
    turned = one[:, None] * factor + add
    least = (turned ^ (turned >> np.uint64(31))).min(axis=0).reshape(BANDS, ROWS)
    mixed = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        mixed = (mixed ^ least[:, r]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed.view(np.int64).tolist()


_ROAD = ["city", "district", "road", "script"]


def official_roads(gazetteer: DataFrame) -> DataFrame:
    """``road_id, o_city, o_district, o_tokens, bands``: official roads in both scripts with what they lie in."""
    g = gazetteer.select("place_id", "kind", "name_zh", "name_en", "parent_id").where("name_zh is not null").distinct()
    side = lambda kind, name: g.where(F.col("kind") == kind).select(F.col("place_id").alias(f"{name}_id"), F.col("parent_id").alias(f"{name}_in"), F.col("name_zh").alias(name), F.col("name_en").alias(f"{name}_en"))
    roads = side("road", "road").join(side("district", "district"), F.col("road_in") == F.col("district_id"))
    roads = roads.join(side("city", "city"), F.col("district_in") == F.col("city_id"), "left").select("road_id", "city", "district", "road", "road_en")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for i, c, d, zh, en in zip(*(col.to_pylist() for col in batch.columns)):
                city = flat(c or "")
                for toks, script in ((tokens(flat(zh), "east"), "east"), (western_tokens(flat(en or "")), "west")):
                    if toks:
                        for col, x in zip(out, (i, city, flat(d), toks, bands(shingles(city, toks, script)))):
                            col.append(x)
            kinds = (pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["road_id", "o_city", "o_district", "o_tokens", "bands"])

    return roads.select(F.col("road_id").cast("long"), "city", "district", "road", "road_en").mapInArrow(run, "road_id long, o_city string, o_district string, o_tokens array<string>, bands array<bigint>")


def written_roads(parts: DataFrame) -> DataFrame:
    """Distinct roads as written, with their bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [bands(shingles(c, tokens(r, s), s)) for c, r, s in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.list_(pa.int64()))], [*_ROAD, "bands"])

    return parts.select(*_ROAD).distinct().mapInArrow(run, ", ".join(f"{k} string" for k in _ROAD) + ", bands array<bigint>")


def _costs(pairs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and the alignment ``cost`` of road (with its script) and o_tokens, where it is at most ``MOST``."""
    schema = pairs.select(*keep).schema

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            costs = [alignment_cost(tokens(r, s), o) for r, s, o in zip(*(c.to_pylist() for c in batch.columns[len(keep) :]))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(costs, pa.float64())], [*keep, "cost"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields) + ", cost double"
    return pairs.select(*keep, F.col("road").alias("_r"), F.col("script").alias("_s"), "o_tokens").mapInArrow(verify, ddl).where(F.col("cost") <= MOST)


def match_roads(written: DataFrame, official: DataFrame) -> DataFrame:
    """``city, district, road, script, road_id`` of every road as written that has one official name."""
    left, right = written.select(*_ROAD, F.explode("bands").alias("band")), official.withColumn("band", F.explode("bands"))
    candidates = left.join(right, "band").where("city = o_city and (district is null or district = o_district)").select(*_ROAD, "road_id", "o_tokens").distinct()
    verified = _costs(candidates, [*_ROAD, "road_id"]).groupBy(*_ROAD, "road_id").agg(F.min("cost").alias("cost"))
    least = verified.groupBy(*_ROAD).agg(F.min(F.struct("cost", "road_id")).alias("best"), F.sort_array(F.collect_list("cost")).alias("all"))
    unique = F.coalesce(F.try_element_at("all", F.lit(2)) > F.col("best.cost"), F.lit(True))
    return least.where(unique).select(*_ROAD, F.col("best.road_id").alias("road_id"))


def near_keys(city: str, toks: list[str]) -> list[tuple[bytes, str]]:
    """Keys of eastern tokens, each with its side: two names cost at most ``MOST`` just if they are equal or opposite in a key.

    ``MOST`` allows one character that differs (both are opposite as ``one``) or one
    gap of up to ``GAP`` tokens (the longer is opposite as ``cut`` to the ``whole``).
    """
    out = {("whole", -1, tuple(toks))}
    for i, t in enumerate(toks):
        if len(t) == 1:
            out.add(("one", i, (*toks[:i], *toks[i + 1 :])))
        out |= {("cut", -1, (*toks[:i], *toks[i + k :])) for k in range(1, GAP + 1) if i + k <= len(toks)}
    return [(blake2b(repr((city, i, rest)).encode(), digest_size=16).digest(), side) for side, i, rest in sorted(out)]


def _eastern_links(named: DataFrame) -> DataFrame:
    """``name, o_name``: eastern spellings, each with the least ones opposite to it in every key: all that are near are linked through them.

    Those of one district and those of none are opposite; one without district to those of any.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, keys, sides = [], [], []
            for i, (c, r) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                for key, side in near_keys(c, tokens(r, "east")):
                    at.append(i)
                    keys.append(key)
                    sides.append(side)
            yield pa.RecordBatch.from_arrays([*batch.select(["name", "district"]).take(pa.array(at, pa.int64())).columns, pa.array(keys, pa.binary()), pa.array(sides, pa.string())], ["name", "district", "key", "side"])

    keyed = cut_lineage(named.where("script = 'east'").select("name", "district", "city", "road").mapInArrow(run, "name string, district string, key binary, side string"))
    opposite = F.when(F.col("side") == "whole", "cut").when(F.col("side") == "cut", "whole").otherwise(F.col("side"))
    least = keyed.groupBy("key", opposite.alias("side"), "district").agg(F.min("name").alias("o_name"))
    least_of_all = least.groupBy("key", "side").agg(F.min("o_name").alias("any"), F.min(F.when(F.col("district").isNull(), F.col("o_name"))).alias("none"))
    same = keyed.where("district is not null").join(least.where("district is not null"), ["key", "side", "district"]).select("name", "o_name")
    offers = F.array("none", F.when(F.col("district").isNull(), F.col("any")))
    other = keyed.join(least_of_all, ["key", "side"]).select("name", F.explode(offers).alias("o_name"))
    return same.unionByName(other).where("name <> o_name").distinct()


def near_words(a: list[str], b: list[str]) -> np.ndarray:
    """Which words of ``a`` may cost ``MOST`` or less with which of ``b``: none that does is ruled out.

    An edit takes two of the ``length + 1`` bigrams of a word with its ends, so that words
    that are near have the others in common.
    """

    def bigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        has, size = np.zeros((len(words), 28 * 28), np.float32), np.array([len(w) for w in words], np.int64)
        for i, w in enumerate(words):
            codes = np.frombuffer(f"`{w}{{".encode(), np.uint8).astype(np.int64) - 96  # ` and { stand beside a and z
            has[i, codes[:-1] * 28 + codes[1:]] = 1
        return has, size, size + 1 - has.sum(axis=1).astype(np.int64)  # the last: bigrams that are repeated

    (has_a, size_a, more_a), (has_b, size_b, more_b) = bigrams(a), bigrams(b)
    longer = np.maximum(size_a[:, None], size_b[None, :])
    edits = np.where(longer == 1, 1, np.floor(longer * (MOST / 4)).astype(np.int64))
    shared = (has_a @ has_b.T).astype(np.int64) + np.minimum(more_a[:, None], more_b[None, :])
    return (abs(size_a[:, None] - size_b[None, :]) <= edits) & (shared >= longer + 1 - 2 * edits)


def _western_links(named: DataFrame, block: int) -> DataFrame:
    """``name, o_name``: western spellings that are near; of two blocks of a city and word for the street, links that hold together all that are.

    Words for the street never differ in two roads that are near: any two of them cost
    more than ``MOST``, and so do two gaps.
    """
    word = F.udf(lambda r: tokens(r, "west")[0], "string")
    west = named.where("script = 'west'").select("name", "city", "district", word("road").alias("word"), F.substring_index("road", " ", -1).alias("kind"))
    sizes = west.groupBy("city", "kind").agg(F.ceil(F.count("*") / block).cast("int").alias("_blocks"))
    dealt = west.join(sizes, ["city", "kind"]).withColumn("at", F.expr("cast(pmod(xxhash64(name), _blocks) as int)"))
    pairs = dealt.withColumn("other", F.expr("explode(sequence(0, _blocks - 1))")).select("city", "kind", F.least("at", "other").alias("low"), F.greatest("at", "other").alias("high"), "at", "name", "district", "word")

    def run(group: pa.Table) -> pa.Table:
        rows = sorted(zip(*(group[k].to_pylist() for k in ("name", "word", "district", "at"))), key=lambda r: r[0])
        low, high = group["low"][0].as_py(), group["high"][0].as_py()
        left, right = [r for r in rows if r[3] == low], [r for r in rows if r[3] == high]
        found: dict[str, str] = {r[0]: r[0] for r in rows}

        def root(x: str) -> str:
            while found[x] != x:
                found[x] = x = found[found[x]]
            return x

        out: tuple[list, list] = ([], [])
        for i, j in zip(*(x.tolist() for x in np.nonzero(near_words([r[1] for r in left], [r[1] for r in right])))) if left and right else ():
            (a, word_a, in_a, _), (b, word_b, in_b, _) = left[i], right[j]
            if (low < high or i < j) and (in_a is None or in_b is None or in_a == in_b) and (ra := root(a)) != (rb := root(b)) and _word_cost(word_a, word_b) <= MOST:
                found[max(ra, rb)] = min(ra, rb)
                out[0].append(a)
                out[1].append(b)
        return pa.table({"name": pa.array(out[0], pa.string()), "o_name": pa.array(out[1], pa.string())})

    return pairs.groupBy("city", "kind", "low", "high").applyInArrow(run, "name string, o_name string").distinct()


def _of_no_size(df: DataFrame) -> DataFrame:
    """``df`` without its estimated size: a checkpoint keeps that of its joins, a number of twice the digits every round."""
    spark = df.sparkSession
    return DataFrame(spark._jsparkSession.createDataFrame(df._jdf.toJavaRDD(), df._jdf.schema()), spark)


def cluster_roads(written: DataFrame, block: int = WORDS_A_BLOCK) -> DataFrame:
    """``city, district, road, script, name``: spellings of roads on no list, with one name for those that denote one road."""
    itself = F.concat_ws("/", F.col("city"), F.coalesce("district", F.lit("")), F.col("road"))
    named = cut_lineage(written.select(*_ROAD, itself.alias("name")))
    if named.isEmpty():
        return named.select(*_ROAD, "name")
    links = cut_lineage(_eastern_links(named).unionByName(_western_links(named, block)))
    both = links.unionByName(links.select(F.col("o_name").alias("name"), F.col("name").alias("o_name")))
    label = named.select("name", F.col("name").alias("label")).distinct()
    while True:  # each round a spelling and the one that names it take the least label of the neighbours, then the label of that, until none changes
        of_other = label.withColumnsRenamed({"name": "o_name", "label": "offer"})
        lower = both.join(label, "name").join(of_other, "o_name").where("offer < label")
        offers = lower.select(F.explode(F.array("name", "label")).alias("name"), "offer").groupBy("name").agg(F.min("offer").alias("offer"))
        lowered = label.join(offers, "name", "left").select("name", F.col("label").alias("before"), F.coalesce(F.least("label", "offer"), F.col("label")).alias("label"))
        further = lowered.select(F.col("name").alias("label"), F.col("label").alias("least"))
        joined = _of_no_size(cut_lineage(lowered.join(further, "label").select("name", F.col("least").alias("label"), (F.col("least") < F.col("before")).alias("moved"))))
        label = joined.select("name", "label")
        if joined.where("moved").isEmpty():
            return named.join(label, "name").select(*_ROAD, F.col("label").alias("name"))


def _same_road(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """``a`` joined to ``b`` on the road as written; a null district equals a null one."""
    names = {k: f"_{k}" for k in _ROAD}
    on = (F.col("city") == F.col("_city")) & F.col("district").eqNullSafe(F.col("_district")) & (F.col("road") == F.col("_road")) & (F.col("script") == F.col("_script"))
    return a.join(b.withColumnsRenamed(names), on, how).drop(*names.values())


def places(records: DataFrame, record: Column, address: Column, gazetteer: DataFrame) -> DataFrame:
    """``record, place``: one row per record that names a place; equal places are equal strings."""
    parts = cut_lineage(read_addresses(records, record, address, Gazetteer.collect(gazetteer)))  # read once, used twice
    written = cut_lineage(written_roads(parts))  # the vocabulary
    matched = cut_lineage(match_roads(written, official_roads(gazetteer)))
    others = cluster_roads(_same_road(written, matched.select(*_ROAD), "left_anti"))
    roads = matched.select(*_ROAD, F.col("road_id").cast("string").alias("name")).unionByName(others)
    place = F.concat_ws("|", F.col("name"), *[F.coalesce(n, F.lit("")) for n in NUMBERS])
    return _same_road(parts, roads, "left").select("record", place.alias("place")).groupBy("record").agg(F.min("place").alias("place"))


def place_pairs(located: DataFrame, block: int = RECORDS_A_BLOCK) -> DataFrame:
    """``record_a, record_b``: all pairs of records of one place, ``record_a`` before ``record_b``.

    The records of a place are dealt into blocks; a task takes one block of them
    against all, so that a place of any size is spread.
    """
    located = cut_lineage(located)
    sizes = located.groupBy("place").agg(F.count("*").alias("_n"))
    blocks = sizes.where("_n > 1").select("place", F.ceil(F.col("_n") / block).cast("int").alias("_blocks"))
    spread = F.pmod(F.xxhash64("record"), F.lit(SALT)).cast("int")
    salted = blocks.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    known = located.withColumn("_salt", spread).join(salted, ["place", "_salt"])
    left = known.select("place", F.col("record").alias("record_a"), F.pmod(F.xxhash64("record"), F.col("_blocks")).alias("_block"))
    right = known.select("place", F.col("record").alias("record_b"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks").cast("long") - 1)).alias("_block"))
    return left.join(right, ["place", "_block"]).where("record_a < record_b").select("record_a", "record_b")
