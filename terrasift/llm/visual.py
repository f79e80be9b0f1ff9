"""One consistent form for text that looks the same.

1. Compatibility normalization of widths, radicals, fonts and blanks; accents are
   composed; characters that show nothing are deleted. Line ends stay.
2. A word of an alphabet with look-alikes is a lattice: at each letter stand all
   letters that look like it. Viterbi search takes the path of best score, the sum of
   character bigram log probabilities (counted over the words of one script of the
   whole corpus, add-one smoothing) and a penalty for every change of script. The
   lattice depends on the looks of a word only, so words that look alike get one
   form: ``Sеñоrial`` with two Cyrillic letters becomes Latin, a Russian word with
   two Latin ones Russian. Of equal paths the more Latin one is taken.
3. A quote stands on a page if its form is part of the page's form. A quote may begin
   or end inside a word; such a word is read as the page's whole word with the
   quote's letters in it and must get the form that the page's word has.

Without step 2 (``scores=None``) look-alikes stay different.

The bigram table holds the letters with look-alikes and one sign for all others of a
script, so it has at most ``len(SYMBOLS) ** 2`` rows, whatever the corpus.

Defined cases: null stays null, empty stays empty; a quote that shows nothing is on
no page; repeated rows and several pages of one number count once (a quote verbatim
on any of them is verbatim); empty tables give empty results.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCRIPT_CHANGE = 6.0

# fixed values: letters of other scripts and the Latin letter they look like
LOOK_ALIKES = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ӏ": "I",
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l", "ү": "y",
    "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V", "Һ": "h",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "α": "a", "γ": "y", "ι": "i", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "ϲ": "c", "ϳ": "j",
    # Armenian
    "Օ": "O", "Ս": "U", "Լ": "L", "օ": "o", "ս": "u", "հ": "h", "ո": "n", "ց": "g", "զ": "q",
    # Cherokee
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮞ": "4", "Ꮤ": "W", "Ꮪ": "S", "Ꮩ": "V", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ᏼ": "B", "Ꮶ": "K",
}
LOOK_ALIKES = {k: v for k, v in LOOK_ALIKES.items() if v.isalpha()}

# fixed values: radical code points without a decomposition of their own, and the ideographs they look like
RADICALS = {
    "⺃": "乚", "⺅": "亻", "⺉": "刂", "⺒": "巳", "⺓": "幺", "⺖": "忄", "⺘": "扌", "⺙": "攵", "⺛": "旡", "⺞": "歺", "⺠": "民", "⺡": "氵", "⺢": "氺", "⺣": "灬", "⺤": "爫", "⺨": "犭", "⺪": "疋",
    "⺭": "礻", "⺯": "糹", "⺹": "耂", "⺽": "臼", "⺾": "艹", "⻂": "衤", "⻃": "覀", "⻄": "西", "⻅": "见", "⻆": "角", "⻈": "讠", "⻉": "贝", "⻋": "车", "⻐": "钅", "⻑": "長", "⻒": "镸", "⻓": "长",
    "⻔": "门", "⻖": "阝", "⻘": "青", "⻙": "韦", "⻚": "页", "⻛": "风", "⻜": "飞", "⻝": "食", "⻟": "飠", "⻠": "饣", "⻢": "马", "⻣": "骨", "⻤": "鬼", "⻥": "鱼", "⻦": "鸟", "⻧": "卤", "⻨": "麦", "⻩": "黄",
    "⻪": "黾", "⻫": "斉", "⻬": "齐", "⻭": "歯", "⻮": "齿", "⻯": "竜", "⻰": "龙", "⻱": "亀",
}

_SEEN_WIDTHS = ("<wide>", "<narrow>", "<noBreak>", "<font>", "<compat>")
_MARKS = "\u0300-\u036f"
_LETTERS = "A-Za-zªºÀ-ÖØ-öø-ʯͰ-ϿЀ-ԯԱ-֏Ꭰ-ᏽᲀ-ᲈḀ-ỿἀ-῿Ⱡ-ⱿꙀ-ꚟꜢ-ꟿꭰ-ꮿ"  # alphabets with look-alikes
_WORD = re.compile(f"[{_LETTERS}][{_LETTERS}{_MARKS}]*")
_WORD_CHAR = re.compile(f"[{_LETTERS}{_MARKS}]")
_LATTICE: dict[str, tuple[str, ...]] = {}  # per letter all that look like it, the Latin one first
for _k, _v in LOOK_ALIKES.items():
    _LATTICE[_v] = (*_LATTICE.get(_v, (_v,)), _k)
for _k, _v in LOOK_ALIKES.items():
    _LATTICE[_k] = _LATTICE[_v]
_LOOKS = str.maketrans({k: v[0] for k, v in _LATTICE.items()})
SCRIPTS = ("LATIN", "GREEK", "CYRILLIC", "ARMENIAN", "CHEROKEE", "?")
SYMBOLS = (*_LATTICE, *SCRIPTS, "^", "$")


def _ignorable(ch: str) -> bool:
    o = ord(ch)
    return unicodedata.category(ch) == "Cf" or o in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0) or 0xFE00 <= o <= 0xFE0F or 0x180B <= o <= 0x180F or 0xE0100 <= o <= 0xE01EF


class _Plain(dict):
    """Per character: what stands for it before composition; filled as characters occur."""

    def __missing__(self, o: int):
        ch = chr(o)
        if _ignorable(ch):
            got: str | None = None
        elif ch == "\t" or unicodedata.category(ch) == "Zs":
            got = " "
        elif ch in RADICALS:
            got = RADICALS[ch]
        else:
            kind = unicodedata.decomposition(ch).split(" ")[0]
            got = unicodedata.normalize("NFKC" if kind in _SEEN_WIDTHS else "NFC", ch) if kind else ch
        self[o] = got
        return got


_PLAIN = _Plain()


def plain(text: str) -> str:
    """Step 1."""
    if text.isascii() and "\t" not in text:
        return text
    return unicodedata.normalize("NFC", text.translate(_PLAIN))


@lru_cache(maxsize=100_000)
def script(ch: str) -> str:
    """The alphabet of a letter, by the first word of its name."""
    if ch < "ɐ":
        return "LATIN"
    return unicodedata.name(ch, "? ").split(" ")[0]


@lru_cache(maxsize=100_000)
def symbol(ch: str) -> str:
    """What stands for a letter in the bigram table: itself if it has look-alikes, else its script."""
    return ch if ch in _LATTICE else script(ch) if script(ch) in SCRIPTS else "?"


class _Units(dict):
    """Letters of the alphabets with look-alikes apart from their accents; all else as it is."""

    def __missing__(self, o: int):
        parts = unicodedata.normalize("NFD", chr(o))
        self[o] = parts if len(parts) > 1 and _WORD_CHAR.match(parts) else chr(o)
        return self[o]


_UNITS = _Units()


def units(text: str) -> str:
    """Step 1 with letters and accents apart, so that step 2 keeps every place."""
    t = plain(text)
    return t if t.isascii() else t.translate(_UNITS)


class Scores:
    """Bigram log probabilities with add-one smoothing, and the best path through a lattice by them."""

    def __init__(self, counts: dict[tuple[str, str], int]):
        self.pairs = counts
        self.first: dict[str, int] = {}
        for (a, _), n in counts.items():
            self.first[a] = self.first.get(a, 0) + n
        self._known: dict[tuple[str, str], float] = {}
        self._words: dict[str, str] = {}

    def __call__(self, a: str, b: str) -> float:
        """Score of letter ``b`` after letter ``a``; ``^`` and ``$`` are the ends of a word."""
        got = self._known.get((a, b))
        if got is None:
            x, y = (c if c in "^$" else symbol(c) for c in (a, b))
            got = math.log((self.pairs.get((x, y), 0) + 1) / (self.first.get(x, 0) + len(SYMBOLS)))
            if a != "^" and b != "$" and script(a) != script(b):
                got -= SCRIPT_CHANGE
            self._known[a, b] = got
        return got

    def path(self, word: str) -> str:
        """The best path through the look-alikes of a word, letter for letter; accents stay on their letters."""
        got = self._words.get(word)
        if got is None:
            if len(self._words) > 200_000:
                self._words.clear()
            got = self._words[word] = self._search(word)
        return got

    def _search(self, word: str) -> str:
        steps: list[tuple[tuple[str, ...], bytes]] = []
        ways, sums = ("^",), [0.0]
        for ch in word:
            if unicodedata.combining(ch):
                steps.append(((ch,), b""))
                continue
            here, totals, back = _LATTICE.get(ch, (ch,)), [], bytearray()
            for way in here:
                options = [s + self(k, way) for k, s in zip(ways, sums)]
                best = max(range(len(options)), key=options.__getitem__)
                totals.append(options[best])
                back.append(best)
            steps.append((here, bytes(back)))
            ways, sums = here, totals
        ends = [s + self(k, "$") for k, s in zip(ways, sums)]
        at = next(i for i, s in enumerate(ends) if s >= max(ends) - 1e-9)
        out = []
        for here, back in reversed(steps):
            out.append(here[at] if back else here[0])
            at = back[at] if back else at
        return "".join(reversed(out))

    def read(self, text: str) -> str:
        """Every word of ``units`` by its best path."""
        return _WORD.sub(lambda m: self.path(m[0]), text)


def _read(text: str, scores: Scores | None) -> str:
    return text if scores is None else scores.read(text)


def consistent(text: str, scores: Scores | None) -> str:
    """The one form of a text: steps 1 and 2, accents composed."""
    form = _read(units(text), scores)
    return form if form.isascii() else unicodedata.normalize("NFC", form)


def stands(quote: str, page: str, form: str, scores: Scores | None) -> bool:
    """Whether a quote is part of a page in the common form (all in ``units``; ``form``: the page's form)."""
    if not quote or unicodedata.combining(quote[0]):
        return False

    def places(part: str, whole: str) -> Iterator[int]:
        at = whole.find(part)
        while at >= 0:
            end = at + len(part)
            if end == len(whole) or not unicodedata.combining(whole[end]):
                yield at
            at = whole.find(part, at + 1)

    if next(places(_read(quote, scores), form), None) is not None:
        return True
    if scores is None or not (_WORD_CHAR.match(quote) or _WORD_CHAR.match(quote[-1])):
        return False
    # places where every letter of the quote has a way in common with the page's letter
    for at in places(quote.translate(_LOOKS), page.translate(_LOOKS)):
        begin, end = at, at + len(quote)
        while begin and _WORD_CHAR.match(quote) and _WORD_CHAR.match(page, begin - 1):
            begin -= 1
        while end < len(page) and _WORD_CHAR.match(quote[-1]) and _WORD_CHAR.match(page, end):
            end += 1
        if scores.read(page[begin:at] + quote + page[at + len(quote) : end]) == form[begin:end]:
            return True
    return False


# ---- DataFrame operators -----------------------------------------------------------


def letter_bigrams(texts: list[DataFrame]) -> Scores:
    """Scores from the words of one script in all texts (single string columns), with word ends.

    Counted per batch before the shuffle; at most ``len(SYMBOLS) ** 2`` rows come back.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = Counter(w for t in batch.column(0).to_pylist() if t for w in _WORD.findall(units(t)))
            seen: Counter = Counter()
            for w, n in words.items():
                letters = [c for c in w if not unicodedata.combining(c)]
                if len({script(c) for c in letters}) == 1:
                    line = ["^", *map(symbol, letters), "$"]
                    for pair in zip(line, line[1:]):
                        seen[pair] += n
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in seen], pa.string()), pa.array([p[1] for p in seen], pa.string()), pa.array(seen.values(), pa.int64())], ["a", "b", "n"])

    counts = None
    for df in texts:
        part = df.mapInArrow(run, "a string, b string, n long")
        counts = part if counts is None else counts.unionByName(part)
    return Scores({(r["a"], r["b"]): r["n"] for r in counts.groupBy("a", "b").agg(F.sum("n").alias("n")).collect()})


def normalize_text(df: DataFrame, text: Column, scores: Scores | None, name: str = "form") -> DataFrame:
    """``df`` with the consistent form of ``text`` as one more column."""

    @F.pandas_udf("string")
    def form(s):
        import pandas as pd

        return pd.Series([None if t is None else consistent(t, scores) for t in s], dtype=object)

    return df.withColumn(name, form(text.cast("string")))


def quotes_in_form(quotes: DataFrame, pages: DataFrame, scores: Scores | None) -> DataFrame:
    """``quote_id`` of quotes that stand on their page in the common form only.

    ``quotes``: quote_id, document_id, page, quote. ``pages``: document_id, page, text.
    """
    q = quotes.where("quote is not null and quote <> '' and quote_id is not null").select("quote_id", "document_id", "page", "quote")
    # repeated rows fall together in the last aggregate, so no text is shuffled for them here
    joined = q.join(pages.where("text is not null").select("document_id", "page", "text"), ["document_id", "page"])
    kind = q.schema["quote_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[str, str]] = {}
        for batch in batches:
            verbatim, same = [], []
            for quote, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if quote in text:
                    verbatim.append(True)
                    same.append(False)
                    continue
                if len(held) > 1000:
                    held.clear()
                if text not in held:
                    page = units(text)
                    held[text] = page, _read(page, scores)
                verbatim.append(False)
                same.append(stands(units(quote), *held[text], scores))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(verbatim), pa.array(same)], ["quote_id", "verbatim", "same"])

    judged = joined.select("quote_id", "quote", "text").mapInArrow(run, f"quote_id {kind}, verbatim boolean, same boolean")
    return judged.groupBy("quote_id").agg(F.bool_or("verbatim").alias("verbatim"), F.bool_or("same").alias("same")).where("same and not verbatim").select("quote_id")
