"""Text helpers."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

PUNCTUATION = "、，,（）()／/"
_HAN = "[㐀-鿿]"
SIMPLIFIED, TRADITIONAL = "满内项积宽势划区业气设细计来统学场广调当别规缓视", "滿內項積寬勢劃區業氣設細計來統學場廣調當別規緩視"
# how a remark on the way of judging begins after a criterion, and the words that such a remark holds
TAIL_MARKS = ("以都市", "以建", "以容", "以區", "以該", "以各", "以接近", "以宗地", "以道路", "以使用", "以其他足以")
TAIL_WORDS = "衡量|制定|判定|計算|影響地價"
# one capture at every place where a token begins: a pair of ideographs, a lone one, or a whole word
TOKEN = f"(?=({_HAN}{{2}}|(?<!{_HAN}){_HAN}|(?<![a-z0-9])[a-z0-9]+))"


def compact(text: Column) -> Column:
    """Without white space and list punctuation."""
    return F.regexp_replace(text, rf"(?U)[\s{PUNCTUATION}]", "")


def nfkc(text: Column) -> Column:
    """In Unicode's form NFKC: full-width signs, compatibility ideographs and radicals as the plain ones."""

    @F.pandas_udf("string")
    def form(s):
        import pandas as pd

        return pd.Series([t if t is None or t.isascii() else unicodedata.normalize("NFKC", t) for t in s], dtype=object)

    return form(text)


def tokens(text: Column) -> Column:
    """Lower-case words of letters and digits, and character pairs of ideograph runs (a lone one stays)."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(1))


def chunk_starts(text: Column, step: int) -> Column:
    """Starts of windows, one each ``step`` characters; none for an empty text."""
    return F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(step)))


def csv_safe(text: Column) -> Column:
    """With an apostrophe before text that a spreadsheet would run as a formula."""
    return F.when(F.regexp_replace(text, r"^ +", "").rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def html_escape(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def first_text(*columns: Column, no_value: tuple[str, ...] = ("-", "NIL", "無")) -> Column:
    """The first trimmed text that is neither empty nor a mark for "no value"."""
    given = [F.regexp_replace(c.cast("string"), r"(?U)^\s+|\s+$", "") for c in columns]
    return F.coalesce(*[F.when((t != "") & ~t.isin(*no_value), t) for t in given])


def first_number(*columns: Column) -> Column:
    """The first finite number."""
    given = [F.regexp_replace(c.cast("string"), r"(?U)^\s+|\s+$", "").try_cast("double") for c in columns]
    return F.coalesce(*[F.when(~F.isnan(n) & (F.abs(n) != float("inf")), n) for n in given])


def split_list(text: Column) -> Column:
    """The parts of a list written with any separator, without empty ones."""
    return F.filter(F.split(text, r"(?U)[、,，/／|｜;；\s]+"), lambda x: x != "")


def in_order(text: Column, words: list[str]) -> Column:
    """All occurrences of ``words`` in ``text`` in the order in which they stand, longest first."""
    pattern = "|".join(rf"\Q{w}\E" for w in sorted(words, key=len, reverse=True))
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def traditional(text: Column) -> Column:
    """Simplified glyphs that readers of tables produce, as the traditional ones."""
    return F.translate(text, SIMPLIFIED, TRADITIONAL)


def numeric_text(text: Column) -> Column:
    """Trimmed, with traditional glyphs, plain signs, square metres as m2, and without the commas of thousands."""
    t = F.translate(F.regexp_replace(traditional(text), r"(?U)^\s+|\s+$", ""), "＋－−﹣％", "+---%")
    return without_commas(F.regexp_replace(t, r"(?i)m[{^]?[2²]\}?\$?", "m2"))


def without_tail(criterion: Column) -> Column:
    """A criterion without the remark on how it is judged: cut at the first mark of the list that such a remark follows."""

    def cut(mark: str) -> Column:
        at = F.locate(mark, criterion, 2)
        return F.when((at > 0) & F.substr(criterion, at).rlike(TAIL_WORDS), F.substr(criterion, F.lit(1), at - 1))

    return F.coalesce(*map(cut, TAIL_MARKS), criterion)


def without_commas(text: Column) -> Column:
    """Without the commas of thousands: those between a digit and a group of exactly three."""
    parts = F.split(text, ",")

    def rejoin(part: Column, i: Column) -> Column:
        grouped = F.get(parts, i - 1).rlike("[0-9]$") & part.rlike("^[0-9]{3}([^0-9]|$)")
        return F.when((i == 0) | grouped, part).otherwise(F.concat(F.lit(","), part))

    return F.array_join(F.transform(parts, rejoin), "")


def holds_number(text: Column, number: Column) -> Column:
    """Whether ``number`` stands in ``text`` as a number of its own (thousands' commas dropped, zeros after the point allowed).

    The text is cut into its runs of digits and points with the sign before each; a
    sign right after a digit joins two numbers and belongs to neither.
    """
    apart = F.regexp_replace(without_commas(text), r"([0-9.])[-+]", "$1 ")
    bare = lambda run: F.when(number.rlike("^[-+]"), run).otherwise(F.ltrim(run, F.lit("+-")))
    same = lambda run: run.startswith(number) & F.substr(run, F.length(number) + 1).rlike(r"^(\.0+)?$")
    return F.exists(F.regexp_extract_all(apart, F.lit("[-+]?[0-9.]+"), F.lit(0)), lambda run: same(bare(run)))


def line_slice(text: Column, first: Column, last: Column) -> Column:
    """Lines ``first`` to ``last``, counted from 1, joined by line feeds; null when they are not there."""
    lines = F.split(text, "\r\n|\n|\r")
    ok = (first >= 1) & (first <= last) & (last <= F.size(lines))
    return F.when(ok, F.array_join(F.slice(lines, F.when(ok, first).otherwise(F.lit(1)), F.when(ok, last - first + 1).otherwise(F.lit(1))), "\n"))


def intervals(text: Column) -> Column:
    """Number intervals written out: ``array<struct<lo, lo_incl, hi, hi_incl>>``; null bounds are open.

    "A or more, below B", "below B", "A or more", "A or less"; alternatives are joined by a word for "or".
    Simplified glyphs and commas of thousands are read too.
    """
    text = numeric_text(text)
    n, unit = r"(\d+(?:\.\d+)?)", r"\s*(?:m2|m²|㎡|平方公尺|m|公尺|%|％|度)?\s*"
    shapes = ((rf"{n}{unit}以上\s*未滿\s*{n}", 1, 2, True, False), (rf"未滿\s*{n}", None, 1, True, False), (rf"{n}{unit}以上", 1, None, True, False), (rf"{n}{unit}以下", None, 1, True, True))

    def one(part: Column) -> Column:
        out = None
        for pattern, lo, hi, lo_incl, hi_incl in shapes:
            get = lambda g: F.regexp_extract(part, pattern, g).try_cast("decimal(20,6)") if g else F.lit(None).cast("decimal(20,6)")  # noqa: B023, E731
            found = F.struct(get(lo).alias("lo"), F.lit(lo_incl).alias("lo_incl"), get(hi).alias("hi"), F.lit(hi_incl).alias("hi_incl"))
            out = F.when(part.rlike(pattern), found) if out is None else out.when(part.rlike(pattern), found)
        return out

    return F.filter(F.transform(F.split(text, "或"), one), lambda x: x.isNotNull())


def short_digest(*parts: Column) -> Column:
    """16 hex digits that identify content."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 16)


def allowed_url(url: Column, hosts: list[str]) -> Column:
    """Whether a URL is https and its host is on the list."""
    return F.coalesce((F.try_parse_url(url, F.lit("PROTOCOL")) == "https") & F.try_parse_url(url, F.lit("HOST")).isin(*hosts), F.lit(False))
