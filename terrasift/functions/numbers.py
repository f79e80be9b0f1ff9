"""Numbers written as text, and exact arithmetic on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXACT = "decimal(20,6)"

# fixed values: marks that stand for "no value"
NO_VALUE = ("-", "—")
# fixed values: counting words
NUMERALS = {"零": 0, "無": 0, "一": 1, "二": 2, "兩": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "十": 10}


def strip_all(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_missing(text: Column) -> Column:
    """Null, blank or a mark for "no value"; 0 is a value."""
    t = strip_all(text)
    return F.coalesce((t == "") | t.isin(*NO_VALUE), F.lit(True))


def parse_number(text: Column) -> Column:
    """A tolerant exact number: commas and blanks are dropped and one percent sign
    of each width is taken off the end; what then is no finite number is null."""
    t = F.regexp_replace(strip_all(F.replace(text, F.lit(","), F.lit(""))), "%$", "")
    return strip_all(F.regexp_replace(t, "％$", "")).try_cast(EXACT)


def half_up(value: Column, digits: int = 0) -> Column:
    """Rounds halves away from zero (decimals)."""
    return F.round(value, digits)


def strict_sum(value: Column) -> Column:
    """The sum, or null as soon as one value is null (SQL's SUM skips nulls)."""
    return F.when(F.count(F.lit(1)) == F.count(value), F.sum(value))


def numeral(word: Column) -> Column:
    """A counting word or digits as an integer, else null."""
    table = F.create_map(*[F.lit(x) for pair in NUMERALS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, word), F.when(word.rlike("^[0-9]+$"), word.try_cast("int")))
