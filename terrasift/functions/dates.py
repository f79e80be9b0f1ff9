"""Dates in the two calendars the records use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROC_OFFSET = 1911


def parse_date(text: Column) -> Column:
    """ISO ``yyyy-mm-dd`` or ROC ``yyymmdd`` (year + 1911) as a date, anything else null."""
    t = F.trim(text)
    year = F.try_add(F.substring(t, 1, 3).try_cast("int"), F.lit(ROC_OFFSET)).cast("string")
    roc = F.concat_ws("-", year, F.substring(t, 4, 2), F.substring(t, 6, 2))
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t.try_cast("date")).when(t.rlike(r"^\d{7}$"), roc.try_cast("date"))
