"""Exports: guarded CSV, JSON, an HTML table, filled cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasift.functions.text import csv_safe, html_escape


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with header in which no text can run as a formula. Refuses to overwrite."""
    safe = {c: csv_safe(F.col(c)) for c, t in df.dtypes if t == "string"}
    df.withColumns(safe).write.mode("errorifexists").csv(path, header=True, escape='"')


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines, nulls written out. Refuses to overwrite."""
    df.write.mode("errorifexists").json(path, ignoreNullFields=False)


def html_rows(df: DataFrame, columns: list[str], nothing: str = "—") -> DataFrame:
    """``html``: one escaped table row per record; a null is shown as ``nothing``."""
    cells = [F.concat(F.lit("<td>"), html_escape(F.coalesce(F.col(c).cast("string"), F.lit(nothing))), F.lit("</td>")) for c in columns]
    return df.select(F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("html"))


def fill_cells(values: DataFrame, cells: DataFrame, keys: list[str], nothing: str = "not provided") -> DataFrame:
    """``record, sheet, cell, value``: a form's cells (sheet, cell, field) filled from long values (record, field, value)."""
    records = values.select(*keys).distinct()
    every = records.join(cells)  # a form has every cell, filled or not
    return every.join(values, [*keys, "field"], "left").select(*keys, "sheet", "cell", F.coalesce("value", F.lit(nothing)).alias("value"))


def sections(parts: dict[str, DataFrame]) -> DataFrame:
    """``section, ord, row``: sections of unlike tables in one, each row as JSON."""
    out = None
    for i, (name, df) in enumerate(parts.items()):
        one = df.select(F.lit(name).alias("section"), F.lit(i).alias("ord"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("row"))
        out = one if out is None else out.unionByName(one)
    return out
