"""Page geometry: rows of boxes, text with its columns, matrices, cells.

A page's lines are one array value, so a page is read inside one row: the array is
sorted and folded by higher-order functions in the JVM, without Python, shuffle or
explode. A box joins the latest of the last ``LOOK_BACK`` rows whose first box has
its centre near; that looks back at what was decided before, hence the fold.

Defined cases: null lines, null texts and boxes that are not four numbers are left
out; a page without lines has no row and an empty text; a null width or height is
the usual one.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasift.functions.text import nfkc

# fixed values
LOOK_BACK, OVERLAP = 3, 0.45
LAST_COLUMN, GLYPHS_A_PAGE, LEAST_GLYPH = 500, 150, 3.0
ROW_GAP = 0.04
BAND = 32.0  # height of the strips in which lines look for their cells


@lru_cache(maxsize=1)
def _wide_class() -> str:
    """A character class of what East Asian width calls wide or full-width."""
    wide = [o for o in range(0x110000) if unicodedata.east_asian_width(chr(o)) in "WF"]
    ends = [(a, b) for a, b in zip(wide, wide[1:] + [0x110000]) if b != a + 1]
    starts = [wide[0]] + [b for _, b in ends[:-1]]
    return "[" + "".join(rf"\x{{{s:x}}}-\x{{{e:x}}}" for s, (e, _) in zip(starts, ends)) + "]"


def display_width(text: Column) -> Column:
    """Columns of a text: wide characters take two."""
    return F.length(text) + F.length(text) - F.length(F.regexp_replace(text, _wide_class(), ""))


def _empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def row_boxes(lines: Column) -> Column:
    """``array<struct<row, x1, ix, x2, mid, wide, text>>``: the good boxes with the number of their row, rows top down, left to right."""
    good = F.filter(lines, lambda l: l["text"].isNotNull() & (F.size(l["bbox"]) == 4) & F.forall(l["bbox"], lambda v: v.isNotNull()))
    flat = F.transform(
        F.coalesce(good, F.slice(lines, 1, 0)),
        lambda l, i: F.struct(((l["bbox"][1] + l["bbox"][3]) / 2).alias("mid"), l["bbox"][0].alias("x1"), i.alias("ix"), l["bbox"][2].alias("x2"), (l["bbox"][3] - l["bbox"][1]).alias("tall"), display_width(l["text"]).alias("wide"), l["text"].alias("text")),
    )
    ordered = F.array_sort(flat)

    def place(state: Column, box: Column) -> Column:
        near = F.filter(state["open"], lambda o: F.abs(o["mid"] - box["mid"]) <= OVERLAP * F.least(o["tall"], box["tall"]))
        opened = F.struct(box["mid"].alias("mid"), box["tall"].alias("tall"), state["n"].alias("row"))
        return F.when(
            F.size(near) > 0, F.struct(state["open"].alias("open"), state["n"].alias("n"), F.array_append(state["rows"], near[0]["row"]).alias("rows"))
        ).otherwise(
            F.struct(F.slice(F.array_prepend(state["open"], opened), 1, LOOK_BACK).alias("open"), (state["n"] + 1).alias("n"), F.array_append(state["rows"], state["n"]).alias("rows"))
        )

    start = F.struct(_empty("struct<mid:double,tall:double,row:int>").alias("open"), F.lit(0).alias("n"), _empty("int").alias("rows"))
    rows = F.aggregate(ordered, start, place, lambda s: s["rows"])
    numbered = F.zip_with(ordered, rows, lambda b, r: F.struct(r.alias("row"), b["x1"].alias("x1"), b["ix"].alias("ix"), b["x2"].alias("x2"), b["mid"].alias("mid"), b["wide"].alias("wide"), b["text"].alias("text")))
    return F.array_sort(numbered)


def _median(values: Column) -> Column:
    """The mean of the two middle values of an array, null for none."""
    s, n = F.array_sort(values), F.size(values)
    return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def laid_out(boxes: Column, width: Column) -> Column:
    """Text of a page from ``row_boxes``: those of one row stand at their columns, at least two blanks apart."""
    glyph = _median(F.transform(boxes, lambda b: (b["x2"] - b["x1"]) / F.greatest(F.lit(1), b["wide"])))
    unit = F.greatest(F.lit(LEAST_GLYPH), F.coalesce(glyph, width / GLYPHS_A_PAGE))

    def write(state: Column, cell: Column) -> Column:
        column = F.least(F.lit(LAST_COLUMN), F.rint(cell["x1"] / state["unit"]).cast("int"))
        fresh = state["row"] != cell["row"]
        line, end = F.when(fresh, F.lit("")).otherwise(state["line"]), F.when(fresh, F.lit(0)).otherwise(state["end"])
        blanks = F.greatest(F.when(line == "", 0).otherwise(2), column - end)
        return F.struct(
            state["unit"].alias("unit"), F.when(fresh & (state["row"] >= 0), F.array_append(state["done"], state["line"])).otherwise(state["done"]).alias("done"),
            F.concat(line, F.repeat(F.lit(" "), blanks), cell["text"]).alias("line"), cell["row"].alias("row"), (F.greatest(column, end + 2) + cell["wide"]).alias("end"),
        )

    # the unit stands in the state, so that it is found once a page and not once a box
    start = F.struct(unit.alias("unit"), _empty("string").alias("done"), F.lit("").alias("line"), F.lit(-1).alias("row"), F.lit(0).alias("end"))
    lines = F.aggregate(boxes, start, write, lambda s: F.array_append(s["done"], s["line"]))
    return F.array_join(F.transform(lines, lambda l: F.regexp_replace(l, r"(?U)\s+$", "")), "\n")


def layout_text(pages: DataFrame, key: list[str]) -> DataFrame:
    """``key, rows, text``: number of rows and laid-out text of each page (columns lines, width)."""
    boxed = pages.select(*key, "width", row_boxes(F.col("lines")).alias("_boxes"))
    rows = F.coalesce(F.array_max(F.transform("_boxes", lambda b: b["row"])) + 1, F.lit(0))
    return boxed.select(*key, rows.cast("int").alias("rows"), F.coalesce(laid_out(F.col("_boxes"), F.coalesce("width", F.lit(1000.0))), F.lit("")).alias("text"))


_PLAIN_SIGNS = ("＋－−﹣％", "+---%")
_WHOLE_NUMBER = r"[-+]?[0-9]++(?:\.[0-9]++)?+"


def _numbers(text: Column) -> Column:
    """The numbers of a text, or null if it holds anything else; none for a blank text."""
    plain = F.translate(text, *_PLAIN_SIGNS)
    return F.when(F.trim(F.regexp_replace(plain, _WHOLE_NUMBER, "")) == "", F.regexp_extract_all(plain, F.lit(_WHOLE_NUMBER), F.lit(0)))


def number_row(text: Column) -> Column:
    """The numbers of a text that holds nothing else, as ``array<decimal(20,6)>``, else null."""
    found = _numbers(text)
    return F.when(F.size(found) > 0, F.transform(found, lambda x: x.try_cast("decimal(20,6)")))


def matrix_blocks(rows: Column, height: Column) -> Column:
    """``array<struct<first, size>>``: square number blocks in rows ``array<struct<mid, nums>>``, found from the top, none in another.

    A block is n rows of n numbers, each close below the one before, with a zero diagonal.
    """

    def block(row: Column, i: Column) -> Column:
        n = F.size(row["nums"])
        part = F.slice(rows, i + 1, F.greatest(n, F.lit(1)))
        step = F.transform(part, lambda r, k: F.when(k == 0, F.lit(True)).otherwise((r["mid"] > part[k - 1]["mid"]) & (r["mid"] - part[k - 1]["mid"] < ROW_GAP * height)))
        square = F.forall(part, lambda r: F.size(r["nums"]) == n)
        diagonal = F.transform(part, lambda r, k: F.get(r["nums"], k) == 0)
        good = (n > 1) & (F.size(part) == n) & square & F.forall(step, lambda x: x) & F.forall(diagonal, lambda x: x)
        return F.when(good, F.struct(i.alias("first"), n.alias("size")))

    every = F.filter(F.transform(rows, block), lambda b: b.isNotNull())
    start = F.struct(F.lit(0).alias("free"), _empty("struct<first:int,size:int>").alias("taken"))
    take = lambda s, b: F.when(b["first"] >= s["free"], F.struct((b["first"] + b["size"]).alias("free"), F.array_append(s["taken"], b).alias("taken"))).otherwise(s)
    return F.aggregate(every, start, take, lambda s: s["taken"])


def _number_rows(boxes: Column) -> Column:
    """``array<struct<mid, nums>>``: the rows of ``row_boxes`` that hold numbers only."""

    def join(state: Column, box: Column) -> Column:
        fresh = state["now"]["row"] != box["row"]
        new = F.struct(box["row"].alias("row"), box["mid"].alias("total"), F.lit(1).alias("n"), box["text"].alias("text"))
        more = F.struct(box["row"].alias("row"), (state["now"]["total"] + box["mid"]).alias("total"), (state["now"]["n"] + 1).alias("n"), F.concat_ws(" ", state["now"]["text"], box["text"]).alias("text"))
        return F.struct(F.when(fresh & (state["now"]["row"] >= 0), F.array_append(state["done"], state["now"])).otherwise(state["done"]).alias("done"), F.when(fresh, new).otherwise(more).alias("now"))

    start = F.struct(_empty("struct<row:int,total:double,n:int,text:string>").alias("done"), F.struct(F.lit(-1).alias("row"), F.lit(0.0).alias("total"), F.lit(0).alias("n"), F.lit("").alias("text")).alias("now"))
    texts = F.aggregate(boxes, start, join, lambda s: F.when(s["now"]["row"] >= 0, F.array_append(s["done"], s["now"])).otherwise(s["done"]))
    read = F.transform(texts, lambda r: F.struct((r["total"] / r["n"]).alias("mid"), F.transform(_numbers(r["text"]), lambda x: x.cast("double")).alias("nums")))
    return F.filter(read, lambda r: r["nums"].isNotNull())


def printed_matrices(pages: DataFrame, key: list[str]) -> DataFrame:
    """``key, block, size, top, cells``: square number blocks printed on pages (columns lines, height).

    Boxes of one row are read from left to right; a row counts if it holds numbers only.
    """
    rows = pages.select(*key, "height", row_boxes(F.col("lines")).alias("_boxes")).select(*key, "height", _number_rows(F.col("_boxes")).alias("_rows"))
    found = rows.select(*key, "_rows", F.posexplode(matrix_blocks(F.col("_rows"), F.coalesce("height", F.lit(1400.0)))).alias("block", "_b"))
    part = F.slice("_rows", F.col("_b.first") + 1, F.col("_b.size"))
    return found.select(*key, "block", F.col("_b.size").alias("size"), F.get("_rows", F.col("_b.first"))["mid"].alias("top"), F.flatten(F.transform(part, lambda r: r["nums"])).alias("cells"))


def cell_scores(lines: DataFrame, cells: DataFrame, key: list[str]) -> DataFrame:
    """Recognised text per truth cell: ``key, cell_id, expected, actual, exact, numeric``.

    A line belongs to a cell if its centre lies in the half-open box. Lines of a cell
    are put together from left to right; compared is in NFKC without white space.
    Lines meet the cells of their strip of the page only.
    """
    cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    strip = lambda y: F.floor(y / BAND)
    l = lines.select(*key, strip(cy).alias("_strip"), cx.alias("cx"), cy.alias("cy"), F.col("x1").alias("lx"), F.col("text").alias("line_text"))
    spread = cells.withColumn("_strip", F.explode_outer(F.when(F.col("c_y2") > F.col("c_y1"), F.sequence(strip(F.col("c_y1")), strip(F.col("c_y2"))))))
    inside = (F.col("cx") >= F.col("c_x1")) & (F.col("cx") < F.col("c_x2")) & (F.col("cy") >= F.col("c_y1")) & (F.col("cy") < F.col("c_y2"))
    j = spread.join(l, [*key, "_strip"], "left").withColumn("hit", F.when(inside, F.struct("lx", "line_text")))
    g = j.groupBy(*key, "cell_id", "expected", "numeric").agg(F.sort_array(F.collect_list("hit")).alias("hits"))
    actual = F.array_join(F.transform("hits", lambda h: h["line_text"]), "")
    g = g.withColumn("actual", actual).withColumns({"_a": nfkc(F.col("actual")), "_e": nfkc(F.col("expected"))})
    bare = lambda c: F.regexp_replace(c, r"(?U)\s+", "")
    return g.select(*key, "cell_id", "expected", "numeric", "actual", (bare(F.col("_a")) == bare(F.col("_e"))).alias("exact"))


def bounding_box(boxes: Column) -> Column:
    """``struct<x1,y1,x2,y2>`` around an array of boxes."""
    at = lambda i: F.transform(boxes, lambda b: F.element_at(b, i))
    return F.struct(F.array_min(at(1)).alias("x1"), F.array_min(at(2)).alias("y1"), F.array_max(at(3)).alias("x2"), F.array_max(at(4)).alias("y2"))
