"""Extracted values against their evidence, and merging of drafts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasift.functions.numbers import is_missing
from terrasift.functions.text import holds_number, nfkc, without_commas

IN_PLAN = 1000
RATE_MARKS = "%|％|修正率|差異率|修正百分"


def squeezed(text: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(text, r"(?U)\s+", "")


def verify(drafts: DataFrame, pages: DataFrame) -> DataFrame:
    """``drafts`` with ``reason``: null when the quote is on its page and holds every claimed value.

    ``drafts``: draft_id, document_id, page, quote, subject, comparable, entered_rate.
    ``pages``: document_id, page, text. One outer pair of quotation marks may be taken
    off. Quote, page and values are compared in NFKC without white space. Reasons:
    no_quote, no_page, no_value, not_on_page, value_not_in_quote. A rate without a
    percent mark in its quote is not a claim.
    """
    forms = pages.where("text is not null").select("document_id", "page", nfkc(F.col("text")).alias("text"))
    text = forms.groupBy("document_id", "page").agg(F.collect_set(squeezed(F.col("text"))).alias("texts"))
    stripped = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    d = drafts.withColumn("quote", stripped(F.col("quote")))
    inner = F.regexp_extract("quote", r'(?s)^(?:"(.+)"|「(.+)」|“(.+)”)$', 0)
    bare = stripped(F.when(inner != "", F.expr("substring(quote, 2, length(quote) - 2)")))
    d = d.withColumns({"rate": F.when(F.col("quote").rlike(RATE_MARKS), F.col("entered_rate")), "_quote": nfkc(F.col("quote")), "_bare": nfkc(bare)})
    d = d.withColumns({"_subject": nfkc(F.col("subject")), "_comparable": nfkc(F.col("comparable"))})
    j = d.join(text, ["document_id", "page"], "left")
    on = lambda q: F.coalesce((q != "") & F.exists("texts", lambda t: t.contains(squeezed(q))), F.lit(False))
    # the words that count: without the marks only where the page has them so alone
    words = F.when(~on(F.col("_quote")) & on(F.col("_bare")), F.col("_bare")).otherwise(F.col("_quote"))

    def claimed(value: Column) -> Column:
        v = F.regexp_replace(F.replace(squeezed(value), F.lit(","), F.lit("")), "%$", "")
        n = F.regexp_replace(v.try_cast("double").cast("string"), r"\.0$", "")
        held = F.when(v.rlike(r"^[+-]?[0-9]+(\.[0-9]+)?$"), holds_number(words, n)).otherwise((v != "") & squeezed(without_commas(words)).contains(v))
        return value.isNull() | F.coalesce(held, F.lit(False))

    values = claimed(F.col("_subject")) & claimed(F.col("_comparable")) & claimed(F.col("rate").cast("string"))
    reason = (
        F.when(F.coalesce(F.col("quote"), F.lit("")) == "", "no_quote").when(F.col("texts").isNull(), "no_page")
        .when(F.coalesce("subject", "comparable", F.col("rate").cast("string")).isNull(), "no_value")
        .when(~(on(F.col("_quote")) | on(F.col("_bare"))), "not_on_page").when(~values, "value_not_in_quote")
    )
    return j.withColumn("reason", reason).drop("texts", "rate", "_quote", "_bare", "_subject", "_comparable")


def without_conflicts(rows: DataFrame, key: list[str], values: list[str], order: list[str]) -> DataFrame:
    """One row per key whose rows agree on ``values``; keys that disagree are dropped whole."""
    rest = [c for c in rows.columns if c not in key]
    g = rows.groupBy(*key).agg(F.countDistinct(F.to_json(F.struct(*values), {"ignoreNullFields": "false"})).alias("_n"), F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return g.where("_n = 1").select(*key, *[F.col("_r")[c].alias(c) for c in rest]).select(*rows.columns)


def only_choice(rows: DataFrame, key: list[str], option: str) -> DataFrame:
    """The option of a key if all its rows name the same one."""
    g = rows.groupBy(*key).agg(F.min(option).alias(option), F.max(option).alias("_m"))
    return g.where(F.col(option) == F.col("_m")).drop("_m")


def blank_patches(patches: DataFrame, current: DataFrame, key: list[str], value: str, priority: str) -> DataFrame:
    """The patch of highest priority for each place that is still blank: lowest ``priority`` number, then lowest value."""
    filled = current.where(~is_missing(F.col(value))).select(*key)
    best = patches.groupBy(*key).agg(F.min(F.struct(priority, value)).alias("_b"))
    return best.join(filled, key, "left_anti").select(*key, F.col("_b")[value].alias(value), F.col("_b")[priority].alias(priority))


def extract_fields(lines: DataFrame, key: list[str], text: str, patterns: DataFrame) -> DataFrame:
    """``key, field, value``: the first group of every pattern of a table in every text that has it.

    ``patterns``: field, pattern. Up to ``IN_PLAN`` of them stand in the plan; more
    are dealt into blocks of that size, and every text is held against every block.
    """
    table = patterns.select("field", "pattern").where("pattern is not null").distinct()
    held = [(r["field"], r["pattern"]) for r in table.orderBy("field", "pattern").limit(IN_PLAN + 1).collect()]
    if len(held) <= IN_PLAN:
        found = F.array(*[F.struct(F.lit(f).alias("field"), F.nullif(F.regexp_extract(F.col(text), p, 1), F.lit("")).alias("value")) for f, p in held])
        return lines.select(*key, F.inline(found)).where("value is not null")
    blocks = table.groupBy(F.pmod(F.xxhash64("field", "pattern"), F.lit(-(-table.count() // IN_PLAN))).alias("_block")).agg(F.collect_list(F.struct("field", "pattern")).alias("_patterns"))
    each = lines.select(*key, F.col(text).alias("_text")).join(blocks).select(*key, "_text", F.inline("_patterns"))
    return each.select(*key, "field", F.expr("nullif(regexp_extract(_text, pattern, 1), '')").alias("value")).where("value is not null")


def labelled_values(pages: DataFrame, key: list[str], labels: DataFrame) -> DataFrame:
    """Values printed on the lines after a label: ``key, label, line, subject, comparable, rate``.

    ``labels``: label, words (array of words that count as values). A label line holds
    the label alone, perhaps with a number before it. Of the up to four lines after it
    the first that is neither a number nor a word ends the run; exactly two values are
    taken, or three if the third is a percentage. Lines never cross a page.
    """
    lines = pages.select(*key, F.split("text", "\r\n|\n|\r").alias("_l")).select(
        *key, F.posexplode(F.transform("_l", lambda x, i: F.struct(x.alias("line"), F.slice(F.col("_l"), i + 2, F.lit(4)).alias("next")))).alias("line", "_s")
    )
    lines = lines.withColumn("_label", F.regexp_replace(squeezed(F.col("_s.line")), "^[0-9]*", ""))
    tags = labels.select(squeezed(F.col("label")).alias("_label"), "label", F.transform("words", squeezed).alias("words"))
    value = lambda v: v.rlike(r"^[-+]?[0-9][0-9,]*(\.[0-9]+)?[%％]?$") | F.array_contains("words", v)
    run = F.aggregate(
        F.transform("_s.next", squeezed), F.struct(F.array().cast("array<string>").alias("v"), F.lit(True).alias("go")),
        lambda acc, x: F.when(acc["go"] & value(x), F.struct(F.array_append(acc["v"], x).alias("v"), F.lit(True).alias("go"))).otherwise(F.struct(acc["v"].alias("v"), F.lit(False).alias("go"))),
        lambda acc: acc["v"],
    )
    j = lines.join(tags, "_label").withColumn("_v", run)
    third = F.try_element_at("_v", F.lit(3))
    good = (F.size("_v") == 2) | ((F.size("_v") == 3) & third.rlike("[%％]$"))
    return j.where(good).select(*key, "label", "line", F.element_at("_v", 1).alias("subject"), F.element_at("_v", 2).alias("comparable"), third.alias("rate"))


def ticked(text: Column, option: str) -> Column:
    """Whether an option stands after a ticked box."""
    return F.coalesce(text.rlike(rf"[☑■●]\s*\Q{option}\E"), F.lit(False))


def single_match(text: Column, pattern: str) -> Column:
    """The one distinct match of a pattern, or null when there is none or several."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    return F.when(F.size(found) == 1, F.element_at(found, 1))


def expired_sources(sources: DataFrame, values: DataFrame, key: list[str]) -> DataFrame:
    """Provenance rows (key, value, ...) whose value is not, or no longer, the one in ``values`` (key, value)."""
    return sources.join(values.select(*key, "value"), [*key, "value"], "left_anti")
