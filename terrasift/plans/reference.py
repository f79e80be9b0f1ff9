"""Queries that run the engine's general operators on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasift.functions import numbers as N
from terrasift.functions import text as X
from terrasift.functions.dates import parse_date
from terrasift.functions.geo import haversine_m, plausible, planar_m, with_wgs84
from terrasift.operators import bands as B
from terrasift.operators import evidence as E
from terrasift.operators import facilities as O
from terrasift.operators import layout as L
from terrasift.operators import logs as G
from terrasift.operators import retrieval as R
from terrasift.operators.nested import shred
from terrasift.operators.ordered import asof_join, with_previous
from terrasift.plans.dealt import snapshot_fields
from terrasift.sources import sinks
from terrasift.sources.records import keyword_filter
from terrasift.sources.tables import table
from terrasift.streaming import tables as S

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _once(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """The wanted columns of a table without stored repeats (its key is among them), so that the scan reads no others."""
    return table(spark, folder, name).select(*columns).distinct()


def _facilities(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return _once(spark, folder, "facilities", "facility_id", *columns)


def _dec(col: str, kind: str = "decimal(18,2)"):
    return F.col(col).cast(kind)


# ---- grading by bands -----------------------------------------------------------------

BAND_ROWS = [("q", g, lo, True, hi, False) for g, lo, hi in ((1, 0, 10), (2, 10, 20), (3, 20, 30), (4, 30, 40), (5, 40, None))]
BAND_DDL = "rule string, grade int, lo decimal(20,6), lo_incl boolean, hi decimal(20,6), hi_incl boolean"


def _bands(spark: SparkSession, rows: list) -> DataFrame:
    from decimal import Decimal

    d = lambda v: None if v is None else Decimal(v)
    return spark.createDataFrame([(r, g, d(lo), li, d(hi), hi_i) for r, g, lo, li, hi, hi_i in rows], BAND_DDL)


@query
def band_quantity(spark: SparkSession, folder: str) -> DataFrame:
    v = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.lit("q").alias("rule"), _dec("l_quantity", "decimal(20,6)").alias("v"))
    out = B.match_bands(v, _bands(spark, BAND_ROWS), "v", ["rule"])
    return out.groupBy("grade", "reason").agg(F.count("*").alias("n"), F.sum("v").cast("double").alias("total"))


@query
def band_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Every mix of open and closed edges; where two intervals hold a value there is no grade."""
    rows = [("cc", 1, 1, True, 20, True), ("cc", 2, 20, True, 50, True), ("co", 1, 1, True, 20, False), ("co", 2, 20, True, 50, True), ("oo", 1, None, True, 20, False), ("oo", 2, 20, False, None, True)]
    v = table(spark, folder, "part").select("p_partkey", F.explode(F.array(*map(F.lit, ("cc", "co", "oo")))).alias("rule"), F.col("p_size").cast("decimal(20,6)").alias("v"))
    return B.match_bands(v, _bands(spark, rows), "v", ["rule"]).select("p_partkey", "rule", "grade", "reason")


@query
def cut_points(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    high = B.cut_grade(F.col("o_totalprice"), [400_000, 300_000, 200_000, 100_000], True)
    low = B.cut_grade(F.col("o_totalprice"), [100_000, 200_000, 300_000, 400_000], False)
    return o.groupBy(high.alias("higher"), low.alias("lower")).agg(F.count("*").alias("n"))


@query
def category_grade(spark: SparkSession, folder: str) -> DataFrame:
    groups = spark.createDataFrame([("1-URGENT", 1), ("2-HIGH", 1), ("3-MEDIUM", 2), ("5-LOW", 3)], "value string, grade int")
    o = table(spark, folder, "orders").withColumnRenamed("o_orderpriority", "value").join(groups, "value", "left")
    return o.groupBy("value", "grade").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("closed"))


@query
def distinct_count_grade(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.countDistinct("l_suppkey").alias("n"))
    return s.groupBy(B.cut_grade(F.col("n"), [4, 3, 2, 1], True).alias("grade")).agg(F.count("*").alias("orders"))


@query
def facility_grade(spark: SparkSession, folder: str) -> DataFrame:
    f = _facilities(spark, folder, "factor", "name", "in_value_section", "distance_m")
    args = (F.col("name").isNotNull(), F.coalesce("in_value_section", F.lit(False)), F.col("distance_m"))
    near = B.facility_grade(*args, [500, 1000, 1500, 2000], 5, True)
    far = B.facility_grade(*args, [2000, 1500, 1000, 500], 5, False)
    return f.groupBy("factor", near.alias("near"), far.alias("far")).agg(F.count("*").alias("n"))


def _size_grades(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part")
    return p.select("p_partkey", "p_brand", B.cut_grade(F.col("p_size"), [40, 30, 20, 10], True).alias("ix"))


@query
def matrix_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Every part against its brand's first part, by the rate matrix of the brand."""
    g = _size_grades(spark, folder)
    first = g.groupBy("p_brand").agg(F.min_by("ix", "p_partkey").alias("comparable_ix"))
    sizes = g.select("p_brand").distinct().withColumns({"size": F.lit(5), "step": F.lit(2.5).cast("decimal(9,4)")})
    cells = B.step_matrix(sizes, ["p_brand"])
    pairs = g.join(first, "p_brand").withColumnRenamed("ix", "subject_ix")
    a = B.rate_lookup(pairs, cells, ["p_brand"], "subject_ix", "comparable_ix")
    b = B.rate_lookup(pairs, B.transpose(cells), ["p_brand"], "subject_ix", "comparable_ix")
    total = lambda d, n: d.groupBy("p_brand").agg(F.sum("rate").cast("double").alias(n), F.count("rate").alias(f"{n}_n"))
    return total(a, "rate").join(total(b, "turned"), "p_brand")


# ---- rule tables ------------------------------------------------------------------------


def rule_parts(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """Flat tables of the nested rule sets by their Dewey labels: ``bands``, ``cells`` or ``values``."""
    path = {"bands": "rules/*/bands/*/*", "cells": "rules/*/matrix/*/*", "values": "rules/*/bands/*/values/*"}[kind]
    lists = ["rules", "rules/*/bands", "rules/*/bands/*/values", "rules/*/matrix", "rules/*/matrix/*"]
    nodes = shred(table(spark, folder, "rulesets"), F.col("id"), F.col("body"), [path], lists).where("kind = 'scalar'").distinct()
    step = lambda i: F.split("label", "/")[i]
    base = nodes.select(F.col("record_id").alias("ruleset_id"), step(1).cast("int").alias("rule_ix"), step(3).alias("s3"), step(4).alias("s4"), "value")
    if kind == "cells":
        return base.select("ruleset_id", "rule_ix", (F.col("s3").cast("int") + 1).alias("subject_ix"), (F.col("s4").cast("int") + 1).alias("comparable_ix"), F.col("value").cast("decimal(9,4)").alias("rate"))
    if kind == "values":
        return base.select("ruleset_id", "rule_ix", F.col("s3").cast("int").alias("band_ix"), "value")
    wide = base.groupBy("ruleset_id", "rule_ix", F.col("s3").cast("int").alias("band_ix")).pivot("s4", ["label", "low", "high"]).agg(F.first("value"))
    return wide.select(
        "ruleset_id", "rule_ix", "band_ix", "label", F.coalesce("low", F.lit("0")).cast("decimal(20,6)").alias("lo"), F.lit(True).alias("lo_incl"), F.col("high").cast("decimal(20,6)").alias("hi"), F.lit(False).alias("hi_incl")
    )


RULE = ["ruleset_id", "rule_ix"]


@query
def rule_band_adjacency(spark: SparkSession, folder: str) -> DataFrame:
    """Neighbouring bands of every rule, the first band's end moved down or up by one in two of three rules."""
    moved = F.when(F.col("band_ix") == 0, F.col("hi") + (F.col("rule_ix") % 3 - 1).cast("decimal(20,6)")).otherwise(F.col("hi")).cast("decimal(20,6)")
    return B.adjacency(rule_parts(spark, folder, "bands").withColumn("hi", moved), RULE).select(*RULE, F.col("at").cast("double").alias("at"), "code")


@query
def rule_band_contiguity(spark: SparkSession, folder: str) -> DataFrame:
    b = rule_parts(spark, folder, "bands").withColumn("ix", F.col("band_ix") + 1)
    return B.contiguous(b, RULE, "ix").join(b.groupBy(*RULE).agg(F.count("*").alias("n_bands"), F.countDistinct("label").alias("n_labels")), RULE)


@query
def rule_alias_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    """Words that stand for several bands of one rule, or twice for one."""
    return B.repeated(rule_parts(spark, folder, "values"), [*RULE, "value"])


@query
def rule_matrix_faults(spark: SparkSession, folder: str) -> DataFrame:
    sizes = rule_parts(spark, folder, "bands").groupBy(*RULE).agg(F.count("*").cast("int").alias("size"))
    return B.matrix_faults(rule_parts(spark, folder, "cells"), sizes, RULE, 5)


def _case_factors(spark: SparkSession, folder: str) -> DataFrame:
    nodes = shred(table(spark, folder, "cases"), F.col("id"), F.col("body"), ["factors/*/id", "ruleset_id"], ["factors"]).where("kind = 'scalar'").distinct()
    ids = nodes.where("schema_path = 'factors/*/id'").select("record_id", F.col("value").alias("rule_id"))
    sets = nodes.where("schema_path = 'ruleset_id'").select("record_id", F.col("value").alias("ruleset_id"))
    return sets.join(ids, "record_id")


def _rule_ids(spark: SparkSession, folder: str) -> DataFrame:
    nodes = shred(table(spark, folder, "rulesets"), F.col("id"), F.col("body"), ["rules/*/id"], ["rules"])
    return nodes.where("kind = 'scalar'").select(F.col("record_id").alias("ruleset_id"), F.col("value").alias("rule_id")).distinct()


@query
def factors_missing_unknown(spark: SparkSession, folder: str) -> DataFrame:
    """Per rule set: rules that a case has no factor for, and factors without a rule."""
    f, r = _case_factors(spark, folder).distinct(), _rule_ids(spark, folder)
    cases = f.select("record_id", "ruleset_id").distinct()
    wanted = cases.join(r, "ruleset_id")
    missing = wanted.join(f, ["record_id", "ruleset_id", "rule_id"], "left_anti").groupBy("ruleset_id").agg(F.count("*").alias("missing"))
    unknown = f.join(r, ["ruleset_id", "rule_id"], "left_anti").groupBy("ruleset_id").agg(F.count("*").alias("unknown"))
    return cases.select("ruleset_id").distinct().join(missing, "ruleset_id", "left").join(unknown, "ruleset_id", "left").fillna(0)


# ---- sums, counts, ranks ---------------------------------------------------------------


@query
def strict_sums(spark: SparkSession, folder: str) -> DataFrame:
    li = table(spark, folder, "lineitem").withColumn("v", F.when(F.col("l_quantity") < 50, _dec("l_extendedprice")))
    g = li.groupBy("l_orderkey").agg(N.strict_sum(F.col("v")).alias("strict"), F.sum("v").alias("loose"), F.sum(F.abs(F.col("v") - 1000)).alias("spread"))
    return g.select("l_orderkey", *[F.col(c).cast("double").alias(c) for c in ("strict", "loose", "spread")])


@query
def status_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Fixed statuses, zeros kept, and whether none is bad."""
    d = table(spark, folder, "lineitem").groupBy("l_orderkey").pivot("l_returnflag", ["A", "N", "R", "X"]).count().fillna(0)
    return d.select("l_orderkey", *[F.col(c).alias(f"n_{c.lower()}") for c in "ANRX"], ((F.col("R") == 0) & (F.col("X") == 0)).alias("complete"))


@query
def dashboard(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    return o.agg(F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count_if(F.col("o_orderstatus").isin("O", "P")).alias("pending"), F.countDistinct("o_custkey").alias("customers"))


@query
def nearest_ranks(spark: SparkSession, folder: str) -> DataFrame:
    li = table(spark, folder, "lineitem")
    low = O.rank_value(li, ["l_returnflag", "l_linestatus"], "l_extendedprice", 0.02, "low")
    return low.join(O.rank_value(li, ["l_returnflag", "l_linestatus"], "l_extendedprice", 0.98, "high"), ["l_returnflag", "l_linestatus"])


@query
def longest_titles(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part")
    return p.groupBy("p_brand").agg(F.max_by("p_name", F.struct(F.length("p_name"), -F.col("p_partkey"))).alias("title"))


@query
def set_operations(spark: SparkSession, folder: str) -> DataFrame:
    """Per nation: customers' segments against a wanted set, as differences and intersection."""
    wanted = F.array(*map(F.lit, ("BUILDING", "MACHINERY", "SPACE")))
    c = table(spark, folder, "customer").groupBy("c_nationkey").agg(F.sort_array(F.collect_set("c_mktsegment")).alias("s"))
    txt = lambda a: F.array_join(F.sort_array(a), ",")
    return c.select("c_nationkey", txt(F.array_intersect("s", wanted)).alias("common"), txt(F.array_except("s", wanted)).alias("extra"), (F.size(F.array_except(wanted, "s")) == 0).alias("covered"))


# ---- numbers, dates, words ---------------------------------------------------------------


@query
def parsed_numbers(spark: SparkSession, folder: str) -> DataFrame:
    d = _once(spark, folder, "pdf_drafts", "draft_id", "subject", "comparable")
    both = d.select("draft_id", F.inline(F.array(*[F.struct(F.lit(c).alias("side"), F.col(c).alias("v")) for c in ("subject", "comparable")])))
    return both.select("draft_id", "side", N.parse_number(F.col("v")).cast("double").alias("number"), N.is_missing(F.col("v")).alias("missing"))


@query
def rounded_prices(spark: SparkSession, folder: str) -> DataFrame:
    li = table(spark, folder, "lineitem")
    v = N.half_up(_dec("l_extendedprice") * (F.lit(1).cast("decimal(9,4)") + _dec("l_tax", "decimal(9,4)")))
    return li.groupBy("l_orderkey").agg(F.sum(v).cast("double").alias("total"))


@query
def roc_dates(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    roc = F.concat(F.lpad((F.year("o_orderdate") - 1911).cast("string"), 3, "0"), F.date_format("o_orderdate", "MMdd"))
    kinds = F.when(F.col("o_orderkey") % 3 == 0, roc).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "yyyy/MM/dd"))
    return o.select("o_orderkey", kinds.alias("written"), parse_date(kinds).alias("day"))


@query
def written_intervals(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part")
    n, m = F.col("p_size").cast("string"), (F.col("p_size") + 10).cast("string")
    kinds = [F.concat(n, F.lit("公尺以上未滿"), m, F.lit("公尺")), F.concat(F.lit("未滿"), n, F.lit("m")), F.concat(n, F.lit("%以上")), F.concat(n, F.lit("㎡以下或"), m, F.lit("㎡以上")), F.lit("無")]
    pick = F.element_at(F.array(*kinds), (F.col("p_partkey") % 5 + 1).cast("int"))
    return p.select("p_partkey", F.inline_outer(X.intervals(pick))).select("p_partkey", F.col("lo").cast("double").alias("lo"), "lo_incl", F.col("hi").cast("double").alias("hi"), "hi_incl")


@query
def counting_words(spark: SparkSession, folder: str) -> DataFrame:
    words = F.array(*map(F.lit, ("無", "一", "兩", "十", "12", "多")))
    p = table(spark, folder, "part").withColumn("word", F.element_at(words, (F.col("p_partkey") % 6 + 1).cast("int")))
    return p.groupBy("word", N.numeral(F.col("word")).alias("number")).agg(F.count("*").alias("n"))


@query
def words_in_order(spark: SparkSession, folder: str) -> DataFrame:
    words = X.in_order(F.col("p_type"), ["STANDARD", "ECONOMY", "BRUSHED", "STEEL", "STEE", "TIN", "ANODIZED"])
    return table(spark, folder, "part").select("p_partkey", F.array_join(words, ">").alias("words"))


@query
def compact_names(spark: SparkSession, folder: str) -> DataFrame:
    f = _facilities(spark, folder, "factor", "item", "name")
    return f.select("facility_id", X.compact(F.concat_ws("、", "factor", "item", "name")).alias("name"))


@query
def first_values(spark: SparkSession, folder: str) -> DataFrame:
    f = _facilities(spark, folder, "phone", "category", "name", "twd97_x", "longitude")
    return f.select("facility_id", X.first_text(F.col("phone"), F.col("category"), F.col("name")).alias("value"), X.first_number(F.col("category"), F.col("twd97_x"), F.col("longitude")).alias("number"))


@query
def list_parts(spark: SparkSession, folder: str) -> DataFrame:
    f = _facilities(spark, folder, "factor", "item", "administrative_district")
    return f.select(F.explode(X.split_list(F.concat_ws("、", "factor", "item", "administrative_district"))).alias("part")).groupBy("part").agg(F.count("*").alias("n"))


# ---- retrieval ---------------------------------------------------------------------------


def _headers(spark: SparkSession, folder: str) -> DataFrame:
    return snapshot_fields(table(spark, folder, "cases"), ["id"], "body", ("ruleset_id", "locality", "land_use", "valuation_date")).distinct()


@query
def documents_in_scope(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence documents that are valid for each case on its valuation date."""
    q = _headers(spark, folder).select(F.col("id").alias("query_id"), "ruleset_id", "locality", "land_use", parse_date(F.col("valuation_date")).alias("day"))
    docs = _once(spark, folder, "evidence_documents", "document_id", "ruleset_id", "locality", "land_use", "valid_from", "valid_to")
    return R.in_scope(docs, q).select(F.col("query_id").alias("case_id"), "document_id", F.col("day").alias("valuation_date"))


@query
def evidence_listing(spark: SparkSession, folder: str) -> DataFrame:
    e = _once(spark, folder, "evidence_documents", "document_id", "ruleset_id")
    d = table(spark, folder, "source_documents").select(F.col("id").alias("document_id"), "name", F.size("pages").alias("n_pages")).distinct()
    return e.join(d, "document_id").select("document_id", "name", "n_pages", "ruleset_id")


@query
def chunk_windows(spark: SparkSession, folder: str) -> DataFrame:
    c = R.chunks(table(spark, folder, "documents"), ["doc_id"], "text")
    return c.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.length("chunk")).alias("chars"), F.max("stop").alias("stop"))


@query
def term_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Term and document frequencies of the whole archive."""
    t = table(spark, folder, "documents").select("doc_id", F.explode(X.tokens(F.col("text"))).alias("term"))
    return t.groupBy("doc_id", "term").agg(F.count("*").alias("tf")).groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))


def _bm25(spark: SparkSession, folder: str, pieces: DataFrame, key: list[str]) -> DataFrame:
    """Every mail whose id is divisible by 20 as a question."""
    asked = table(spark, folder, "documents").where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.col("text").alias("question"))
    return R.bm25(pieces, key, "chunk", asked, 20)


@query
def bm25_mails(spark: SparkSession, folder: str) -> DataFrame:
    return _bm25(spark, folder, R.chunks(table(spark, folder, "documents"), ["doc_id"], "text"), ["doc_id", "start"])


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "source_documents").select(F.col("id").alias("document_id"), F.explode("pages").alias("p")).select("document_id", "p.*").distinct()


@query
def bm25_pages(spark: SparkSession, folder: str) -> DataFrame:
    p = _pages(spark, folder).select("document_id", "page", "text").distinct()
    return _bm25(spark, folder, R.chunks(p, ["document_id", "page"], "text"), ["document_id", "page", "start"])


@query
def citation_ids(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "evidence_documents").select("document_id", "sha256").distinct()
    c = R.chunks(_pages(spark, folder).select("document_id", "page", "text").distinct(), ["document_id", "page"], "text")
    return c.join(e, "document_id").select("document_id", "page", "start", R.citation_id(F.col("document_id"), F.col("sha256"), F.col("page"), F.col("start"), F.col("stop")).alias("citation"))


@query
def chunk_boxes(spark: SparkSession, folder: str) -> DataFrame:
    """The box of every chunk that is a whole page; other chunks have none."""
    p = _pages(spark, folder).select("document_id", "page", "text", "lines")
    c = R.chunks(p.withColumn("p", F.struct("text", F.col("lines.bbox").alias("bbox"))), ["document_id", "page", "p"], "text")
    return c.select("document_id", "page", "start", "stop", R.chunk_box(F.col("start"), F.col("chunk"), F.col("p.text"), F.col("p.bbox")).alias("b")).select("document_id", "page", "start", "stop", "b.*")


@query
def criteria_read(spark: SparkSession, folder: str) -> DataFrame:
    """The quotes of drafts read as criteria: without remarks, in one writing, and the intervals in them."""
    q = _once(spark, folder, "pdf_drafts", "draft_id", "evidence.quote").withColumn("bare", X.without_tail(X.traditional(F.col("quote"))))
    return q.select("draft_id", X.numeric_text(F.col("bare")).alias("criterion"), F.size(X.intervals(F.col("bare"))).alias("intervals"))


@query
def page_slices(spark: SparkSession, folder: str) -> DataFrame:
    """Every mail in slices that cover it; an empty one has one empty slice."""
    starts = F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(2000))
    d = table(spark, folder, "documents").where("text is not null").select("doc_id", F.explode(starts).alias("offset"), "text")
    s = d.select("doc_id", "offset", R.page_slice(F.col("text"), F.col("offset")).alias("s"))
    return s.select("doc_id", "offset", F.md5("s.quote").alias("digest"), F.col("s.next_start").cast("int").alias("next_start"))


# ---- evidence ------------------------------------------------------------------------------


@query
def quotes_verified(spark: SparkSession, folder: str) -> DataFrame:
    """Draft items by why their quote does or does not bear their values out."""
    d = _once(spark, folder, "pdf_drafts", "draft_id", "document_id", "evidence", "subject", "comparable", "entered_rate").select("draft_id", "document_id", "evidence.page", "evidence.quote", "subject", "comparable", F.col("entered_rate").cast("decimal(9,4)"))
    return E.verify(d, _pages(spark, folder)).select("draft_id", "reason")


@query
def conflicts_dropped(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "pdf_drafts").select("draft_id", "document_id", "factor_id", "subject", "comparable").distinct()
    return E.without_conflicts(d, ["document_id", "factor_id"], ["subject", "comparable"], ["draft_id"])


@query
def only_choices(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "pdf_drafts").select("document_id", F.col("evidence.method").alias("method")).where("method is not null")
    return E.only_choice(d, ["document_id"], "method")


@query
def blank_patches(spark: SparkSession, folder: str) -> DataFrame:
    """Drafts offer values for places that are blank in the document's first draft of a factor."""
    d = _once(spark, folder, "pdf_drafts", "draft_id", "document_id", "factor_id", "subject", "comparable")
    current = d.groupBy("document_id", "factor_id").agg(F.min_by("subject", "draft_id").alias("value"))
    offers = d.where(~N.is_missing(F.col("comparable"))).select("document_id", "factor_id", F.col("comparable").alias("value"), F.col("draft_id").alias("priority"))
    return E.blank_patches(offers, current, ["document_id", "factor_id"], "value", "priority")


@query
def page_fields(spark: SparkSession, folder: str) -> DataFrame:
    patterns = spark.createDataFrame([("base_day", "估價基準日 ([0-9]{7})"), ("coverage", "建蔽率 ([0-9]+)%"), ("floor_area", "容積率 ([0-9]+)%"), ("file", "收文字號 ([0-9]+)")], "field string, pattern string")
    return E.extract_fields(_pages(spark, folder).select("document_id", "page", "text").distinct(), ["document_id", "page"], "text", patterns)


@query
def quoted_lines(spark: SparkSession, folder: str) -> DataFrame:
    p = _pages(spark, folder).select("document_id", "page", "text").distinct()
    return p.select("document_id", "page", X.line_slice(F.col("text"), F.lit(2), F.lit(3)).alias("lines")).where("lines is not null")


# ---- facilities ------------------------------------------------------------------------------


@query
def district_match(spark: SparkSession, folder: str) -> DataFrame:
    f = _facilities(spark, folder, "administrative_district", "address", "name")
    districts = table(spark, folder, "place_names").where("kind = 'district'").select(F.col("name_zh").alias("district")).distinct()
    field = f.withColumn("declared", F.when(F.col("facility_id") % 3 != 0, F.regexp_replace("administrative_district", "^..市", "")))
    out = O.match_district(field, ["facility_id"], "declared", "address", "name", "霧澤區", districts)
    return out.select("facility_id", "match_basis")


@query
def districts_matched(spark: SparkSession, folder: str) -> DataFrame:
    """Every district of each facility, all districts at once."""
    f = _facilities(spark, folder, "administrative_district", "address", "name")
    districts = table(spark, folder, "place_names").where("kind = 'district'").select(F.col("name_zh").alias("district")).distinct()
    field = f.withColumn("declared", F.when(F.col("facility_id") % 3 != 0, F.regexp_replace("administrative_district", "^..市", "")))
    return O.match_districts(field, ["facility_id"], "declared", "address", "name", districts)


@query
def coordinates_normalised(spark: SparkSession, folder: str) -> DataFrame:
    """Coordinates of each facility, a third of the given ones blanked so that the grid is used."""
    f = _facilities(spark, folder, "longitude", "latitude", "twd97_x", "twd97_y")
    blank = F.when(F.col("facility_id") % 3 != 0, F.col("longitude"))
    c = O.with_coordinates(f, blank, F.col("latitude"), F.col("twd97_x"), F.col("twd97_y"), "c")
    return c.select("facility_id", F.round("c.lon", 6).alias("lon"), F.round("c.lat", 6).alias("lat"), F.col("c.source").alias("source"))


@query
def grid_errors(spark: SparkSession, folder: str) -> DataFrame:
    """How far the converted grid coordinates are from the given ones, and grid distances to a point."""
    f = _facilities(spark, folder, "longitude", "latitude", "twd97_x", "twd97_y").where(plausible(F.col("longitude"), F.col("latitude")) & F.col("twd97_x").isNotNull() & F.col("twd97_y").isNotNull())
    g = with_wgs84(f, F.col("twd97_x"), F.col("twd97_y"), "g")
    error = haversine_m(F.col("longitude"), F.col("latitude"), F.col("g.lon"), F.col("g.lat"))
    return g.select("facility_id", F.round(error, 1).alias("error_m"), F.round(planar_m(F.col("twd97_x"), F.col("twd97_y"), F.lit(300000.0), F.lit(2770000.0)), 3).alias("planar_m"))


def _boxes(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    f = table(spark, folder, "facilities").select("facility_id", "administrative_district", "match_basis", "longitude", "latitude").distinct().where("administrative_district is not null")
    return f, O.reference_box(f.where("match_basis <> 'name_keyword'"), ["administrative_district"])


@query
def reference_boxes(spark: SparkSession, folder: str) -> DataFrame:
    _, b = _boxes(spark, folder)
    return b.select("administrative_district", *[F.round(c, 9).alias(c) for c in ("min_lon", "max_lon", "min_lat", "max_lat")], "n_points")


@query
def loose_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    f, b = _boxes(spark, folder)
    return O.adjudicate(f.where("match_basis = 'name_keyword'"), b, ["administrative_district"]).select("facility_id", "verdict")


@query
def slot_report(spark: SparkSession, folder: str) -> DataFrame:
    f = _facilities(spark, folder, "factor", "item", "category", "address", "needs_manual_check", "source_key", "school_year")
    records = f.where("address is not null and not needs_manual_check").select("factor", "item")
    status = F.when(F.max("school_year").isNull(), "skipped_heavy").when(F.count("*") > 5, "ok").otherwise("error")
    sources = f.groupBy("factor", "item", "source_key").agg(status.alias("status"))
    survey = f.where("category is null").select("factor", "item", F.lit("?").alias("category")).distinct()
    return O.slot_report(records, sources, survey)


@query
def category_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Records per slot and its categories, most frequent first."""
    f = _facilities(spark, folder, "factor", "category").withColumn("category", F.coalesce("category", F.lit("-")))
    c = f.groupBy("factor", "category").agg(F.count("*").alias("n"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "category", "n")))
    return c.groupBy("factor").agg(F.sum("n").alias("records"), order.alias("s")).select("factor", "records", F.array_join(F.transform("s", lambda x: F.concat(x["category"], F.lit(" "), x["n"].cast("string"))), "; ").alias("summary"))


@query
def names_by_keyword(spark: SparkSession, folder: str) -> DataFrame:
    """Catalogue search: names with all keywords, and short forms by their ending."""
    p = table(spark, folder, "place_names").select("place_id", F.col("name_en").alias("name"), F.col("name_zh").alias("description"))
    hit = keyword_filter(p, ["XING", "rd"])
    return hit.where(F.col("description").endswith("路")).select("place_id", "name")


# ---- logs --------------------------------------------------------------------------------------


@query
def latest_state(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "audit").select("id", "case_id", "at_utc", "action").distinct()
    return G.latest(a, ["case_id"], ["at_utc", "id"])


def _revisions(spark: SparkSession, folder: str) -> DataFrame:
    rows = snapshot_fields(table(spark, folder, "audit"), ["id", "case_id", "at_utc"], "snapshot", ("revision", "locality", "land_use", "ruleset_id"))
    return rows.distinct().withColumn("revision", F.col("revision").try_cast("long"))


@query
def accepted_writes(spark: SparkSession, folder: str) -> DataFrame:
    w = G.accepted_writes(_revisions(spark, folder).where("case_id is not null"), ["case_id"], ["id"], "revision", F.floor(F.col("id") / 10_000))
    return w.groupBy("case_id").agg(F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected"))


@query
def changed_fields(spark: SparkSession, folder: str) -> DataFrame:
    c = G.changed_fields(_revisions(spark, folder).where("case_id is not null"), ["case_id"], ["id"], ["locality", "land_use", "ruleset_id"], F.floor(F.col("id") / 10_000))
    return c.select("case_id", "id", "field", "old", "new")


@query
def fifo_cache(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").where("received_at is not null and n_chars is not null").select("doc_id", "received_at", "n_chars").distinct()
    return G.fifo_cache(d, "received_at", "n_chars", 200_000, ["doc_id"])


@query
def newest_drafts(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "pdf_drafts").select("draft_id", "factor_id", "extracted_at").distinct()
    return G.newest(d, ["factor_id"], "extracted_at", "draft_id", 3)


@query
def expired_events(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    now = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    return e.groupBy("event_type").agg(F.count_if(G.expired(F.col("ts"), now, 900)).alias("expired"), F.count("*").alias("n"))


@query
def spaced_calls(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").select("event_id", "event_type", "ts")
    return G.spaced(e, ["event_type"], "ts", "event_id", 1.1).select("event_id", "wait_us")


@query
def repeated_mails(spark: SparkSession, folder: str) -> DataFrame:
    """Mails archived twice, whatever the archive."""
    d = table(spark, folder, "documents").where("text is not null").select("doc_id", "text", F.lit("archive").alias("source"))
    return G.repeated_pages(d, ["source"], "doc_id", F.col("text"))


# ---- layout and exports --------------------------------------------------------------------------


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    p = _pages(spark, folder).select("document_id", "page", F.posexplode("lines").alias("ix", "l"))
    b = lambda i: F.try_element_at("l.bbox", F.lit(i))
    return p.select("document_id", "page", "ix", F.col("l.text").alias("text"), F.col("l.confidence").alias("confidence"), b(1).alias("x1"), b(2).alias("y1"), b(3).alias("x2"), b(4).alias("y2"))


@query
def page_layout(spark: SparkSession, folder: str) -> DataFrame:
    return L.layout_text(_pages(spark, folder).select("document_id", "page", "lines", "width").distinct(), ["document_id", "page"])


@query
def page_boxes(spark: SparkSession, folder: str) -> DataFrame:
    p = _pages(spark, folder).where("size(lines) > 0").select("document_id", "page", L.bounding_box(F.col("lines.bbox")).alias("b"))
    return p.select("document_id", "page", "b.*")


@query
def line_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Confidence in ten-thousandths and median glyph width per document; blank lines are left out."""
    l = _lines(spark, folder).where("trim(text) <> ''")
    return l.groupBy("document_id").agg(F.count("*").alias("n"), F.sum(F.round(F.col("confidence") * 10_000).cast("long")).alias("confidence"), F.round(F.percentile(((F.col("x2") - F.col("x1")) / F.length("text")), 0.5), 6).alias("glyph"))


@query
def cell_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    """Recognised lines against a half-line raster as truth cells, by page."""
    l = _lines(spark, folder)
    cells = l.select("document_id", "page", F.col("ix").alias("cell_id"), F.col("text").alias("expected"), F.col("text").rlike("[0-9]").alias("numeric"),
                     F.col("x1").alias("c_x1"), F.col("y1").alias("c_y1"), F.when(F.col("ix") % 5 == 0, F.col("x1") + 1).otherwise(F.col("x2")).alias("c_x2"), F.col("y2").alias("c_y2"))
    s = L.cell_scores(l, cells, ["document_id", "page"])
    return s.groupBy("document_id", "page").agg(F.count("*").alias("cells"), F.count_if("exact").alias("exact"), F.count_if(F.col("exact") & F.col("numeric")).alias("numeric_exact"))


@query
def number_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of numbers only, from price lists made of order lines."""
    li = table(spark, folder, "lineitem")
    t = F.concat_ws(" ", F.col("l_linenumber").cast("string"), F.concat(F.lit("－"), F.col("l_quantity").cast("int").cast("string")), F.when(F.col("l_linenumber") == 3, F.lit("x")))
    n = L.number_row(t)
    return li.groupBy("l_linenumber").agg(F.count(n).alias("number_rows"), F.sum(F.try_element_at(n, F.lit(2))).cast("double").alias("second"))


@query
def guarded_csv(spark: SparkSession, folder: str) -> DataFrame:
    """Whole mails as cells, three of four behind a sign that a spreadsheet may run."""
    d = table(spark, folder, "documents").where("text is not null")
    cell = F.concat(F.element_at(F.array(*map(F.lit, ("=", "", " @", "-"))), (F.col("doc_id") % 4 + 1).cast("int")), "text")
    return d.select("doc_id", X.csv_safe(cell).alias("cell"))


@query
def html_report(spark: SparkSession, folder: str) -> DataFrame:
    return sinks.html_rows(table(spark, folder, "documents").select("doc_id", "lang", "message_id", "in_reply_to"), ["doc_id", "lang", "message_id", "in_reply_to"])


@query
def filled_cells(spark: SparkSession, folder: str) -> DataFrame:
    h = _headers(spark, folder)
    values = h.select(F.col("id").alias("record"), F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in ("locality", "land_use", "valuation_date")]))).where("value is not null")
    cells = spark.createDataFrame([("s1", "B2", "locality"), ("s1", "B3", "land_use"), ("s2", "C4", "valuation_date"), ("s2", "C5", "weight")], "sheet string, cell string, field string")
    return sinks.fill_cells(values, cells, ["record"])


@query
def report_sections(spark: SparkSession, folder: str) -> DataFrame:
    r = table(spark, folder, "region").select("r_regionkey", "r_name")
    n = table(spark, folder, "nation").groupBy("n_regionkey").agg(F.count("*").alias("nations"))
    return sinks.sections({"regions": r, "nations": n})


# ---- streams ----------------------------------------------------------------------------------------

EVENT_DDL = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _event_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(EVENT_DDL).option("pathGlobFilter", "events*.parquet").parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


@query
def stream_windows(spark: SparkSession, folder: str) -> DataFrame:
    w = S.windowed_counts(_event_stream(spark, folder), ["event_type"], "ts", "1 day", "1 day")
    return S.collect_stream(w, "stream_windows", "complete").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query
def stream_without_repeats(spark: SparkSession, folder: str) -> DataFrame:
    d = S.without_repeats(_event_stream(spark, folder), ["event_id"], "ts", "400 days")
    return S.collect_stream(d.select("event_id", "event_type"), "stream_without_repeats").groupBy("event_type").agg(F.count("*").alias("n"))


@query
def session_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of each user that end after a day without an event (the batch form)."""
    e = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    p = with_previous(e, ["user_id"], ["ts", "event_id"], ["ts"], F.unix_date(F.to_date("ts")))
    gap = F.coalesce(F.unix_micros("ts") - F.unix_micros("previous.ts") >= 86_400_000_000, F.lit(True))
    return p.withColumn("new", gap.cast("int")).groupBy("user_id").agg(F.sum("new").alias("sessions"), F.count("*").alias("n"))


# ---- further extraction and comparison ---------------------------------------------------------------


def _factors(spark: SparkSession, folder: str) -> DataFrame:
    """Factors of current cases: case_id, ix, factor_id, subject, comparable."""
    nodes = shred(table(spark, folder, "cases"), F.col("id"), F.col("body"), ["factors/*/id", "factors/*/subject", "factors/*/comparable"], ["factors"]).where("kind = 'scalar'").distinct()
    wide = nodes.select(F.col("record_id").alias("case_id"), F.split("label", "/")[1].cast("int").alias("ix"), F.split("label", "/")[2].alias("f"), "value")
    return wide.groupBy("case_id", "ix").pivot("f", ["id", "subject", "comparable"]).agg(F.first("value")).withColumnRenamed("id", "factor_id").where("factor_id is not null")


def _field_sources(spark: SparkSession, folder: str) -> DataFrame:
    fields = ["factor_id", "field", "kind", "value"]
    nodes = shred(table(spark, folder, "cases"), F.col("id"), F.col("body"), [f"field_sources/*/{f}" for f in fields], ["field_sources"]).where("kind = 'scalar'").distinct()
    wide = nodes.select(F.col("record_id").alias("case_id"), F.split("label", "/")[1].cast("int").alias("ix"), F.split("label", "/")[2].alias("f"), "value")
    return wide.groupBy("case_id", "ix").pivot("f", fields).agg(F.first("value"))


@query
def sources_expired(spark: SparkSession, folder: str) -> DataFrame:
    """Provenance rows of current cases whose value does not stand in the factor."""
    f = _factors(spark, folder)
    values = f.select("case_id", "factor_id", F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("subject", "comparable")]))).distinct()
    return E.expired_sources(_field_sources(spark, folder), values, ["case_id", "factor_id", "field"]).select("case_id", "ix", "factor_id", "field", "value").distinct()


@query
def draft_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Document factors whose first and last draft differ, appear or disappear between two halves of the drafts."""
    d = table(spark, folder, "pdf_drafts").select("draft_id", "document_id", "factor_id", "subject", "comparable").distinct()
    state = lambda x: G.latest(x, ["document_id", "factor_id"], ["draft_id"])
    return G.member_changes(state(d.where("draft_id % 2 = 0")), state(d.where("draft_id % 2 = 1")), ["document_id", "factor_id"], ["subject", "comparable"])


@query
def documents_ready(spark: SparkSession, folder: str) -> DataFrame:
    d = _once(spark, folder, "pdf_drafts", "draft_id", "document_id", "evidence", "entered_rate")
    return G.ready(d, ["document_id"], (F.col("evidence.quote") != "") & F.col("entered_rate").isNotNull())


@query
def single_localities(spark: SparkSession, folder: str) -> DataFrame:
    """The locality of a page, if it names exactly one."""
    p = _pages(spark, folder).select("document_id", "page", "text").distinct()
    return p.select("document_id", "page", E.single_match(F.col("text"), "[一-鿿]{2}市[一-鿿]{2}區").alias("locality")).where("locality is not null")


@query
def pages_of_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Pages that the rules of a document's rule set cite."""
    nodes = shred(table(spark, folder, "rulesets"), F.col("id"), F.col("body"), ["rules/*/source_page"], ["rules"]).where("kind = 'scalar'")
    cited = nodes.select(F.col("record_id").alias("ruleset_id"), F.col("value").cast("int").alias("page")).distinct()
    e = table(spark, folder, "evidence_documents").select("document_id", "ruleset_id").distinct()
    p = _pages(spark, folder).select("document_id", "page").distinct().join(e, "document_id")
    return p.join(cited, ["ruleset_id", "page"], "left_semi").select("document_id", "ruleset_id", "page")


@query
def content_versions(spark: SparkSession, folder: str) -> DataFrame:
    r = table(spark, folder, "rulesets")
    return r.select("id", X.short_digest(F.col("id"), F.col("body")).alias("version"), X.allowed_url(F.concat(F.lit("https://data.example/"), F.col("id")), ["data.example"]).alias("allowed"))


@query
def label_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Values on the lines after a label, from order lines printed one value a line."""
    li = table(spark, folder, "lineitem")
    q = F.col("l_quantity").cast("int").cast("string")
    third = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.col("l_linenumber").cast("string"), F.lit("%"))).when(F.col("l_linenumber") % 3 == 1, F.lit("note"))
    text = F.concat_ws("\n", F.lit("head"), F.concat(F.lit("7 "), F.col("l_returnflag")), q, F.when(F.col("l_linenumber") == 7, F.lit("none")).otherwise(F.lit("12")), third)
    pages = li.select("l_returnflag", "l_linenumber", text.alias("text")).distinct()
    labels = spark.createDataFrame([("A", ["none"]), ("N", []), ("R", ["none"])], "label string, words array<string>")
    return E.labelled_values(pages, ["l_returnflag", "l_linenumber"], labels).groupBy("label", "l_linenumber").agg(F.count("*").alias("n"), F.count("rate").alias("rates"), F.sum(F.col("subject").cast("long")).alias("total"))


@query
def printed_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Matrices of the rule sets printed as boxes and found again."""
    cells = rule_parts(spark, folder, "cells")
    row = lambda i: F.struct(F.col("rate").cast("double").cast("string").alias("text"), F.array((F.col("comparable_ix") * 60).cast("double"), (F.col("subject_ix") * 20).cast("double"), (F.col("comparable_ix") * 60 + 40).cast("double"), (F.col("subject_ix") * 20 + 15).cast("double")).alias("bbox"))
    pages = cells.groupBy(*RULE).agg(F.sort_array(F.collect_list(row(0))).alias("lines")).withColumn("height", F.lit(1400.0))
    return L.printed_matrices(pages, RULE).select(*RULE, "size", F.aggregate("cells", F.lit(0.0), lambda a, x: a + F.abs(x)).alias("weight"))


@query
def asof_events(spark: SparkSession, folder: str) -> DataFrame:
    """Each purchase with the latest view of the same user before it."""
    e = table(spark, folder, "events")
    buys = e.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    views = e.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"))
    out = asof_join(buys, views, ["user_id"], "ts", ["view_id"], F.unix_date(F.to_date("ts")))
    return out.select("event_id", "user_id", F.col("match.view_id").alias("view_id"))


@query
def rows_per_source(spark: SparkSession, folder: str) -> DataFrame:
    """Held rows of every source with their share of all."""
    return O.source_shares(_facilities(spark, folder, "source_key", "address"))


@query
def required_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Per source whether every raw row has the keys a source must have."""
    f = table(spark, folder, "facilities").select("facility_id", "source_key", F.from_json("raw", "map<string,string>").alias("row")).dropDuplicates(["facility_id"])
    return O.required_keys(f, ["source_key"], "row", ["名稱", "地址"])
