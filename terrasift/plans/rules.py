"""Queries of the rule checks, grading ways and guards, with their SQL."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasift.operators import bands as B
from terrasift.operators import logs as G
from terrasift.operators import rules as K
from terrasift.plans.dealt import snapshot_fields
from terrasift.plans.reference import RULE, _facilities, rule_parts
from terrasift.plans.reference_sql import _CASES, _FAC, _RULES
from terrasift.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return put


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, l_quantity AS lo, l_linenumber % 2 = 0 AS lo_incl, CASE l_linenumber % 3 WHEN 0 THEN l_quantity ELSE l_quantity + l_tax * 100 - 4 END AS hi, l_linenumber % 4 = 0 AS hi_incl FROM lineitem)
  SELECT l_orderkey, l_linenumber, CASE WHEN lo > hi THEN 'reversed' ELSE 'empty' END AS fault FROM t WHERE lo > hi OR (lo = hi AND NOT (lo_incl AND hi_incl))""")
def interval_faults(spark: SparkSession, folder: str) -> DataFrame:
    """Intervals made of order lines: some end before they begin, some hold no point."""
    n = F.col("l_linenumber")
    hi = F.when(n % 3 == 0, F.col("l_quantity")).otherwise(F.col("l_quantity") + F.col("l_tax") * 100 - 4)
    t = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", K.interval_fault(F.col("l_quantity"), n % 2 == 0, hi, n % 4 == 0).alias("fault"))
    return t.where("fault is not null")


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_shipdate, CASE WHEN l_quantity >= 40 THEN 1 WHEN l_quantity >= 30 THEN 2 WHEN l_quantity >= 20 THEN 3 WHEN l_quantity >= 10 THEN 4 ELSE 5 END AS grade FROM lineitem),
  d AS (SELECT l_orderkey, grade - lag(grade) OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, grade) AS d FROM s)
  SELECT l_orderkey, count(*) AS n, coalesce(bool_and(d >= 0), true) AS rising, coalesce(bool_and(d <= 0), true) AS falling FROM d GROUP BY 1""")
def grade_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the grades of an order's lines only rise or only fall along their dates."""
    s = table(spark, folder, "lineitem").select("l_orderkey", "l_shipdate", B.cut_grade(F.col("l_quantity"), [40, 30, 20, 10], True).alias("grade"))
    return K.grade_order(s, ["l_orderkey"], "l_shipdate", "grade")


@query("""SELECT p_brand, p_size AS lo, hi FROM (SELECT p_brand, p_size, lead(p_size) OVER (PARTITION BY p_brand ORDER BY p_size) AS hi FROM (SELECT DISTINCT p_brand, p_size FROM part WHERE p_size IS NOT NULL)) WHERE hi IS NOT NULL""")
def edges_paired(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "part").groupBy("p_brand").agg(F.collect_set("p_size").alias("edges"))
    return e.select("p_brand", F.inline(K.edge_pairs(F.col("edges"))))


@query(f"""WITH {_RULES}, r AS (SELECT ruleset_id, rule_ix, (['numeric', 'count', 'boolean', 'oracle'])[rule_ix % 4 + 1] AS method, CASE WHEN rule_ix % 5 = 0 THEN 'flag' ELSE 'number' END AS input, nullif(rule ->> '$.unit', '') AS unit, nullif(rule ->> '$.name', '') AS name FROM rl),
  m AS (SELECT * FROM (VALUES ('numeric', 'number', 'unit'), ('count', 'number', 'name'), ('boolean', 'flag', NULL)) t(method, i, needs))
  SELECT DISTINCT ruleset_id || '/' || rule_ix AS rule, CASE WHEN m.method IS NULL THEN 'unknown_method' WHEN input <> i THEN 'wrong_input' ELSE 'missing_payload' END AS code
  FROM r LEFT JOIN m USING (method) WHERE m.method IS NULL OR input <> i OR (needs = 'unit' AND (unit IS NULL OR trim(unit) = '')) OR (needs = 'name' AND (name IS NULL OR trim(name) = ''))""")
def rule_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Rules that do not fit the method dealt to them: its input, or what it needs."""
    from terrasift.operators.nested import shred

    nodes = shred(table(spark, folder, "rulesets"), F.col("id"), F.col("body"), ["rules/*", "rules/*/unit", "rules/*/name"], ["rules"]).distinct()
    ix = F.split("label", "/")[1].cast("int")
    held = nodes.where("kind = 'scalar'").groupBy("record_id", ix.alias("ix")).agg(F.map_from_entries(F.collect_set(F.struct(F.split("label", "/")[2], F.col("value")))).alias("payload"))
    every = nodes.where("schema_path = 'rules/*'").select("record_id", ix.alias("ix")).distinct().join(held, ["record_id", "ix"], "left")
    method = F.element_at(F.array(*map(F.lit, ("numeric", "count", "boolean", "oracle"))), F.col("ix") % 4 + 1)
    payload = F.coalesce("payload", F.create_map().cast("map<string,string>"))
    rules = every.select(F.concat_ws("/", "record_id", F.col("ix").cast("string")).alias("rule"), method.alias("method"), F.when(F.col("ix") % 5 == 0, "flag").otherwise("number").alias("input"), payload.alias("payload"))
    return K.payload_faults(rules, spark.createDataFrame([("numeric", "number", "unit"), ("count", "number", "name"), ("boolean", "flag", None)], "method string, input string, needs string")).distinct()


@query("""WITH p AS (SELECT p_brand, p_size, p_type || '、' || p_name AS t FROM part),
  l AS (SELECT p_brand, p_size % 3 AS grade, t FROM (SELECT DISTINCT p_brand, p_size, t FROM p WHERE p_brand <> 'Brand#13' OR p_size % 3 = 0)),
  f AS (SELECT DISTINCT p_brand, grade, regexp_replace(t, '[\\s、]', '', 'g') AS whole, unnest(string_split_regex(t, '[、\\s]+')) AS part FROM l),
  c AS (SELECT p_brand, max(n) > 1 AS cp FROM (SELECT p_brand, part, count(DISTINCT grade) AS n FROM f GROUP BY 1, 2) GROUP BY 1),
  w AS (SELECT p_brand, max(n) > 1 AS cw FROM (SELECT p_brand, whole, count(DISTINCT grade) AS n FROM f GROUP BY 1, 2) GROUP BY 1),
  y AS (SELECT p_brand, CASE WHEN NOT cp THEN 'fragment' WHEN NOT cw THEN 'whole' ELSE 'manual' END AS way FROM c JOIN w USING (p_brand))
  SELECT DISTINCT p_brand, way, CASE way WHEN 'fragment' THEN part WHEN 'whole' THEN whole END AS word, CASE WHEN way <> 'manual' THEN CAST(grade AS INT) END AS grade FROM f JOIN y USING (p_brand)""")
def fragment_words(spark: SparkSession, folder: str) -> DataFrame:
    """Words that stand for one grade; where parts clash the whole texts, where those clash none."""
    p = table(spark, folder, "part").where("p_brand <> 'Brand#13' or p_size % 3 = 0")
    labels = p.select("p_brand", (F.col("p_size") % 3).cast("int").alias("grade"), F.concat("p_type", F.lit("、"), "p_name").alias("text")).distinct()
    return K.fragment_grades(labels, ["p_brand"])


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN CASE WHEN p_size >= 40 THEN 1 WHEN p_size >= 20 THEN 2 ELSE 3 END WHEN 1 THEN CASE WHEN p_type = 'LARGE' THEN 1 WHEN p_type = 'MEDIUM' THEN 2 END WHEN 2 THEN CASE WHEN p_retailprice > 1000 THEN 1 ELSE 4 END END AS grade,
  CASE WHEN p_partkey % 4 = 3 THEN 'external decision required' WHEN p_partkey % 4 = 1 AND p_type NOT IN ('LARGE', 'MEDIUM') THEN 'no match' ELSE 'graded' END AS status FROM part""")
def graded_by_method(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part")
    method = F.element_at(F.array(*map(F.lit, ("numeric", "category", "boolean", "manual"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    ways = {
        "numeric": B.cut_grade(F.col("p_size"), [40, 20], True), "category": F.when(F.col("p_type") == "LARGE", 1).when(F.col("p_type") == "MEDIUM", 2),
        "boolean": K.boolean_grade(F.col("p_retailprice") > 1000, 1, 4),
    }
    return p.select("p_partkey", K.grade_by_method(method, ways).alias("g")).select("p_partkey", "g.*")


_CLASS_BANDS = [("r", 1, ["甲", "0"], None, None, "m"), ("r", 2, None, None, 50, "m"), ("r", 3, [], 50, 400, "m"), ("r", 4, None, 300, None, "m"), ("r", 5, None, 0, 9999, None)]


@query("""WITH v AS (SELECT DISTINCT draft_id, subject AS s FROM pdf_drafts),
  n AS (SELECT draft_id, trim(s) AS t, s IS NULL OR trim(s) IN ('', '-', '—') AS missing, TRY_CAST(regexp_replace(regexp_replace(trim(replace(s, ',', '')), '%$', ''), '％$', '') AS DECIMAL(38,10)) AS x FROM v),
  f AS (SELECT draft_id, list_filter([CASE WHEN t IN ('甲', '0') THEN 1 END, CASE WHEN x >= 0 AND x < 50 THEN 2 END, CASE WHEN x >= 50 AND x < 400 THEN 3 END, CASE WHEN x >= 300 THEN 4 END], lambda y: y IS NOT NULL) AS g, missing FROM n)
  SELECT draft_id, CASE WHEN NOT missing AND len(g) = 1 THEN g[1] END AS grade FROM f""")
def values_classified(spark: SparkSession, folder: str) -> DataFrame:
    """Written values of drafts by the one band that they fit, by alias or by number."""
    d = lambda x: None if x is None else Decimal(x)
    bands = spark.createDataFrame([(r, g, a, d(lo), d(hi), u) for r, g, a, lo, hi, u in _CLASS_BANDS], "rule string, grade int, aliases array<string>, lo decimal(20,6), hi decimal(20,6), unit string")
    v = table(spark, folder, "pdf_drafts").select("draft_id", F.lit("r").alias("rule"), F.col("subject").alias("value")).distinct()
    return K.classify(v, ["draft_id"], ["rule"], bands)


@query(f"""WITH {_RULES}, b AS (SELECT DISTINCT ruleset_id, rule_ix, band_ix + 1 AS ix, label FROM bd), v AS (SELECT r.ruleset_id, r.rule_ix, l.label FROM (SELECT DISTINCT ruleset_id, rule_ix FROM b) r, (VALUES ('甲'), ('丙'), ('戊'), ('x')) l(label))
  SELECT v.ruleset_id, v.rule_ix, v.label, CAST(CASE WHEN min(ix) = max(ix) THEN min(ix) END AS INT) AS ix FROM v LEFT JOIN b USING (ruleset_id, rule_ix, label) GROUP BY 1, 2, 3""")
def labels_indexed(spark: SparkSession, folder: str) -> DataFrame:
    """The band that a grade's label stands for, for rules that are given a grade only."""
    b = rule_parts(spark, folder, "bands").select(*RULE, (F.col("band_ix") + 1).alias("ix"), "label")
    v = b.select(*RULE).distinct().withColumn("label", F.explode(F.array(*map(F.lit, ("甲", "丙", "戊", "x")))))
    return K.label_index(v, RULE, b)


@query(f"""WITH f AS (SELECT DISTINCT factor, item FROM {_FAC}), c AS (SELECT n_name, replace(n_name, ' ', '、') AS entry FROM nation)
  SELECT x.name, c.n_name FROM (SELECT DISTINCT CASE WHEN n_nationkey % 2 = 0 THEN ' ' || n_name || ' ' ELSE '(' || n_name || ')' END AS name, CASE n_name WHEN 'CHINA' THEN 'JAPAN' ELSE replace(n_name, ' ', '') END AS k FROM nation) x JOIN c ON replace(c.n_name, ' ', '') = x.k""")
def names_by_alias(spark: SparkSession, folder: str) -> DataFrame:
    n = table(spark, folder, "nation")
    left = n.select(F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit(" "), "n_name", F.lit(" "))).otherwise(F.concat(F.lit("("), "n_name", F.lit(")"))).alias("name")).distinct()
    catalogue = n.select("n_name", F.replace("n_name", F.lit(" "), F.lit("、")).alias("entry"))
    return K.by_alias(left, "name", catalogue, "entry", spark.createDataFrame([("CHINA", "JAPAN")], "alias string, means string")).select("name", "n_name")


@query("""WITH g AS (SELECT l_orderkey, list(CASE WHEN l_linenumber = 6 THEN -l_quantity ELSE l_quantity END) AS v, count(*) FILTER (WHERE l_linenumber = 6) AS neg, count(*) AS n, sum(l_quantity) AS s, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS r FROM lineitem GROUP BY 1)
  SELECT l_orderkey, CASE WHEN neg = 0 THEN round(CAST(s AS DOUBLE) / n, 6) END AS mean, CASE WHEN neg > 0 THEN 'negative' END AS error, round(CAST(r AS DOUBLE) / s * 100, 6) AS percent FROM g""")
def guarded_figures(spark: SparkSession, folder: str) -> DataFrame:
    """Means that a negative value makes an error, and shares of a whole that must be positive."""
    q = F.col("l_quantity").cast("decimal(20,6)")
    g = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        F.collect_list(F.when(F.col("l_linenumber") == 6, -q).otherwise(q)).alias("v"), F.sum(q).alias("s"), F.sum(F.when(F.col("l_returnflag") == "R", q).otherwise(0)).alias("r")
    )
    out = g.select("l_orderkey", K.guarded_mean(F.col("v")).alias("m"), K.guarded_percent(F.col("r").cast("double"), F.col("s").cast("double")).alias("p"))
    return out.select("l_orderkey", F.round(F.col("m.mean").cast("double"), 6).alias("mean"), "m.error", F.round("p", 6).alias("percent"))


@query(f"""WITH {_CASES} SELECT id AS case_id, trim(coalesce(b ->> '$.subject_name', '')) <> '' AND trim(coalesce(b ->> '$.comparable_name', '')) <> '' AS complete, lower(concat_ws(' ', b ->> '$.title', b ->> '$.case_number')) LIKE '%-1%' AS found FROM cs WHERE json_type(b) = 'OBJECT' AND id IS NOT NULL""")
def cases_searched(spark: SparkSession, folder: str) -> DataFrame:
    """Per case whether both names are given and whether a search over title and number finds it."""
    c = snapshot_fields(table(spark, folder, "cases"), ["id"], "body", ("subject_name", "comparable_name", "title", "case_number")).where("id is not null").distinct()
    hit = K.search(c, ["title", "case_number"], "-1").select("id").distinct().withColumn("found", F.lit(True))
    return c.join(hit, "id", "left").select(F.col("id").alias("case_id"), K.both_given(F.col("subject_name"), F.col("comparable_name")).alias("complete"), F.coalesce("found", F.lit(False)).alias("found"))


@query("""SELECT DISTINCT document_id, valid_to IS NULL OR valid_from <= valid_to AS in_order, valid_to IS NOT NULL AND valid_to < indexed_at::DATE AS late FROM evidence_documents""")
def periods_in_order(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "evidence_documents")
    return e.select("document_id", K.in_order(F.col("valid_from"), F.col("valid_to")).alias("in_order"), (~K.in_order(F.to_date("indexed_at"), F.col("valid_to"))).alias("late")).distinct()


@query("""SELECT source, count(*) AS n, count(*) FILTER (WHERE coalesce(length(text), 0) <= 24000) AS n_tool, count(*) FILTER (WHERE coalesce(length(text), 0) <= 2000) AS n_slice FROM documents GROUP BY 1""")
def texts_within(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("text")
    return table(spark, folder, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(K.within_size(t, 24_000)).alias("n_tool"), F.count_if(K.within_size(t, 2_000)).alias("n_slice"))


@query("""SELECT facility_id, k AS key, extra[k] AS value FROM (SELECT DISTINCT facility_id, extra FROM facilities), (VALUES ('班級數'), ('站牌')) t(k) WHERE extra[k] IS NOT NULL AND extra[k] <> ''""")
def extra_values(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "facilities").select("facility_id", F.explode(K.extra_keys(F.col("extra"), ["班級數", "站牌"])).alias("key", "value"))
    return e.distinct()


@query(f"""SELECT facility_id, address FROM {_FAC} WHERE school_year = 113 AND contains(address, '市') AND regexp_matches(address, '^(?:[0-9]{{3}}-?)?雲[臺台]市')""")
def rows_of_year(spark: SparkSession, folder: str) -> DataFrame:
    """Facilities of one year whose address begins with the city."""
    f = _facilities(spark, folder, "school_year", "address")
    return K.of_year(f, "school_year", 113, "市", "address", "(?:[0-9]{3}-?)?雲[臺台]市").select("facility_id", "address")


@query("""SELECT user_id, bool_and(value < 490) AS passed, count(*) AS requests, count(*) FILTER (WHERE event_type = 'error' AND value IS NOT NULL) AS fixable FROM events GROUP BY 1""")
def runs_judged(spark: SparkSession, folder: str) -> DataFrame:
    """Runs that pass when all their criteria hold, with totals and the errors that have a value to take over."""
    fixable = (F.col("event_type") == "error") & F.col("value").isNotNull()
    return G.passed(table(spark, folder, "events"), ["user_id"], F.col("value") < 490).join(table(spark, folder, "events").groupBy("user_id").agg(F.count_if(fixable).alias("fixable")), "user_id")


@query("""WITH t AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name || ' ： ' || p_type WHEN 1 THEN 'G' || p_size || ':' || p_type ELSE ' ' || p_size || '-' || (p_partkey % 9) || ' ' END AS t FROM part)
  SELECT p_partkey, CASE WHEN p_partkey % 3 = 1 THEN regexp_extract(t, '^([^:]*):', 1) END AS label, CASE WHEN p_partkey % 3 = 1 THEN regexp_extract(t, ':(.*)$', 1) END AS body, CASE WHEN p_partkey % 3 = 2 THEN trim(t) END AS page FROM t""")
def lines_read(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of a rule table: graded ones by label and body, and page numbers."""
    k = F.col("p_partkey") % 3
    t = F.when(k == 0, F.concat("p_name", F.lit(" ： "), "p_type")).when(k == 1, F.concat(F.lit("G"), F.col("p_size").cast("string"), F.lit(":"), "p_type")).otherwise(F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit("-"), (F.col("p_partkey") % 9).cast("string"), F.lit(" ")))
    return table(spark, folder, "part").select("p_partkey", K.graded_line(t).alias("g"), K.page_number(t).alias("page")).select("p_partkey", "g.label", "g.body", "page")
