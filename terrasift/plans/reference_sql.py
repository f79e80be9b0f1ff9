"""SQL of the queries in ``reference`` on the same tables."""

from __future__ import annotations

_FAC = "(SELECT DISTINCT facility_id, factor, item, category, name, administrative_district, address, phone, longitude, latitude, twd97_x, twd97_y, match_basis, needs_manual_check, school_year, in_value_section, distance_m, source_key FROM facilities)"
_CUT_DOWN = "1 + CAST({v} < {a} AS INT) + CAST({v} < {b} AS INT) + CAST({v} < {c} AS INT) + CAST({v} < {d} AS INT)"
_CUT_UP = "1 + CAST({v} >= {a} AS INT) + CAST({v} >= {b} AS INT) + CAST({v} >= {c} AS INT) + CAST({v} >= {d} AS INT)"


def _cut(v: str, edges: tuple, down: bool) -> str:
    return (_CUT_DOWN if down else _CUT_UP).format(v=v, **dict(zip("abcd", edges)))


_TEXT_JSON = "CASE WHEN json_type({x}) = 'VARCHAR' AND json_valid({x} ->> '$') THEN CAST({x} ->> '$' AS JSON) ELSE {x} END"
_RULES = f"""
rs AS (SELECT id AS ruleset_id, {_TEXT_JSON.format(x="CAST(body AS JSON)")} AS b FROM rulesets),
rl AS (SELECT ruleset_id, CAST(u.key AS INT) AS rule_ix, u.value AS rule FROM rs, json_each(b, '$.rules') u),
bs AS (SELECT ruleset_id, rule_ix, {_TEXT_JSON.format(x="(rule -> '$.bands')")} AS bands, rule -> '$.matrix' AS matrix FROM rl),
bd AS (SELECT ruleset_id, rule_ix, CAST(u.key AS INT) AS band_ix, u.value ->> '$.label' AS label, CAST(coalesce(u.value ->> '$.low', '0') AS DECIMAL(20,6)) AS lo,
              CAST(u.value ->> '$.high' AS DECIMAL(20,6)) AS hi, u.value -> '$.values' AS vals FROM bs, json_each(bands) u),
cl AS (SELECT ruleset_id, rule_ix, CAST(r.key AS INT) + 1 AS subject_ix, CAST(c.key AS INT) + 1 AS comparable_ix, CAST(c.value ->> '$' AS DECIMAL(9,4)) AS rate
       FROM bs, json_each(matrix) r, json_each(r.value) c)"""
_CASES = f"""
cs AS (SELECT DISTINCT id, {_TEXT_JSON.format(x="CAST(body AS JSON)")} AS b FROM cases WHERE json_valid(body)),
hd AS (SELECT DISTINCT id, nullif(b ->> '$.ruleset_id', '') AS ruleset_id, nullif(b ->> '$.locality', '') AS locality, nullif(b ->> '$.land_use', '') AS land_use, nullif(b ->> '$.valuation_date', '') AS vd FROM cs)"""
_DAY = "CASE WHEN regexp_matches({v}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN TRY_CAST({v} AS DATE) WHEN regexp_matches({v}, '^[0-9]{{7}}$') THEN TRY_CAST(CAST(CAST({v}[1:3] AS INT) + 1911 AS VARCHAR) || '-' || {v}[4:5] || '-' || {v}[6:7] AS DATE) END"
_PAGES = "pg AS (SELECT DISTINCT document_id, p.page AS page, p.text AS text, p.lines AS lines FROM (SELECT id AS document_id, unnest(pages) AS p FROM source_documents))"
_LINES = f"""{_PAGES},
ln AS (SELECT document_id, page, ix - 1 AS ix, l.text AS text, l.confidence AS confidence, l.bbox[1] AS x1, l.bbox[2] AS y1, l.bbox[3] AS x2, l.bbox[4] AS y2
       FROM (SELECT document_id, page, unnest(lines) AS l, generate_subscripts(lines, 1) AS ix FROM pg))"""
_MISSING = "({v} IS NULL OR regexp_replace({v}, '^[\\s\\x{{3000}}]+|[\\s\\x{{3000}}]+$', '', 'g') IN ('', '-', '—'))"
_TOKENS = "flatten([CASE WHEN regexp_matches(r, '^[\\x{{3400}}-\\x{{9fff}}]') THEN [r[i:i+1] for i in generate_series(1, greatest(length(r) - 1, 1))] ELSE [r] END for r in regexp_extract_all(lower({t}), '[\\x{{3400}}-\\x{{9fff}}]+|[a-z0-9]+')])"


def _bm25(pieces: str, keys: str) -> str:
    out = keys.replace("start", "CAST(start AS INT) AS start")
    return f"""
q AS (SELECT doc_id AS query_id, text AS question FROM documents WHERE doc_id % 20 = 0),
qt AS (SELECT DISTINCT query_id, unnest({_TOKENS.format(t='question')}) AS term FROM q),
ch AS ({pieces}),
tk AS (SELECT {keys}, {_TOKENS.format(t='chunk')} AS toks FROM ch),
tl AS (SELECT {keys}, toks, len(toks) AS dl FROM tk WHERE len(toks) > 0),
st AS (SELECT count(*) AS n, avg(dl) AS a FROM tl),
tf AS (SELECT {keys}, dl, term, count(*) AS tf FROM (SELECT {keys}, dl, unnest(toks) AS term FROM tl) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
sc AS (SELECT query_id, {keys}, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 6) AS score
       FROM tf JOIN df USING (term) JOIN qt USING (term), st GROUP BY query_id, {keys}),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {keys}) AS rank FROM sc WHERE score > 0)
SELECT query_id, {out}, score, CAST(rank AS INT) AS rank FROM rk WHERE rank <= 20"""


def _chunks(source: str, keys: str) -> str:
    return f"SELECT {keys}, s AS start, substr(text, s + 1, 800) AS chunk FROM (SELECT {keys}, text, unnest(generate_series(0, length(text) - 1, 680)) AS s FROM {source} WHERE length(text) > 0)"


def _band(rule: str, rows: list) -> str:
    num = lambda v: "NULL" if v is None else str(v)
    return ", ".join(f"('{r}', {g}, {num(lo)}, {li}, {num(hi)}, {hi_i})" for r, g, lo, li, hi, hi_i in rows)


_HIT = "(lo IS NULL OR v > lo OR (v = lo AND li)) AND (hi IS NULL OR v < hi OR (v = hi AND hi_i))"
_REASON = "CASE WHEN v IS NULL THEN 'no_value' WHEN g = 0 THEN 'no_band' WHEN g > 1 THEN 'several_bands' END"
_QTY = [("q", g, lo, True, hi, False) for g, lo, hi in ((1, 0, 10), (2, 10, 20), (3, 20, 30), (4, 30, 40), (5, 40, None))]
_EDGE = [("cc", 1, 1, True, 20, True), ("cc", 2, 20, True, 50, True), ("co", 1, 1, True, 20, False), ("co", 2, 20, True, 50, True), ("oo", 1, None, True, 20, False), ("oo", 2, 20, False, None, True)]

# inverse transverse Mercator series, step by step
_GRID = """
g0 AS (SELECT facility_id, longitude, latitude, twd97_x AS x, twd97_y AS y, 1 / 298.257222101 AS f, 6378137.0::DOUBLE AS a FROM {source}),
g1 AS (SELECT *, 2 * f - f * f AS e2 FROM g0),
g2 AS (SELECT *, e2 / (1 - e2) AS ep, (1 - sqrt(1 - e2)) / (1 + sqrt(1 - e2)) AS n, y / (a * 0.9999 * (1 - e2 / 4 - 3 * e2 ** 2 / 64 - 5 * e2 ** 3 / 256)) AS mu FROM g1),
g3 AS (SELECT *, mu + (1.5 * n - 27.0::DOUBLE / 32 * n ** 3) * sin(2 * mu) + (21.0::DOUBLE / 16 * n ** 2 - 55.0::DOUBLE / 32 * n ** 4) * sin(4 * mu) + 151.0::DOUBLE / 96 * n ** 3 * sin(6 * mu) + 1097.0::DOUBLE / 512 * n ** 4 * sin(8 * mu) AS p FROM g2),
g4 AS (SELECT *, ep * cos(p) ** 2 AS c1, tan(p) ** 2 AS t1, a / sqrt(1 - e2 * sin(p) ** 2) AS n1, a * (1 - e2) / (1 - e2 * sin(p) ** 2) ** 1.5 AS r1 FROM g3),
g5 AS (SELECT *, (x - 250000) / (n1 * 0.9999) AS d FROM g4),
g6 AS (SELECT facility_id, longitude, latitude, x, y,
  degrees(p - n1 * tan(p) / r1 * (d ** 2 / 2 - (5 + 3 * t1 + 10 * c1 - 4 * c1 ** 2 - 9 * ep) * d ** 4 / 24 + (61 + 90 * t1 + 298 * c1 + 45 * t1 ** 2 - 252 * ep - 3 * c1 ** 2) * d ** 6 / 720)) AS glat,
  121 + degrees((d - (1 + 2 * t1 + c1) * d ** 3 / 6 + (5 - 2 * c1 + 28 * t1 - 3 * c1 ** 2 + 8 * ep + 24 * t1 ** 2) * d ** 5 / 120) / cos(p)) AS glon FROM g5)"""
_OK = "({lon} BETWEEN 119.0 AND 122.5 AND {lat} BETWEEN 21.5 AND 26.5)"
_RANK = "list_sort(list({v}))[CAST(round_even({q} * (count({v}) - 1), 0) AS INT) + 1]"
_BOX = f"""
fb AS (SELECT DISTINCT facility_id, administrative_district, match_basis, longitude, latitude FROM facilities WHERE administrative_district IS NOT NULL),
bx AS (SELECT administrative_district, {_RANK.format(v='longitude', q='0.02')} - 0.015 AS min_lon, {_RANK.format(v='longitude', q='0.98')} + 0.015 AS max_lon,
              {_RANK.format(v='latitude', q='0.02')} - 0.015 AS min_lat, {_RANK.format(v='latitude', q='0.98')} + 0.015 AS max_lat, count(*) AS n_points
       FROM fb WHERE match_basis <> 'name_keyword' AND {_OK.format(lon='longitude', lat='latitude')} GROUP BY 1 HAVING count(*) >= 4)"""
_REV = """
rv AS (SELECT id, case_id, at_utc, TRY_CAST(s ->> '$.revision' AS BIGINT) AS revision, nullif(s ->> '$.locality', '') AS locality, nullif(s ->> '$.land_use', '') AS land_use, nullif(s ->> '$.ruleset_id', '') AS ruleset_id
  FROM (SELECT id, case_id, at_utc, CASE WHEN json_type(snapshot) = 'VARCHAR' THEN CAST(snapshot AS JSON) ->> '$' ELSE snapshot END AS s FROM (SELECT DISTINCT id, case_id, at_utc, snapshot FROM audit) WHERE json_valid(snapshot))
  WHERE json_valid(s) AND case_id IS NOT NULL)"""
_HTML = "replace(replace(replace(replace(replace({t}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"
_FIRST = "CASE WHEN trim({c}) NOT IN ('', '-', 'NIL', '無') THEN trim({c}) END"

def _layout() -> str:
    """Boxes one after the other: first their rows, then the columns of each row's text."""
    from terrasift.operators.layout import _wide_class

    wide = f"(2 * length(text) - length(regexp_replace(text, '{_wide_class()}', '', 'g')))"
    return f"""WITH RECURSIVE pg AS (SELECT DISTINCT id AS document_id, p.page AS page, p.lines AS lines, p.width AS width FROM (SELECT id, unnest(pages) AS p FROM source_documents)),
b AS (SELECT document_id, page, ix, l.text AS text, l.bbox[1] AS x1, l.bbox[3] AS x2, (l.bbox[2] + l.bbox[4]) / 2 AS mid, l.bbox[4] - l.bbox[2] AS tall FROM (SELECT document_id, page, unnest(lines) AS l, generate_subscripts(lines, 1) AS ix FROM pg)
      WHERE l.text IS NOT NULL AND len(l.bbox) = 4),
o AS (SELECT *, {wide} AS wide, row_number() OVER (PARTITION BY document_id, page ORDER BY mid, x1, ix) AS n FROM b),
u AS (SELECT document_id, page, greatest(3, median((x2 - x1) / greatest(1, wide))) AS unit FROM o GROUP BY 1, 2),
w AS (
  SELECT document_id, page, n, [struct_pack(mid := mid, tall := tall, r := 0)] AS near, 0 AS r, 1 AS rows FROM o WHERE n = 1
  UNION ALL
  SELECT document_id, page, n, CASE WHEN hit IS NULL THEN list_prepend(struct_pack(mid := mid, tall := tall, r := rows), near)[1:3] ELSE near END, coalesce(hit, rows), rows + CAST(hit IS NULL AS INT)
  FROM (SELECT o.*, w.near, w.rows, list_filter(w.near, lambda z: abs(z.mid - o.mid) <= 0.45 * least(z.tall, o.tall))[1].r AS hit FROM w JOIN o ON o.document_id = w.document_id AND o.page = w.page AND o.n = w.n + 1)
),
c AS (SELECT document_id, page, r, text, wide, least(500, CAST(round_even(x1 / unit, 0) AS INT)) AS col, row_number() OVER (PARTITION BY document_id, page, r ORDER BY x1, ix) AS k FROM o JOIN w USING (document_id, page, n) JOIN u USING (document_id, page)),
t AS (
  SELECT document_id, page, r, k, repeat(' ', col) || text AS line, greatest(col, 2) + wide AS stop FROM c WHERE k = 1
  UNION ALL
  SELECT c.document_id, c.page, c.r, c.k, line || repeat(' ', greatest(CASE WHEN line = '' THEN 0 ELSE 2 END, col - stop)) || text, greatest(col, stop + 2) + wide
  FROM t JOIN c ON c.document_id = t.document_id AND c.page = t.page AND c.r = t.r AND c.k = t.k + 1
),
d AS (SELECT document_id, page, r, regexp_replace(arg_max(line, k), '\\s+$', '') AS line FROM t GROUP BY 1, 2, 3),
g AS (SELECT document_id, page, count(*) AS rows, string_agg(line, chr(10) ORDER BY r) AS text FROM d GROUP BY 1, 2)
SELECT document_id, page, CAST(coalesce(rows, 0) AS INT) AS rows, coalesce(text, '') AS text FROM (SELECT document_id, page FROM pg) LEFT JOIN g USING (document_id, page)"""


SQL = {
    "band_quantity": f"""WITH b AS (SELECT * FROM (VALUES {_band('q', _QTY)}) t(rule, grade, lo, li, hi, hi_i)),
      m AS (SELECT rn, v, count(DISTINCT grade) FILTER (WHERE {_HIT}) AS g, min(grade) FILTER (WHERE {_HIT}) AS grade FROM (SELECT row_number() OVER () AS rn, CAST(l_quantity AS DECIMAL(20,6)) AS v FROM lineitem), b GROUP BY ALL)
      SELECT CASE WHEN g = 1 THEN grade END AS grade, {_REASON} AS reason, count(*) AS n, CAST(sum(v) AS DOUBLE) AS total FROM m GROUP BY ALL""",
    "band_edges": f"""WITH b AS (SELECT * FROM (VALUES {_band('e', _EDGE)}) t(rule, grade, lo, li, hi, hi_i)),
      m AS (SELECT p_partkey, rule, v, count(DISTINCT grade) FILTER (WHERE {_HIT}) AS g, min(grade) FILTER (WHERE {_HIT}) AS grade FROM (SELECT p_partkey, p_size AS v FROM part), b GROUP BY ALL)
      SELECT p_partkey, rule, CASE WHEN g = 1 THEN grade END AS grade, {_REASON} AS reason FROM m""",
    "cut_points": f"SELECT {_cut('o_totalprice', (400000, 300000, 200000, 100000), True)} AS higher, {_cut('o_totalprice', (100000, 200000, 300000, 400000), False)} AS lower, count(*) AS n FROM orders GROUP BY ALL",
    "category_grade": "SELECT o_orderpriority AS value, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '5-LOW' THEN 3 END AS grade, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS closed FROM orders GROUP BY ALL",
    "distinct_count_grade": f"SELECT {_cut('n', (4, 3, 2, 1), True)} AS grade, count(*) AS orders FROM (SELECT l_orderkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1) GROUP BY ALL",
    "facility_grade": f"""SELECT factor, CASE WHEN name IS NULL THEN 5 WHEN coalesce(in_value_section, false) THEN 1 ELSE {_cut('distance_m', (500, 1000, 1500, 2000), False)} END AS near,
      CASE WHEN name IS NULL THEN 1 WHEN coalesce(in_value_section, false) THEN 5 ELSE {_cut('distance_m', (2000, 1500, 1000, 500), True)} END AS far, count(*) AS n FROM {_FAC} GROUP BY ALL""",
    "matrix_rates": f"""WITH g AS (SELECT p_partkey, p_brand, {_cut('p_size', (40, 30, 20, 10), True)} AS ix FROM part), f AS (SELECT p_brand, arg_min(ix, p_partkey) AS c FROM g GROUP BY 1)
      SELECT p_brand, CAST(sum((c - ix) * 2.5) AS DOUBLE) AS rate, count(*) AS rate_n, CAST(sum((ix - c) * 2.5) AS DOUBLE) AS turned, count(*) AS turned_n FROM g JOIN f USING (p_brand) GROUP BY 1""",
    "rule_band_adjacency": f"""WITH {_RULES}, n AS (SELECT *, row_number() OVER w AS rn, lag(hi) OVER w AS p_hi FROM (SELECT * REPLACE (CASE WHEN band_ix = 0 THEN hi + (rule_ix % 3 - 1) ELSE hi END AS hi) FROM bd) WINDOW w AS (PARTITION BY ruleset_id, rule_ix ORDER BY lo NULLS FIRST, hi NULLS LAST))
      SELECT ruleset_id, rule_ix, CAST(lo AS DOUBLE) AS at, CASE WHEN p_hi IS NULL OR p_hi > lo THEN 'overlap' ELSE 'gap' END AS code FROM n WHERE rn > 1 AND (p_hi IS NULL OR p_hi <> lo)""",
    "rule_band_contiguity": f"WITH {_RULES} SELECT ruleset_id, rule_ix, min(band_ix) = 0 AND max(band_ix) + 1 = count(*) AND count(DISTINCT band_ix) = count(*) AS ok, count(*) AS n_bands, count(DISTINCT label) AS n_labels FROM bd GROUP BY ALL",
    "rule_alias_conflicts": f"WITH {_RULES} SELECT ruleset_id, rule_ix, v.value ->> '$' AS value, count(*) AS n FROM bd, json_each(vals) v WHERE json_type(vals) = 'ARRAY' AND json_type(v.value) <> 'NULL' GROUP BY ALL HAVING count(*) > 1",
    "rule_matrix_faults": f"""WITH {_RULES}, sz AS (SELECT ruleset_id, rule_ix, count(*) AS size FROM bd GROUP BY ALL),
      m AS (SELECT ruleset_id, rule_ix, count(rate) AS n, max(greatest(subject_ix, comparable_ix)) AS top, max(abs(rate)) FILTER (WHERE subject_ix = comparable_ix) AS dg, max(abs(rate)) AS lg FROM cl GROUP BY ALL),
      od AS (SELECT DISTINCT a.ruleset_id, a.rule_ix FROM cl a JOIN cl b ON a.ruleset_id = b.ruleset_id AND a.rule_ix = b.rule_ix AND a.subject_ix = b.comparable_ix AND a.comparable_ix = b.subject_ix WHERE a.rate <> -b.rate)
      SELECT ruleset_id, rule_ix, 'shape' AS code FROM sz LEFT JOIN m USING (ruleset_id, rule_ix) WHERE coalesce(n <> size * size OR top <> size, true)
      UNION ALL SELECT ruleset_id, rule_ix, 'diagonal' FROM sz JOIN m USING (ruleset_id, rule_ix) WHERE dg <> 0
      UNION ALL SELECT ruleset_id, rule_ix, 'magnitude' FROM sz JOIN m USING (ruleset_id, rule_ix) WHERE lg > 5
      UNION ALL SELECT ruleset_id, rule_ix, 'antisymmetry' FROM sz JOIN od USING (ruleset_id, rule_ix)""",
    "factors_missing_unknown": f"""WITH {_RULES}, {_CASES}, fx AS (SELECT id, b ->> '$.ruleset_id' AS ruleset_id, {_TEXT_JSON.format(x="(b -> '$.factors')")} AS fs FROM cs),
      fc AS (SELECT DISTINCT id, ruleset_id, fid AS rule_id FROM (SELECT fx.id, fx.ruleset_id, u.value ->> '$.id' AS fid FROM fx, json_each(fs) u WHERE json_type(fs) = 'ARRAY' UNION ALL SELECT id, ruleset_id, fs ->> '$.id' FROM fx WHERE json_type(fs) = 'OBJECT') WHERE fid IS NOT NULL AND ruleset_id IS NOT NULL),
      ri AS (SELECT DISTINCT ruleset_id, rule ->> '$.id' AS rule_id FROM rl WHERE rule ->> '$.id' IS NOT NULL), ca AS (SELECT DISTINCT id, ruleset_id FROM fc),
      mi AS (SELECT ca.ruleset_id, count(*) AS missing FROM ca JOIN ri USING (ruleset_id) WHERE NOT EXISTS (SELECT 1 FROM fc WHERE fc.id = ca.id AND fc.ruleset_id = ca.ruleset_id AND fc.rule_id = ri.rule_id) GROUP BY 1),
      un AS (SELECT fc.ruleset_id, count(*) AS unknown FROM fc WHERE NOT EXISTS (SELECT 1 FROM ri WHERE ri.ruleset_id = fc.ruleset_id AND ri.rule_id = fc.rule_id) GROUP BY 1)
      SELECT ruleset_id, coalesce(missing, 0) AS missing, coalesce(unknown, 0) AS unknown FROM (SELECT DISTINCT ruleset_id FROM ca) LEFT JOIN mi USING (ruleset_id) LEFT JOIN un USING (ruleset_id)""",
    "strict_sums": """SELECT l_orderkey, CAST(CASE WHEN count(*) = count(v) THEN sum(v) END AS DOUBLE) AS strict, CAST(sum(v) AS DOUBLE) AS loose, CAST(sum(abs(v - 1000)) AS DOUBLE) AS spread
      FROM (SELECT l_orderkey, CASE WHEN l_quantity < 50 THEN CAST(l_extendedprice AS DECIMAL(18,2)) END AS v FROM lineitem) GROUP BY 1""",
    "status_counts": "SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'A') AS n_a, count(*) FILTER (WHERE l_returnflag = 'N') AS n_n, count(*) FILTER (WHERE l_returnflag = 'R') AS n_r, count(*) FILTER (WHERE l_returnflag = 'X') AS n_x, count(*) FILTER (WHERE l_returnflag IN ('R', 'X')) = 0 AS complete FROM lineitem GROUP BY 1",
    "dashboard": "SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS done, count(*) FILTER (WHERE o_orderstatus IN ('O', 'P')) AS pending, count(DISTINCT o_custkey) AS customers FROM orders",
    "nearest_ranks": f"SELECT l_returnflag, l_linestatus, {_RANK.format(v='l_extendedprice', q='0.02')} AS low, {_RANK.format(v='l_extendedprice', q='0.98')} AS high FROM lineitem GROUP BY 1, 2",
    "longest_titles": "SELECT p_brand, arg_max(p_name, row(length(p_name), -p_partkey)) AS title FROM part GROUP BY 1",
    "set_operations": """WITH c AS (SELECT c_nationkey, list_sort(list(DISTINCT c_mktsegment)) AS s, ['BUILDING', 'MACHINERY', 'SPACE'] AS w FROM customer GROUP BY 1)
      SELECT c_nationkey, array_to_string([x for x in s if list_contains(w, x)], ',') AS common, array_to_string([x for x in s if NOT list_contains(w, x)], ',') AS extra, len([x for x in w if NOT list_contains(s, x)]) = 0 AS covered FROM c""",
    "parsed_numbers": f"""WITH d AS (SELECT DISTINCT draft_id, subject, comparable FROM pdf_drafts), b AS (SELECT draft_id, 'subject' AS side, subject AS v FROM d UNION ALL SELECT draft_id, 'comparable', comparable FROM d)
      SELECT draft_id, side, CAST(TRY_CAST(regexp_replace(regexp_replace(trim(replace(v, ',', '')), '%$', ''), '％$', '') AS DECIMAL(20,6)) AS DOUBLE) AS number, {_MISSING.format(v='v')} AS missing FROM b""",
    "rounded_prices": "SELECT l_orderkey, CAST(sum(round(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 + CAST(l_tax AS DECIMAL(9,4))), 0)) AS DOUBLE) AS total FROM lineitem GROUP BY 1",
    "roc_dates": """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN lpad(CAST(year(o_orderdate) - 1911 AS VARCHAR), 3, '0') || strftime(o_orderdate, '%m%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y/%m/%d') END AS written,
      CASE WHEN o_orderkey % 3 < 2 THEN CAST(o_orderdate AS DATE) END AS day FROM orders""",
    "written_intervals": """SELECT p_partkey, CAST(lo AS DOUBLE) AS lo, lo_incl, CAST(hi AS DOUBLE) AS hi, hi_incl FROM (
      SELECT p_partkey, p_size AS lo, true AS lo_incl, p_size + 10 AS hi, false AS hi_incl FROM part WHERE p_partkey % 5 = 0 UNION ALL SELECT p_partkey, NULL, true, p_size, false FROM part WHERE p_partkey % 5 = 1
      UNION ALL SELECT p_partkey, p_size, true, NULL, false FROM part WHERE p_partkey % 5 = 2 UNION ALL SELECT p_partkey, NULL, true, p_size, true FROM part WHERE p_partkey % 5 = 3
      UNION ALL SELECT p_partkey, p_size + 10, true, NULL, false FROM part WHERE p_partkey % 5 = 3 UNION ALL SELECT p_partkey, NULL, NULL, NULL, NULL FROM part WHERE p_partkey % 5 = 4)""",
    "counting_words": "SELECT (['無', '一', '兩', '十', '12', '多'])[p_partkey % 6 + 1] AS word, ([0, 1, 2, 10, 12, NULL])[p_partkey % 6 + 1] AS number, count(*) AS n FROM part GROUP BY ALL",
    "words_in_order": "SELECT p_partkey, array_to_string(regexp_extract_all(p_type, 'STANDARD|ANODIZED|ECONOMY|BRUSHED|STEEL|STEE|TIN'), '>') AS words FROM part",
    "compact_names": f"SELECT facility_id, regexp_replace(concat_ws('、', factor, item, name), '[\\s、，,（）()／/]', '', 'g') AS name FROM {_FAC}",
    "first_values": f"SELECT facility_id, coalesce({_FIRST.format(c='phone')}, {_FIRST.format(c='category')}, {_FIRST.format(c='name')}) AS value, coalesce(TRY_CAST(category AS DOUBLE), twd97_x, longitude) AS number FROM {_FAC}",
    "list_parts": f"SELECT part, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(concat_ws('、', factor, item, administrative_district), '[、,，/／|｜;；\\s]+')) AS part FROM {_FAC}) WHERE part <> '' GROUP BY 1",
    "documents_in_scope": f"""WITH {_CASES}, q AS (SELECT *, {_DAY.format(v='vd')} AS day FROM hd), e AS (SELECT DISTINCT * FROM evidence_documents)
      SELECT q.id AS case_id, e.document_id, q.day AS valuation_date FROM q JOIN e USING (ruleset_id, locality, land_use) WHERE valid_from <= day AND (valid_to IS NULL OR day <= valid_to)""",
    "evidence_listing": "SELECT e.document_id, d.name, d.n_pages, e.ruleset_id FROM (SELECT DISTINCT * FROM evidence_documents) e JOIN (SELECT DISTINCT id, name, CAST(len(pages) AS INT) AS n_pages FROM source_documents) d ON e.document_id = d.id",
    "chunk_windows": f"SELECT doc_id, count(*) AS chunks, CAST(sum(length(chunk)) AS BIGINT) AS chars, CAST(max(start + length(chunk)) AS INT) AS stop FROM ({_chunks('documents', 'doc_id')}) GROUP BY 1",
    "term_counts": f"""SELECT term, CAST(sum(tf) AS BIGINT) AS tf, count(*) AS df FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOKENS.format(t='text')}) AS term FROM documents) GROUP BY 1, 2) GROUP BY 1""",
    "bm25_mails": f"WITH {_bm25(_chunks('documents', 'doc_id'), 'doc_id, start')}",
    "bm25_pages": f"WITH {_PAGES}, pp AS (SELECT DISTINCT document_id, page, text FROM pg), {_bm25(_chunks('pp', 'document_id, page'), 'document_id, page, start')}",
    "citation_ids": f"""WITH {_PAGES}, pp AS (SELECT DISTINCT document_id, page, text FROM pg), ch AS ({_chunks('pp', 'document_id, page')})
      SELECT document_id, page, CAST(start AS INT) AS start, sha256(document_id || ':' || sha256 || ':' || page || ':' || start || ':' || (start + length(chunk))) AS citation FROM ch JOIN (SELECT DISTINCT document_id, sha256 FROM evidence_documents) e USING (document_id)""",
    "page_slices": """WITH s AS (SELECT doc_id, o AS "offset", substr(text, o + 1, 2000) AS q, length(text) AS n FROM (SELECT doc_id, text, CAST(unnest(range(0, greatest(length(text), 1), 2000)) AS INT) AS o FROM documents WHERE text IS NOT NULL))
      SELECT doc_id, "offset", md5(q) AS digest, CAST(CASE WHEN "offset" + length(q) < n THEN "offset" + length(q) END AS INT) AS next_start FROM s""",
    "conflicts_dropped": """SELECT arg_max(draft_id, draft_id) AS draft_id, document_id, factor_id, arg_max(subject, draft_id) FILTER (WHERE subject IS NOT NULL) AS subject, arg_max(comparable, draft_id) FILTER (WHERE comparable IS NOT NULL) AS comparable
      FROM (SELECT DISTINCT draft_id, document_id, factor_id, subject, comparable FROM pdf_drafts) GROUP BY document_id, factor_id HAVING count(DISTINCT row(subject, comparable)) = 1""",
    "only_choices": "SELECT document_id, min(evidence.method) AS method FROM pdf_drafts WHERE evidence.method IS NOT NULL GROUP BY 1 HAVING min(evidence.method) = max(evidence.method)",
    "blank_patches": f"""WITH d AS (SELECT DISTINCT draft_id, document_id, factor_id, subject, comparable FROM pdf_drafts),
      f AS (SELECT document_id, factor_id, subject FROM d QUALIFY row_number() OVER (PARTITION BY document_id, factor_id ORDER BY draft_id) = 1),
      o AS (SELECT document_id, factor_id, comparable, draft_id FROM d WHERE NOT {_MISSING.format(v='comparable')} QUALIFY row_number() OVER (PARTITION BY document_id, factor_id ORDER BY draft_id, comparable) = 1)
      SELECT o.document_id, o.factor_id, o.comparable AS value, o.draft_id AS priority FROM o JOIN f USING (document_id, factor_id) WHERE {_MISSING.format(v='f.subject')}""",
    "page_fields": f"""WITH {_PAGES}, pp AS (SELECT DISTINCT document_id, page, text FROM pg)
      SELECT document_id, page, field, nullif(regexp_extract(text, pattern, 1), '') AS value FROM pp, (VALUES ('base_day', '估價基準日 ([0-9]{{7}})'), ('coverage', '建蔽率 ([0-9]+)%'), ('floor_area', '容積率 ([0-9]+)%'), ('file', '收文字號 ([0-9]+)')) t(field, pattern)
      WHERE nullif(regexp_extract(text, pattern, 1), '') IS NOT NULL""",
    "quoted_lines": f"WITH {_PAGES}, pp AS (SELECT DISTINCT document_id, page, regexp_split_to_array(text, '\\r\\n|\\n|\\r') AS l FROM pg) SELECT document_id, page, l[2] || chr(10) || l[3] AS lines FROM pp WHERE len(l) >= 3",
    "district_match": f"""WITH f AS (SELECT *, CASE WHEN facility_id % 3 <> 0 THEN regexp_replace(administrative_district, '^..市', '') END AS declared FROM {_FAC}),
      p AS (SELECT facility_id, address, name, [x for x in regexp_split_to_array(coalesce(declared, ''), '[、,，/／|｜;；\\s]+') if x <> ''] AS parts FROM f),
      ds AS (SELECT list(DISTINCT name_zh[1:length(name_zh)-1]) AS bare FROM place_names WHERE kind = 'district')
      SELECT facility_id, CASE WHEN len([x for x in parts if x = '霧澤' OR regexp_matches(x, '^霧澤[區市鎮鄉]')]) > 0 THEN 'district_field'
        WHEN len([x for x in parts if list_contains(bare, x) OR (list_contains(bare, x[1:2]) AND regexp_matches(x[3:3], '[區市鎮鄉]'))]) > 0 THEN NULL
        WHEN regexp_matches(address, '霧澤[區市鎮鄉]') THEN 'address' WHEN contains(name, '霧澤') THEN 'name_keyword' END AS match_basis FROM p, ds""",
    "page_layout": _layout(),
    "districts_matched": f"""WITH f AS (SELECT *, CASE WHEN facility_id % 3 <> 0 THEN regexp_replace(administrative_district, '^..市', '') END AS declared FROM {_FAC}),
      p AS (SELECT facility_id, address, name, [x for x in regexp_split_to_array(coalesce(declared, ''), '[、,，/／|｜;；\\s]+') if x <> ''] AS parts FROM f),
      d AS (SELECT DISTINCT name_zh AS district, name_zh[1:length(name_zh)-1] AS bare FROM place_names WHERE kind = 'district'),
      c AS (SELECT facility_id, district, bare, address, name, len([x for x in parts if x = bare OR (starts_with(x, bare) AND regexp_matches(x[length(bare)+1:length(bare)+1], '[區市鎮鄉]'))]) > 0 AS mine FROM p, d),
      o AS (SELECT *, bool_or(mine) OVER (PARTITION BY facility_id) AS declared FROM c)
      SELECT facility_id, district, CASE WHEN mine THEN 'district_field' WHEN regexp_matches(address, bare || '[區市鎮鄉]') THEN 'address' ELSE 'name_keyword' END AS match_basis
      FROM o WHERE mine OR (NOT declared AND (coalesce(regexp_matches(address, bare || '[區市鎮鄉]'), false) OR coalesce(contains(name, bare), false)))""",
    "coordinates_normalised": f"""WITH {_GRID.format(source=f"(SELECT facility_id, CASE WHEN facility_id % 3 <> 0 THEN longitude END AS longitude, latitude, twd97_x, twd97_y FROM {_FAC})")}
      SELECT facility_id, round(CASE WHEN {_OK.format(lon='longitude', lat='latitude')} THEN longitude WHEN {_OK.format(lon='glon', lat='glat')} THEN glon END, 6) AS lon,
        round(CASE WHEN {_OK.format(lon='longitude', lat='latitude')} THEN latitude WHEN {_OK.format(lon='glon', lat='glat')} THEN glat END, 6) AS lat,
        CASE WHEN {_OK.format(lon='longitude', lat='latitude')} THEN 'dataset_wgs84' WHEN {_OK.format(lon='glon', lat='glat')} THEN 'twd97_converted' END AS source FROM g6""",
    "grid_errors": f"""WITH {_GRID.format(source=f"(SELECT * FROM {_FAC} WHERE {_OK.format(lon='longitude', lat='latitude')} AND twd97_x IS NOT NULL AND twd97_y IS NOT NULL)")}
      SELECT facility_id, round(2 * 6371008.8 * asin(least(1.0, sqrt(sin((radians(glat) - radians(latitude)) / 2) ** 2 + cos(radians(latitude)) * cos(radians(glat)) * sin(radians(glon - longitude) / 2) ** 2))), 1) AS error_m,
        round(sqrt((300000 - x) ** 2 + (2770000 - y) ** 2), 3) AS planar_m FROM g6""",
    "reference_boxes": f"WITH {_BOX} SELECT administrative_district, round(min_lon, 9) AS min_lon, round(max_lon, 9) AS max_lon, round(min_lat, 9) AS min_lat, round(max_lat, 9) AS max_lat, n_points FROM bx",
    "loose_verdicts": f"""WITH {_BOX} SELECT facility_id, CASE WHEN NOT coalesce({_OK.format(lon='longitude', lat='latitude')}, false) OR min_lon IS NULL THEN 'unverified'
      WHEN longitude BETWEEN min_lon AND max_lon AND latitude BETWEEN min_lat AND max_lat THEN 'kept' ELSE 'rejected' END AS verdict FROM fb LEFT JOIN bx USING (administrative_district) WHERE match_basis = 'name_keyword'""",
    "slot_report": f"""WITH f AS (SELECT * FROM {_FAC}), r AS (SELECT factor, item, count(*) AS rc FROM f WHERE address IS NOT NULL AND NOT needs_manual_check GROUP BY ALL),
      so AS (SELECT factor, item, source_key, CASE WHEN max(school_year) IS NULL THEN 'skipped_heavy' WHEN count(*) > 5 THEN 'ok' ELSE 'error' END AS status FROM f GROUP BY 1, 2, 3),
      s AS (SELECT factor, item, list(DISTINCT status) AS st, count(*) AS sc FROM so GROUP BY ALL), g AS (SELECT DISTINCT factor, item, true AS gap FROM f WHERE category IS NULL)
      SELECT factor, item, coalesce(rc, 0) AS record_count, coalesce(sc, 0) AS source_count, CASE WHEN coalesce(rc, 0) > 0 THEN 'ok' WHEN st IS NULL THEN 'no_open_data_source' WHEN st = ['skipped_heavy'] THEN 'skipped_heavy'
        WHEN list_contains(st, 'error') AND NOT list_contains(st, 'ok') AND NOT list_contains(st, 'no_district_matches') THEN 'error' ELSE 'no_district_matches' END AS status,
        coalesce(rc, 0) = 0 OR gap IS NOT NULL OR coalesce(list_contains(st, 'error') OR list_contains(st, 'skipped_heavy'), false) AS survey_required
      FROM s FULL JOIN r USING (factor, item) FULL JOIN g USING (factor, item)""",
    "category_summary": f"""WITH c AS (SELECT factor, coalesce(category, '-') AS category, count(*) AS n FROM {_FAC} GROUP BY ALL)
      SELECT factor, CAST(sum(n) AS BIGINT) AS records, string_agg(category || ' ' || n, '; ' ORDER BY n DESC, category) AS summary FROM c GROUP BY 1""",
    "names_by_keyword": "SELECT place_id, name_en AS name FROM place_names WHERE contains(lower(concat_ws(' ', name_en, name_zh)), 'xing') AND contains(lower(concat_ws(' ', name_en, name_zh)), 'rd') AND ends_with(name_zh, '路')",
    "latest_state": "SELECT id, case_id, at_utc, action FROM (SELECT DISTINCT id, case_id, at_utc, action FROM audit) QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY at_utc DESC, id DESC) = 1",
    "accepted_writes": f"WITH {_REV}, w AS (SELECT case_id, revision = coalesce(lag(revision) OVER (PARTITION BY case_id ORDER BY id), 0) + 1 AS ok FROM rv) SELECT case_id, count(*) FILTER (WHERE coalesce(ok, false)) AS accepted, count(*) FILTER (WHERE NOT coalesce(ok, false)) AS rejected FROM w GROUP BY 1",
    "changed_fields": f"""WITH {_REV}, w AS (SELECT case_id, id, row_number() OVER o AS rn, locality AS n1, lag(locality) OVER o AS o1, land_use AS n2, lag(land_use) OVER o AS o2, ruleset_id AS n3, lag(ruleset_id) OVER o AS o3 FROM rv WINDOW o AS (PARTITION BY case_id ORDER BY id)),
      u AS (SELECT case_id, id, rn, 'locality' AS field, o1 AS old, n1 AS new FROM w UNION ALL SELECT case_id, id, rn, 'land_use', o2, n2 FROM w UNION ALL SELECT case_id, id, rn, 'ruleset_id', o3, n3 FROM w)
      SELECT case_id, id, field, old, new FROM u WHERE rn > 1 AND old IS DISTINCT FROM new""",
    "fifo_cache": """SELECT doc_id, received_at, n_chars FROM (SELECT doc_id, received_at, n_chars, sum(n_chars) OVER (ORDER BY CAST(received_at AS DATE) DESC, received_at DESC, doc_id) AS run
      FROM (SELECT DISTINCT doc_id, received_at, n_chars FROM documents WHERE received_at IS NOT NULL AND n_chars IS NOT NULL) WHERE n_chars <= 200000) WHERE run <= 200000""",
    "newest_drafts": "SELECT draft_id, factor_id, extracted_at FROM (SELECT DISTINCT draft_id, factor_id, extracted_at FROM pdf_drafts) QUALIFY row_number() OVER (PARTITION BY factor_id ORDER BY extracted_at DESC, draft_id) <= 3",
    "expired_events": "SELECT event_type, count(*) FILTER (WHERE epoch_us(TIMESTAMP '2024-01-15 00:00:00') - epoch_us(ts) > 900000000) AS expired, count(*) AS n FROM events GROUP BY 1",
    "spaced_calls": """WITH e AS (SELECT event_id, event_type, epoch_us(ts) AS m, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events)
      SELECT event_id, max(m - i * 1100000) OVER (PARTITION BY event_type ORDER BY i ROWS UNBOUNDED PRECEDING) + i * 1100000 - m AS wait_us FROM e""",
    "repeated_mails": "SELECT 'archive' AS source, doc_id, first_page FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_page FROM documents WHERE text IS NOT NULL) WHERE doc_id > first_page",
    "page_boxes": f"WITH {_LINES} SELECT document_id, page, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM ln GROUP BY 1, 2",
    "line_statistics": f"WITH {_LINES} SELECT document_id, count(*) AS n, CAST(sum(CAST(round(confidence * 10000) AS BIGINT)) AS BIGINT) AS confidence, round(quantile_cont((x2 - x1) / length(text), 0.5), 6) AS glyph FROM ln WHERE trim(text) <> '' GROUP BY 1",
    "cell_accuracy": f"""WITH {_LINES}, c AS (SELECT document_id, page, ix AS cell_id, text AS expected, regexp_matches(text, '[0-9]') AS num, x1 AS c1, y1 AS c2, CASE WHEN ix % 5 = 0 THEN x1 + 1 ELSE x2 END AS c3, y2 AS c4 FROM ln),
      j AS (SELECT c.document_id, c.page, cell_id, expected, num, string_agg(l.text, '' ORDER BY l.x1, l.text) AS actual FROM c LEFT JOIN ln l ON c.document_id = l.document_id AND c.page = l.page AND (l.x1 + l.x2) / 2 >= c1 AND (l.x1 + l.x2) / 2 < c3 AND (l.y1 + l.y2) / 2 >= c2 AND (l.y1 + l.y2) / 2 < c4 GROUP BY 1, 2, 3, 4, 5)
      SELECT document_id, page, count(*) AS cells, count(*) FILTER (WHERE coalesce(actual, '') = expected) AS exact, count(*) FILTER (WHERE coalesce(actual, '') = expected AND num) AS numeric_exact FROM j GROUP BY 1, 2""",
    "number_lines": "SELECT l_linenumber, count(*) FILTER (WHERE l_linenumber <> 3) AS number_rows, CAST(sum(-CAST(l_quantity AS INT)) FILTER (WHERE l_linenumber <> 3) AS DOUBLE) AS second FROM lineitem GROUP BY 1",
    "guarded_csv": """SELECT doc_id, CASE WHEN regexp_matches(ltrim(c), '^[=+\\-@\\t\\r]') THEN '''' || c ELSE c END AS cell FROM (SELECT doc_id, (['=', '', ' @', '-'])[doc_id % 4 + 1] || text AS c FROM documents WHERE text IS NOT NULL)""",
    "html_report": f"SELECT '<tr><td>' || doc_id || '</td><td>' || {_HTML.format(t="coalesce(lang, '—')")} || '</td><td>' || {_HTML.format(t="coalesce(message_id, '—')")} || '</td><td>' || {_HTML.format(t="coalesce(in_reply_to, '—')")} || '</td></tr>' AS html FROM documents",
    "filled_cells": f"""WITH {_CASES}, v AS (SELECT id, 'locality' AS field, locality AS value FROM hd UNION ALL SELECT id, 'land_use', land_use FROM hd UNION ALL SELECT id, 'valuation_date', vd FROM hd), vv AS (SELECT * FROM v WHERE value IS NOT NULL)
      SELECT r.id AS record, sheet, cell, coalesce(value, 'not provided') AS value FROM (SELECT DISTINCT id FROM vv) r CROSS JOIN (VALUES ('s1', 'B2', 'locality'), ('s1', 'B3', 'land_use'), ('s2', 'C4', 'valuation_date'), ('s2', 'C5', 'weight')) t(sheet, cell, field) LEFT JOIN vv ON vv.id = r.id AND vv.field = t.field""",
    "report_sections": """SELECT 'regions' AS section, 0 AS ord, '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}' AS row FROM region
      UNION ALL SELECT 'nations', 1, '{"n_regionkey":' || n_regionkey || ',"nations":' || count(*) || '}' FROM nation GROUP BY n_regionkey""",
    "stream_windows": "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "stream_without_repeats": "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1",
    "session_counts": "SELECT user_id, count(*) FILTER (WHERE coalesce(g >= 86400000000, true)) AS sessions, count(*) AS n FROM (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events) GROUP BY 1",
    "sources_expired": f"""WITH {_CASES}, fx AS (SELECT id, {_TEXT_JSON.format(x="(b -> '$.factors')")} AS fs, {_TEXT_JSON.format(x="(b -> '$.field_sources')")} AS ss FROM cs),
      fc AS (SELECT fx.id AS case_id, u.value AS v FROM fx, json_each(CASE WHEN json_type(fs) = 'ARRAY' THEN fs WHEN json_type(fs) = 'OBJECT' THEN json_array(fs) ELSE '[]'::JSON END) u),
      sc AS (SELECT fx.id AS case_id, CAST(u.key AS INT) AS ix, u.value AS v FROM fx, json_each(CASE WHEN json_type(ss) = 'ARRAY' THEN ss WHEN json_type(ss) = 'OBJECT' THEN json_array(ss) ELSE '[]'::JSON END) u),
      cur AS (SELECT DISTINCT case_id, v ->> '$.id' AS factor_id, 'subject' AS field, v ->> '$.subject' AS current FROM fc UNION SELECT case_id, v ->> '$.id', 'comparable', v ->> '$.comparable' FROM fc)
      SELECT DISTINCT s.case_id, s.ix, s.v ->> '$.factor_id' AS factor_id, s.v ->> '$.field' AS field, s.v ->> '$.value' AS value FROM sc s
      WHERE json_type(s.v) = 'OBJECT' AND NOT EXISTS (SELECT 1 FROM cur c WHERE s.case_id = c.case_id AND s.v ->> '$.factor_id' = c.factor_id AND s.v ->> '$.field' = c.field AND s.v ->> '$.value' = c.current)""",
    "draft_changes": """WITH d AS (SELECT DISTINCT draft_id, document_id, factor_id, subject, comparable FROM pdf_drafts),
      o AS (SELECT * FROM d WHERE draft_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY document_id, factor_id ORDER BY draft_id DESC) = 1), n AS (SELECT * FROM d WHERE draft_id % 2 = 1 QUALIFY row_number() OVER (PARTITION BY document_id, factor_id ORDER BY draft_id DESC) = 1)
      SELECT document_id, factor_id, CASE WHEN o.draft_id IS NULL THEN 'added' WHEN n.draft_id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM o FULL JOIN n USING (document_id, factor_id)
      WHERE o.draft_id IS NULL OR n.draft_id IS NULL OR o.subject IS DISTINCT FROM n.subject OR o.comparable IS DISTINCT FROM n.comparable""",
    "documents_ready": "SELECT document_id, bool_and(coalesce(evidence.quote <> '' AND entered_rate IS NOT NULL, false)) AS ready, count(*) AS n FROM (SELECT DISTINCT * FROM pdf_drafts) GROUP BY 1",
    "single_localities": f"""WITH {_PAGES}, pp AS (SELECT DISTINCT document_id, page, text FROM pg), m AS (SELECT document_id, page, list_distinct(regexp_extract_all(text, '[\\x{{4e00}}-\\x{{9fff}}]{{2}}市[\\x{{4e00}}-\\x{{9fff}}]{{2}}區')) AS f FROM pp)
      SELECT document_id, page, f[1] AS locality FROM m WHERE len(f) = 1""",
    "pages_of_rules": f"""WITH {_RULES}, {_PAGES}, c AS (SELECT DISTINCT ruleset_id, CAST(rule ->> '$.source_page' AS INT) AS page FROM rl)
      SELECT DISTINCT p.document_id, e.ruleset_id, p.page FROM pg p JOIN evidence_documents e USING (document_id) JOIN c ON c.ruleset_id = e.ruleset_id AND c.page = p.page""",
    "content_versions": "SELECT id, substr(sha256(id || chr(31) || body), 1, 16) AS version, true AS allowed FROM rulesets",
    "label_rows": """SELECT l_returnflag AS label, l_linenumber, count(*) AS n, count(*) FILTER (WHERE l_linenumber % 3 = 0) AS rates, CAST(sum(q) AS BIGINT) AS total
      FROM (SELECT DISTINCT l_returnflag, l_linenumber, CAST(l_quantity AS INT) AS q FROM lineitem WHERE l_linenumber <> 7 OR l_returnflag <> 'N') GROUP BY 1, 2""",
    "printed_blocks": f"""WITH {_RULES}, m AS (SELECT ruleset_id, rule_ix, max(subject_ix) AS size, sum(abs(rate)) AS weight, count(*) AS n, max(abs(rate)) FILTER (WHERE subject_ix = comparable_ix) AS dg FROM cl GROUP BY 1, 2)
      SELECT ruleset_id, rule_ix, CAST(size AS INT) AS size, CAST(weight AS DOUBLE) AS weight FROM m WHERE size > 1 AND n = size * size AND dg = 0""",
    "asof_events": """WITH b AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, max(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY 1, 2)
      SELECT b.event_id, b.user_id, v.view_id FROM b ASOF LEFT JOIN v ON b.user_id = v.user_id AND b.ts >= v.ts""",
    "rows_per_source": f"""WITH f AS (SELECT * FROM {_FAC})
      SELECT source_key, count(*) AS n, count(address) AS with_address, round(count(*) / (SELECT count(*) FROM f), 6) AS share FROM f GROUP BY 1""",
    "required_fields": "SELECT source_key, count(*) AS n_rows, bool_and(json_exists(raw, '$.名稱') AND json_exists(raw, '$.地址')) AS complete FROM (SELECT DISTINCT facility_id, source_key, raw FROM facilities) GROUP BY 1",
}
