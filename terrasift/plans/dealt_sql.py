"""SQL of the general data problems."""

from __future__ import annotations

_REFERENCES = """
refs AS (
  SELECT 'audit' AS child_table, 'case_id' AS ref_field, CAST(id AS VARCHAR) AS child_key, case_id AS k, at_utc AS t FROM audit
  UNION ALL SELECT 'evidence_documents', 'document_id', document_id, document_id, indexed_at FROM evidence_documents
  UNION ALL SELECT 'evidence_documents', 'ruleset_id', document_id, ruleset_id, indexed_at FROM evidence_documents
),
targets AS (
  SELECT 'case_id' AS ref_field, id AS k, min(created) AS born, CASE WHEN count(*) = count(removed_at) THEN max(removed_at) END AS gone FROM cases GROUP BY id
  UNION ALL SELECT 'document_id', id, min(received_at), CASE WHEN count(*) = count(removed_at) THEN max(removed_at) END FROM source_documents GROUP BY id
  UNION ALL SELECT 'ruleset_id', id, min(published_at), CASE WHEN count(*) = count(removed_at) THEN max(removed_at) END FROM rulesets GROUP BY id
),
judged AS (
  SELECT r.child_table, r.ref_field, r.child_key, r.t,
         CASE WHEN g.k IS NULL THEN 'missing' WHEN r.t > g.gone THEN 'deleted' WHEN r.t < g.born THEN 'late' END AS reason
  FROM refs r LEFT JOIN targets g ON r.ref_field = g.ref_field AND r.k = g.k
  WHERE r.k IS NOT NULL AND r.k <> ''
)"""

_SNAPSHOTS = """
parsed AS (
  SELECT id, case_id, at_utc,
         CASE WHEN json_valid(snapshot) THEN CASE WHEN json_type(snapshot) = 'VARCHAR' THEN CAST(snapshot AS JSON) ->> '$' ELSE snapshot END END AS s
  FROM (SELECT DISTINCT id, case_id, at_utc, snapshot FROM audit)
),
f AS (
  SELECT id, case_id, at_utc, TRY_CAST(s ->> '$.revision' AS BIGINT) AS revision,
         nullif(s ->> '$.case_number', '') AS case_number, nullif(s ->> '$.valuation_date', '') AS vd, nullif(s ->> '$.locality', '') AS locality,
         nullif(s ->> '$.land_use', '') AS land_use, nullif(s ->> '$.ruleset_id', '') AS ruleset_id, nullif(s ->> '$.document_id', '') AS document_id
  FROM parsed WHERE s IS NOT NULL AND json_valid(s) AND case_id IS NOT NULL
),
h AS (
  SELECT id, case_id, at_utc, revision,
         to_json([case_number, CASE WHEN regexp_matches(vd, '^[0-9]{7}$') THEN CAST(CAST(vd[1:3] AS INT) + 1911 AS VARCHAR) || '-' || vd[4:5] || '-' || vd[6:7] ELSE vd END, locality, land_use, ruleset_id, document_id]) AS fields
  FROM f
),
v AS (
  SELECT id, case_id, at_utc, revision, fields IS DISTINCT FROM lag(fields) OVER (PARTITION BY case_id ORDER BY at_utc, revision NULLS FIRST, id) AS opens
  FROM h
)"""

# every observation against all of its case: its nearest earlier-recorded neighbours, and what each split
_LEDGER = f"""
{_SNAPSHOTS},
o AS (SELECT h.id, h.case_id, h.at_utc, f.ruleset_id, f.document_id, row_number() OVER (PARTITION BY h.case_id ORDER BY h.at_utc, h.revision NULLS FIRST, h.id) AS p FROM h JOIN f USING (id)),
n AS (
  SELECT y.id, y.case_id, y.at_utc, y.ruleset_id, y.document_id,
         max(row(x.p, x.id)) FILTER (WHERE x.p < y.p) AS l, min(row(x.p, x.id, x.at_utc)) FILTER (WHERE x.p > y.p) AS r
  FROM o y LEFT JOIN o x ON x.case_id = y.case_id AND x.id < y.id GROUP BY ALL
),
w AS (
  SELECT case_id, id AS observation, r[3] AS valid_to, r[2] AS closed_by, id AS recorded_from FROM n
  UNION ALL SELECT case_id, l[2], at_utc, id, id FROM n WHERE l IS NOT NULL
),
led AS (
  SELECT w.case_id, w.observation, o.at_utc AS valid_from, w.valid_to, w.closed_by, w.recorded_from, lead(w.recorded_from) OVER (PARTITION BY w.case_id, w.observation ORDER BY w.recorded_from) AS recorded_to, o.ruleset_id, o.document_id
  FROM w JOIN o ON o.id = w.observation
)"""

_OPEN = "CASE WHEN json_type({x}) = 'VARCHAR' AND json_valid({x} ->> '$') THEN CAST({x} ->> '$' AS JSON) ELSE {x} END"


def _list(source: str, keep: str, child: str, expression: str, prefix: str) -> str:
    """Elements of one list below ``source``: an object stands at position 0, nulls are no case."""
    x = _OPEN.format(x=f"({expression})")
    return (
        f"SELECT {keep}, '{child}' AS child, {prefix}u.key AS child_key, u.value AS v FROM (SELECT {keep}, v AS pv, child_key AS pk, {x} AS x FROM {source}) s, json_each(CASE WHEN json_type(x) = 'ARRAY' THEN x WHEN json_type(x) = 'OBJECT' THEN json_array(x) ELSE '[]'::JSON END) u"
        " WHERE json_type(u.value) <> 'NULL'"
    )


_RULE_LIST = _list("top", "src_table, record_id", "rules", "v -> '$.rules'", "'' || ")
_CHILDREN = f"""
raw AS (SELECT DISTINCT 'cases' AS src_table, id AS record_id, body AS t FROM cases UNION SELECT 'audit', CAST(id AS VARCHAR), snapshot FROM audit UNION SELECT 'rulesets', id, body FROM rulesets),
top AS (SELECT src_table, record_id, {_OPEN.format(x='CAST(t AS JSON)')} AS v, '' AS child_key FROM raw WHERE json_valid(t)),
ru AS (SELECT src_table, record_id, child, child_key, {_OPEN.format(x='v')} AS v FROM ({_RULE_LIST})),
bd AS (SELECT src_table, record_id, child, child_key, {_OPEN.format(x='v')} AS v FROM ({_list('ru', 'src_table, record_id', 'bands', "v -> '$.bands'", "pk || '/' || ")})),
al AS (
  {_list('top', 'src_table, record_id', 'factors', "v -> '$.factors'", "'' || ")}
  UNION ALL {_list('top', 'src_table, record_id', 'field_sources', "v -> '$.field_sources'", "'' || ")}
  UNION ALL {_list('top', 'src_table, record_id', 'extraction_warnings', "v -> '$.extraction_warnings'", "'' || ")}
  UNION ALL SELECT src_table, record_id, child, child_key, v FROM ru
  UNION ALL SELECT src_table, record_id, child, child_key, v FROM bd
  UNION ALL {_list('bd', 'src_table, record_id', 'band_values', "v -> '$.values'", "pk || '/' || ")}
  UNION ALL {_list('bd', 'src_table, record_id', 'band_ranges', "v -> '$.ranges'", "pk || '/' || ")}
  UNION ALL SELECT src_table, record_id, 'total_evidence', u.key, u.value FROM (SELECT src_table, record_id, {_OPEN.format(x="(v -> '$.total_evidence')")} AS x FROM top) s, json_each(CASE WHEN json_type(x) = 'OBJECT' THEN x ELSE '{{}}'::JSON END) u WHERE json_type(u.value) <> 'NULL'
)"""

SQL = {
    "p6_found": f"WITH {_CHILDREN} SELECT DISTINCT src_table, record_id, child, CAST(child_key AS VARCHAR) AS child_key FROM al",
    "p6_tables": f"""WITH {_CHILDREN}, d AS (SELECT DISTINCT src_table, record_id, child, CAST(child_key AS VARCHAR) AS child_key FROM al),
      l AS (SELECT c.src_table, c.child, count(*) AS n_linked FROM d c JOIN d p ON p.src_table = c.src_table AND p.record_id = c.record_id AND p.child = CASE c.child WHEN 'bands' THEN 'rules' ELSE 'bands' END
            AND c.child IN ('bands', 'band_values', 'band_ranges') AND p.child_key = regexp_replace(c.child_key, '/[0-9]+$', '') GROUP BY 1, 2)
      SELECT src_table, child, count(*) AS n_rows, count(DISTINCT record_id) AS n_records, coalesce(max(n_linked), 0) AS n_linked FROM d LEFT JOIN l USING (src_table, child) GROUP BY 1, 2""",
    "p1_found": f"WITH {_REFERENCES} SELECT DISTINCT child_table, ref_field, child_key, reason FROM judged WHERE reason IS NOT NULL",
    "p1_counts": f"WITH {_REFERENCES} SELECT child_table, ref_field, date_trunc('month', t) AS period, reason, count(*) AS n_references FROM judged WHERE reason IS NOT NULL GROUP BY ALL",
    "p5_found": f"WITH {_SNAPSHOTS} SELECT case_id, id AS audit_id FROM v WHERE opens",
    "p5_ledger": f"WITH {_LEDGER} SELECT * FROM led",
    "p5_believed": f"WITH {_LEDGER} SELECT case_id, count(*) AS n_rows, count(recorded_to) AS n_superseded FROM led GROUP BY 1",
    "p5_history": f"WITH {_SNAPSHOTS} SELECT case_id, id AS audit_id, at_utc AS valid_from, lead(at_utc) OVER (PARTITION BY case_id ORDER BY at_utc, revision NULLS FIRST, id) AS valid_to FROM v WHERE opens",
}
