"""Queries of the general data problems: orphans, history, nesting."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasift.functions.dates import parse_date
from terrasift.operators.history import as_recorded, ledger, openings, versions
from terrasift.operators.nested import parent_label, read_json, shred
from terrasift.operators.orphans import Reference, orphan_counts, orphans
from terrasift.session import cut_lineage
from terrasift.sources.tables import table

HEADER = ("case_number", "valuation_date", "locality", "land_use", "ruleset_id", "document_id")


def _references(spark: SparkSession, folder: str) -> list[Reference]:
    audit, evidence = table(spark, folder, "audit"), table(spark, folder, "evidence_documents")
    at = F.col("indexed_at")
    return [
        Reference("audit", "case_id", audit, F.col("id"), F.col("case_id"), F.col("at_utc"), table(spark, folder, "cases"), F.col("id"), F.col("created"), F.col("removed_at")),
        Reference("evidence_documents", "document_id", evidence, F.col("document_id"), F.col("document_id"), at, table(spark, folder, "source_documents"), F.col("id"), F.col("received_at"), F.col("removed_at")),
        Reference("evidence_documents", "ruleset_id", evidence, F.col("document_id"), F.col("ruleset_id"), at, table(spark, folder, "rulesets"), F.col("id"), F.col("published_at"), F.col("removed_at")),
    ]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    first, *rest = [orphans(r) for r in _references(spark, folder)]
    for x in rest:
        first = first.unionByName(x)
    return first


def p1_counts(spark: SparkSession, folder: str) -> DataFrame:
    first, *rest = [orphan_counts(r) for r in _references(spark, folder)]
    for x in rest:
        first = first.unionByName(x)
    return first


def snapshot_fields(df: DataFrame, keep: list[str], body: str, fields: tuple[str, ...]) -> DataFrame:
    """``keep`` and the text of top-level ``fields`` of complete JSON objects; other rows are left out."""
    schema = df.select(*keep).schema

    def text(v) -> str | None:
        return None if v is None or v == "" else v if isinstance(v, str) else str(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies, at, got = batch.column(len(keep)).to_pylist(), [], [[] for _ in fields]
            for i, b in enumerate(bodies):
                value = read_json(b)
                if isinstance(value, dict):
                    at.append(i)
                    for col, f in zip(got, fields):
                        col.append(text(value.get(f)))
            kept = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns[: len(keep)], *[pa.array(c, pa.string()) for c in got]], [*keep, *fields])

    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields), *(f"`{f}` string" for f in fields)])
    return df.where(f"{body} is not null").select(*keep, body).mapInArrow(run, ddl)


def audit_ledger(spark: SparkSession, folder: str, *keep: str) -> DataFrame:
    """The ledger of the case headers with the attributes to ``keep``; a change of any of them counts."""
    rows = snapshot_fields(table(spark, folder, "audit"), ["id", "case_id", "at_utc"], "snapshot", ("revision", *HEADER))
    attributes: dict[str, Column] = {k: F.col(k) for k in HEADER}
    attributes["valuation_date"] = F.coalesce(parse_date(F.col("valuation_date")).cast("string"), F.col("valuation_date"))
    return ledger(rows, F.col("case_id"), F.col("at_utc"), F.col("id"), attributes, F.col("revision").try_cast("double").try_cast("long"), keep=list(keep))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return openings(as_recorded(audit_ledger(spark, folder))).select(F.col("entity").alias("case_id"), F.col("observation").alias("audit_id"))


def p5_history(spark: SparkSession, folder: str) -> DataFrame:
    """Every version with the moment it begins and the moment the next replaces it."""
    return versions(audit_ledger(spark, folder)).select(F.col("entity").alias("case_id"), F.col("observation").alias("audit_id"), "valid_from", "valid_to")


def p5_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Every interval that was ever believed, with the time it held and the arrivals between which it was believed."""
    led = audit_ledger(spark, folder, "ruleset_id", "document_id")
    return led.select(F.col("entity").alias("case_id"), "observation", "valid_from", "valid_to", "closed_by", "recorded_from", "recorded_to", "ruleset_id", "document_id")


def p5_believed(spark: SparkSession, folder: str) -> DataFrame:
    """Per case, the rows of the ledger and how many of them later arrivals superseded."""
    led = audit_ledger(spark, folder)
    return led.groupBy(F.col("entity").alias("case_id")).agg(F.count("*").alias("n_rows"), F.count("recorded_to").alias("n_superseded"))


LISTS = ("factors", "field_sources", "extraction_warnings", "rules", "rules/*/bands", "rules/*/bands/*/values", "rules/*/bands/*/ranges")
CHILDREN = {
    "factors": "factors/*", "field_sources": "field_sources/*", "extraction_warnings": "extraction_warnings/*", "rules": "rules/*", "total_evidence": "total_evidence/*",
    "bands": "rules/*/bands/*", "band_values": "rules/*/bands/*/values/*", "band_ranges": "rules/*/bands/*/ranges/*",
}


def child_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled child elements of cases, audit snapshots and rulesets."""
    parts = []
    for name, body, children in (
        ("cases", "body", ("factors", "field_sources", "extraction_warnings", "total_evidence")),
        ("audit", "snapshot", ("factors", "field_sources", "extraction_warnings", "total_evidence")),
        ("rulesets", "body", ("rules", "bands", "band_values", "band_ranges")),
    ):
        nodes = shred(table(spark, folder, name), F.col("id"), F.col(body), [CHILDREN[c] for c in children], LISTS)
        parts.append(nodes.withColumn("src_table", F.lit(name)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _child(schema_path: Column) -> Column:
    out = F.when(schema_path.startswith("total_evidence/") & ~schema_path.startswith("total_evidence/*"), "total_evidence")
    for child, path in CHILDREN.items():
        out = out if child == "total_evidence" else out.when(schema_path == path, child)
    return out


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    nodes = child_nodes(spark, folder).withColumn("child", _child(F.col("schema_path"))).where("child is not null")
    steps = F.regexp_replace(F.regexp_replace("label", r"^(factors|field_sources|extraction_warnings|rules|total_evidence)/", ""), r"/(bands|values|ranges)/", "/")
    key = F.when(F.col("child") == "total_evidence", F.replace(F.replace(F.substring("label", 16, 1 << 30), F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))).otherwise(steps)
    return nodes.select("src_table", "record_id", "child", key.alias("child_key")).distinct()


def p6_tables(spark: SparkSession, folder: str) -> DataFrame:
    """The children as flat tables, one a schema path, counted with the rows that find their parent there.

    A parent is the label cut at its end; every child but those of the record itself
    has its parent as a row of another table.
    """
    nodes = child_nodes(spark, folder).withColumn("child", _child(F.col("schema_path"))).where("child is not null").select("src_table", "record_id", "child", "label", parent_label(F.col("label")).alias("parent")).distinct()
    nodes = cut_lineage(nodes)  # used twice
    inner = nodes.where("child in ('bands', 'band_values', 'band_ranges')").withColumn("parent", F.regexp_replace("parent", "/(bands|values|ranges)$", ""))
    there = inner.join(nodes.select("src_table", "record_id", F.col("label").alias("parent")), ["src_table", "record_id", "parent"], "left_semi")
    linked = there.groupBy("src_table", "child").agg(F.count("*").alias("n_linked"))
    tables = nodes.groupBy("src_table", "child").agg(F.count("*").alias("n_rows"), F.countDistinct("record_id").alias("n_records"))
    return tables.join(linked, ["src_table", "child"], "left").fillna(0, ["n_linked"])


QUERIES = {f.__name__: f for f in (p1_found, p1_counts, p5_found, p5_history, p5_ledger, p5_believed, p6_found, p6_tables)}
