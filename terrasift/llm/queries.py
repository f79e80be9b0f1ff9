"""Queries of the text problems and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasift.llm.address import Gazetteer, place_pairs, places
from terrasift.llm.encode import encode, tokenizer_path
from terrasift.llm.packing import pack
from terrasift.llm.personal import personal_items, redacted
from terrasift.llm.spans import shared_share, shared_spans
from terrasift.llm.visual import letter_bigrams, normalize_text, quotes_in_form
from terrasift.plans.dealt import snapshot_fields
from terrasift.sources.tables import table

CAPACITY = 4096


def personal_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Texts that may hold personal items: pages and subject addresses."""
    pages = source_pages(spark, folder).select(F.lit("pages").alias("field"), F.col("document_id").alias("record_id"), "page", "text")
    cases = snapshot_fields(table(spark, folder, "cases"), ["id"], "body", ("subject_address",))
    both = pages.unionByName(cases.select(F.lit("subject_address").alias("field"), F.col("id").alias("record_id"), F.lit(0).alias("page"), F.col("subject_address").alias("text")))
    return both.where("text is not null").select(F.struct("field", "record_id", "page", F.xxhash64("text").alias("h")).alias("unit"), "text")


def _personal(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    texts = personal_texts(spark, folder)
    items = personal_items(texts, Gazetteer.collect(table(spark, folder, "place_names"), roads=True))
    return texts, items.where("not (unit.field = 'subject_address' and kind = 'street_address')")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    _, items = _personal(spark, folder)
    return items.select("unit.field", "unit.record_id", "unit.page", "kind", "found").distinct()


def p2_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """The texts with typed placeholders."""
    texts, items = _personal(spark, folder)
    return redacted(texts, items).select("unit.field", "unit.record_id", "unit.page", "text")


def address_records(spark: SparkSession, folder: str) -> DataFrame:
    """Address records: both addresses of every case and that of every facility."""
    cases = snapshot_fields(table(spark, folder, "cases"), ["id"], "body", ("subject_address", "comparable_address"))
    facilities = table(spark, folder, "facilities")
    side = lambda name: F.struct(F.concat(F.lit("case:"), F.col("id"), F.lit(f":{name}")).alias("record"), F.col(f"{name}_address").alias("address"))
    return (
        cases.select(F.inline(F.array(side("subject"), side("comparable"))))
        .unionByName(facilities.select(F.concat(F.lit("facility:"), F.col("facility_id").cast("string")).alias("record"), "address"))
    )


def p3_places(spark: SparkSession, folder: str) -> DataFrame:
    """Every address record with the place it denotes."""
    return places(address_records(spark, folder), F.col("record"), F.col("address"), table(spark, folder, "place_names"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return place_pairs(p3_places(spark, folder))


def source_pages(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "source_documents")
    return docs.select(F.col("id").alias("document_id"), F.explode("pages").alias("p")).select("document_id", "p.page", "p.text")


def _quotes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pdf_drafts").select(F.col("draft_id").alias("quote_id"), "document_id", F.col("evidence.page").alias("page"), F.col("evidence.quote").alias("quote"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    pages, quotes = source_pages(spark, folder), _quotes(spark, folder)
    scores = letter_bigrams([pages.select("text"), quotes.select("quote")])
    return quotes_in_form(quotes, pages, scores).withColumnRenamed("quote_id", "draft_id")


def p4_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The text of every page in the common form."""
    pages = source_pages(spark, folder).distinct()
    return normalize_text(pages, F.col("text"), letter_bigrams([pages.select("text")])).drop("text")


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return encode(docs, F.col("doc_id"), F.col("text"), tokenizer_path("byte_bpe_50k.tiktoken")).withColumnRenamed("key", "doc_id")


def p8_packed(spark: SparkSession, folder: str) -> DataFrame:
    """Every document (or part of one) with its container."""
    docs = table(spark, folder, "documents")
    sizes = encode(docs, F.col("doc_id"), F.col("text"), tokenizer_path("byte_bpe_50k.tiktoken"), counts_only=True)
    return pack(sizes, F.col("key"), F.col("n_tokens"), CAPACITY).withColumnsRenamed({"key": "doc_id", "n": "n_tokens"})


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that the packing had to split."""
    return p8_packed(spark, folder).where("part = 1").select("doc_id")


def p8_use(spark: SparkSession, folder: str) -> DataFrame:
    """Containers, tokens and the share of the space that is used."""
    boxes = p8_packed(spark, folder).where("container is not null").groupBy("container").agg(F.sum("n_tokens").alias("n"))
    return boxes.agg(F.count("*").alias("containers"), F.sum("n").alias("tokens"), F.max("n").alias("fullest"), (F.sum("n") / (F.count("*") * CAPACITY)).alias("used"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return shared_spans(docs, F.col("doc_id"), F.col("text")).withColumnRenamed("id", "doc_id")


def p9_shared(spark: SparkSession, folder: str) -> DataFrame:
    """How much of each mail also stands in another."""
    docs = table(spark, folder, "documents")
    return shared_share(shared_spans(docs, F.col("doc_id"), F.col("text")), docs, F.col("doc_id"), F.col("text")).withColumnRenamed("id", "doc_id")


QUERIES = {f.__name__: f for f in (p2_found, p2_redacted, p3_found, p3_places, p4_found, p4_pages, p7_ids, p8_found, p8_packed, p8_use, p9_found, p9_shared)}
# every window of 200 characters of every text, grouped by its digest
_SPANS = """w AS (SELECT doc_id, i, md5(substr(text, i + 1, 200)) AS h FROM (SELECT doc_id, text, unnest(range(0, length(text) - 199)) AS i FROM documents WHERE length(text) >= 200)),
  s AS (SELECT h FROM w GROUP BY h HAVING count(DISTINCT doc_id) > 1),
  c AS (SELECT DISTINCT doc_id, i FROM w JOIN s USING (h)),
  g AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS n FROM c),
  r AS (SELECT doc_id, i, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM g),
  sp AS (SELECT doc_id, min(i) AS span_start, max(i) + 200 AS span_end FROM r GROUP BY doc_id, k)"""

SQL: dict[str, str] = {
    "p9_found": f"WITH {_SPANS} SELECT doc_id, span_start, span_end FROM sp",
    "p9_shared": f"""WITH {_SPANS}, t AS (SELECT doc_id, CAST(sum(span_end - span_start) AS BIGINT) AS n FROM sp GROUP BY 1)
      SELECT doc_id, CAST(coalesce(length(text), 0) AS BIGINT) AS n_chars, coalesce(n, 0) AS shared_chars, CASE WHEN length(text) > 0 THEN round(coalesce(n, 0) / length(text), 6) END AS share FROM documents LEFT JOIN t USING (doc_id)""",
}
