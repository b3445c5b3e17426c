"""Queries over the pages of packets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.functions import fields as fx
from packetloom.operators import duplicate_pages, extraction, page_fields, page_metadata, page_rules, page_types
from packetloom.operators.page_order import page_dates, page_order_of
from packetloom.session import materialize, table


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(packet_id, page_index, text); null pages stay, packets without pages have no row."""
    return table(spark, sf_dir, "packet", ["packet_id", "pages"]).select("packet_id", F.posexplode("pages").alias("page_index", "text"))


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_metadata.summaries(table(spark, sf_dir, "packet_runs", ["id", "file_name", "analyzed_at", "intel_summary_json"]))


def described_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with its reading confidence, engines and zones, written once."""
    files = table(spark, sf_dir, "packet", ["packet_id", "file_name"])
    return materialize(page_metadata.described(pages(spark, sf_dir), files, _reports(spark, sf_dir)), "described-pages")


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(page_types.fill_context(page_types.classify(described_pages(spark, sf_dir))), "typed-pages")


def page_types_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _typed(spark, sf_dir).drop("normal")


def document_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_types.spans(_typed(spark, sf_dir))


def page_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence, engines and zones of every page that a report tells of."""
    return described_pages(spark, sf_dir).where("segments > 0 OR read IS NOT NULL").select("packet_id", "page_index", "read", "segments", F.array_join("engines", ",").alias("engines"), F.array_join("zones", ",").alias("zones"), "zone_confidence")


def intake_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_metadata.intake(described_pages(spark, sf_dir))


def layout_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_metadata.layout_summary(described_pages(spark, sf_dir))


def reading_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_metadata.reading_candidates(described_pages(spark, sf_dir))


def retry_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why packets should be read again: authorization missing, few types, sparse pages."""
    described = described_pages(spark, sf_dir)
    types = materialize(page_types.classify(described), "typed-pages").where("doc_type <> 'unknown'").groupBy("packet_id").agg(F.countDistinct("doc_type").alias("document_types"))
    return page_metadata.retry_reasons(described, page_fields.authorizations(described), types)


def source_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the captured values of every packet are traced to pages."""
    return page_metadata.lineage(field_observations(spark, sf_dir), table(spark, sf_dir, "packet", ["packet_id"]))


def type_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, spans, confidence and reliability of every page type in every packet."""
    described = described_pages(spark, sf_dir)
    typed = materialize(page_types.fill_context(page_types.classify(described)), "typed-pages")
    return page_types.confidence_model(typed, described.select("packet_id", "page_index", "read"), duplicate_pages.exact_groups(typed))


def page_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recommended order of the pages of every packet."""
    typed = _typed(spark, sf_dir).select("packet_id", "page_index", "doc_type")
    return page_order_of(typed.join(page_dates(pages(spark, sf_dir)), ["packet_id", "page_index"], "left"))


def detected_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types found in every packet against the types listed with it."""
    found = _typed(spark, sf_dir).where("doc_type <> 'unknown'").groupBy("packet_id").agg(F.array_sort(F.collect_set("doc_type")).alias("found"))
    listed = table(spark, sf_dir, "packet", ["packet_id", "detected_documents"])
    none = F.array().cast("array<string>")
    both = listed.join(found, "packet_id", "left").select("packet_id", F.coalesce("detected_documents", none).alias("listed"), F.coalesce("found", none).alias("found"))
    return both.select("packet_id", F.size("listed").alias("listed"), F.size("found").alias("found"), F.size(F.array_intersect("listed", "found")).alias("agreed"), F.array_join(F.array_sort(F.array_except("listed", "found")), ",").alias("missing"))


def exact_duplicate_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_pages.exact_groups(_typed(spark, sf_dir))


def near_duplicate_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_pages.near_groups(_typed(spark, sf_dir))


def page_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_fields.page_measures(pages(spark, sf_dir))


def sparse_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse pages of every packet, and whether they are half of its pages or more."""
    m = page_measures(spark, sf_dir).groupBy("packet_id").agg(F.count(F.lit(1)).alias("pages"), F.sum(F.col("sparse").cast("bigint")).alias("sparse_pages"))
    return m.withColumn("half_sparse", F.col("sparse_pages") / F.col("pages") >= 0.5)


def field_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_fields.observations(pages(spark, sf_dir))


def selected_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_fields.selected(field_observations(spark, sf_dir))


def packet_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_fields.pivoted(selected_fields(spark, sf_dir))


def field_redundancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_fields.redundancy(field_observations(spark, sf_dir))


def page_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of every page: of its code lines, else of all its text, with those its diagnoses imply."""
    return pages(spark, sf_dir).where("text IS NOT NULL").select("packet_id", "page_index", F.explode(extraction.page_codes(F.col("text"))).alias("code"))


def packet_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code list that every packet keeps; pages with a code line are surer."""
    told = F.col("text").rlike(extraction.CODE_LINE)
    per_page = pages(spark, sf_dir).where("text IS NOT NULL").select("packet_id", "page_index", extraction.page_codes(F.col("text")).alias("codes"), F.when(told, 0.95).otherwise(0.75).alias("confidence"))
    return extraction.richest_codes(per_page)


def listed_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes on pages that are on the canonical list: the allow-list join."""
    ref = table(spark, sf_dir, "diagnosis_ref", ["ref_code"]).withColumnRenamed("ref_code", "code")
    return page_codes(spark, sf_dir).join(ref, "code", "left_semi").groupBy("code").agg(F.count(F.lit(1)).alias("pages"), F.countDistinct("packet_id").alias("packets"))


def inferred_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.findings(pages(spark, sf_dir))


def page_authorizations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_fields.authorizations(pages(spark, sf_dir))


def section_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles that the lines of every page tell; see `extraction.section_roles` for those a page type implies."""
    untyped = pages(spark, sf_dir).withColumn("doc_type", F.lit("unknown"))
    return extraction.section_roles(untyped).groupBy("packet_id", "page_index", "role").agg(F.count(F.lit(1)).alias("headings"))


def page_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leading role of every page, told or implied by its type."""
    typed = pages(spark, sf_dir).join(_typed(spark, sf_dir).select("packet_id", "page_index", "doc_type"), ["packet_id", "page_index"])
    roles = extraction.section_roles(typed).groupBy("packet_id", "page_index").agg(F.collect_set("role").alias("roles"), F.sum(F.col("inferred").cast("bigint")).alias("inferred"))
    return roles.select("packet_id", "page_index", extraction.leading_role(F.col("roles")).alias("role"), F.size("roles").alias("roles"), "inferred")


#: Anchors of concepts (fixed values).
CONCEPTS = {"reason": r"\breason for (?:request|referral|consultation)\b", "necessity": r"\bmedical necessity\b", "assessment": r"\bassessment\b", "impression": r"\bimpression\b", "history": r"\bhistory of present illness\b"}


def concept_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands behind or below the anchors of concepts, cut at the next label."""
    found = extraction.concept_windows(pages(spark, sf_dir), CONCEPTS)
    return found.withColumn("value", extraction.cut_at_label(F.col("value"))).where("value <> ''")


def cut_diagnoses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagnosis values of every page up to the label that follows."""
    lines = F.regexp_extract_all("text", F.lit(r"(?i)\bdiagnosis: *([^\n\r]+)"), F.lit(1))
    values = pages(spark, sf_dir).where("text IS NOT NULL").select("packet_id", "page_index", F.posexplode(lines).alias("n", "value"))
    return values.select("packet_id", "page_index", "n", extraction.cut_at_label(F.col("value")).alias("value"))


def suspect_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured values that hardly belong to their field, and why."""
    seen = field_observations(spark, sf_dir)
    return seen.withColumn("reason", extraction.suspect_reason(F.col("field"), F.col("value"), F.col("snippet"))).where("reason IS NOT NULL").select("packet_id", "page_index", "line_no", "field", "value", "reason")


def form_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms that every page mentions by their plain names."""
    return pages(spark, sf_dir).select("packet_id", "page_index", F.explode(page_rules.forms(F.col("text"))).alias("form"))


def packet_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind of every packet by the first pattern its text has."""
    return table(spark, sf_dir, "packet", ["packet_id", "pages"]).select("packet_id", page_rules.packet_kind(F.coalesce(F.array_join("pages", "\n"), F.lit(""))).alias("kind"))


def unfilled_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that are the empty form of their type."""
    typed = pages(spark, sf_dir).join(_typed(spark, sf_dir).select("packet_id", "page_index", "doc_type"), ["packet_id", "page_index"])
    return typed.where(page_rules.unfilled(F.col("doc_type"), F.col("text"))).select("packet_id", "page_index", "doc_type")


def layout_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_rules.layout_marks(pages(spark, sf_dir))


def plain_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_rules.plain_fields(pages(spark, sf_dir))


def signed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).groupBy("packet_id").agg(F.sum(page_fields.signature_present(F.col("text")).cast("bigint")).alias("signed_pages"))


def masked_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event notes as they may stand in a log."""
    return table(spark, sf_dir, "packet_events", ["id", "note"]).dropDuplicates(["id"]).where("note IS NOT NULL").select("id", fx.masked(F.col("note")).alias("note"))


#: SQL counterparts are in `pages_sql`.
QUERIES = {
    "page_types": page_types_of,
    **{f.__name__: f for f in (
        document_spans, detected_documents, exact_duplicate_pages, near_duplicate_pages, page_measures, sparse_packets, retry_reasons, field_observations, selected_fields, packet_fields, field_redundancy, page_codes, packet_codes, listed_codes, signed_pages, masked_notes,
        page_summaries, intake_diagnostics, layout_summary, reading_candidates, source_lineage, type_confidence, page_order, inferred_findings, page_authorizations, section_roles, page_roles, concept_values, cut_diagnoses, suspect_values, form_mentions, packet_kinds, unfilled_forms, plain_fields, layout_marks,
    )},
}
