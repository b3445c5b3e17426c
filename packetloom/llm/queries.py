"""Queries of the problems tagged llm, over their whole tables."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm import canonical_values, lookalikes, mixing, name_variants, personal_information, scan_repair, survivors, tokens
from packetloom.operators.packed_values import unpack
from packetloom.plans.problems import packed_rows
from packetloom.session import materialize, table

SURVIVOR_FIELDS = ["patient_name", "dob", "authorization_number", "va_icn", "ordering_provider", "referring_provider", "diagnosis_text", "forms_text"]


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["case_key", "id", "analyzed_at", "packet_confidence", *SURVIVOR_FIELDS]
    return table(spark, sf_dir, "packet_runs", columns).where("case_key <> 'unknown_case'")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run of each case that no other run of the case exceeds in any measure."""
    rows = survivors.measured(_cases(spark, sf_dir), "case_key", "id", "analyzed_at", "packet_confidence", SURVIVOR_FIELDS)
    several = survivors.dominating(rows, len(SURVIVOR_FIELDS))
    return several.where("records >= 2").select(F.col("key").alias("case_key"), F.col("record").alias("id"))


def p6_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One surviving run per case, its missing fields filled from the following dominance layers."""
    return survivors.survivor(_cases(spark, sf_dir), "case_key", "id", "analyzed_at", "packet_confidence", SURVIVOR_FIELDS).withColumnsRenamed({"key": "case_key", "record": "id"})


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k, without special tokens."""
    return tokens.encode_corpus(table(spark, sf_dir, "documents", ["doc_id", "text"]))


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sized = table(spark, sf_dir, "documents", ["doc_id", "source", "text"]).select("doc_id", "source", tokens.token_counts(F.col("text")).alias("n_tokens"))
    return mixing.mix(materialize(sized, "mix-sizes"), table(spark, sf_dir, "mix_targets"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen documents, and how often each is used."""
    return _mixed(spark, sf_dir)[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted and reached tokens and shares of each listed source."""
    return _mixed(spark, sf_dir)[1]


def p10_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text in its one consistent form."""
    return lookalikes.canonical(table(spark, sf_dir, "documents", ["doc_id", "text"])).select("doc_id", "canonical", "main")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that look the same but are not the same string."""
    return lookalikes.alike_pairs(lookalikes.canonical(table(spark, sf_dir, "documents", ["doc_id", "text"])))


def p1_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of diagnosis_text and icd_codes with the canonical entry it means, or UNMATCHED."""
    values = materialize(unpack(packed_rows(spark, sf_dir, ("diagnosis_text", "icd_codes"))), "canonical-values")
    mapped = canonical_values.map_values(values.select("value"), table(spark, sf_dir, "diagnosis_ref"))
    return values.withColumn("trimmed", F.trim("value")).join(mapped.withColumnRenamed("value", "trimmed"), "trimmed").select("field", "row_key", "pos", "value", "ref_code")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values that are not already written as a name or code of the list."""
    ref = table(spark, sf_dir, "diagnosis_ref")
    written = ref.select(F.lower(F.trim("ref_name")).alias("as_written")).union(ref.select(F.lower(F.trim("ref_code")))).distinct()
    return (
        p1_mapped(spark, sf_dir)
        .withColumn("as_written", F.lower(F.trim("value")))
        .join(written, "as_written", "left_anti")
        .select("field", "row_key", "pos", "ref_code")
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different strings that name the same provider, or the same patient of one birth date."""
    runs = table(spark, sf_dir, "packet_runs", ["file_name", "provider_name", "ordering_provider", "referring_provider", "patient_name", "dob"])
    provider = [F.struct(F.lit("provider").alias("kind"), F.lit("").alias("block"), F.col(c).alias("name"), F.concat(F.lit(f"{c}|"), "file_name").alias("place")) for c in ("provider_name", "ordering_provider", "referring_provider")]
    patient = F.struct(F.lit("patient").alias("kind"), F.col("dob").alias("block"), F.col("patient_name").alias("name"), F.concat(F.lit("patient|"), "dob").alias("place"))
    said = runs.select(F.explode(F.array(*provider, patient)).alias("x")).select("x.*").where("name IS NOT NULL AND block IS NOT NULL").groupBy("kind", "block", "name", "place").agg(F.count(F.lit(1)).alias("n"))
    said = materialize(said, "names-said")
    names = said.groupBy("kind", "block", "name").agg(F.sum("n").alias("n"))
    return name_variants.variant_pairs(names, said.where("place IS NOT NULL")).select(F.col("kind").alias("name_kind"), F.col("block").alias("dob"), "name_a", "name_b")


def _personal_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field, row_key, texts) of all free texts; rows repeated whole count once."""
    runs = table(spark, sf_dir, "packet_runs", ["id", "diagnosis_text", "fields_json"])
    fields = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in ("diagnosis_text", "fields_json")]))
    of_runs = runs.select(F.col("id").cast("string").alias("row_key"), fields.alias("x")).where("x.text IS NOT NULL").select("x.field", "row_key", F.array("x.text").alias("texts"))
    pages = table(spark, sf_dir, "packet", ["packet_id", "pages"]).select(F.lit("pages").alias("field"), F.col("packet_id").alias("row_key"), F.col("pages").alias("texts"))
    return pages.unionByName(of_runs)


def _name_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["patient_name", "provider_name", "ordering_provider", "referring_provider"]
    return table(spark, sf_dir, "packet_runs", columns).select(F.explode(F.array(*columns)).alias("name")).where("name IS NOT NULL").distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every mention of personal information in pages, diagnoses and free-text members of JSON."""
    return personal_information.find_mentions(_personal_texts(spark, sf_dir), _name_columns(spark, sf_dir))


_session_keys: dict[str, str] = {}


def redaction_key(spark: SparkSession) -> str:
    """`packetloom.redaction.key` of the session; where it is unset, a secret drawn anew for each application."""
    return spark.conf.get("packetloom.redaction.key", None) or _session_keys.setdefault(spark.sparkContext.applicationId, secrets.token_hex(16))


def p5_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with a typed stand-in in place of each mention."""
    return personal_information.redact(_personal_texts(spark, sf_dir).distinct(), redaction_key(spark), _name_columns(spark, sf_dir))


def _scans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pages of every packet, and the mean OCR confidence of its runs."""
    packets = table(spark, sf_dir, "packet", ["packet_id", "file_name", "pages"])
    read = table(spark, sf_dir, "packet_runs", ["id", "file_name", "ocr_confidence"]).where("file_name IS NOT NULL AND ocr_confidence IS NOT NULL").distinct()
    confidence = packets.select("packet_id", "file_name").join(read.groupBy("file_name").agg(F.avg("ocr_confidence").alias("ocr_confidence")), "file_name")
    return packets.select("packet_id", "pages"), confidence


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Furniture lines, broken words and misread words of every page, with their repair."""
    return scan_repair.repairs(*_scans(spark, sf_dir)).select("packet_id", "page_index", "line_no", "kind", "fixed").distinct()


def p7_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as continuous paragraphs."""
    return scan_repair.repaired_pages(*_scans(spark, sf_dir))
