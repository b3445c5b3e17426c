"""Labelled fields of pages: observations with their place, one selected value per packet and field.

A field is a label at the beginning of a line and what follows it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.operators.extraction import ROLES, confidence

#: Labels of fields (fixed values): field -> what stands before its value.
LABELS = {
    "name": r"(?:patient name|veteran name|full name|veteran|patient|name)",
    "dob": r"(?:date of birth|birth date|dob|d\.o\.b\.)",
    "authorization_number": r"(?:authorization number|auth number|referral number)",
    "va_icn": r"(?:va icn|icn|integrated control number)",
    "ordering_provider": r"(?:ordering provider|ordering physician|ordered by|requested by)",
    "referring_provider": r"(?:referring provider|referred by)",
    "diagnosis": r"(?:diagnosis|assessment|clinical impression|impression)",
    "provider": r"(?:rendering provider|treating provider|provider name|provider)",
    "clinic_name": r"(?:clinic name|practice name|office name|submitting office)",
    "npi": r"(?:npi)",
    "reason_for_request": r"(?:reason for (?:request|referral|consultation)|chief complaint|requested service|requested procedure)",
    "signed_by": r"(?:signed by|electronically signed by)",
}

PEOPLE = ("ordering_provider", "referring_provider", "provider", "signed_by")


def lines(pages: DataFrame) -> DataFrame:
    """(packet_id, page_index, line_no, line) of pages(packet_id, page_index, text)."""
    return pages.where("text IS NOT NULL").select("packet_id", "page_index", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1).where("trim(line) <> ''")


def _value(field: str, line: Column) -> Column:
    raw = F.trim(F.regexp_extract(line, rf"(?i)(?:^|\s{{3,}})\s*(?:\d{{1,2}}\.\s+)?{LABELS[field]}\s*(?::|\s-\s)\s*(.+?)\s*$", 1))
    if field in PEOPLE:
        raw = F.regexp_replace(F.regexp_replace(raw, r"(?i)^dr\.?\s+", ""), r"(?i),?\s+(?:md|do|np|pa-c|pa|dpt)\.?$", "")
    if field == "dob":
        raw = F.regexp_extract(raw, r"(\d{1,2}/\d{1,2}/\d{4})", 1)
    return F.when(raw != "", raw)


def observations(pages: DataFrame) -> DataFrame:
    """(packet_id, page_index, line_no, field, value, role, confidence, at, snippet) of every labelled line.

    `role` is the leading role of the page, `at` the place of the value in its text (from 1), `snippet` the
    value with up to 80 characters on either side. Page texts travel with their labelled lines only as
    far as the snippet is cut, never through a shuffle.
    """
    found = F.array(*[F.struct(F.lit(f).alias("field"), _value(f, F.col("line")).alias("value")) for f in LABELS])
    marked = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("line"))), lambda x: x["line"].rlike(r"(?::|\s-\s)"))
    role = F.coalesce(*[F.when(F.col("text").rlike(rf"(?i)\b(?:{'|'.join(words)})\b"), F.lit(r)) for r, words in ROLES.items()])
    per_line = pages.where("text IS NOT NULL").select("packet_id", "page_index", "text", role.alias("role"), F.explode(marked).alias("m")).select("packet_id", "page_index", "text", "role", "m.*")
    long = per_line.select("packet_id", "page_index", "line_no", "text", "role", F.explode(F.filter(found, lambda x: x["value"].isNotNull())).alias("x"))
    sure = confidence(F.col("x.field"), F.col("x.value"), F.lower("text"), F.lit(True), F.lit(None).cast("double"), F.lit(None).cast("double"), F.col("role"))
    at = F.expr("locate(x.value, text)")
    begin = F.greatest(F.lit(1), at - 80)
    snippet = F.substring("text", begin, at - begin + F.length("x.value") + 80)
    return long.select("packet_id", "page_index", "line_no", "x.field", "x.value", "role", sure.alias("confidence"), at.alias("at"), F.trim(F.regexp_replace(snippet, r"\s+", " ")).alias("snippet"))


def selected(observed: DataFrame) -> DataFrame:
    """The value of every packet and field with the highest confidence; the last page, then the last line, wins ties."""
    w = Window.partitionBy("packet_id", "field").orderBy(F.desc("confidence"), F.desc("page_index"), F.desc("line_no"))
    return observed.withColumn("n", F.row_number().over(w)).where("n = 1").select("packet_id", "field", "value", "page_index", "confidence")


def _comparable(field: Column, value: Column) -> Column:
    """Names in one order, identifiers without separators, all in lower case."""
    v = F.lower(value)
    name = F.array_join(F.array_sort(F.filter(F.split(F.regexp_replace(v, r"[^a-z]+", " "), " "), lambda x: F.length(x) > 1)), " ")
    return F.when(field.isin("name", *PEOPLE), name).otherwise(F.regexp_replace(v, r"[^a-z0-9]", ""))


def redundancy(observed: DataFrame) -> DataFrame:
    """Captured and distinct values of every packet and field; more than one distinct value is a conflict."""
    t = observed.withColumn("same", _comparable(F.col("field"), F.col("value")))
    return t.groupBy("packet_id", "field").agg(F.count(F.lit(1)).alias("captured"), F.countDistinct("same").alias("distinct_values")).withColumn("conflict", F.col("distinct_values") > 1)


#: What tells an authorization, the surest first (fixed values).
AUTHORIZATIONS = (
    (r"(?i)\bauth(?:orization)?(?: number| no\.?| #)?\s*[:#-]\s*(VA\s?[0-9]{6,12})\b", 1),
    (r"(?i)\breferral(?: number| no\.?| #)?\s*[:#-]\s*(VA\s?[0-9]{6,12})\b", 2),
    (r"(?is)\bauthorization\b.{0,140}?\b(VA[0-9]{6,12})\b", 3),
    (r"(?i)\bauth(?:orization)?(?: number| no\.?| #)?\s*[:#-]\s*([A-Z0-9][A-Z0-9-]*[0-9][A-Z0-9-]{3,})", 4),
    (r"\b(VA[0-9]{10})\b", 5),
)


def authorizations(pages: DataFrame) -> DataFrame:
    """(packet_id, page_index, authorization, rank): the surest authorization number of every page that has one."""
    found = [F.nullif(F.regexp_replace(F.upper(F.regexp_extract("text", p, 1)), " ", ""), F.lit("")) for p, _ in AUTHORIZATIONS]
    best = F.coalesce(*[F.when(c.isNotNull(), F.struct(c.alias("authorization"), F.lit(rank).alias("rank"))) for c, (_, rank) in zip(found, AUTHORIZATIONS)])
    return pages.where("text IS NOT NULL").select("packet_id", "page_index", best.alias("x")).where("x IS NOT NULL").select("packet_id", "page_index", "x.*")


def signature_present(text: Column) -> Column:
    return F.coalesce(text.rlike(r"(?i)\b(?:electronically )?signed by\s*:?\s*[A-Za-z]"), F.lit(False))


def page_measures(pages: DataFrame) -> DataFrame:
    """Length, lines and alphanumeric characters of every page, and whether it is sparse."""
    t = F.trim(F.coalesce(F.col("text"), F.lit("")))
    filled = F.size(F.filter(F.split(t, "\n"), lambda x: F.trim(x) != ""))
    alnum = F.length(F.regexp_replace(t, r"[^A-Za-z0-9]", ""))
    sparse = (F.col("n_chars") < 220) | ((F.col("n_lines") <= 4) & (F.col("n_alnum") < 180))
    return pages.select("packet_id", "page_index", F.length(t).alias("n_chars"), filled.alias("n_lines"), alnum.alias("n_alnum")).withColumn("sparse", sparse)


def pivoted(chosen: DataFrame) -> DataFrame:
    """One row per packet with a column per field."""
    return chosen.groupBy("packet_id").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in LABELS])
